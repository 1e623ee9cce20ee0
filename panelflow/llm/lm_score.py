"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

A token is a lower-cased word. Words are counted exactly over the whole corpus; table, classes and network grow with the
number n of different words. Slots of the table are at least 2n (and 2**SLOT_BITS); words that share one share a count.
Classes are about sqrt(n) (and OWN + SHARED at least): three in four belong to one of the most frequent slots each, the
others share the rest by hash. The network, trained in numpy, gives the class of a token from the classes of the two
tokens on either side, in two softmax steps that both look at the context: one of GROUPS groups of classes, then the
class in its group. A token's probability is its class's probability in context times its share of the class's count,
which doesn't depend on the context. A document's score is the sum of the log-probabilities of all its tokens.

Up to 2**TABLE_BITS slots, classes and shares of all slots are broadcast as one table (50 MB). Beyond, only the own classes'
slots, the classes' totals (both about sqrt(n)) and the shares of the HEAD most frequent slots are; what shared class a slot is in follows
from its number, and shares of the rest come by a join of documents' rare slots with the table of counts, added up by document. Scores
are the same either way.

Texts are turned into classes once, into a table that training and scoring read. Training covers all tokens: in each of
`stride` rounds every partition walks over its texts from the shared parameters, predicting every stride-th token (another
phase in each round, so each token is a target once), and the partitions' parameters are averaged by tokens. So parameters
depend on how the table is dealt to tasks, and scores in their last digits on the order of sums.

Edge cases: null and empty texts have no tokens and score 0; contexts beyond either end are a class of their own; words
not counted (none when scoring what was counted) count once; without any token every class is as likely. Whole texts are
scored. Each row gets a result, repeated rows and null ids, too; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import column_words, gather_blocks, materialize, text_bytes

SLOT_BITS = 20
OWN = 96
SHARED = 32
GROUPS = OWN + SHARED
HIDDEN = 24
REACH = 2
STRIDE = 2
_BATCH = 4096
_RANGES = 64
#: Slots of a table that is broadcast whole, and frequent slots that are broadcast where there are more.
TABLE_BITS = 23
HEAD = 1 << 21


@dataclass(frozen=True)
class Vocabulary:
    """class_of, log_share: of each slot, and the class's log of its part of its class's count; None where there are too many slots. Then
    own: the own classes' slots, ascending, and their classes; head: frequent slots, ascending, and logs of their counts; counts: the
    table (slot, n) of all that occur."""

    log_prior: np.ndarray  # of each class
    bits: int
    class_of: np.ndarray | None = None
    log_share: np.ndarray | None = None
    own: tuple[np.ndarray, np.ndarray] | None = None
    head: tuple[np.ndarray, np.ndarray] | None = None
    log_total: np.ndarray | None = None  # of each class
    counts: DataFrame | None = None

    @property
    def code(self) -> np.dtype:
        return np.dtype(np.uint16 if len(self.log_prior) < 1 << 16 else np.int32)

    def look_up(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, log shares, and which of the slots are rare: their shares still lack the log of their counts."""
        if self.class_of is not None:
            return self.class_of[slots], self.log_share[slots], np.zeros(0, np.int64)
        own, shared = len(self.own[0]), len(self.log_prior) - len(self.own[0])
        classes = own + slots % shared
        hit, at = _find(self.own[0], slots)
        classes[hit] = self.own[1][at]
        share = -self.log_total[classes]
        hit, at = _find(self.head[0], slots)
        share[hit] += self.head[1][at]
        return classes.astype(self.code), share, np.flatnonzero(~hit)


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are among the ascending known ones, and where."""
    at = np.searchsorted(known, wanted)
    hit = at < len(known)
    hit[hit] = known[at[hit]] == wanted[hit]
    return hit, at[hit]


@dataclass
class Network:
    context: np.ndarray  # place x (classes and the edge) x hidden
    hidden_bias: np.ndarray
    out: np.ndarray  # hidden x groups
    out_bias: np.ndarray
    fine: np.ndarray  # group x its classes x hidden; class c is number c // groups of group c % groups
    fine_bias: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.hidden_bias, self.out, self.out_bias, self.fine, self.fine_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def of(self, flat: np.ndarray) -> Network:
        """A network of this one's shape."""
        ends = np.cumsum([x.size for x in self.parts()])
        return Network(*[flat[e - x.size : e].reshape(x.shape).astype(np.float32) for x, e in zip(self.parts(), ends, strict=True)])


def count_exactly(documents: DataFrame) -> DataFrame:
    """(range, n, words, counts): the different words, by hash and in order, of each of _RANGES ranges of hashes."""
    columns = "range int, n long, words binary, counts binary"

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        held = 0
        for batch in batches:
            for _, _, h in column_words(batch.column("text")):
                have.append(np.unique(h, return_counts=True))
                held += len(have[-1][0])
                if held > max(len(have[0][0]), 1 << 18):
                    have, held = [merge(have)], 0
        words, counts = merge(have)
        cuts = np.searchsorted(words, np.arange(1, _RANGES, dtype=np.uint64) << np.uint64(64 - _RANGES.bit_length() + 1))
        for k, (w, c) in enumerate(zip(np.split(words, cuts), np.split(counts, cuts), strict=True)):
            if len(w):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(w)], pa.int64()), pa.array([w.tobytes()]), pa.array([c.tobytes()])], ["range", "n", "words", "counts"])

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for pdf in batches:
            for k, w, c in zip(pdf["range"], pdf["words"], pdf["counts"], strict=True):
                mine = have.setdefault(k, [])
                mine.append((np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)))
                if sum(len(x) for x, _ in mine[1:]) > max(len(mine[0][0]), 1 << 18):
                    have[k] = [merge(mine)]
        for k, mine in have.items():
            w, c = merge(mine)
            yield pd.DataFrame({"range": [k], "n": [len(w)], "words": [w.tobytes()], "counts": [c.tobytes()]})

    return materialize(documents.select("text").mapInArrow(count, columns).repartition(_RANGES, "range").mapInPandas(combine, columns), "words")


def table_sizes(n: int) -> tuple[int, int]:
    """Bits of the slot table, and classes in a group, for n different words."""
    return max(SLOT_BITS, (2 * n - 1).bit_length() if n else 0), max(1, -(-math.isqrt(n) // GROUPS))


def count_words(documents: DataFrame) -> Vocabulary:
    found = count_exactly(documents)
    bits, fold = table_sizes(found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    own, shared = OWN * fold, SHARED * fold
    if bits > TABLE_BITS:
        return _count_many(found, bits, own, shared)

    def to_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, w, c in zip(pdf["range"], pdf["words"], pdf["counts"], strict=True):
                size = (1 << bits) // _RANGES
                slots = (np.frombuffer(w, np.uint64) >> np.uint64(64 - bits)).astype(np.int64) - k * size
                table = np.bincount(slots, np.frombuffer(c, np.int64), size).astype(np.int64)
                yield pd.DataFrame({"block": [k], "data": [zlib.compress(table.tobytes(), 1)]}).astype({"block": np.int32})

    counts = gather_blocks(found.select("range", "words", "counts").mapInPandas(to_slots, "block int, data binary"), 1 << bits, "int64", np.add)
    # the most frequent slots, of equals the first ones
    least = np.partition(counts, -own)[-own]
    top = np.concatenate((np.flatnonzero(counts > least), np.flatnonzero(counts == least)))[:own]
    top = top[np.lexsort((top, -counts[top]))]
    class_of = (own + np.arange(1 << bits) % shared).astype(np.uint16 if own + shared < 1 << 16 else np.int32)
    class_of[top] = np.arange(len(top))
    np.maximum(counts, 1, out=counts)
    total = np.bincount(class_of, counts, own + shared)
    log_share = np.log(counts, dtype=np.float32)
    log_share -= np.log(total).astype(np.float32)[class_of]
    return Vocabulary(np.log(total / total.sum()).astype(np.float32), bits, class_of, log_share)


def _count_many(found: DataFrame, bits: int, own: int, shared: int) -> Vocabulary:
    """The same of a table with too many slots for one array: it stays in Spark, and what reaches the driver has about sqrt(n) rows, or HEAD."""

    def to_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, c in zip(pdf["words"], pdf["counts"], strict=True):
                slots = (np.frombuffer(w, np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                new = np.flatnonzero(np.concatenate((np.ones(min(1, len(slots)), bool), slots[1:] != slots[:-1])))
                yield pd.DataFrame({"slot": slots[new], "n": np.add.reduceat(np.frombuffer(c, np.int64), new) if len(new) else []}).astype({"slot": np.int64, "n": np.int64})

    counts = materialize(found.select("words", "counts").mapInPandas(to_slots, "slot long, n long"), "slots")
    top = counts.orderBy(F.col("n").desc(), "slot").limit(own).collect()
    slots, sizes = np.array([r["slot"] for r in top], np.int64), np.array([r["n"] for r in top], np.int64)
    # shared classes: what occurs in each, and a count of one for each slot that doesn't
    sums = counts.groupBy((F.col("slot") % shared).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("used")).collect()
    residue = lambda n: n // shared + (np.arange(shared) < n % shared)
    total = residue(1 << bits).astype(np.float64)
    for r in sums:
        total[r["c"]] += r["n"] - r["used"]
    np.subtract.at(total, slots % shared, sizes)
    total = np.concatenate((sizes, total))
    # frequent slots: from the least count on that HEAD of them have at most
    steps = counts.groupBy("n").agg(F.count("*").alias("slots")).orderBy(F.col("n").desc()).limit(HEAD)
    upto = 0
    least = 2**62
    for r in steps.toLocalIterator():
        upto += r["slots"]
        if upto > HEAD:
            break
        least = r["n"]
    often = counts.where(F.col("n") >= least).toPandas().sort_values("slot")
    order = np.argsort(slots)
    head = often["slot"].to_numpy(np.int64), np.log(often["n"].to_numpy(np.int64), dtype=np.float32)
    return Vocabulary(np.log(total / total.sum()).astype(np.float32), bits, own=(slots[order], order), head=head, log_total=np.log(total).astype(np.float32), counts=counts)


def encode(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, doc_id, share, classes, rare) of every row: its words' classes, the sum of their log shares of them, and the slots whose
    counts are still to be looked up."""
    words = documents.sparkSession.sparkContext.broadcast(replace(vocabulary, counts=None))
    code = vocabulary.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value
        for batch in batches:
            for k, n, h in column_words(batch.column("text")):
                classes_, shares, rare = v.look_up((h >> np.uint64(64 - v.bits)).astype(np.int64))
                of = np.repeat(np.arange(len(n)), n)
                share = np.bincount(of, shares, len(n))
                ends = np.cumsum(n) * code.itemsize
                data = classes_.tobytes()
                classes = [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
                left = [b""] * len(n)
                if len(rare):
                    slots = (h[rare] >> np.uint64(64 - v.bits)).astype(np.int64).tobytes()
                    cuts = (np.searchsorted(of[rare], np.arange(len(n) + 1)) * 8).tolist()
                    left = [slots[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("row")[k : k + len(n)], batch.column("doc_id")[k : k + len(n)], pa.array(share), pa.array(classes, pa.binary()), pa.array(left, pa.binary())], ["row", "doc_id", "share", "classes", "rare"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return materialize(rows.mapInArrow(run, f"row long, doc_id {kind}, share double, classes binary, rare binary"), "classes")


def rare_shares(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, more): the sum of the logs of the counts of each row's rare slots, by a join with the table of counts."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column("rare").to_pylist()], np.int64)
            slots = np.frombuffer(b"".join(batch.column("rare").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("row").to_numpy(), sizes)), pa.array(slots)], ["r", "s"])

    rare = coded.where(F.length("rare") > 0).select("row", "rare").mapInArrow(flat, "r long, s long")
    # no rare slot is frequent, so no key of this join is
    met = rare.join(vocabulary.counts, F.col("s") == F.col("slot"), "left")
    return met.groupBy("r").agg(F.sum(F.log(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).cast("double"))).alias("more"))


def _tokens(column: pa.Array, code: np.dtype, edge: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the texts of a column with `reach` edges around each text, the tokens of each text, and each token's place."""
    raw, start, end = text_bytes(column)
    n = (end - start) // code.itemsize
    place = np.arange(n.sum()) + np.repeat(reach * (2 * np.arange(len(n)) + 1), n)
    padded = np.full(int(n.sum()) + 2 * reach * len(n), edge, np.int32)
    padded[place] = np.frombuffer(raw.tobytes(), code)
    return padded, n, place


def contexts(padded: np.ndarray, at: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The classes around each place: -reach..-1, 1..reach."""
    return np.stack([padded[at + d] for d in (*range(-reach, 0), *range(1, reach + 1))])


def targets(n: np.ndarray, turn: int, stride: int = STRIDE) -> np.ndarray:
    """Which tokens of texts of n tokens each are predicted in a round; over all rounds, each of them once."""
    end = np.repeat(np.cumsum(n), n)
    return (end - np.arange(len(end)) + turn) % stride == 0


def _hidden(net: Network, around: np.ndarray) -> np.ndarray:
    h = net.hidden_bias + net.context[0][around[0]]
    for p in range(1, len(around)):
        h += net.context[p][around[p]]
    return np.tanh(h, out=h)


def _exp(z: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """exp(z - a number for each row) in place of z, and the sums of its rows. reach: no |z| is above it; where it is small, nothing is taken off."""
    if reach > 60:
        top = z.max()
        z -= top if top - z.min() < 60 else z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, (z @ np.ones(z.shape[1], z.dtype))[:, None]


def _reach(weights: np.ndarray, bias: np.ndarray, axis: int) -> float:
    """A bound of scores of hidden values, which lie between -1 and 1."""
    return float(np.abs(weights).sum(axis=axis).max() + np.abs(bias).max())


def _by_group(net: Network, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """An order by group, h in that order, (group, from, to) of those that occur, and exp of the scores of their classes with sums."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=net.out.shape[1])).tolist()
    members = [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]
    h = h[order]
    scores = np.empty((len(h), net.fine.shape[1]), np.float32)
    for g, a, b in members:
        np.matmul(h[a:b], net.fine[g].T, out=scores[a:b])
        scores[a:b] += net.fine_bias[g]
    return order, h, members, scores


def log_probabilities(net: Network, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability of each position's class, target."""
    h, at = _hidden(net, around), np.arange(len(target))
    group, number = target % net.out.shape[1], target // net.out.shape[1]
    z = h @ net.out
    z += net.out_bias
    e, total = _exp(z, _reach(net.out, net.out_bias, 0))
    log_p = np.log(np.maximum(e[at, group], 1e-37)) - np.log(total[:, 0])
    if net.fine.shape[1] > 1:
        order, _, _, scores = _by_group(net, h, group)
        e, total = _exp(scores, _reach(net.fine, net.fine_bias, 2))
        log_p[order] += np.log(np.maximum(e[at, number[order]], 1e-37)) - np.log(total[:, 0])
    return log_p


def _learn(net: Network, squares: list[np.ndarray], around: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One Adagrad step on a batch, in place; of context, only the rows that occur."""
    h, at, n = _hidden(net, around), np.arange(len(target)), np.float32(len(target))
    group, number = target % net.out.shape[1], target // net.out.shape[1]

    def update(weights: np.ndarray, square: np.ndarray, where, grad: np.ndarray) -> None:  # noqa: ANN001
        new = square[where] + grad * grad
        square[where] = new
        weights[where] -= np.float32(rate) * grad / np.sqrt(new + np.float32(1e-8))

    z = h @ net.out
    z += net.out_bias
    dz, total = _exp(z, _reach(net.out, net.out_bias, 0))
    dz *= 1 / (total * n)
    dz[at, group] -= 1 / n
    dh = dz @ net.out.T
    out_grad, out_bias = h.T @ dz, np.ones(len(dz), np.float32) @ dz
    if net.fine.shape[1] > 1:
        order, sorted_h, members, scores = _by_group(net, h, group)
        dy, total = _exp(scores, _reach(net.fine, net.fine_bias, 2))
        dy *= 1 / (total * n)
        dy[at, number[order]] -= 1 / n
        grad, grad_bias, more = np.zeros_like(net.fine), np.zeros_like(net.fine_bias), np.empty_like(h)
        for g, a, b in members:
            np.matmul(dy[a:b], net.fine[g], out=more[a:b])
            np.matmul(dy[a:b].T, sorted_h[a:b], out=grad[g])
            grad_bias[g] = dy[a:b].sum(axis=0)
        dh[order] += more
        update(net.fine, squares[4], ..., grad)
        update(net.fine_bias, squares[5], ..., grad_bias)
    dh *= 1 - h * h
    # the rows of all places together, each once
    places, classes = len(around), net.context.shape[1]
    key = (around + classes * np.arange(places)[:, None]).ravel()
    order = np.argsort(key.astype(np.uint16) if places * classes < 1 << 16 else key, kind="stable")
    found = key[order]
    starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    update(net.context.reshape(places * classes, -1), squares[0].reshape(places * classes, -1), found[starts], np.add.reduceat(dh[order % len(target)], starts, axis=0))
    update(net.hidden_bias, squares[1], ..., np.ones(len(dh), np.float32) @ dh)
    update(net.out, squares[2], ..., out_grad)
    update(net.out_bias, squares[3], ..., out_bias)


def train(documents: DataFrame, vocabulary: Vocabulary, hidden: int = HIDDEN, reach: int = REACH, stride: int = STRIDE, rate: float = 0.1, coded: DataFrame | None = None) -> Network:
    """coded: what encode has made of documents, if it has been called already."""
    coded = encode(documents, vocabulary) if coded is None else coded
    classes = len(vocabulary.log_prior)
    rng = np.random.Generator(np.random.PCG64(5))
    prior = np.exp(vocabulary.log_prior.astype(np.float64)).reshape(-1, GROUPS).T
    group = prior.sum(axis=1)
    net = Network(
        (rng.standard_normal((2 * reach, classes + 1, hidden)) * 0.1).astype(np.float32),
        np.zeros(hidden, np.float32),
        (rng.standard_normal((hidden, GROUPS)) * 0.1).astype(np.float32),
        np.log(group).astype(np.float32),
        (rng.standard_normal((*prior.shape, hidden)) * 0.1).astype(np.float32),
        np.log(prior / group[:, None]).astype(np.float32),
    )
    sc = documents.sparkSession.sparkContext
    code, size = vocabulary.code, len(net.flat())
    columns, tasks = "turn int, seen long, data binary", int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(stride):
        start = sc.broadcast(net)

        def walk(batches: Iterator[pa.RecordBatch], turn: int = turn, start=start) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = start.value.of(start.value.flat())
            squares = [np.zeros(x.shape, np.float32) for x in own.parts()]
            seen = 0
            for batch in batches:
                padded, n, place = _tokens(batch.column("classes"), code, classes, reach)
                place = place[targets(n, turn, stride)]
                for at in np.array_split(place, -(-len(place) // _BATCH)) if len(place) else ():
                    _learn(own, squares, contexts(padded, at, reach), padded[at], rate)
                seen += len(place)
            if seen:
                task = TaskContext.get().partitionId() % max(8, tasks)
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([seen], pa.int64()), pa.array([(own.flat().astype(np.float64) * seen).tobytes()])], ["turn", "seen", "data"])

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, total, of = 0, np.zeros(size), 0
            for pdf in batches:
                seen += int(pdf["seen"].sum())
                of = int(pdf["turn"].iloc[0])
                for data in pdf["data"]:
                    total += np.frombuffer(data)
            if seen:
                yield pd.DataFrame({"turn": [of], "seen": [seen], "data": [total.tobytes()]})

        # parameters are added up as a tree: by as many tasks as the session shuffles to, then by 8
        found = coded.select("classes").mapInArrow(walk, columns)
        for to in (tasks, 8) if tasks > 64 else (8,):
            found = found.repartition(to, "turn").mapInPandas(add, columns)
        rows = found.collect()
        if not (seen := sum(r["seen"] for r in rows)):
            continue  # no text has a token in this phase
        net = net.of(sum(np.frombuffer(r["data"]) for r in rows) / seen)
    return net


def score(documents: DataFrame, vocabulary: Vocabulary, net: Network, reach: int = REACH, coded: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_prob, per_token) of every row; per_token is the mean, for texts of different length (0 without tokens)."""
    coded = encode(documents, vocabulary) if coded is None else coded
    model = documents.sparkSession.sparkContext.broadcast(net)
    classes, code = len(vocabulary.log_prior), vocabulary.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            padded, n, place = _tokens(batch.column("classes"), code, classes, reach)
            log_p = np.empty(len(place))
            for a in range(0, len(place), _BATCH):
                at = place[a : a + _BATCH]
                log_p[a : a + _BATCH] = log_probabilities(m, contexts(padded, at, reach), padded[at])
            total = batch.column("share").to_numpy() + np.bincount(np.repeat(np.arange(len(n)), n), log_p, len(n))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n), pa.array(total)], ["row", "doc_id", "n_tokens", "log_prob"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = coded.select("row", "doc_id", "share", "classes").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, log_prob double")
    if vocabulary.counts is not None:
        out = out.join(rare_shares(coded, vocabulary), F.col("row") == F.col("r"), "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_prob", (F.col("log_prob") / F.greatest("n_tokens", F.lit(1))).alias("per_token"))
