"""Ranked lexical search: MaxScore over document blocks, its bounds tightened by pairs of terms.

Items (queries) are taken in blocks of a bounded number of terms; the terms of a block are broadcast. One pass over the
documents keeps each document's length and its counts of those terms, and gives the corpus statistics; a second one reads these
counts and cuts them into shards of documents. In a shard, each term has a posting list of scores and its maximum. For
pairs of terms that several items share, frequent terms first, the intersection of their lists is stored with the greatest
score that both reach together: a document with both gets that at most, one with a single term gets that term's
maximum, so a pair's bound is the greatest of the three and never above the sum of the two maxima.

A query sorts its terms by maximum. The bound of a set of terms is the sum of their maxima less what its disjoint pairs
save. The longest run of low terms whose bound stays below the kth score so far isn't opened to find documents: only
documents of the other lists are candidates, and each low list is then looked up only for candidates that the bound of
what is left can still bring to the kth score. A task keeps the kth scores from shard to shard, and gives k rows an item.

Edge cases: a null text has no term; documents without a term aren't found and don't count; items without one find
none; equal scores are ordered by id, null ids last; repeated documents are found each, repeated items are answered
each; texts of any length are read whole; an empty table finds nothing. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.common import materialize

#: Documents in a shard, and different terms of the items that are answered at once (the broadcast: some 100 MB at most).
SHARD_ROWS = 8192
QUERY_TERMS = 1_000_000
#: Of an item, terms in most documents that are paired with each other.
PAIRED = 8
#: Items that must share a pair for its list to be stored, and the pairs stored for each item at most, on average.
SHARED, PAIRS = 2, 4
# Fixed values of the score: a tf of 1000 and 8 thousandths of a length factor of 100, 90 of it by the mean length.
UNIT, TF, LENGTH, BASE, SLOPE = 10**9, 1000, 8, 100, 90
_NOT_TERM = bytes(32 if not (48 <= b < 58 or 97 <= b < 123 or b >= 128) else b for b in (b + 32 if 65 <= b < 91 else b for b in range(256)))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased: runs of letters, digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NOT_TERM).split()


def term_weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    if not len(n) or SLOPE * int(n.max()) * n_documents < 2**63:
        return BASE - SLOPE + SLOPE * n * n_documents // max(1, n_terms)
    return np.array([BASE - SLOPE + SLOPE * v * n_documents // n_terms for v in n.tolist()], np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, words): a number and the distinct terms of each row of items that has one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [sorted(set(terms(t))) for t in pdf["text"]]
            yield pdf.assign(words=words, n=[len(w) for w in words]).drop(columns="text")

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return materialize(rows.mapInPandas(read, f"item long, item_id {kind}, words array<binary>, n int").where("n > 0"), "items")


class Queries:
    """A block of items: terms by number, each item's terms, and the pairs that are worth a list."""

    def __init__(self, items: list[tuple[int, list[bytes]]]) -> None:
        self.items = [i for i, _ in items]
        self.number = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.of = [np.array([self.number[w] for w in ws], np.int64) for _, ws in items]
        self.weight = np.zeros(len(self.number), np.int64)
        self.pairs: list[tuple[int, int]] = []
        self.pairs_of: list[list[tuple[int, int]]] = [[] for _ in items]

    def weigh(self, n_documents: int, df: dict[int, int]) -> None:
        """Term weights, and the pairs: of each item's most frequent terms, those that several items share, most shared first."""
        self.weight[:] = [term_weight(n_documents, df.get(k, 0)) for k in range(len(self.number))]
        mine = []
        for of in self.of:
            often = sorted(sorted(of.tolist(), key=lambda k: (-df.get(k, 0), k))[:PAIRED])
            mine.append([(a, b) for i, a in enumerate(often) for b in often[i + 1 :]])
        shared = Counter(p for ps in mine for p in ps)
        self.pairs = sorted(p for p, n in shared.most_common(PAIRS * len(self.of)) if n >= SHARED)
        held = set(self.pairs)
        self.pairs_of = [[p for p in ps if p in held] for ps in mine]


class Shard:
    """Posting lists of a few thousand documents: for each term their places (ascending), scores, and maximum; pair lists."""

    def __init__(self, queries: Queries, place: np.ndarray, term: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((place, term))
        self.place, self.score = place[order], score[order]
        self.start = np.searchsorted(term[order], np.arange(len(queries.number) + 1))
        full = np.flatnonzero(np.diff(self.start))
        self.most = np.zeros(len(queries.number), np.int64)
        if len(full):
            self.most[full] = np.maximum.reduceat(self.score, self.start[full])
        # what each pair saves: its maxima's sum less the pair's bound
        self.both: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        self.saves: dict[tuple[int, int], int] = {}
        for a, b in queries.pairs:
            pa_, pb = self.places(a), self.places(b)
            if len(pa_) and len(pb):
                at, i, j = np.intersect1d(pa_, pb, assume_unique=True, return_indices=True)
                joint = self.scores(a)[i] + self.scores(b)[j]
                top = int(joint.max(initial=0))
                self.both[a, b] = (at, joint, top)
                if (save := int(self.most[a] + self.most[b]) - max(top, int(self.most[a]), int(self.most[b]))) > 0:
                    self.saves[a, b] = save

    def places(self, t: int) -> np.ndarray:
        return self.place[self.start[t] : self.start[t + 1]]

    def scores(self, t: int) -> np.ndarray:
        return self.score[self.start[t] : self.start[t + 1]]

    def bounds(self, low: list[int], pairs: list[tuple[int, int]]) -> tuple[np.ndarray, dict[int, int]]:
        """Of terms by ascending maximum, an upper bound of what the first j reach together, for each j; and the partners of
        the disjoint pairs that it counts, those that save most first."""
        at = {t: i for i, t in enumerate(low)}
        saved, partner = np.zeros(len(low), np.int64), {}
        for save, a, b in sorted(((self.saves[a, b], a, b) for a, b in pairs if (a, b) in self.saves), reverse=True):
            if a not in partner and b not in partner:
                partner[a], partner[b] = b, a
                saved[max(at[a], at[b])] += save
        return np.concatenate(([0], np.cumsum(self.most[low] - saved))), partner

    def find(self, query: np.ndarray, pairs: list[tuple[int, int]], floor: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of all documents whose score is at least floor (1 or more), and how many postings were opened."""
        low = [t for t in query[np.argsort(self.most[query], kind="stable")].tolist() if self.most[t]]
        bound, partner = self.bounds(low, pairs)
        closed = int(np.searchsorted(bound[1:], floor, "left"))  # the first `closed` terms alone stay below
        total = np.zeros(n, np.int64)
        read = 0
        for t in low[closed:]:
            total[self.places(t)] += self.scores(t)
            read += len(self.places(t))
        found = np.flatnonzero(total)
        shut = set(low[:closed])
        units = []
        for t in low[:closed]:
            if partner.get(t) not in shut:
                units.append((int(self.most[t]), t, -1))
            elif t < partner[t]:
                units.append((int(self.most[t] + self.most[partner[t]]) - self.saves[t, partner[t]], t, partner[t]))
        left = int(bound[closed])
        for most, t, other in sorted(units, reverse=True):
            found = found[total[found] + left >= floor]
            if not len(found):
                break
            rest = found
            if other >= 0:  # documents with both have their joint score in the pair's list; the rest look each term up
                places, joint, _ = self.both[t, other]
                hit, where = _lookup(places, found)
                total[found[hit]] += joint[where]
                rest = found[~hit]
            for x in (t, other) if other >= 0 else (t,):
                hit, where = _lookup(self.places(x), rest)
                total[rest[hit]] += self.scores(x)[where]
            left -= most
        found = found[total[found] >= floor]
        return found, total[found], read


def _lookup(places: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are among the ascending places, and where."""
    at = np.searchsorted(places, wanted)
    hit = at < len(places)
    hit[hit] = places[at[hit]] == wanted[hit]
    return hit, at[hit]


def _count(documents: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its number of terms, and its counts of the queries' terms."""
    shared = documents.sparkSession.sparkContext.broadcast(queries.number)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            ids, lengths, offsets, of, tfs = [], [], [0], [], []
            for k, text in enumerate(batch.column(1)):
                found = terms(text.as_py())
                if found:
                    held = Counter(filter(number.__contains__, found))
                    ids.append(k)
                    lengths.append(len(found))
                    of += map(number.__getitem__, held)
                    tfs += held.values()
                    offsets.append(len(of))
            at = pa.array(offsets, pa.int32())
            columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(of, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return materialize(documents.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tfs array<long>"), "counts")


def _best(score: np.ndarray, null: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, null, -score))[:k]


def search(documents: DataFrame, items: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, query_terms: int = QUERY_TERMS) -> DataFrame:
    """documents (doc_id long, text), items (item_id, text): (item_id, rank, doc_id, score), the k best documents of each item."""
    asked = item_terms(items)
    # blocks of items with query_terms terms each, by their numbers: running sums of counts by task first
    sums = asked.groupBy(F.shiftright("item", 33).alias("part")).agg(F.sum("n").alias("n"))
    ahead = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a task
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = asked.withColumn("part", F.shiftright("item", 33)).withColumn("inside", inside).join(ahead, F.col("part") == F.col("p"))
    dealt = materialize(dealt.select("item", "item_id", "words", F.floor((F.col("ahead") + F.col("inside")) / query_terms).alias("block")), "dealt")
    blocks = [r[0] for r in dealt.select("block").distinct().orderBy("block").collect()]
    kind = documents.schema["doc_id"].dataType.simpleString()
    if not blocks:
        return asked.select("item_id", *[F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("doc_id", kind), ("score", "long"))]).limit(0)
    found = reduce(DataFrame.unionByName, [_answer(documents, dealt.where(F.col("block") == b), k, shard_rows, kind) for b in blocks])
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # k rows an item of each task; of some tasks together first
    part = found.withColumn("part", F.pmod(F.col("task"), F.lit(64)))
    some = part.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _answer(documents: DataFrame, items: DataFrame, k: int, shard_rows: int, kind: str) -> DataFrame:
    """(item, task, doc_id, score): the k best of each item that each task finds."""
    queries = Queries([(r["item"], [bytes(w) for w in r["words"]]) for r in items.select("item", "words").collect()])
    counts = _count(documents, queries)
    n_documents, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["df"] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # a row a term of the block
    queries.weigh(n_documents, df)
    shared = documents.sparkSession.sparkContext.broadcast(queries)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(q.of)
        for ids, null, n, sizes, of, tf in _shards(batches, shard_rows):
            m = length_factor(n, n_documents, n_terms)
            place = np.repeat(np.arange(len(ids)), sizes)
            score = q.weight[of] * (UNIT * tf // (TF * tf + LENGTH * m[place]))
            shard = Shard(q, place, of, score)
            for i, query in enumerate(q.of):
                floor = int(best[i][0][-1]) if len(best[i][0]) == k else 1
                at, got, _ = shard.find(query, q.pairs_of[i], floor, len(ids))
                if len(at):
                    s, z, d = np.append(best[i][0], got), np.append(best[i][1], null[at]), np.append(best[i][2], ids[at])
                    top = _best(s, z, d, k)
                    best[i] = (s[top], z[top], d[top])
        size = [len(b[0]) for b in best]
        if sum(size):
            columns = [pa.array(np.repeat(np.array(q.items, np.int64), size)), pa.array(np.concatenate([b[2] for b in best]), pa.int64(), mask=np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    found = counts.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "terms", "tfs").mapInArrow(answer, "item long, doc_id long, score long")
    return found.select("item", F.spark_partition_id().alias("task"), F.col("doc_id").cast(kind).alias("doc_id"), "score")


def _shards(batches: Iterator[pa.RecordBatch], shard_rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, null ids, lengths, terms in each, terms, tfs) of shard_rows documents at a time."""
    held: list[pa.RecordBatch] = []

    def take() -> tuple[np.ndarray, ...]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, lists = table.column("doc_id"), table.column("terms").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        null = np.asarray(ids.is_null())
        return ids.fill_null(0).to_numpy(), null, table.column("n").to_numpy(), np.asarray(lists.value_lengths()), flat, table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)

    for batch in batches:
        for at in range(0, batch.num_rows, shard_rows):
            held.append(batch.slice(at, shard_rows))
            if sum(b.num_rows for b in held) >= shard_rows:
                yield take()
                held = []
    if held and sum(b.num_rows for b in held):
        yield take()


#: Brute force over all documents that share a term with an item.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
i AS (SELECT DISTINCT iid, item_id, t FROM (SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
g AS MATERIALIZED (SELECT rid, doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
z AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM g GROUP BY rid),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM z),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM g, s WHERE t IN (SELECT t FROM i) GROUP BY t, nd),
p AS (SELECT rid, doc_id, g.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))) AS x FROM g JOIN w ON g.t = w.t JOIN z USING (rid), s),
r AS (SELECT iid, item_id, rid, doc_id, CAST(sum(x) AS BIGINT) AS score FROM i JOIN p ON i.t = p.t GROUP BY ALL HAVING sum(x) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r
QUALIFY row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST) <= 10
"""
