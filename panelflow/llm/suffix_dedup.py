"""Suffix-array dedup with a run-length index: run-compressed Burrows-Wheeler transforms that texts are streamed against.

Every window of `LENGTH` bytes that also starts in a document with a smaller id is marked. So that equal windows meet,
runs of windows that have the same minimizer (the least hash among the 16-byte strings inside) are cut out as segments
and dealt to shards by that minimizer. Minimizers that only one document has are left out beforehand; a bitmap of a
bounded size says which (what passes by chance only costs work), and a join where it would be too full. Where very many
segments share a minimizer, its windows are dealt one by one by their own hash instead; each task adds up its own
occurrences of these before the shuffle, so that a frequent passage puts rows by task, not by document, into a shard.

In a shard the distinct segments, ordered by smallest document, are indexed: suffixes are sorted, and of their order only
the run-length encoded Burrows-Wheeler transform, the first and last suffix of each run and the match lengths there are
kept. Then all texts of the shard are streamed against this index from their ends on: each step goes to the suffix that
is one byte longer (the last-to-first mapping over runs) and adds one to its match length, or takes the sampled one where
a run begins. Suffixes that match over LENGTH bytes or more are one interval of rows; its smallest document decides.

Edge cases: null texts count as empty; texts shorter than LENGTH have no window; rows with a null id neither remove nor
lose anything; rows that repeat an id don't remove each other's bytes, as their id isn't smaller; overlapping matches
count; bytes are UTF-8, so a cut may fall inside a character. Texts of any length are read in pieces, whole. Segments are
told apart by 128 bits, two hashes of their bytes from different tables, wherever they meet; minimizers by 64, but two that
agree only share a shard, in which their segments are told apart all the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from panelflow.llm.common import _BASE, _BYTE, _INVERSE, _MUL, MOST_KEYS, _powers, filter_has, materialize, membership_filter, mix, text_bytes

LENGTH = 50
_K = 16
_LONGEST = 64
#: The bytes' numbers in the second hash of a segment.
_CHECK = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Odd factors; one for each doubling of the hashed length.
_STEP_MUL = list(np.array([1, 3, 7, 13], np.uint64) * _MUL)
#: Bytes that are hashed at once, and bytes whose segments are put out at once.
_PIECE = 1 << 17
_FLUSH = 1 << 20
#: From so many segments on, a minimizer's windows are dealt one by one.
HOT = 8000
SHARD_SEGMENTS = 8000
#: Different windows of frequent minimizers that a task adds up before it puts them out.
_HOT_ROWS = 1 << 16


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] values), start[1], ... and so on."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def segments(raw: np.ndarray, length: int = LENGTH, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each run of windows; a run has _LONGEST windows at most.

    valid: which windows count (all, if not given); a run ends where one doesn't.
    """
    if len(raw) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _BYTE[raw]
    for step, by in zip((1, 2, 4, 8), _STEP_MUL, strict=True):
        h = h[:-step] * by + h[step:]
    h = mix(h)
    width, reach = length - _K + 1, 1
    while 2 * reach <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    if width > reach:
        h = np.minimum(h[: len(h) - (width - reach)], h[width - reach :])
    new = np.concatenate(([True], h[1:] != h[:-1]))
    if valid is not None:
        new[1:] |= valid[1:] != valid[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h)))
    if n.max() > _LONGEST:
        parts = -(-n // _LONGEST)
        turn = _ranges(np.zeros(len(n), np.int64), parts)
        at = np.repeat(at, parts) + turn * _LONGEST
        n = np.minimum(np.repeat(n, parts) - turn * _LONGEST, _LONGEST)
    if valid is not None:
        at, n = at[valid[at]], n[valid[at]]
    return h[at], at, n


def _stretches(start: np.ndarray, end: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Texts k0..k1-1 and their bytes a..b, about _PIECE of them; of a longer text, b is a piece's last window's end."""
    k = 0
    while k < len(start):
        size = int(end[k] - start[k])
        if size > _PIECE:
            for a in range(int(start[k]), int(end[k]) - length + 1, _PIECE):
                yield k, k + 1, a, min(a + _PIECE + length - 1, int(end[k]))
            k += 1
            continue
        to = max(k + 1, int(np.searchsorted(end, start[k] + _PIECE, "right")))
        yield k, to, int(start[k]), int(end[to - 1])
        k = to


def cut_texts(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of stretches of the texts in a column: bytes, their place in the column's bytes, and each segment's text, minimizer, first window and windows."""
    raw, start, end = text_bytes(column)
    for k0, k1, a, b in _stretches(start, end, length):
        part = raw[a:b]
        if len(part) < length:
            continue
        valid = None
        if k1 - k0 > 1:
            valid = np.ones(len(part) - length + 1, bool)
            short = np.minimum(end[k0:k1] - start[k0:k1], length - 1)
            out = _ranges(end[k0:k1] - short - a, short)
            valid[out[out < len(valid)]] = False
        minimizer, first, windows = segments(part, length, valid)
        owner = k0 + np.searchsorted(start[k0:k1], first + a, "right") - 1
        yield part, a, owner, minimizer, first, windows


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[raw] * _powers(len(raw), _BASE, "up"), dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * _powers(len(raw) + 1, _INVERSE, "down")[start] + (end - start).astype(np.uint64))


def shared_segments(column: pa.Array, length: int, common: np.ndarray, hot: np.ndarray, key_bits: int = 64) -> Iterator[tuple[np.ndarray, ...]]:
    """Of stretches of the texts in a column: bytes, their place, and of the segments that others may share: text, key (a hash,
    cut to key_bits), minimizer, whether it is one window of a frequent minimizer, start and end in the stretch."""
    for part, a, owner, minimizer, first, windows in cut_texts(column, length):
        keep = filter_has(common, minimizer)
        if not keep.any():
            continue
        owner, minimizer, first, windows = owner[keep], minimizer[keep], first[keep], windows[keep]
        single = filter_has(hot, minimizer)
        if single.any():
            n = np.where(single, windows, 1)
            which = np.repeat(np.arange(len(n)), n)
            start = _ranges(first, n)
            owner, minimizer, single = owner[which], minimizer[which], single[which]
            end = start + np.where(single, 1, windows[which]) + length - 1
        else:
            start, end = first, first + windows + length - 1
        yield part, a, owner, _hashes(part, start, end) >> np.uint64(64 - key_bits), minimizer, single, start, end


def suffix_order(padded: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order up to the end of their text, equal ones by position.

    padded: bytes, 0 at the end of each text, and 128 more zeros; left: bytes to the end of the text. Suffixes are sorted by
    their first bytes, then only those still tied, by twice as many bytes in each turn. A key holds the rank so far, the rank
    of what follows, and the position, so that sorting values is enough.
    """
    n = len(left)
    bits = n.bit_length()
    low = (1 << bits) - 1
    depth = (63 - bits) // 8
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for d in range(depth):
        byte = padded[d : d + n] * alive
        alive = byte != 0
        key <<= 8
        key |= byte
    key <<= bits
    key |= np.arange(n)
    key.sort()
    order = (key & low).astype(np.int32)
    key >>= bits
    new = np.concatenate(([True], key[1:] != key[:-1]))
    slots, rank = np.arange(n, dtype=np.int32), np.empty(n, np.int32)
    while True:
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(slots)))
        rank[order[slots]] = np.repeat(slots[start], size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots) or depth >= 128:
            return order
        at = order[slots]
        after = rank[np.minimum(at + np.int32(depth), n - 1)] + np.int32(1)
        after[left[at] <= depth] = 0
        key = rank[at].astype(np.int64)
        key <<= bits
        key |= after
        if 3 * bits <= 63:
            key <<= bits
            key |= at
            key.sort()
            order[slots] = key & low
            key >>= bits
        else:  # more than two million bytes
            turn = np.lexsort((at, key))
            key, order[slots] = key[turn], at[turn]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        depth *= 2


def _first_of_each(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key and check, and where each different pair starts in it."""
    order = np.argsort(key, kind="stable")
    k, c = key[order], check[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # keys that agree by chance
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
    return order, np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))


class RunIndex:
    """The run-length index of some texts: transform runs, first-row samples, and the match length one step on from each run's start.

    body: bytes plus one, 0 at the end of each text; end: the place of each text's 0. Memory goes by bits for rows and by runs
    for the rest; the order of suffixes is dropped.
    """

    def __init__(self, body: np.ndarray, end: np.ndarray) -> None:
        n = len(body)
        place = np.arange(n, dtype=np.int32)
        size = np.diff(np.concatenate(([-1], end)))
        left = (np.repeat(end.astype(np.int32), size) - place).astype(np.uint8)  # bytes up to the text's end
        padded = np.concatenate((body, np.zeros(128, np.uint8)))
        order = suffix_order(padded, left)
        previous = np.concatenate((np.zeros(1, np.uint8), body[:-1]))  # 0 before each text's first byte
        before = previous[order]
        head = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0)))
        self.start = np.flatnonzero(head).astype(np.int32)
        last = np.append(self.start[1:], n).astype(np.int32) - 1
        byte = before[self.start]
        first, tail = order[self.start], order[last]  # the sampled ends of runs
        # where a run's rows go when one byte is added in front: behind all lesser bytes and the same byte's runs before it
        by = np.argsort(byte, kind="stable")
        length = (last - self.start + 1)[by]
        self.target = np.empty(len(by), np.int32)
        self.target[by] = np.cumsum(length) - length
        # a run's first suffix meets the last one of the same byte's run before it, there; both are one byte longer then
        self.match = np.zeros(len(by), np.int16)
        same = np.flatnonzero((byte[by[1:]] == byte[by[:-1]]) & (byte[by[1:]] != 0)) + 1
        going, x, y, d = by[same], first[by[same]], tail[by[same - 1]], 0
        while len(going):
            self.match[going] = d + 1
            c = padded[x + np.int32(d)]
            on = (c == padded[y + np.int32(d)]) & (c != 0)
            going, x, y, d = going[on], x[on], y[on], d + 1
        # rank over the marks of runs' first rows: a count for each 64 rows, and bits
        bits = np.packbits(np.concatenate((head, np.zeros(-n % 64, bool))), bitorder="little").view(np.uint64)
        self.bits, ones = bits, np.bitwise_count(bits)
        self.ahead = (np.cumsum(ones) - ones).astype(np.int32)
        self.rows = n

    def step(self, row: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and match length (with the row above) of the suffixes that are one byte longer."""
        word = row >> 6
        upto = (np.uint64(2) << (row & 63).astype(np.uint64)) - np.uint64(1)
        run = self.ahead[word] + np.bitwise_count(self.bits[word] & upto) - 1
        into = row - self.start[run]
        return self.target[run] + into, np.where(into == 0, self.match[run], match + np.int16(1))


def first_texts(texts: pa.Array, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of `length` bytes of the texts, in order: its text, its offset there, and the first of the texts that holds it.

    texts: binary values, each shorter than 128 bytes, in the order in which one comes before another.
    """
    raw, begin, end = text_bytes(texts)
    size = end - begin
    close = np.cumsum(size + 1) - 1
    body = np.zeros(len(raw) + len(size), np.uint8)
    held = np.ones(len(body), bool)
    held[close] = False
    body[held] = raw + np.uint8(1)  # UTF-8 has no 255, so none becomes 0, which ends a text
    index = RunIndex(body, close)

    # stream all texts side by side, the longest first so that those that end drop off
    turn = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    still = np.searchsorted(-size[turn], -np.arange(longest), "left")  # texts with more bytes than so many
    windows = np.maximum(size - length + 1, 0)
    ahead = (np.cumsum(windows) - windows)[turn]
    row, match = turn.astype(np.int32), np.zeros(len(turn), np.int16)  # ends of texts are the first rows, in their order
    opens = np.zeros(index.rows, bool)
    opens[: len(turn)] = True
    at = np.empty(int(windows.sum()), np.int32)
    for done in range(longest):
        k = int(still[done])
        row, match = index.step(row[:k], match[:k])
        opens[row[match < length]] = True  # matches nothing above it, so an interval begins
        if done + 1 >= length:
            at[ahead[:k] + size[turn[:k]] - done - 1] = row
    which = np.repeat(np.arange(len(size)), windows)
    interval = np.cumsum(opens, dtype=np.int32)[at]
    least = np.empty(index.rows + 1, np.int32)
    least[interval[::-1]] = which[::-1]  # of several texts the first one is put in last
    return which, _ranges(np.zeros(len(size), np.int64), windows), least[interval]


def mark_repeats(documents: DataFrame, length: int = LENGTH, name: str = "spans", key_bits: int = 64) -> DataFrame:
    """Every row with all its columns and, named `name`, the byte ranges [start, end) to remove, disjoint and ascending (binary of int64 pairs).

    key_bits: bits of a segment's first hash; results don't depend on it, as the second one has 64.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND octet_length(text) >= " + str(length))
    rows = rows.withColumn("fp", F.xxhash64("text"))

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, owner, h, _, _ in cut_texts(batch.column("text"), length):
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                at = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))))
                yield pa.RecordBatch.from_arrays([pa.array(h[at].astype(np.int64)), pa.array(np.diff(np.append(at, len(h))).astype(np.int32))], ["h", "m"])

    counts = rows.select("text").mapInArrow(minimizers, "h long, m int").groupBy("h").agg(F.count("*").alias("n"), F.sum("m").alias("m")).where("n > 1")
    counts = materialize(counts, "minimizers")
    total = counts.agg(F.count("*"), F.sum("m")).first()
    common, hot = membership_filter(counts.select("h"), total[0]), membership_filter(counts.where(F.col("m") >= HOT).select("h"))
    shards = max(1, -(-(total[1] or 0) // SHARD_SEGMENTS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def once(key, check, h, shard, lo, hi, parts):  # noqa: ANN001, ANN202
            """Each segment once, with its least and greatest document."""
            order, at = _first_of_each(key, check)
            pick = order[at]
            return key[pick], check[pick], h[pick], shard[pick], np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at), [parts[i] for i in pick.tolist()]

        def batch_of(key, check, h, shard, lo, hi, parts) -> pa.RecordBatch:  # noqa: ANN001
            numbers = [pa.array(x.astype(np.int64)) for x in (h, shard, key, check, lo, hi)]
            return pa.RecordBatch.from_arrays([*numbers[:4], pa.array(parts, pa.binary()), *numbers[4:]], ["h", "shard", "key", "check", "part", "lo", "hi"])

        def joined(found: list):  # noqa: ANN202
            return [*(np.concatenate([f[i] for f in found]) for i in range(6)), [p for f in found for p in f[6]]]

        frequent: list = []  # windows of frequent minimizers, added up over this task's batches
        held: list = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal frequent
            if held:
                yield batch_of(*once(*joined(held)))
                held.clear()
            if sum(len(f[0]) for f in frequent) > 2 * _HOT_ROWS:
                frequent = [once(*joined(frequent))]
                if len(frequent[0][0]) > _HOT_ROWS:
                    yield batch_of(*frequent.pop())

        for batch in batches:
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part, _, owner, key, h, single, start, end in shared_segments(batch.column("text"), length, common.value, hot.value, key_bits):
                data, doc, check = part.tobytes(), docs[owner], _hashes(part, start, end, _CHECK)
                shard = np.where(single, key, h) % np.uint64(shards)
                for some, put in ((~single, held), (single, frequent)):
                    if some.any():
                        put.append((key[some], check[some], h[some], shard[some], doc[some], doc[some], [data[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]))
                size += len(part)
                if size > _FLUSH:
                    size = 0
                    yield from flush()
        yield from flush()
        if frequent:
            yield batch_of(*once(*joined(frequent)))

    def index(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, check, lo, hi = (table.column(c).to_numpy() for c in ("key", "check", "lo", "hi"))
        order, at = _first_of_each(key, check)
        pick, lo, hi = order[at], np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)
        turn = np.argsort(lo, kind="stable")
        pick, lo, hi = pick[turn], lo[turn], hi[turn]
        which, offset, least = first_texts(table.column("part").take(pa.array(pick)).combine_chunks(), length)
        doc = lo[least]
        new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (doc[1:] != doc[:-1]))))
        last = np.append(new[1:], len(doc)) - 1
        use = doc[new] < hi[which[new]]
        new, last = new[use], last[use]
        return pa.table({"key": key[pick][which[new]], "check": check[pick][which[new]], "first": offset[new], "last": offset[last], "least": doc[new]})

    parts = rows.select("doc_id", "text").mapInArrow(cut, "h long, shard long, key long, check long, part binary, lo long, hi long")
    if total[0] > MOST_KEYS:  # the bitmap is too full to leave much out: a join does
        parts = parts.join(counts.select("h"), "h", "left_semi")
    marks = parts.select("shard", "key", "check", "part", "lo", "hi").groupBy("shard").applyInArrow(index, "key long, check long, first long, last long, least long")
    marks = materialize(marks, "marks")
    marked = membership_filter(marks.select("key"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, begin, _ = text_bytes(batch.column("text"))
            doc, fp = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False)
            for part, a, owner, key, _, _, start, end in shared_segments(batch.column("text"), length, common.value, hot.value, key_bits):
                keep = filter_has(marked.value, key)
                if keep.any():
                    who, check = owner[keep], _hashes(part, start[keep], end[keep], _CHECK)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[keep].astype(np.int64), check.astype(np.int64), doc[who], fp[who], start[keep] + a - begin[who])], ["key", "check", "doc_id", "fp", "at"])

    # a key has a row for each stretch of its marks, so where it is frequent adaptive execution splits its occurrences
    held = rows.mapInArrow(occurrences, "key long, check long, doc_id long, fp long, at long").join(marks, ["key", "check"]).where("least < doc_id")
    spans = held.groupBy("doc_id", "fp").agg(F.collect_list(F.struct((F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("last") + length).alias("b"))).alias("found"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), F.col("found.a").alias("a"), F.col("found.b").alias("b"))

    columns = [f"_{k}" for k in range(len(documents.columns))]  # so that no column of documents clashes
    every = documents.toDF(*columns)
    doc_id, text = (F.col(columns[documents.columns.index(c)]) for c in ("doc_id", "text"))
    joined = every.join(spans, (doc_id.cast("long") == F.col("d")) & (F.xxhash64(text) == F.col("f")), "left").select(*columns, "a", "b")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                if not a.is_valid:
                    out.append(b"")
                    continue
                a, b = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
                out.append(np.stack((a[new], b[np.append(new[1:], len(a)) - 1]), axis=1).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.binary())], [*columns, "spans"])

    schema = StructType([*every.schema.fields, StructField("spans", BinaryType())])
    return joined.mapInArrow(merge, schema).toDF(*documents.columns, name)


def kept_bytes(text: str | None, spans: bytes) -> bytes:
    data, out, at = utf8(text), [], 0
    for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def removal_digest(documents: DataFrame, length: int = LENGTH, key_bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            kept = [kept_bytes(t, s) for t, s in zip(texts, spans, strict=True)]
            total = np.array([len(utf8(t)) for t in texts], np.int64)
            gone = total - np.array([len(k) for k in kept], np.int64)
            values = [pa.array(total), pa.array(gone), pa.array([len(s) // 16 for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return mark_repeats(documents.select("doc_id", "text"), length, key_bits=key_bits).mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents with the marked bytes cut from text; of a character that a cut splits, nothing stays."""

    name = "_spans" + "_" * max(map(len, documents.columns), default=0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column(name).to_pylist()
            text = pa.array([t if not s else kept_bytes(t, s).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in documents_columns], documents_columns)

    documents_columns = list(documents.columns)
    return mark_repeats(documents, length, name).mapInArrow(cut, documents.schema)


#: Every window of LENGTH bytes, for small data.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT *, unnest(range(len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
m AS (SELECT g, min(doc_id) AS lo FROM w GROUP BY g),
r AS (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM w JOIN m USING (g) WHERE lo < doc_id),
i AS (SELECT rid, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p) AS k FROM r),
s AS (SELECT rid, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY rid, k),
e AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS f FROM s),
t AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM e JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""
