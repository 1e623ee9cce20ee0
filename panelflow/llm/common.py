"""Helpers shared by the corpus operators: shared scratch tables, text access, bounded sketches, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.session import materialize

#: A word is a run of characters other than space and \t..\r; the same in Java's and Python's regular expressions.
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    """The words of a text; of null, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def learn_fold(doc_id: Column) -> Column:
    """True where labels may be learnt from: crc32(doc_id as text) mod 4 is not 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 != 2


# ---------------------------------------------------------------- words as numbers

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x5851F42D4C957F2D  # odd, so that its powers can be inverted modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of a text that are hashed at once.
_LONG = 1 << 21
#: Bytes of short texts that are hashed at once.
_STRETCH = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a finalizer of the splitmix kind)."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int, base: int, key: str) -> np.ndarray:
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[key] = have = np.multiply.accumulate(have)
    return have[:n]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in an array of UTF-8 bytes."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each word of a text, A-Z lower-cased, in order. Equal words have equal hashes.

    Long texts are hashed in pieces that end at a gap between words, so that memory follows the piece (or the longest word).
    """
    return _long_words(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), lower)


def _long_words(raw: np.ndarray, lower: bool) -> np.ndarray:
    if len(raw) <= _LONG:
        return _span_hashes(raw, *word_spans(raw), lower)
    ends = np.append(np.flatnonzero(_SPACE[raw]), len(raw))
    out, at = [], 0
    while at < len(raw):
        end = int(ends[np.searchsorted(ends, min(at + _LONG, len(raw)))])
        out.append(_span_hashes(raw[at:end], *word_spans(raw[at:end]), lower))
        at = end + 1
    return np.concatenate(out)


def _span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    if lower:
        raw = _LOWER[raw]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers(len(raw), _BASE, "up"), dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * _powers(len(raw), _INVERSE, "down")[start] + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of n words; of fewer words, of the whole sequence; of none, none."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    h = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * _MUL + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(h)


# ---------------------------------------------------------------- texts as bytes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column of texts as one array without copying, and each text's start and end in it; null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    return raw, at[:-1], at[1:]


def column_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """word_hashes of the texts in an Arrow column, stretch by stretch: the first text, the words of each, all their hashes in order."""
    raw, start, end = text_bytes(column)
    k = 0
    while k < len(start):
        if end[k] - start[k] > _STRETCH:
            h = _long_words(raw[start[k] : end[k]], lower)
            yield k, np.array([len(h)]), h
            k += 1
            continue
        to = max(k + 1, int(np.searchsorted(end, start[k] + _STRETCH, "right")))
        part, first = raw[start[k] : end[to - 1]], start[k:to] - start[k]
        gap = _SPACE[part]
        cut = np.append(gap, True)  # places that a word can't reach across, seen from the byte before
        cut[first] = True
        head = ~gap
        head[1:] &= gap[:-1] | (cut[1:-1] & ~gap[1:])
        at, stop = np.flatnonzero(head), np.flatnonzero(~gap & cut[1:]) + 1
        yield k, np.diff(np.append(np.searchsorted(at, first), len(at))), _span_hashes(part, at, stop, lower)
        k = to


# ---------------------------------------------------------------- tables of a fixed size, built on the executors


def gather_blocks(parts: DataFrame, n: int, dtype: str, add) -> np.ndarray:
    """Combine rows (block int, data binary), each a compressed piece of an array of n values, into the whole array.

    Pieces are added up as a tree: first those of a block in several turns, as many as the session's shuffle partitions give
    room for, then the turns of each block. A task holds one array for each block it sees; what reaches the driver has the
    array's fixed size, whatever the size of the corpus.
    """
    import zlib

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"], strict=True):
                piece = np.frombuffer(zlib.decompress(data), dtype)
                total[block] = add(total[block], piece) if block in total else piece.copy()
        yield pd.DataFrame({"block": list(total), "data": [zlib.compress(x.tobytes(), 1) for x in total.values()]})

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if (turns := tasks // 16) > 1:
        turn = F.pmod(F.spark_partition_id(), F.lit(turns)).alias("turn")
        parts = parts.select("block", "data", turn).repartition(tasks, "block", "turn").select("block", "data").mapInPandas(combine, "block int, data binary")
    out = np.zeros(n, dtype)
    for row in parts.repartition(16, "block").mapInPandas(combine, "block int, data binary").collect():
        piece = np.frombuffer(zlib.decompress(row["data"]), dtype)
        out[row["block"] * len(piece) : (row["block"] + 1) * len(piece)] = piece
    return out


def split_blocks(table: np.ndarray, blocks: int) -> pd.DataFrame:
    """The non-empty pieces of a table as rows for gather_blocks."""
    import zlib

    pieces = table.reshape(blocks, -1)
    used = np.flatnonzero(pieces.any(axis=1))
    return pd.DataFrame({"block": used.astype(np.int32), "data": [zlib.compress(pieces[i].tobytes(), 1) for i in used]})


#: Bits of the largest bitmap: 128 MB. Up to about MOST_KEYS keys, one in six others passes at most.
MOST_BITS = 30
MOST_KEYS = 300_000_000


def membership_filter(keys: DataFrame, n: int | None = None) -> Broadcast:
    """A bitmap of the 64-bit keys in the only column of keys, broadcast: twelve bits for each of the n keys (counted if not
    given), 2**MOST_BITS at most.

    It only spares work: what passes by chance is handled exactly later, so a full bitmap costs time, not results.
    """
    bits = min(MOST_BITS, max(20, (12 * (keys.count() if n is None else n)).bit_length()))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << (bits - 3), np.uint8)
        for pdf in batches:
            for slots in _slots(pdf.iloc[:, 0].to_numpy(np.int64), bits):
                np.bitwise_or.at(table, slots >> 3, _BIT[slots & 7])
        yield split_blocks(table, 64)

    parts = keys.mapInPandas(mark, "block int, data binary")
    return keys.sparkSession.sparkContext.broadcast(gather_blocks(parts, 1 << (bits - 3), "uint8", np.bitwise_or))


_BIT = np.array([128, 64, 32, 16, 8, 4, 2, 1], np.uint8)


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each key."""
    h = mix(keys.astype(np.uint64))
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def filter_has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in the bitmap; all that were put in are."""
    one, two = _slots(keys, len(bitmap).bit_length() + 2)
    return (bitmap[one >> 3] & _BIT[one & 7] != 0) & (bitmap[two >> 3] & _BIT[two & 7] != 0)


# ---------------------------------------------------------------- connected components


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (id, component): the smallest id reachable from each id that has a link.

    Alternates hooking each id to its smallest neighbour's label with pointer jumping; every round is two joins and is
    written to the shared scratch folder. Labels shrink along a path at least twice as fast each round.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        # what an id's old label's id has found holds for it too
        up = hooked.groupBy(F.col("was").alias("up")).agg(F.min("now").alias("best"))
        step = hooked.join(up, F.col("was") == F.col("up")).select("id", "was", F.least("now", "best").alias("now"))
        jump = step.select(F.col("id").alias("to"), F.col("now").alias("far"))
        labels = materialize(step.join(jump, F.col("now") == F.col("to")).select("id", F.least("now", "far").alias("component"), (F.least("now", "far") != F.col("was")).alias("changed")), "labels")
        if labels.where("changed").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
