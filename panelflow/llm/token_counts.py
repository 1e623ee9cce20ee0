"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A text is cut at the vocabulary's special strings (a token each) and then into pieces by the byte-level pattern. A piece's
bytes are its first symbols, linked as a list; a heap gives the adjacent pair of the lowest rank (the leftmost of equals),
whose merge removes one symbol and may put two new pairs into the heap. So a piece has as many tokens as bytes less merges.
n bytes take n log n steps, however long a piece is. Counts of pieces are kept for the task, CACHE of them at once.

The vocabulary is a file of the `tokenizers` library (byte-level BPE, read on the driver and broadcast: its size is the
file's, whatever the corpus); its path is a parameter. Counts are those of that library without begin, end or padding.

Edge cases: null counts as the empty text and has 0 tokens; texts of any length are counted whole, stretch by stretch (cut
only where every text may be cut without changing its pieces); repeated rows and null ids are counted each; an empty table
gives no rows. Only the named columns are read, others are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose counts a task keeps.
CACHE = 400_000
#: Characters that are cut into pieces at once.
STRETCH = 1 << 18

# The byte-level pattern, and letters and numbers that Unicode has taken in since version 16, which the
# `tokenizers` library doesn't take for such.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?NUMBER+| ?OTHER+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
NEW_CODES = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff "
    "18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de "
    "1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)


def _byte_letters() -> dict[str, int]:
    """The letter that a vocabulary file writes for each byte: itself if it can be seen, else the next free one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Symbols by number: a byte's symbol, and for a pair (left * width + right) its rank; a rank's merged symbol."""

    bytes_: list[int]
    width: int
    ranks: dict[int, int]
    merged: list[int]
    special: list[str] = field(default_factory=list)


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE vocabulary file; other kinds raise."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
    vocab = model["vocab"]
    first = [0] * 256
    for letter, byte in _byte_letters().items():
        first[byte] = vocab[letter]
    width = max(vocab.values()) + 1
    ranks, merged = {}, []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks[vocab[left] * width + vocab[right]] = rank
        merged.append(vocab[left + right])
    return Vocabulary(first, width, ranks, merged, [t["content"] for t in spec.get("added_tokens", [])])


def public_vocabulary(name: str) -> str:
    """Where the installed vocabulary files have the one of this name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_piece(piece: bytes, v: Vocabulary) -> int:
    """Tokens of one piece: its bytes less the merges that the heap finds."""
    n = len(piece)
    symbol = [v.bytes_[b] for b in piece]
    if n < 2:
        return n
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    ranks, merged, width = v.ranks, v.merged, v.width
    # an entry is rank * n + place of the pair's left symbol
    heap = [r * n + i for i in range(n - 1) if (r := ranks.get(symbol[i] * width + symbol[i + 1])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        j = after[i]
        if symbol[i] < 0 or j < 0:
            continue
        now = ranks.get(symbol[i] * width + symbol[j])
        if now is None or merged[now] != merged[rank]:
            continue  # one of the two has been merged since
        symbol[i], symbol[j] = merged[rank], -1
        after[i] = k = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get(symbol[i] * width + symbol[k])) is not None:
                heapq.heappush(heap, r * n + i)
        h = before[i]
        if h >= 0 and (r := ranks.get(symbol[h] * width + symbol[i])) is not None:
            heapq.heappush(heap, r * n + h)
    return left


class Counter:
    """Counts texts; keeps the counts of pieces it has seen."""

    def __init__(self, v: Vocabulary) -> None:
        import regex

        class Seen(dict):
            def __missing__(self, piece: str) -> int:
                n = self[piece] = count_piece(piece.encode(), v)
                return n

        new = "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in (r.split("-") for r in NEW_CODES.split()))
        self.seen = Seen()
        self.ascii = re.compile(ASCII_PATTERN)
        letter, number, other = r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"
        fill = lambda *kinds: regex.compile(reduce(lambda p, k: p.replace(*k), zip(("LETTER", "NUMBER", "OTHER"), kinds, strict=True), PATTERN))
        self.any = fill(letter, number, other)
        self.rare = fill(f"(?:(?![{new}]){letter})", f"(?:(?![{new}]){number})", f"(?:{other}|[{new}])")
        self.new = re.compile(f"[{new}]")
        self.cut = re.compile(r"\S(?= )")
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        total, at = 0, 0
        while at < len(text):
            # between a character that isn't white space and a space, a piece ends in every text
            m = self.cut.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            end = m.end() if m else len(text)
            part = text[at:end]
            pattern = self.ascii if part.isascii() else self.rare if self.new.search(part) else self.any
            total += sum(map(self.seen.__getitem__, pattern.findall(part)))
            if len(self.seen) > CACHE:
                self.seen.clear()
            at = end
        return total


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document under the vocabulary file; over_limit: more than `limit` tokens."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(load(vocabulary))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column(2)
            found = np.fromiter((counter(t.as_py()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long")
    rows = documents.select("doc_id", n_bytes.alias("n_bytes"), F.col("text"))
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
