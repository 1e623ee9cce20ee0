"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all learning rows: each partition adds up its n-gram counts by language, Spark sums them by language
and bucket, and the log-probability matrix (2**14 rows, a column for each language) is broadcast. Scoring builds a sparse
batch (bucket and count of each document's n-grams) and multiplies it with the matrix in numpy.

Edge cases: a text that is null or has no letter gets `und` and score 0; rows without a language or a text teach nothing;
without any learning row every text gets `und`; ties go to the language first by code point. There may be any number of
languages; the matrix grows with them. Texts of any length are counted whole; their code points are held as an array in one
task. Repeated rows count again. Only the named columns are read, others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.session import materialize

BITS = 14
ORDERS = (1, 2, 3)
ALPHA = 0.5
#: Labels whose dense counts a task holds at once.
_LABELS_AT_ONCE = 64
_PIECE = 1 << 20
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased code points; every character that isn't a letter becomes a space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[points], points, np.uint32(32))


def gram_counts(points: np.ndarray, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """How many n-grams of the given orders fall into each of 2**bits buckets."""
    total = np.zeros(1 << bits, np.int64)
    for at in range(0, len(points), _PIECE):
        for n in orders:
            piece = points[at : at + _PIECE + n - 1]
            if len(piece) < n:
                continue
            h = np.full(len(piece) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ piece[i : len(piece) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            total += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return total


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages
    prior: np.ndarray
    bits: int = BITS


def fit(rows: DataFrame, bits: int = BITS, alpha: float = ALPHA) -> LanguageModel:
    """Learn from the columns text and lang of rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, total in grams.items():
                used = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "bucket": np.append(used, -1).astype(np.int32), "n": np.append(total[used], seen[lang])})
            grams.clear()
            seen.clear()

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if lang not in grams and len(grams) == _LABELS_AT_ONCE:
                    yield from flush()
                got = gram_counts(code_points(text), bits)
                grams[lang] = grams[lang] + got if lang in grams else got
                seen[lang] = seen.get(lang, 0) + 1
        yield from flush()

    counts = rows.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInPandas(count, "lang string, bucket int, n long")
    # a row for each language, and for each n-gram bucket that a language has: bounded by the languages, not by the corpus
    counts = materialize(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams").toArrow()
    lang, bucket, n = counts.column("lang").to_numpy(), counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    languages, place = np.unique(lang.astype(str), return_inverse=True)
    whole = bucket < 0
    docs = np.bincount(place[whole], n[whole], len(languages))
    table = np.zeros((1 << bits, len(languages)))
    table[bucket[~whole], place[~whole]] = n[~whole]
    languages = languages.tolist()
    table += alpha
    return LanguageModel(languages, np.log(table / table.sum(axis=0)), np.log(docs / docs.sum()) if languages else docs, bits)


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of documents; score is the posterior probability of lang_pred."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            names = np.full(len(pdf), "und", object)
            best = np.zeros(len(pdf))
            where, buckets, counts = [], [], []
            for k, text in enumerate(pdf["text"]):
                points = code_points(text)
                if m.languages and (points != 32).any():
                    total = gram_counts(points, m.bits)
                    used = np.flatnonzero(total)
                    where.append(k)
                    buckets.append(used)
                    counts.append(total[used])
            for at in range(0, len(where), 256):
                some = slice(at, at + 256)
                first = np.concatenate(([0], np.cumsum([len(b) for b in buckets[some]])[:-1]))
                parts = m.log_probability[np.concatenate(buckets[some])] * np.concatenate(counts[some])[:, None]
                total = np.add.reduceat(parts, first, axis=0) + m.prior
                likely = total.argmax(axis=1)
                names[where[some]] = [m.languages[i] for i in likely]
                best[where[some]] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": names, "score": best})

    kind = documents.schema["doc_id"].dataType.simpleString()
    # ids travel as text: with a null among them, pandas would make them floats
    out = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(score, "doc_id string, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
