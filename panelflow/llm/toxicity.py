"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

The classifier learns from at most about `max_rows` labelled rows, chosen by a hash of the id, so their ids can be broadcast
and no text is shuffled. How many toxic and other texts among them hold each hashed n-gram is counted on the executors. Of
the buckets, those whose shares differ between the classes by EVIDENCE standard errors keep their log-count ratio as scale
(the `features` strongest of them at most, 64 of all at least); a logistic regression over the scaled presence of these is
fitted on at most about `fit_rows` of the rows, then weight times scale is broadcast. All texts are scored.

Edge cases: null and empty texts have no n-grams and get the score of the intercept; learning rows with a null text, label
or id teach nothing, several labels of a document count as toxic if one is; without both classes to learn from every
score is the share of toxic rows (0 without rows). Whole texts count, whatever their length; each row gets one result, so
repeated rows get equal ones. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.langid import code_points

BITS = 18
ORDERS = (3, 4, 5, 6)
FEATURES = 4096
EVIDENCE = 4.0
#: Log-count ratios come from so many labelled rows at most, the logistic regression from so many of them.
MAX_ROWS = 30_000
FIT_ROWS = 12_000
_PIECE = 1 << 20


def gram_set(text: str | None, flags: np.ndarray, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The buckets of a text's n-grams, ascending. flags: a table of 2**bits False values, left so."""
    points = np.concatenate((np.full(1, 32, np.uint32), code_points(text), np.full(1, 32, np.uint32)))
    for at in range(0, len(points), _PIECE):
        for n in orders:
            piece = points[at : at + _PIECE + n - 1]
            if len(piece) < n:
                continue
            h = np.full(len(piece) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ piece[i : len(piece) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            flags[h >> np.uint32(32 - bits)] = True
    used = np.flatnonzero(flags)
    flags[used] = False
    return used


@dataclass(frozen=True)
class ToxicityModel:
    weight: np.ndarray  # of each bucket: classifier weight times log-count ratio
    intercept: float
    bits: int = BITS


def _share(rows: DataFrame, part: float) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, part) * 1_000_000))


def _labelled(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of a bounded number of labelled rows (doc_id, toxic)."""
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(rows), "doc_id").select("doc_id", "toxic", "text")


def _logistic(indices: list[np.ndarray], y: np.ndarray, scale: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept for rows that hold the features in indices, each worth its scale; Adam on all rows."""
    rows = np.repeat(np.arange(len(indices)), [len(x) for x in indices])
    cols = np.concatenate(indices) if len(rows) else np.zeros(0, np.int64)
    values = scale[cols]
    w, b = np.zeros(len(scale)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * w[cols], len(y)) + b, -40, 40)))
        g = np.append(np.bincount(cols, values * (p - y)[rows], len(scale)) / len(y) + l2 * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(documents: DataFrame, labels: DataFrame, bits: int = BITS, features: int = FEATURES, max_rows: int = MAX_ROWS, fit_rows: int = FIT_ROWS, l2: float = 1e-4, steps: int = 250) -> ToxicityModel:
    """Learn from the texts of documents that labels (doc_id, toxic 0/1) covers."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_labels = labels.count()
    labels = _share(labels, max_rows / max(1, n_labels))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, total, seen = np.zeros(1 << bits, bool), np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        for pdf in batches:
            for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
                total[int(toxic > 0), gram_set(text, flags, bits)] += 1
                seen[int(toxic > 0)] += 1
        used = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": np.append(used, -1).astype(np.int32), "toxic": np.append(total[1, used], seen[1]), "other": np.append(total[0, used], seen[0])})

    got = _labelled(documents, labels).mapInPandas(count, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toPandas()
    head = got[got["bucket"] < 0]
    n_toxic, n_other = int(head["toxic"].sum()), int(head["other"].sum())
    if not n_toxic or not n_other:
        return ToxicityModel(np.zeros(1 << bits), 40.0 if n_toxic else -40.0, bits)
    got = got[got["bucket"] >= 0].sort_values("bucket")
    ratio = np.log((got["toxic"] + 1) / (n_toxic + 2)).to_numpy() - np.log((got["other"] + 1) / (n_other + 2)).to_numpy()
    strength = np.abs(got["toxic"] / n_toxic - got["other"] / n_other).to_numpy() * np.abs(ratio)
    seen = (got["toxic"] + got["other"]).to_numpy()
    share = seen / (n_toxic + n_other)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_toxic + 1 / n_other))
    weak = (seen < 3) | (np.abs(got["toxic"] / n_toxic - got["other"] / n_other).to_numpy() < EVIDENCE * error)
    best = np.sort(np.lexsort((-strength, weak))[: min(features, max(64, int((~weak).sum())))])
    chosen, scale = got["bucket"].to_numpy()[best], ratio[best]
    place = np.full(1 << bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = documents.sparkSession.sparkContext.broadcast(place)

    def features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, at = np.zeros(1 << bits, bool), shared.value
        for pdf in batches:
            held = [at[gram_set(text, flags, bits)] for text in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": (pdf["toxic"] > 0).astype(np.int32), "held": [x[x >= 0].astype(np.int32).tobytes() for x in held]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = _labelled(documents, _share(labels, min(1.0, max_rows / max(1, n_labels)) * fit_rows / (n_toxic + n_other))).mapInPandas(features_of, f"doc_id {kind}, toxic int, held binary")
    # as many rows as asked for, about; where many rows repeat an id, twice as many at most
    rows = rows.orderBy(F.xxhash64("doc_id", "held"), "doc_id").limit(2 * fit_rows).toPandas().sort_values("doc_id", kind="stable")
    y = rows["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(np.zeros(1 << bits), float(np.log(n_toxic / n_other)), bits)
    w, b = _logistic([np.frombuffer(x, np.int32) for x in rows["held"]], y, scale, l2, steps)
    weight = np.zeros(1 << bits)
    weight[chosen] = w * scale
    return ToxicityModel(weight, b, bits)


def predict(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of documents; score: the probability of label 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        flags = np.zeros(1 << m.bits, bool)
        for pdf in batches:
            z = np.array([m.weight[gram_set(text, flags, m.bits)].sum() + m.intercept for text in pdf["text"]], float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))})

    kind = documents.schema["doc_id"].dataType.simpleString()
    # ids travel as text: with a null among them, pandas would make them floats
    out = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(score, "doc_id string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
