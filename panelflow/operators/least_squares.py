"""Least squares over expanding windows from mergeable QR factors.

A triangular factor of the rows seen so far is all that a fit needs; factors of parts merge by stacking and factoring
again, so they add up like sums, without squaring the condition of the problem. Each task makes one factor for each
segment of time it meets, segments merge across tasks, then prefixes of segments merge in two levels: within chunks of
CHUNK segments side by side, and over the totals of the chunks. No row is compared with folds: a date's segment comes by an
equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.schemas import PRICE_FEATURES, TARGET

#: Segments whose prefixes one task merges.
CHUNK = 256
#: Directions with less than this part of the largest one's size (columns scaled alike) count as missing: the fit of least norm.
RANK = 1e-9
_ROWS = 4096


def merge(*factors: np.ndarray) -> np.ndarray:
    """The triangular factor of all rows that the factors stand for."""
    return np.linalg.qr(np.concatenate(factors), mode="r") if sum(map(len, factors)) else factors[0]


def solve(factor: np.ndarray) -> list[float]:
    """Intercept and coefficients of least norm (columns scaled to like size) from a factor of (1, x..., y); zeros without rows."""
    a, y = factor[:, :-1], factor[:, -1]
    size = np.sqrt((a * a).sum(axis=0))
    size[size == 0] = 1.0
    return list(np.linalg.lstsq(a / size, y, rcond=RANK)[0] / size)


def _read(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, width)


def segment_factors(rows: DataFrame, segment: str, features: list[str] = PRICE_FEATURES, target: str = TARGET) -> DataFrame:
    """(segment, factor) of rows with a target: the QR factor of (1, features, target), null features as 0."""
    width = len(features) + 2
    names = [f"x{i}" for i in range(len(features))]
    use = rows.where(F.col(target).isNotNull()).select(F.col(segment).cast("long").alias("segment"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(n) for f, n in zip(features, names, strict=True)], F.col(target).cast("double").alias("y"))

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = np.concatenate((np.ones((len(pdf), 1)), pdf[[*names, "y"]].to_numpy(float)), axis=1)
            of = pdf["segment"].to_numpy()
            order = np.argsort(of, kind="stable")
            x, of = x[order], of[order]
            for at in np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1) if len(of) else []:
                for part in range(0, len(at), _ROWS):
                    held[of[at[0]]] = merge(held.get(of[at[0]], np.zeros((0, width))), x[at[part : part + _ROWS]])
        yield pd.DataFrame({"segment": list(held), "factor": [r.tobytes() for r in held.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "factor": [_merged(pdf["factor"], width).tobytes()]})

    parts = use.mapInPandas(factor, "segment long, factor binary")
    # a segment has a factor from each task: where there are many tasks, those of some of them meet first
    if int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 64:
        parts = parts.withColumn("turn", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("segment", "turn").applyInPandas(add, "segment long, factor binary")
    return parts.groupBy("segment").applyInPandas(add, "segment long, factor binary")


def _merged(factors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((0, width))
    for at in range(0, len(factors), 64):
        out = merge(out, *[_read(f, width) for f in factors.iloc[at : at + 64]])
    return out


def expanding_fits(rows: DataFrame, ends: DataFrame, date: str = "date", features: list[str] = PRICE_FEATURES, target: str = TARGET) -> DataFrame:
    """(fold_id, coefficients) for each row of ends (fold_id, train_end): least squares on all rows up to train_end.

    coefficients: intercept first; the fit of least norm where columns depend on each other; zeros where there is no row.
    """
    width = len(features) + 2
    # a segment is what lies between two ends: calendar-sized tables, a row a day or a fold
    known = ends.where("train_end IS NOT NULL").select("fold_id", "train_end")
    marks = known.select(F.col("train_end").alias("at")).distinct().withColumn("segment", (F.row_number().over(Window.orderBy("at")) - 1).cast("long"))
    days = rows.select(F.col(date).alias("at")).where("at IS NOT NULL").distinct()
    both = days.withColumn("s", F.lit(None).cast("long")).unionByName(marks.select("at", F.col("segment").alias("s")))
    after = F.first("s", ignorenulls=True).over(Window.orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the first end at or after the day; a day and an end of it are two rows, so the least counts
    places = both.withColumn("segment", after).groupBy("at").agg(F.min("segment").alias("segment")).where("segment IS NOT NULL").select(F.col("at").alias("day"), "segment")
    factors = segment_factors(rows.join(places, F.col(date) == F.col("day")), "segment", features, target)

    every = marks.select(F.col("segment").alias("of")).join(factors, F.col("of") == F.col("segment"), "left").select(F.col("of").alias("segment"), "factor")
    every = every.withColumn("chunk", F.floor(F.col("segment") / CHUNK))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "factor": [_merged(pdf["factor"].dropna(), width).tobytes()]})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        now, out = np.zeros((0, width)), []
        for data in pdf["factor"]:
            out.append(now.tobytes())
            now = merge(now, _read(data, width))
        return pd.DataFrame({"chunk": pdf["chunk"], "carried": out})

    def fit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("segment")
        now, out = _read(right["carried"].iloc[0], width), []
        for data in left["factor"]:
            now = now if data is None else merge(now, _read(data, width))
            out.append(solve(now) if len(now) else [0.0] * (width - 1))
        return pd.DataFrame({"segment": left["segment"], "coefficients": out})

    totals = every.groupBy("chunk").applyInPandas(total, "chunk long, factor binary")
    carried = totals.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(carry, "chunk long, carried binary")  # a row for each CHUNK ends
    fits = every.groupBy("chunk").cogroup(carried.groupBy("chunk")).applyInPandas(fit, "segment long, coefficients array<double>")
    return known.join(marks, F.col("train_end") == F.col("at")).select("fold_id", F.col("segment").alias("s")).join(fits, F.col("s") == F.col("segment")).select("fold_id", "coefficients")
