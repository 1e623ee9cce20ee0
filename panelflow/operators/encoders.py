"""One-hot encoding and scaling, fitted on the training split only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More categories than this make no feature vector.
MAX_CATEGORIES = 10_000


def fit_one_hot(train: DataFrame, column: str = "ticker") -> list[str]:
    """The sorted categories of the training rows; few, as they become feature columns (at most MAX_CATEGORIES)."""
    rows = train.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    return [r[0] for r in rows]


def one_hot(value: Column, categories: list[str]) -> Column:
    """An array with 1.0 at the value's category; all zeros for an unseen value."""
    if not categories:
        return F.array().cast("array<double>")
    return F.transform(F.array(*[F.lit(c) for c in categories]), lambda c: F.when(value == c, 1.0).otherwise(0.0))


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, scale): population standard deviation, 1 where it is 0. Nulls count as 0."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    got = train.agg(*[F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).alias(c) for c, v in filled.items()])
    rows = got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in columns])).alias("r")).select("r.*")
    return rows.select("feature", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("scale"))


def apply(df: DataFrame, categories: list[str], scaler: DataFrame, column: str = "ticker", name: str = "vector") -> DataFrame:
    """df with an array column: one-hot categories, then scaled features in the scaler's order. Nulls count as 0."""
    fitted = [(r["feature"], r["mean"], r["scale"]) for r in scaler.collect()]  # a row for each feature
    scaled = [(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s) for f, m, s in fitted]
    return df.withColumn(name, F.concat(one_hot(F.col(column), categories), F.array(*scaled)))
