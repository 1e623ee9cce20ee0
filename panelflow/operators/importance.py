"""Permutation importance: every permuted row is computed, not ranked.

Rows are numbered from 0. A keyed bijection of these numbers, one for each feature and repeat, says which row gets a
row's value of the feature: a Feistel network on a grid just larger than the number of rows, walked on from cells outside
until it is back inside. So each row sends its values straight to the rows that get them: one shuffle for all features
and repeats, and one pass of the model over all permuted rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.schemas import TARGET
from panelflow.session import materialize

#: Half rounds of the network.
ROUNDS = 4
#: Steps back inside: a walk meets fewer cells outside than the grid has, which are fewer than 40 up to 1,600 rows; beyond, the
#: chance of any walk this long is below n**-18.
WALK = 40
_WORD = 1 << 32


def evaluation_split(df: DataFrame) -> DataFrame:
    """The val rows, or the test rows if there are none."""
    val = df.where("split = 'val'")
    return df.where("split = 'test'") if val.isEmpty() else val


def numbered(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """df with numbers from 0 on, without gaps, in the order of the md5 of the key's text: the same however df is partitioned. Rows of
    one key are numbered by chance.

    Numbers come from counts of 4096 ranges of the md5 and row numbers inside them, so that no task sorts all rows.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    df = df.withColumn("_md5", F.md5(text)).withColumn("_part", F.substring("_md5", 1, 3))
    counts = df.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows
    ahead = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_md5")) - 1
    return df.withColumn("_in", inside).join(F.broadcast(ahead), F.col("_part") == F.col("_p")).withColumn(name, F.col("_ahead") + F.col("_in")).drop("_md5", "_part", "_p", "_ahead", "_in")


def _scatter(value: Column, key: Column) -> Column:
    """A 32-bit number from two; plain arithmetic below 2**63, so that SQL gives the same."""
    word = F.lit(_WORD).cast("long")
    y = (value * F.lit(0x9E3779B1) + key) % word
    y = y.bitwiseXOR(F.shiftright(y, 15)) * F.lit(0x05EBCA77) % word
    return y.bitwiseXOR(F.shiftright(y, 13))


def round_key(run: Column, seed: int, i: int) -> Column:
    """The key of half round i of a run."""
    return (run.cast("long") * F.lit(0x7FEB352D) + F.lit((seed * 0x1000193 + i * 0x27D4EB2F) % _WORD)) % F.lit(_WORD).cast("long")


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest grid of about equal sides with n cells or more."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1) if n else 1
    return a, max(1, -(-n // a))


def partner(number: Column, run: Column, n: int, seed: int = 42) -> Column:
    """The number that gets the value of `number` in a run: a bijection of 0..n-1 for each run and seed."""
    a, b = grid(n)
    keys = [round_key(run, seed, i) for i in range(ROUNDS)]

    def step(x: Column) -> Column:
        pair = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        for i, key in enumerate(keys):
            pair = F.transform(F.array(pair), _half(key, a, b, i % 2 == 0))[0]
        return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]

    first = step(number.cast("long"))
    # outside the grid's first n cells: walk on
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(step(x)))


def _half(key: Column, a: int, b: int, left: bool) -> Callable[[Column], Column]:
    if left:
        return lambda p: F.struct(((p["l"] + _scatter(p["r"], key)) % a).alias("l"), p["r"].alias("r"))
    return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + _scatter(p["l"], key)) % b).alias("r"))


def permute(df: DataFrame, column: str, key: list[str], seed: int = 42) -> DataFrame:
    """df with the values of column dealt to other rows, by a bijection that the seed keys."""
    rows = materialize(numbered(df, key, "_place"), "numbered")
    n = rows.count()
    given = rows.select(partner(F.col("_place"), F.lit(0), n, seed).alias("_to"), F.col(column).alias("_value"))
    return rows.join(given, F.col("_place") == F.col("_to")).drop("_place", "_to", column).withColumnRenamed("_value", column).select(*df.columns)


def permuted_runs(df: DataFrame, features: list[str], key: list[str], n_repeats: int, seed: int = 42) -> DataFrame:
    """Every row once as it is (run -1), and once for each feature (number f of features) and repeat r (run f * n_repeats + r) with that
    feature's value from another row. Columns of df, and `run`."""
    rows = materialize(numbered(df, key, "_place"), "numbered")
    n = rows.count()
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(features) * n_repeats - 1).cast("long")))
    sent = rows.select("_place", *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(features)], runs.alias("run"))
    value = F.coalesce(*[F.when(F.floor(F.col("run") / n_repeats) == i, F.struct(F.col(f"v{i}").alias("v"))) for i in range(len(features))])
    sent = sent.select(partner(F.col("_place"), F.col("run"), n, seed).alias("_place"), F.struct("run", value["v"].alias("v")).alias("got"))
    kept = rows.select("_place", F.struct(*df.columns).alias("row"))
    # a row meets the values it gets, one for each run, in one shuffle
    met = kept.unionByName(sent, allowMissingColumns=True).groupBy("_place").agg(F.first("row", ignorenulls=True).alias("row"), F.collect_list("got").alias("got"))
    base = F.array(F.struct(F.lit(-1).cast("long").alias("run"), F.lit(None).cast("double").alias("v")))
    every = met.select("row.*", F.explode(F.concat(base, "got")).alias("got"))
    of = F.floor(F.col("got.run") / n_repeats)
    changed = {f: F.when((F.col("got.run") >= 0) & (of == i), F.col("got.v")).otherwise(F.col(f).cast("double")) for i, f in enumerate(features)}
    return every.withColumns(changed).select(*df.columns, F.col("got.run").alias("run"))


def _importance(errors: DataFrame, features: list[str], n_repeats: int) -> DataFrame:
    """errors: (run, mse), a row for each run."""
    base = errors.where("run = -1").select(F.col("mse").alias("base"))
    rise = errors.where("run >= 0").crossJoin(F.broadcast(base)).select(F.element_at(F.array(*[F.lit(f) for f in features]), (F.floor(F.col("run") / n_repeats) + 1).cast("int")).alias("feature"), (F.col("mse") - F.col("base")).alias("rise"))
    return rise.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("std")).orderBy(F.col("importance").desc(), "feature")


def model_importance(df: DataFrame, score: Callable[[DataFrame], DataFrame], features: list[str], key: list[str], n_repeats: int = 5, seed: int = 42, target: str = TARGET) -> DataFrame:
    """(feature, importance, std) of any fitted model: score adds y_pred to a table, and is called once, over all permuted rows.
    importance is the mean rise of the mean squared error over n_repeats permutations of the feature, largest first."""
    rows = permuted_runs(df.where(F.col(target).isNotNull()), features, key, n_repeats, seed)
    return _importance(score(rows).groupBy("run").agg(F.avg((F.col("y_pred") - F.col(target)) ** 2).alias("mse")), features, n_repeats)


def permutation_importance(df: DataFrame, prediction: Column, features: list[str], key: list[str], n_repeats: int = 5, seed: int = 42, target: str = TARGET) -> DataFrame:
    """model_importance of a model that is an expression over its features."""
    return model_importance(df.select(*key, target, *features), lambda rows: rows.withColumn("y_pred", prediction), features, key, n_repeats, seed, target)
