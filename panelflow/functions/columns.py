"""Column helpers that hold under ANSI mode."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import materialize


def number(c: Column) -> Column:
    """A string as a double; null if empty, not a number, or NaN."""
    value = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value), value)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_digits(value: Column, digits: int) -> Column:
    """value rounded to digits, halves away from 0, by scaling; never negative zero. Infinite, NaN and huge values stay."""
    scale = float(10**digits)
    x = value.cast("double")
    near = F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)
    return F.when(F.abs(x) < F.lit(9e18 / scale), near).otherwise(x)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, marked to be broadcast if it has no more than so many (narrow) rows; counting stops there. Beyond, Spark joins as it sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Left rows of one group and time that meet their answer in one task.
HOT_ROWS = 100_000


def latest_as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, payload: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left as-of join: each left row with the payload of the last right row of its group at or before its time.

    The left side's distinct times and the right rows are cut into blocks of about equal size by sampled ranges of (group,
    time), whatever kind of time it is and however large a group or how many rows share a time; inside a block, a running `last` answers each
    time, and a row for each group and block carries the last payload on. Answers then meet the left rows by an equi-join, in parts
    where more than hot_rows rows ask for one group and time. Unmatched left rows, those without a time too, keep null payloads;
    of right rows of one time, that of the greatest hash counts. payload names must not be columns of left.
    """
    group = [f"_by{i}" for i in range(len(by))]
    kind = left.select(left_time).union(right.select(right_time)).schema[0].dataType
    # every column of left travels in a struct, so names cannot clash
    l = left.select(*[F.col(c).alias(g) for c, g in zip(by, group, strict=True)], F.col(left_time).cast(kind).alias("_t"), F.struct(*left.columns).alias("_row"))  # noqa: E741
    r = right.select(*[F.col(c).alias(g) for c, g in zip(by, group, strict=True)], F.col(right_time).cast(kind).alias("_t"), F.struct(*payload).alias("_payload")).where(F.col("_t").isNotNull())
    hashed = not any("map<" in t for _, t in r.select("_payload.*").dtypes)
    r = r.withColumn("_side", F.lit(0)).withColumn("_tie", F.xxhash64("_payload") if hashed else F.lit(0).cast("long"))
    times = materialize(l.groupBy(*group, "_t").agg(F.count("*").alias("_n")), "times")
    both = r.unionByName(times.drop("_n").withColumns({"_side": F.lit(1), "_tie": F.lit(0).cast("long")}), allowMissingColumns=True)
    blocks = materialize(both.repartitionByRange(*group, "_t", "_side", "_tie").withColumn("_block", F.spark_partition_id()), "blocks")

    ends = blocks.where("_side = 0").groupBy(*group, "_block").agg(F.max_by("_payload", F.struct("_t", "_tie")).alias("_end"))
    spans = blocks.select(*group, "_block").distinct()  # the blocks that a group reaches over
    same = lambda one, other, names: reduce(and_, [one[c].eqNullSafe(other[f"{c}_"]) for c in names])
    named = lambda df, names: df.select(*[F.col(c).alias(f"{c}_") for c in names], *[c for c in df.columns if c not in names])
    ended = named(ends, [*group, "_block"])
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(ended, same(spans, ended, [*group, "_block"]), "left").select(*group, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    order = Window.partitionBy(*group, "_block").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    asked = blocks.withColumn("_last", F.last("_payload", ignorenulls=True).over(order)).where("_side = 1").select(*group, "_block", "_t", "_last")
    carried = named(carried, [*group, "_block"])
    answers = asked.join(carried, same(asked, carried, [*group, "_block"]), "left").select(*group, "_t", F.coalesce("_last", "_carried").alias("_last"))

    # parts for times that many rows ask for: there are as many such times as hot_rows go into the left side at most
    hot = times.where(F.col("_n") > hot_rows).select(*group, "_t", F.ceil(F.col("_n") / hot_rows).cast("long").alias("_parts"))
    if hot.isEmpty():
        l, answers = l.withColumn("_part", F.lit(0).cast("long")), answers.withColumn("_part", F.lit(0).cast("long"))  # noqa: E741
    else:
        parts = broadcast_if_small(named(hot, [*group, "_t"]))
        split = lambda df: df.join(parts, same(df, parts, [*group, "_t"]), "left")
        l = split(l).select(*group, "_t", "_row", F.coalesce(F.pmod(F.monotonically_increasing_id(), "_parts"), F.lit(0)).alias("_part"))  # noqa: E741
        answers = split(answers).select(*group, "_t", "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
    answers = named(answers, [*group, "_t", "_part"])
    found = l.join(answers, same(l, answers, [*group, "_t", "_part"]), "left")
    return found.select("_row.*", *[F.col("_last")[c].alias(c) for c in payload])


def with_previous(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with the value of the row before each row of its group, by the column order; null for a group's first row.

    Rows are cut into blocks by sampled ranges of (group, order), and a row for each group and block carries its last value on, so no
    task sorts a whole group. Of rows with equal order, any may come first.
    """
    blocks = materialize(df.repartitionByRange(*by, order).withColumn("_block", F.spark_partition_id()), "ordered")
    ends = blocks.groupBy(*by, "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_end"))
    carried = ends.select(*[F.col(c).alias(f"{c}_") for c in by], F.col("_block").alias("_b"), F.lag("_end").over(Window.partitionBy(*by).orderBy("_block")).alias("_carried"))
    inside = Window.partitionBy(*by, "_block").orderBy(order)
    rows = blocks.withColumns({"_n": F.row_number().over(inside), "_before": F.lag(value).over(inside)})
    same = reduce(and_, [rows[c].eqNullSafe(carried[f"{c}_"]) for c in by]) & (rows["_block"] == carried["_b"])
    out = rows.join(carried, same, "left")
    return out.select(*df.columns, F.when(F.col("_n") == 1, F.col("_carried")["v"]).otherwise(F.col("_before")).alias(name))


def hashed_rank(df: DataFrame, by: list[str], key: Column, name: str) -> DataFrame:
    """A 0-based rank of each row inside its `by` group, in the order of a 64-bit hash of key; ties are broken by chance.

    Ranks come from counts of 4096 hash ranges and row numbers inside them, so that no task sorts a group.
    """
    df = df.withColumn("_hash", F.xxhash64(key)).withColumn("_part", F.shiftright("_hash", 52))
    counts = df.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_part").orderBy("_hash")
    return df.withColumn("_in", F.row_number().over(inside) - 1).join(counts, [*by, "_part"]).withColumn(name, F.col("_ahead") + F.col("_in")).drop("_hash", "_part", "_ahead", "_in")
