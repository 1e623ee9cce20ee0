"""Window features by rows of an entity: one partitioning and one sort for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelflow.functions.columns import ratio, round_digits
from panelflow.schemas import PRICE_FEATURES, TARGET


def by_entity(*extra: str) -> WindowSpec:
    return Window.partitionBy("ticker", *extra).orderBy("date")


def simple_return(price: Column, rows: int, w: WindowSpec) -> Column:
    return ratio(price, F.lag(price, rows).over(w)) - 1


def forward_return(price: Column, rows: int, w: WindowSpec) -> Column:
    return ratio(F.lead(price, rows).over(w), price) - 1


def rolling_std(value: Column, rows: int, w: WindowSpec) -> Column:
    """Sample standard deviation of the last `rows` values; null unless all are there."""
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) >= rows, F.stddev_samp(value).over(frame))


def range_hl() -> Column:
    return ratio(F.col("high") - F.col("low"), F.col("close"))


def volume_pct(w: WindowSpec) -> Column:
    """Relative change of volume, null counted as 0; 0 for the first row and 0 after 0, infinite for a rise from 0."""
    now = F.coalesce("volume", F.lit(0)).cast("double")
    was = F.lag(now).over(w)
    return F.when(was.isNull() | ((was == 0) & (now == 0)), 0.0).when(was == 0, F.signum(now) * F.lit(float("inf"))).otherwise(ratio(now, was) - 1)


def pad_forward(price: Column, w: WindowSpec) -> Column:
    """Nulls replaced by the last value before them."""
    return F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def round_features(df: DataFrame, columns: list[str], digits: int = 10) -> DataFrame:
    return df.withColumns({c: round_digits(F.col(c), digits) for c in columns})


def clip_dates(df: DataFrame, start: str | None, end: str | None, date: str = "date") -> DataFrame:
    """Rows in the inclusive range; applied after windows, so that they still see what lies before it."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def _blocks(df: DataFrame, rows: int, before: int, after: int) -> DataFrame:
    """Each entity's rows cut into blocks of `rows`, with copies of the neighbours that windows reach (_own is false for these).

    _pos is a row's 1-based place in its entity, from row counts of its years and its place in the year.
    """
    year = F.year("date")
    counts = df.withColumn("_year", year).groupBy("ticker", "_year").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("ticker").orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("ticker", "_year", ahead.alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("ticker", "_year").orderBy("date"))
    df = df.withColumn("_year", year).withColumn("_in", place).join(counts, ["ticker", "_year"]).withColumn("_pos", F.col("_ahead") + F.col("_in")).drop("_year", "_in", "_ahead")
    first, last = F.floor((F.col("_pos") - 1 - after) / rows), F.floor((F.col("_pos") - 1 + before) / rows)
    df = df.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return df.withColumn("_own", F.floor((F.col("_pos") - 1) / rows) == F.col("_block"))


def _padded_by_year(df: DataFrame) -> DataFrame:
    """df with _price, adjusted_close padded forward, by years of an entity: a row a year carries the last value on."""
    df = df.withColumn("_year", F.year("date"))
    p = F.col("adjusted_close")
    ends = df.groupBy("ticker", "_year").agg(F.max_by(p, F.when(p.isNotNull(), F.col("date"))).alias("_end"))
    earlier = Window.partitionBy("ticker").orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("ticker", "_year", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("ticker", "_year").orderBy("date")
    return df.join(ends, ["ticker", "_year"]).withColumn("_price", F.coalesce(pad_forward(p, inside), "_carried")).drop("_year", "_carried")


def price_features(df: DataFrame, lookback: int = 21, horizon: int = 1, date_range: tuple[str | None, str | None] | None = None, pad: bool = False, halo_rows: int | None = None) -> DataFrame:
    """(ticker, date, features, target); the first `lookback` rows of an entity and rows without target are dropped.

    pad: take returns over prices padded forward. halo_rows: cut long series into blocks of so many rows (at least
    `lookback` and `horizon`) for parallelism beyond the number of entities; results are the same.
    """
    if halo_rows is not None:
        if halo_rows < max(lookback, horizon):
            raise ValueError("blocks must hold a window")
        df = _padded_by_year(df) if pad else df.withColumn("_price", F.col("adjusted_close"))
        df, w = _blocks(df, halo_rows, 2 * lookback, horizon), by_entity("_block")
    else:
        w = by_entity()
        price = pad_forward(F.col("adjusted_close"), w) if pad else F.col("adjusted_close")
        df = df.withColumn("_price", price).withColumn("_pos", F.row_number().over(w)).withColumn("_own", F.lit(True))
    p = F.col("_price")
    df = df.select(
        "ticker", "date", "_pos", "_own", *(["_block"] if halo_rows is not None else []),
        simple_return(p, 1, w).alias("return_1d"), simple_return(p, 5, w).alias("return_5d"), simple_return(p, lookback, w).alias("return_21d"),
        range_hl().alias("range_hl"), volume_pct(w).alias("volume_pct_1d"), forward_return(F.col("adjusted_close"), horizon, w).alias(TARGET),
    )
    r1 = F.col("return_1d")
    df = df.withColumns({"volatility_5d": rolling_std(r1, 5, w), "volatility_21d": rolling_std(r1, lookback, w)})
    df = df.where(F.col("_own") & (F.col("_pos") > lookback) & F.col(TARGET).isNotNull())
    df = clip_dates(df, *(date_range or (None, None)))
    return round_features(df.select("ticker", "date", *PRICE_FEATURES, TARGET), [*PRICE_FEATURES, TARGET])


def row_accounting(prices: DataFrame, features: DataFrame) -> DataFrame:
    """(rows_in, rows_out, rows_dropped)."""
    n = prices.agg(F.count("*").alias("rows_in")).crossJoin(features.agg(F.count("*").alias("rows_out")))
    return n.withColumn("rows_dropped", F.col("rows_in") - F.col("rows_out"))
