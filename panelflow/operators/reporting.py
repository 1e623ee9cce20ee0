"""Tables for charts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.columns import latest_as_of, round_digits
from panelflow.schemas import METRICS


def metrics_long(metrics: DataFrame, ids: list[str], digits: int = 6) -> DataFrame:
    """(ids, metric, value): null and NaN left out."""
    long = metrics.unpivot(ids, METRICS, "metric", "value").where("value IS NOT NULL AND NOT isnan(value)")
    return long.withColumn("value", round_digits(F.col("value"), digits))


def fold_metrics_table(metrics: DataFrame, folds: DataFrame) -> DataFrame:
    """A row for each fold, model and metric, with the fold's test window."""
    return metrics_long(metrics, ["fold_id", "model_name"]).join(F.broadcast(folds.select("fold_id", "test_start", "test_end")), "fold_id")  # a row a fold


def mean_std_rows(aggregates: DataFrame, digits: int = 6) -> DataFrame:
    rows = aggregates.where("mean IS NOT NULL AND NOT isnan(mean)")
    return rows.select("model_name", "metric", round_digits(F.col("mean"), digits).alias("mean"), round_digits(F.col("std"), digits).alias("std"))


def series_long(preds: DataFrame, ticker: str) -> DataFrame:
    """(target_date, series, value): the truth once a date, and each model's prediction."""
    mine = preds.where(F.col("ticker") == ticker)
    truth = mine.groupBy("target_date").agg(F.max("y_true").alias("value")).select("target_date", F.lit("y_true").alias("series"), "value")
    return truth.unionByName(mine.select("target_date", F.col("model_name").alias("series"), F.col("y_pred").alias("value")))


def error_series(preds: DataFrame, ticker: str) -> DataFrame:
    return preds.where(F.col("ticker") == ticker).select("target_date", "model_name", (F.col("y_pred") - F.col("y_true")).alias("error"))


def price_overlay(preds: DataFrame, prices: DataFrame, ticker: str) -> DataFrame:
    """The ticker's prices inside the range of its prediction dates."""
    span = preds.where(F.col("ticker") == ticker).agg(F.min("target_date").alias("lo"), F.max("target_date").alias("hi"))  # one row
    return prices.where(F.col("ticker") == ticker).join(F.broadcast(span), (F.col("date") >= F.col("lo")) & (F.col("date") <= F.col("hi"))).drop("lo", "hi")


def implied_price(requests: DataFrame, prices: DataFrame, prediction: str = "prediction") -> DataFrame:
    """requests (ticker, as_of, prediction) with the last price at or before as_of and that price times (1 + prediction)."""
    p = prices.select("ticker", F.col("date").alias("price_date"), F.col("adjusted_close").alias("last_price"))
    out = latest_as_of(requests, p, ["ticker"], "as_of", "price_date", ["price_date", "last_price"])
    return out.withColumn("implied_price", F.col("last_price") * (1 + F.col(prediction)))


def filter_values(preds: DataFrame) -> DataFrame:
    """(kind, value): the tickers, models and folds there are."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("ticker", "ticker"), ("model", "model_name"), ("fold", "fold_id"))]))
    return preds.select(each.alias("r")).select("r.*").distinct()
