"""As-of lookup of features and scoring of request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.columns import latest_as_of, round_digits


def asof_lookup(requests: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """requests (request_id, ticker, as_of) with the latest feature row at or before as_of, tickers in any case; nulls if none.

    feature_date says which row matched.
    """
    left = requests.withColumn("_key", F.upper(F.trim("ticker")))
    right = features.select(F.upper(F.trim("ticker")).alias("_key"), F.col("date").alias("feature_date"), *columns)
    return latest_as_of(left, right, ["_key"], "as_of", "feature_date", ["feature_date", *columns]).drop("_key")


def unknown_tickers(requests: DataFrame, known: DataFrame) -> DataFrame:
    """(ticker, requests): requested tickers, in upper case, that aren't known."""
    names = known.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return requests.select(F.upper(F.trim("ticker")).alias("ticker")).join(names, "ticker", "left_anti").groupBy("ticker").agg(F.count("*").alias("requests"))


def check_schema(requests: DataFrame, features: list[str], strict: bool = True, optional: list[str] | None = None) -> DataFrame:
    """requests (with a map column `features`) plus missing, extra and ok. Not strict: optional names may be missing, others extra."""
    names = F.array(*[F.lit(f) for f in features])
    missing = F.array_except(names, F.map_keys("features"))
    if not strict and optional:
        missing = F.array_except(missing, F.array(*[F.lit(f) for f in optional]))
    extra = F.array_except(F.map_keys("features"), names)
    out = requests.withColumn("missing", F.sort_array(F.coalesce(missing, names))).withColumn("extra", F.sort_array(F.coalesce(extra, F.array().cast("array<string>"))))
    ok = F.size("missing") == 0
    return out.withColumn("ok", ok & (F.size("extra") == 0) if strict else ok)


def feature_vector(features: Column, names: list[str]) -> Column:
    """A map's values in the trained order; what is missing, null or NaN counts as 0."""
    value = lambda n: F.try_element_at(features, n)
    return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.when(~F.isnan(value(n)), value(n)), F.lit(0.0)))


def linear_score(vector: Column, intercept: float, coefficients: list[float]) -> Column:
    parts = F.zip_with(vector, F.array(*[F.lit(float(c)) for c in coefficients]), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(float(intercept)), lambda a, b: a + b)


def with_confidence(df: DataFrame, prediction: Column) -> DataFrame:
    """df with prediction (6 digits) and confidence 0.5 + 0.5 * (1 - min(1, |prediction|)) (4 digits)."""
    confidence = 0.5 + 0.5 * (1 - F.least(F.lit(1.0), F.abs(prediction)))
    return df.withColumn("prediction", round_digits(prediction, 6)).withColumn("confidence", round_digits(confidence, 4))


def score_requests(requests: DataFrame, features: DataFrame, columns: list[str], prediction: Column) -> DataFrame:
    """Requests with prediction and confidence from their as-of features; status is ok or no_features."""
    found = asof_lookup(requests, features, columns)
    matched = F.col("feature_date").isNotNull()
    out = with_confidence(found, F.when(matched, prediction)).withColumn("status", F.when(matched, "ok").otherwise("no_features"))
    return out.select(*requests.columns, "feature_date", "prediction", "confidence", "status")


def prediction_options(features: DataFrame) -> DataFrame:
    """(ticker, dates): the sorted distinct dates of each ticker, in upper case."""
    return features.groupBy(F.upper("ticker").alias("ticker")).agg(F.sort_array(F.collect_set("date")).alias("dates"))


def filter_predictions(preds: DataFrame, ticker: str | None = None, model: str | None = None) -> DataFrame:
    if ticker is not None:
        preds = preds.where(F.upper("ticker") == ticker.strip().upper())
    return preds if model is None else preds.where(F.col("model_name") == model)


def price_slice(prices: DataFrame, ticker: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A ticker's prices in the inclusive range, ascending; plain comparisons, so that they reach the scan."""
    from panelflow.operators.features import clip_dates

    return clip_dates(prices.where(F.col("ticker") == ticker), start, end).orderBy("date")
