"""Walk-forward backtest. Fold tables have a row for each window of test dates, so they are bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import broadcast_if_small
from panelflow.operators import baselines, least_squares
from panelflow.operators.metrics import compute_metrics
from panelflow.schemas import PRICE_FEATURES, TARGET
from panelflow.session import materialize


def fold_map(test: DataFrame, fold_size: int, step: int) -> DataFrame:
    """(date, fold_id): the windows of distinct test dates that each date is in. Fold k starts at date k * step.

    Dates may be in several folds (step below fold_size) or in none; trailing windows may be short.
    """
    dates = test.select("date").where("date IS NOT NULL").distinct()
    i = F.row_number().over(Window.orderBy("date")) - 1  # a row a day, so one task
    lo, hi = F.greatest(F.ceil((i - fold_size + 1) / step), F.lit(0)), F.floor(i / step)
    folds = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return dates.withColumn("folds", folds.cast("array<int>")).select("date", F.explode("folds").alias("fold_id"))


def one_per_date(test: DataFrame) -> DataFrame:
    """The first ticker's row of each date."""
    return test.withColumn("_rn", F.row_number().over(Window.partitionBy("date").orderBy("ticker"))).where("_rn = 1").drop("_rn")


def fold_table(train: DataFrame, test: DataFrame, folds: DataFrame, min_train: int = 0, embargo: int = 0) -> DataFrame:
    """(fold_id, train_start, train_end, n_train_dates, test_start, test_end): train dates are those of train and test before
    test_start (less the last `embargo` of them); folds with fewer than min_train are left out, others keep their numbers."""
    spans = folds.groupBy("fold_id").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    dates = train.select("date").union(test.select("date")).where("date IS NOT NULL").distinct()
    dates = dates.withColumn("n", F.row_number().over(Window.orderBy("date")))
    # dates before test_start: one less than the place of test_start, as it is among the dates
    at = spans.join(dates.select(F.col("date").alias("test_start"), (F.col("n") - 1 - embargo).alias("n_train_dates")), "test_start")
    first = dates.where("n = 1").select(F.col("date").alias("train_start"))
    last = dates.select(F.col("date").alias("train_end"), F.col("n").alias("n_train_dates"))
    out = at.join(last, "n_train_dates", "left").crossJoin(first)  # one row
    return out.where((F.col("n_train_dates") >= min_train) & (F.col("n_train_dates") > 0)).select("fold_id", "train_start", "train_end", "n_train_dates", "test_start", "test_end")


def ols_per_fold(rows: DataFrame, folds: DataFrame, features: list[str] = PRICE_FEATURES) -> DataFrame:
    """(fold_id, coefficients): least squares on all rows up to each fold's train_end, from one scan (see least_squares)."""
    return least_squares.expanding_fits(rows, folds, "date", features)


def run(train: DataFrame, test: DataFrame, fold_size: int, step: int, min_train: int = 0, panel: str = "full", embargo: int = 0, horizon: int = 1, names: tuple[str, ...] = ("naive", "heuristic", "simple_ml"), fixed: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(fold table, long predictions). fixed: further models as expressions over test rows; they aren't refitted."""
    if panel == "one_per_date":
        test = one_per_date(test)
    windows = fold_map(test, fold_size, step)
    folds = fold_table(train, test, windows, min_train, embargo)
    placed = test.join(broadcast_if_small(windows.join(folds.select("fold_id"), "fold_id", "left_semi")), "date")
    models: dict[str, Column] = {}
    for name in names:
        if name == "naive":
            models[name] = F.lit(0.0)
        elif name == "heuristic":
            models[name] = F.coalesce(F.col("return_1d").cast("double"), F.lit(0.0))
        elif name == "simple_ml":
            fits = materialize(ols_per_fold(train.unionByName(test, allowMissingColumns=True), folds), "fits")
            placed = placed.join(broadcast_if_small(fits), "fold_id")
            x = F.array(F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in PRICE_FEATURES])
            models[name] = F.aggregate(F.zip_with("coefficients", x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        else:
            raise ValueError(f"no baseline {name}")
    return folds, baselines.to_long(placed, models | (fixed or {}), horizon)


def fold_metrics(preds: DataFrame) -> DataFrame:
    return compute_metrics(preds, ["fold_id", "model_name"])


def worst_windows(metrics: DataFrame, k: int = 5) -> DataFrame:
    """The k (fold, model) with the largest mse."""
    return metrics.where("NOT isnan(mse)").orderBy(F.col("mse").desc(), "fold_id", "model_name").limit(k)

