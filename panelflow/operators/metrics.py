"""Evaluation metrics of long predictions (y_true, y_pred), by any keys, in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.columns import round_digits
from panelflow.schemas import METRICS


def _nan() -> Column:
    return F.lit(float("nan"))


def compute_metrics(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mse, rmse, mae, r2, directional_accuracy, ic and n_samples of each group.

    Rows with a null on either side don't count. r2 is NaN for a constant truth; ic is 0 if either side is constant; the
    direction of 0 only matches 0. Without keys an empty input gives one row: NaN, ic 0, n_samples 0.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    err = p - y
    n = F.count("*")
    flat = (F.min(y) == F.max(y)) | (F.min(p) == F.max(p))
    rows = preds.where(y.isNotNull() & p.isNotNull())
    out = rows.groupBy(*(by or [])).agg(
        round_digits(F.avg(err * err), 10).alias("mse"),
        round_digits(F.sqrt(F.avg(err * err)), 10).alias("rmse"),
        round_digits(F.avg(F.abs(err)), 10).alias("mae"),
        round_digits(F.when(F.var_pop(y) > 0, 1 - F.try_divide(F.avg(err * err), F.var_pop(y))), 10).alias("r2"),
        round_digits(F.avg((F.signum(y) == F.signum(p)).cast("double")), 6).alias("directional_accuracy"),
        round_digits(F.when(~flat, F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))), 6).alias("ic"),
        n.alias("n_samples"),
    )
    return out.withColumns({c: F.coalesce(c, F.lit(0.0) if c == "ic" else _nan()) for c in METRICS})


def aggregate_folds(fold_metrics: DataFrame) -> DataFrame:
    """(model_name, metric, mean, std) over folds: NaN left out, population standard deviation."""
    values = fold_metrics.withColumn("n_samples", F.col("n_samples").cast("double")).unpivot(["model_name", "fold_id"], [*METRICS, "n_samples"], "metric", "value")
    values = values.where("value IS NOT NULL AND NOT isnan(value)")
    return values.groupBy("model_name", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def pooled_metrics(preds: DataFrame, n_folds: int) -> DataFrame:
    """Metrics over all folds together; models that missed a fold are left out."""
    complete = preds.groupBy("model_name").agg(F.count_distinct("fold_id").alias("folds")).where(F.col("folds") == n_folds).select("model_name")
    return compute_metrics(preds.join(complete, "model_name", "left_semi"), ["model_name"])
