"""Baselines, and the linear model from sums of products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.schemas import PRICE_FEATURES, TARGET


def _filled(features: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]


def moments(features: list[str] = PRICE_FEATURES, target: str = TARGET) -> list[Column]:
    """Aggregates n, xx_i_j and xy_i that determine a least-squares fit with intercept; they add up over any parts."""
    x = _filled(features)
    out = [F.count("*").alias("n")]
    out += [F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return out + [F.sum(x[i] * F.col(target)).alias(f"xy_{i}") for i in range(len(x))]


def solve(sums: dict, n_features: int) -> list[float]:
    """Intercept and coefficients of least norm from the moments; zeros without rows."""
    k = n_features + 1
    if not sums.get("n"):
        return [0.0] * k
    xx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = sums[f"xx_{i}_{j}"]
    xy = np.array([sums[f"xy_{i}"] for i in range(k)])
    size = np.sqrt(np.maximum(np.diag(xx), 1e-300))  # columns of like size, for a sound rank
    return list(np.linalg.pinv(xx / np.outer(size, size), rcond=1e-10, hermitian=True) @ (xy / size) / size)


def fit_ols(train: DataFrame, features: list[str] = PRICE_FEATURES, target: str = TARGET) -> list[float]:
    row = train.where(F.col(target).isNotNull()).agg(*moments(features, target)).first()
    return solve(row.asDict(), len(features))


def linear(coefficients: list[float], features: list[str] = PRICE_FEATURES) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, x in zip(coefficients[1:], _filled(features)[1:], strict=True):
        out = out + F.lit(float(c)) * x
    return out


def predict(train: DataFrame, test: DataFrame, names: tuple[str, ...] = ("naive", "heuristic", "simple_ml"), naive: str = "zero", horizon: int = 1, fold_id: int = -1, trading_days: bool = False) -> DataFrame:
    """Long predictions: a row for each test row and baseline.

    naive: 0, or the mean target of train; heuristic: the last one-day return (null counts as 0); simple_ml: least squares on
    train. target_date is `horizon` calendar days on, or with trading_days the entity's row that far on.
    """
    value: dict[str, Column] = {}
    for name in names:
        if name == "naive" and naive == "zero":
            value[name] = F.lit(0.0)
        elif name == "naive":
            value[name] = F.lit(float(train.agg(F.avg(TARGET)).first()[0] or 0.0))
        elif name == "heuristic":
            value[name] = F.coalesce(F.col("return_1d").cast("double"), F.lit(0.0))
        elif name == "simple_ml":
            value[name] = linear(fit_ols(train))
        else:
            raise ValueError(f"no baseline {name}")
    return to_long(test, value, horizon, fold_id, trading_days)


def to_long(test: DataFrame, models: dict[str, Column], horizon: int = 1, fold_id: int = -1, trading_days: bool = False) -> DataFrame:
    """(ticker, asof_date, target_date, y_true, y_pred, model_name, fold_id): test rows times models, in one pass."""
    from panelflow.operators.features import by_entity

    on = F.lead("date", horizon).over(by_entity()) if trading_days else F.date_add("date", horizon)
    test = test.withColumn("target_date", on)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), p.alias("y_pred")) for m, p in models.items()]))
    fold = F.col("fold_id") if "fold_id" in test.columns else F.lit(fold_id)
    rows = test.select("ticker", F.col("date").alias("asof_date"), "target_date", F.col(TARGET).alias("y_true"), fold.cast("int").alias("fold_id"), each.alias("m"))
    return rows.select("ticker", "asof_date", "target_date", "y_true", F.col("m.y_pred").alias("y_pred"), F.col("m.model_name").alias("model_name"), "fold_id")
