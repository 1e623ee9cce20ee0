"""A pooled regressor across entities, as a Spark ML pipeline, and its comparison with baselines."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.columns import round_digits
from panelflow.schemas import PRICE_FEATURES, TARGET


def fit_regressor(train: DataFrame, val: DataFrame | None, features: list[str] = PRICE_FEATURES, kind: str = "gbt", max_iter: int = 20, seed: int = 42) -> PipelineModel:
    """One-hot tickers (unseen: all zeros) and features to the target; gbt stops early on val, if given. Null features count as 0."""
    stages = [
        StringIndexer(inputCol="ticker", outputCol="_ticker", stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=["_ticker"], outputCols=["_hot"], handleInvalid="error", dropLast=True),
        VectorAssembler(inputCols=["_hot", *features], outputCol="_features"),
    ]
    rows = train.withColumn("_val", F.lit(False))
    if val is not None:
        rows = rows.unionByName(val.withColumn("_val", F.lit(True)), allowMissingColumns=True)
    rows = rows.where(F.col(TARGET).isNotNull()).fillna(0.0, features)
    if kind == "gbt":
        held_out = {} if val is None else {"validationIndicatorCol": "_val"}
        stages.append(GBTRegressor(featuresCol="_features", labelCol=TARGET, predictionCol="y_pred", maxIter=max_iter, maxDepth=3, seed=seed, **held_out))
    elif kind == "linear":
        rows = rows.where("NOT _val")
        stages.append(LinearRegression(featuresCol="_features", labelCol=TARGET, predictionCol="y_pred", solver="normal", regParam=0.0))
    else:
        raise ValueError(f"no regressor {kind}")
    return Pipeline(stages=stages).fit(rows)


def staged_curve(rows: DataFrame, stages: list[Column], target: str = TARGET) -> DataFrame:
    """(iteration, mse, mae, n) of prefix ensembles, counted from 1, in one pass: stages[k] is the prediction after k + 1 iterations."""
    errors = F.transform(F.array(*stages), lambda p: p - F.col(target).cast("double"))
    each = rows.where(F.col(target).isNotNull()).select(F.posexplode(errors).alias("k", "e"))
    return each.groupBy((F.col("k") + 1).alias("iteration")).agg(F.avg(F.col("e") ** 2).alias("mse"), F.avg(F.abs("e")).alias("mae"), F.count("*").alias("n"))


def early_stop(losses: list[float], patience: int) -> tuple[int, int]:
    """(best, last) iteration, counted from 1: training ends after `patience` iterations without a lesser loss, and the best one is kept."""
    best = 0
    for k, loss in enumerate(losses):
        if k == 0 or loss < losses[best]:
            best = k
        elif k - best >= patience:
            return best + 1, k + 1
    return (best + 1, len(losses)) if losses else (0, 0)


def _marked(curve: DataFrame, patience: int) -> tuple[DataFrame, int]:
    """curve with best and trained (whether early stopping would have reached the iteration), and the best iteration."""
    rows = sorted(curve.collect(), key=lambda r: r["iteration"])  # a row an iteration
    best, last = early_stop([r["mse"] for r in rows], patience)
    table = curve.sparkSession.createDataFrame([(*r, r["iteration"] == best, r["iteration"] <= last) for r in rows], "iteration int, mse double, mae double, n long, best boolean, trained boolean")
    return table, best


@dataclass
class StagedModel:
    """A boosted model cut after its best iteration: feature stages, trees and their weights."""

    stages: PipelineModel
    trees: list
    weights: list[float]
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with y_pred."""
        out = with_stages(self, df)
        return out.withColumn("y_pred", _prefix(self.weights)[-1]).drop("_ticker", "_hot", "_features", *[f"_t{k}" for k in range(len(self.trees))])


def _prefix(weights: list[float]) -> list[Column]:
    parts = [F.lit(float(w)) * F.col(f"_t{k}") for k, w in enumerate(weights)]
    return list(accumulate(parts))


def with_stages(model: StagedModel, df: DataFrame) -> DataFrame:
    """df with each tree's own prediction, one narrow step after another."""
    out = model.stages.transform(df.fillna(0.0, model.features))
    for k, tree in enumerate(model.trees):
        out = tree.copy().setPredictionCol(f"_t{k}").setFeaturesCol("_features").transform(out)
    return out


def fit_staged(train: DataFrame, val: DataFrame, features: list[str] = PRICE_FEATURES, max_iter: int = 20, patience: int = 3, seed: int = 42) -> tuple[StagedModel, DataFrame]:
    """Boosted trees on train, and the table of their losses on val (iteration, mse, mae, n, best, trained). The model keeps the trees up
    to the best iteration: what training with `patience` would have kept, as later trees don't change earlier ones."""
    fitted = fit_regressor(train, None, features, "gbt", max_iter, seed)
    boosted = fitted.stages[-1]
    whole = StagedModel(PipelineModel(fitted.stages[:-1]), list(boosted.trees), list(boosted.treeWeights), features)
    curve, best = _marked(staged_curve(with_stages(whole, val), _prefix(whole.weights)), patience)
    return StagedModel(whole.stages, whole.trees[:best], whole.weights[:best], features), curve


def fit_boosted_linear(train: DataFrame, val: DataFrame, features: list[str] = PRICE_FEATURES, max_iter: int = 40, rate: float = 0.3, patience: int = 3) -> tuple[list[list[float]], DataFrame]:
    """Componentwise boosting of a linear model: each iteration adds `rate` times the one-feature fit of the residual that lowers its sum
    of squares most. Returns the coefficients (intercept first) after each iteration up to the best one on val, and the table of losses.

    train is read once for its moments, val once for all iterations; null features count as 0.
    """
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    known = train.where(F.col(TARGET).isNotNull())
    k = len(x)
    sums = [F.avg(c) for c in x] + [F.avg(TARGET)] + [F.covar_pop(x[i], x[j]) for i in range(k) for j in range(k)] + [F.covar_pop(c, F.col(TARGET)) for c in x]
    got = known.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    values = [float(v or 0.0) for v in got]
    mean, y, size, c = values[:k], values[k], [values[k + 1 + i * k : k + 1 + (i + 1) * k] for i in range(k)], values[k + 1 + k * k :]
    slope, path = [0.0] * k, []
    for _ in range(max_iter):
        gain = [c[j] ** 2 / size[j][j] if size[j][j] > 0 else 0.0 for j in range(k)]
        j = max(range(k), key=gain.__getitem__)
        step = rate * c[j] / size[j][j] if gain[j] > 0 else 0.0
        slope = [b + step * (i == j) for i, b in enumerate(slope)]
        c = [c[i] - step * size[i][j] for i in range(k)]
        path.append([y - sum(b * m for b, m in zip(slope, mean, strict=True)), *slope])
    stages = [sum((F.lit(b) * c for b, c in zip(p[1:], x, strict=True)), F.lit(p[0])) for p in path]
    curve, best = _marked(staged_curve(val, stages), patience)
    return path[:best], curve


def score(model: PipelineModel | StagedModel, df: DataFrame, features: list[str] = PRICE_FEATURES) -> DataFrame:
    """df with y_pred."""
    if isinstance(model, StagedModel):
        return model.transform(df)
    return model.transform(df.fillna(0.0, features)).drop("_ticker", "_hot", "_features")


def baseline_deltas(metrics: DataFrame, model: str) -> DataFrame:
    """(baseline, mae_delta, rmse_delta): the model's error less each baseline's."""
    mine = metrics.where(F.col("model_name") == model).select(F.col("mae").alias("m_mae"), F.col("rmse").alias("m_rmse"))
    others = metrics.where(F.col("model_name") != model)
    return others.crossJoin(mine).select(F.col("model_name").alias("baseline"), round_digits(F.col("m_mae") - F.col("mae"), 10).alias("mae_delta"), round_digits(F.col("m_rmse") - F.col("rmse"), 10).alias("rmse_delta"))
