"""Features, splits, sentiment, metrics, baselines, walk-forward and serving on small tables."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.functions.columns import latest_as_of, round_digits
from panelflow.operators import baselines, encoders, features, importance, ingest, metrics, modeling, quality, reporting, sentiment, serving, splits, walkforward
from panelflow.schemas import PRICE_FEATURES, TARGET
from panelflow.sources import tables
from panelflow.streaming import jobs

D = dt.date
BOUNDS = {"train_end": "2024-01-24", "val_start": "2024-01-25", "val_end": "2024-01-26", "test_start": "2024-01-27"}


def test_features_of_a_trend(trend):
    out = features.price_features(trend()).orderBy("date").collect()
    assert len(out) == 30 - 21 - 1
    first = out[0]
    assert first["date"] == D(2024, 1, 22)
    assert first["return_1d"] == pytest.approx(110.5 / 110 - 1, abs=1e-9)
    assert first["return_21d"] == pytest.approx(110.5 / 100 - 1, abs=1e-9)
    assert first[TARGET] == pytest.approx(111 / 110.5 - 1, abs=1e-9)
    assert first["range_hl"] == pytest.approx(2 / 110.5, abs=1e-9)


def test_blocks_give_the_same_features(spark, trend):
    df = trend(120).withColumn("adjusted_close", F.col("close") + F.sin(F.col("close"))).unionByName(trend(70, "MSFT"))
    whole, blocks = (sorted(map(tuple, features.price_features(df, lookback=10, horizon=2, halo_rows=h).collect())) for h in (None, 15))
    assert whole == blocks and len(whole) == 190 - 2 * 12
    with pytest.raises(ValueError):
        features.price_features(df, halo_rows=3)


def test_blocks_pad_over_gaps_of_any_length(spark, trend):
    df = trend(500).withColumn("adjusted_close", F.when(~F.dayofyear("date").between(20, 110) & (F.dayofyear("date") < 330), F.col("close") + F.sin(F.col("close"))))
    df = df.unionByName(trend(40, "MSFT").withColumn("adjusted_close", F.lit(None).cast("double")))
    whole, blocks = (sorted(map(tuple, features.price_features(df, lookback=5, pad=True, halo_rows=h).collect()), key=str) for h in (None, 10))
    assert whole == blocks and len(whole) > 200
    # the first price after a gap of two months, which spans blocks and years, against the last one before it
    got = {(r["ticker"], r["date"]): r["return_1d"] for r in features.price_features(df, lookback=5, pad=True, halo_rows=10).collect()}
    now, was = (100 + i / 2 + math.sin(100 + i / 2) for i in (366, 328))
    assert got["AAPL", D(2025, 1, 1)] == pytest.approx(now / was - 1, abs=1e-9)


def test_future_prices_do_not_change_past_features(trend):
    df = trend(40)
    changed = df.withColumn("adjusted_close", F.when(F.col("date") > D(2024, 2, 5), F.col("adjusted_close") * 3).otherwise(F.col("adjusted_close")))
    before = [[tuple(r) for r in features.price_features(x).where("date < DATE'2024-02-05'").drop(TARGET).orderBy("date").collect()] for x in (df, changed)]
    assert before[0] == before[1] and before[0]


def test_volume_change_and_padding(spark):
    rows = [("A", D(2024, 1, i + 1), 1.0, 1.0, 1.0, 1.0, p, v) for i, (p, v) in enumerate([(10.0, None), (None, 0), (12.0, 5), (None, 10)])]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, adjusted_close double, volume bigint")
    w = features.by_entity()
    got = df.select("date", features.volume_pct(w).alias("v"), features.pad_forward(F.col("adjusted_close"), w).alias("p")).orderBy("date").collect()
    assert [r["v"] for r in got] == [0.0, 0.0, math.inf, 1.0]
    assert [r["p"] for r in got] == [10.0, 10.0, 12.0, 12.0]


def test_round_digits(spark):
    got = spark.createDataFrame([(0.125,), (-0.125,), (float("nan"),), (float("inf"),), (None,), (-1e-9,)], "x double").select(round_digits(F.col("x"), 2).alias("r")).collect()
    assert [got[0][0], got[1][0], got[3][0], got[4][0]] == [0.13, -0.13, math.inf, None] and math.isnan(got[2][0]) and str(got[5][0]) == "0.0"


def test_splits(trend):
    out = splits.assign_split(features.price_features(trend()), BOUNDS)
    assert {r["split"]: r["rows"] for r in splits.split_counts(out).collect()} == {"train": 3, "val": 2, "test": 3}
    gap = {**BOUNDS, "val_start": "2024-01-26", "val_end": "2024-01-26"}
    with pytest.raises(ValueError, match="gap"):
        splits.apply_split(features.price_features(trend()), gap)
    assert splits.apply_split(features.price_features(trend()), gap, mode="drop").count() == 7
    with pytest.raises(ValueError):
        splits.check_boundaries({**BOUNDS, "val_start": "2024-01-20"})
    with pytest.raises(ValueError):
        splits.check_boundaries({"train_end": "2024-01-01"})
    p = splits.provenance(out).first()
    assert (p["train_rows"], p["val_rows"], p["test_rows"], p["date_min"]) == (3, 2, 3, D(2024, 1, 22))


def test_sentiment_windows(spark):
    rows = [("A", "2024-01-10T12:00:00Z", 0.5, "a1"), ("A", "2024-01-11T09:00:00Z", -0.2, "a2"), ("A", "2024-01-11T14:00:00Z", 0.1, "a3"), ("A", "bad", 9.0, "a4"), ("A", "2024-01-12T00:00:00Z", 7.0, "a3")]
    news = tables.read_news(spark.createDataFrame(rows, "ticker string, publication_timestamp string, sentiment_score double, article_uuid string"))
    got = {r["date"]: r for r in sentiment.sentiment_features(news).collect()}
    assert (got[D(2024, 1, 10)]["sentiment_avg"], got[D(2024, 1, 10)]["sentiment_count"]) == (0.5, 1)
    assert got[D(2024, 1, 11)]["sentiment_avg"] == pytest.approx(0.4 / 3, abs=1e-9) and got[D(2024, 1, 11)]["sentiment_count"] == 3
    assert got[D(2024, 1, 11)]["sentiment_momentum"] == got[D(2024, 1, 11)]["sentiment_avg"] and len(got) == 2
    short = {r["date"]: r for r in sentiment.sentiment_features(news, lookback_days=1).collect()}
    assert short[D(2024, 1, 11)]["sentiment_momentum"] == pytest.approx(-0.05 - 0.5, abs=1e-9)
    none = spark.createDataFrame([("A", None, None, None)], "ticker string, publication_timestamp string, sentiment_score double, article_uuid string")
    assert sentiment.sentiment_features(tables.read_news(none)).count() == 0


def test_sentiment_attach(spark, trend):
    s = spark.createDataFrame([("AAPL", D(2024, 1, 3), 0.5, 2, 0.1)], "ticker string, date date, sentiment_avg double, sentiment_count bigint, sentiment_momentum double")
    plain = [r["sentiment_avg"] for r in sentiment.attach(trend(6), s).orderBy("date").collect()]
    recent = [r["sentiment_avg"] for r in sentiment.attach_asof(trend(6), s, 2).orderBy("date").collect()]
    assert plain == [0, 0, 0.5, 0, 0, 0] and recent == [0, 0, 0.5, 0.5, 0, 0]


def _pairs(spark, y, p):
    return spark.createDataFrame(list(zip(map(float, y), map(float, p), strict=True)), "y_true double, y_pred double")


def test_metrics(spark):
    m = metrics.compute_metrics(_pairs(spark, [0.01, -0.02, 0, 0.03], [0.01, 0.01, 0, 0.02])).first()
    assert m["n_samples"] == 4 and m["directional_accuracy"] == 0.75
    assert metrics.compute_metrics(_pairs(spark, [0.01, -0.01, 0.02], [0.02, 0.01, -0.01])).first()["directional_accuracy"] == pytest.approx(1 / 3, abs=1e-6)
    flat = metrics.compute_metrics(_pairs(spark, [1, 2, 3], [1, 1, 1])).first()
    assert flat["ic"] == 0 and math.isnan(metrics.compute_metrics(_pairs(spark, [1, 1], [1, 2])).first()["r2"])
    empty = metrics.compute_metrics(spark.createDataFrame([], "y_true double, y_pred double")).first()
    assert empty["n_samples"] == 0 and empty["ic"] == 0 and math.isnan(empty["mse"])
    rng = np.random.default_rng(3)
    y, p = rng.normal(size=50), rng.normal(size=50)
    got = metrics.compute_metrics(_pairs(spark, y, p)).first()
    assert got["mse"] == pytest.approx(((y - p) ** 2).mean(), abs=1e-9) and got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    assert got["ic"] == pytest.approx(np.corrcoef(y, p)[0, 1], abs=1e-6)


def _feature_rows(spark, dates, split, tickers=("A",), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(t, d, split, *map(float, rng.normal(size=8))) for d in dates for t in tickers]
    return spark.createDataFrame(rows, "ticker string, date date, split string, " + ", ".join(f"{c} double" for c in [*PRICE_FEATURES, TARGET]))


def test_baselines_and_ols(spark):
    train = _feature_rows(spark, [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)], "train")
    test = _feature_rows(spark, [D(2024, 4, 1), D(2024, 4, 2)], "test", seed=1)
    preds = baselines.predict(train, test)
    assert preds.count() == 6 and {r["fold_id"] for r in preds.collect()} == {-1}
    assert preds.where("model_name = 'naive'").agg(F.max(F.abs("y_pred"))).first()[0] == 0
    x = np.array([[1.0, *[r[c] for c in PRICE_FEATURES]] for r in train.collect()])
    y = np.array([r[TARGET] for r in train.collect()])
    assert baselines.fit_ols(train) == pytest.approx(list(np.linalg.lstsq(x, y, rcond=None)[0]), abs=1e-8)
    twin = train.withColumn("return_5d", F.col("return_1d"))  # collinear: least norm
    x[:, 2] = x[:, 1]
    assert baselines.fit_ols(twin) == pytest.approx(list(np.linalg.lstsq(x, y, rcond=None)[0]), abs=1e-6)
    assert baselines.fit_ols(train.limit(0)) == [0.0] * 8
    days = baselines.predict(train, test, ("naive",), trading_days=True).orderBy("asof_date").collect()
    assert [r["target_date"] for r in days] == [D(2024, 4, 2), None]


def test_walk_forward(spark):
    train = _feature_rows(spark, [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(14)], "train")
    test_days = [D(2024, 2, 1) + dt.timedelta(days=i) for i in range(15)]
    test = _feature_rows(spark, test_days, "test", tickers=("A", "B"), seed=2)
    folds, preds = walkforward.run(train, test, 5, 5, 5)
    f = folds.orderBy("fold_id").collect()
    assert len(f) == 3 and f[0]["train_end"] == D(2024, 1, 14) and f[1]["n_train_dates"] == 19 and f[2]["test_end"] == test_days[-1]
    assert preds.groupBy("fold_id", "model_name").count().where("count = 10").count() == 9
    one = walkforward.run(train, test, 5, 5, 5, names=("naive",), panel="one_per_date")[1]
    assert one.count() == 15
    assert walkforward.run(train, test, 5, 5, 16, names=("naive",))[0].count() == 2
    overlap = {r["fold_id"]: r["n"] for r in walkforward.fold_map(test, 6, 4).groupBy("fold_id").agg(F.count("*").alias("n")).collect()}
    assert overlap == {0: 6, 1: 6, 2: 6, 3: 3}
    gaps = {r["fold_id"]: r["n"] for r in walkforward.fold_map(test, 2, 6).groupBy("fold_id").agg(F.count("*").alias("n")).collect()}
    assert gaps == {0: 2, 1: 2, 2: 2}
    # refit of fold 1 equals least squares on all rows before it
    got = {r["fold_id"]: r["coefficients"] for r in walkforward.ols_per_fold(train.unionByName(test), folds).collect()}
    use = train.unionByName(test).where(F.col("date") < test_days[5]).collect()
    x = np.array([[1.0, *[r[c] for c in PRICE_FEATURES]] for r in use])
    assert got[1] == pytest.approx(list(np.linalg.lstsq(x, np.array([r[TARGET] for r in use]), rcond=None)[0]), abs=1e-8)
    m = walkforward.fold_metrics(preds)
    agg = {(r["model_name"], r["metric"]): r for r in metrics.aggregate_folds(m).collect()}
    assert agg["naive", "n_samples"]["mean"] == 10 and agg["naive", "n_samples"]["std"] == 0
    assert metrics.pooled_metrics(preds, 3).count() == 3 and metrics.pooled_metrics(preds.where("NOT (model_name = 'naive' AND fold_id = 0)"), 3).count() == 2
    assert walkforward.worst_windows(m, 2).count() == 2
    assert reporting.fold_metrics_table(m, folds).count() == m.count() * 6
    assert walkforward.run(train, test.limit(0), 5, 5, 5)[1].count() == 0


def test_encoders(spark):
    train = spark.createDataFrame([("B", 1.0, None), ("A", 3.0, None)], "ticker string, x double, y double")
    known = encoders.fit_one_hot(train)
    scaler = encoders.fit_scaler(train, ["x", "y"])
    assert known == ["A", "B"] and {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()} == {"x": (2.0, 1.0), "y": (0.0, 1.0)}
    out = encoders.apply(spark.createDataFrame([("C", 5.0, 1.0), ("B", None, None)], train.schema), known, scaler).collect()
    assert out[0]["vector"] == [0.0, 0.0, 3.0, 1.0] and out[1]["vector"] == [0.0, 1.0, -2.0, 0.0]


def test_regressor_and_deltas(spark):
    train = _feature_rows(spark, [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)], "train", ("A", "B"))
    val = _feature_rows(spark, [D(2024, 3, 1) + dt.timedelta(days=i) for i in range(10)], "val", ("A", "Z"), seed=4)
    for kind in ("linear", "gbt"):
        scored = modeling.score(modeling.fit_regressor(train, val, kind=kind, max_iter=3), val)
        assert scored.where("y_pred IS NULL OR isnan(y_pred)").count() == 0 and scored.count() == 20
    m = spark.createDataFrame([("m", 1.0, 2.0), ("naive", 0.5, 2.5)], "model_name string, mae double, rmse double")
    d = modeling.baseline_deltas(m, "m").first()
    assert (d["baseline"], d["mae_delta"], d["rmse_delta"]) == ("naive", 0.5, -0.5)


def test_permutation(spark):
    df = _feature_rows(spark, [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(50)], "val", ("A", "B"))
    dealt = importance.permute(df, "return_1d", ["ticker", "date"], seed=1)
    values = lambda x: [r["return_1d"] for r in x.orderBy("ticker", "date").collect()]
    assert sorted(values(dealt)) == sorted(values(df)) and values(dealt) != values(df)
    assert values(dealt) == values(importance.permute(df.repartition(7), "return_1d", ["ticker", "date"], seed=1))
    df = df.withColumn(TARGET, 3 * F.col("return_1d"))
    got = importance.permutation_importance(df, 3 * F.col("return_1d"), ["return_1d", "return_5d"], ["ticker", "date"]).collect()
    assert got[0]["feature"] == "return_1d" and got[0]["importance"] > 1 and got[1]["importance"] == pytest.approx(0)
    assert importance.evaluation_split(df).count() == 100


def test_serving(spark):
    f = spark.createDataFrame([("AAPL", D(2024, 1, 22), 1.0), ("AAPL", D(2024, 1, 25), 2.0)], "ticker string, date date, x double")
    r = spark.createDataFrame([("1", "aapl ", D(2024, 1, 24)), ("2", "AAPL", D(2024, 1, 1)), ("3", "XX", D(2024, 1, 26)), ("4", "AAPL", D(2024, 1, 25))], "request_id string, ticker string, as_of date")
    got = {x["request_id"]: x for x in serving.score_requests(r, f, ["x"], F.col("x") / 4).collect()}
    assert got["1"]["feature_date"] == D(2024, 1, 22) and (got["1"]["prediction"], got["1"]["confidence"]) == (0.25, 0.875)
    assert got["2"]["status"] == got["3"]["status"] == "no_features" and got["4"]["prediction"] == 0.5
    assert [(x["ticker"], x["requests"]) for x in serving.unknown_tickers(r, f).collect()] == [("XX", 1)]
    assert [x["dates"] for x in serving.prediction_options(f.union(f)).collect()] == [[D(2024, 1, 22), D(2024, 1, 25)]]
    maps = spark.createDataFrame([({"a": 1.0, "b": float("nan")},), ({"a": 1.0, "c": 2.0},), (None,)], "features map<string,double>")
    strict = serving.check_schema(maps, ["a", "b"]).collect()
    assert [x["ok"] for x in strict] == [True, False, False] and strict[1]["missing"] == ["b"] and strict[1]["extra"] == ["c"]
    assert [x["ok"] for x in serving.check_schema(maps, ["a", "b"], strict=False, optional=["b"]).collect()] == [True, True, False]
    assert [x[0] for x in maps.select(serving.feature_vector(F.col("features"), ["b", "a"])).collect()] == [[0.0, 1.0], [0.0, 1.0], [0.0, 0.0]]


def test_as_of_join_keeps_clashing_names(spark):
    left = spark.createDataFrame([("a", 5, 1)], "k string, t int, _side int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 6, "y"), ("a", None, "z")], "k string, u int, v string")
    assert [tuple(r) for r in latest_as_of(left, right, ["k"], "t", "u", ["v"]).collect()] == [("a", 5, 1, "x")]


def test_flatten_prices(spark):
    day = {"1. open": "187", "2. high": "190", "3. low": "", "4. close": "188.0", "5. volume": "1000000.7"}
    days = {"2024-01-02": day, "2024-01-03": {**day, "5. adjusted close": "94", "6. volume": "7"}, "2024-01-04": {**day, "4. close": ""}, "2024-01-05": {**day, "2. high": "n/a"}, "2024-01-06": {**day, "5. volume": ""}}
    raw = spark.createDataFrame([("A", json.dumps({"Time Series (Daily)": days})), ("B", "{}"), ("C", None)], "ticker string, payload string")
    got = {r["date"].day: r for r in ingest.flatten_daily_prices(raw).collect()}
    assert sorted(got) == [2, 3, 6] and got[2]["adjusted_close"] == 188.0 and got[2]["volume"] == 1000000 and got[2]["low"] is None
    assert (got[3]["adjusted_close"], got[3]["volume"], got[6]["volume"]) == (94.0, 7, None)


def test_flatten_news(spark):
    def article(uuid, title, *entities):
        return {"uuid": uuid, "title": title, "published_at": "2024-01-10T12:00:00Z", "entities": [{"symbol": s, "sentiment_score": v, "match_score": "2"} for s, v in entities]}

    page = {"data": [article("1", "t", ("aapl ", "0.5"), ("MSFT", "1")), article("2", "fallback", ("MSFT", "1")), article("3", "", ("MSFT", "1")), article("4", "t", ("AAPL", "bad"))]}
    raw = spark.createDataFrame([("AAPL", json.dumps(page)), ("AAPL", json.dumps({"pages": [page, page]}))], "ticker string, payload string")
    got = ingest.flatten_news(raw)
    assert got.count() == 9
    assert {(r["article_uuid"], r["sentiment_score"]) for r in got.collect()} == {("1", 0.5), ("2", None), ("4", None)}


def test_merge_history(spark, trend):
    old = trend(2)
    new = trend(2, start=D(2024, 1, 2)).withColumn("close", F.lit(101.6)).withColumn("high", F.lit(None).cast("double"))
    out = ingest.merge_history(old, new).orderBy("date").collect()
    assert [r["close"] for r in out] == [100.0, 101.6, 101.6] and out[1]["high"] is None
    s = ingest.merge_stats(old, new).first()
    assert (s["status"], s["new_rows"], s["total_rows"], s["date_max"]) == ("updated", 1, 3, D(2024, 1, 3))
    assert ingest.merge_stats(old.limit(0), new).first()["status"] == "created"
    twice = new.withColumn("n", F.lit(1)).unionByName(new.withColumn("close", F.lit(7.0)).withColumn("n", F.lit(2)))
    assert ingest.merge_history(old, twice, seq=F.col("n")).where("date = DATE'2024-01-03'").first()["close"] == 7.0


def test_quality(spark, trend, tmp_path):
    df = trend(3)
    assert quality.check_columns(df, ["ticker", "x"]) == ["x"]
    assert quality.check_dates(spark.createDataFrame([("2024-01-01",), ("01/02/2024",), (None,)], "d string"), "d").count("01/02/2024") == 1
    twice = df.union(df.limit(1))
    r = quality.duplicate_rows(twice).first()
    assert (r["rows"], r["keys"]) == (2, 1)
    with pytest.raises(ValueError, match="duplicate"):
        quality.assert_panel(twice)
    with pytest.raises(ValueError, match="missing"):
        quality.assert_panel(df.drop("date"))
    quality.assert_panel(df.limit(0))
    seq = spark.createDataFrame([("f", "A", 1, 1), ("f", "A", 2, 2), ("f", "B", 1, 2), ("f", "B", 2, 1), ("f", "C", 1, 1), ("f", "C", 2, 1), ("f", "D", 1, 1)], "file string, ticker string, s int, date int")
    assert {r["ticker"]: r["status"] for r in quality.ordering_status(seq, F.col("s"), F.col("file")).collect()} == {"A": "ascending", "B": "descending", "C": "unsorted", "D": "ascending"}
    nulls = spark.createDataFrame([("1", None), ("x", "2")], "a string, b string")
    assert {r["column"]: r["nulls"] for r in quality.numeric_nulls(nulls, ["a", "b"]).collect()} == {"a": 1, "b": 1}
    late = trend(2, start=D(2024, 1, 15))
    assert quality.cutoff_violations(df, late).count() == 2 and quality.cutoff_violations(df, df).count() == 0 and quality.cutoff_violations(df, trend(1, "ZZ")).count() == 1
    assert quality.sentiment_violations(late, df).count() == 2 and quality.sentiment_violations(trend(1, "ZZ"), df).count() == 0
    with pytest.raises(ValueError):
        quality.assert_empty(quality.cutoff_violations(df, late), "leak")
    assert quality.validation_summary(df, F.col("ticker")).count() == 2
    prints = [quality.dataset_fingerprint(x).first() for x in (df, df.repartition(3).orderBy(F.col("date").desc()), df.withColumn("volume", F.col("volume") + 1))]
    assert prints[0] == prints[1] != prints[2]
    quality.rewrite_sorted(df.orderBy(F.col("date").desc()), str(tmp_path / "sorted"))
    assert [r["date"].day for r in spark.read.parquet(str(tmp_path / "sorted")).collect()] == [1, 2, 3]
    m = quality.dataset_manifest(df, F.lit("all")).first()
    assert (m["rows"], m["tickers"]) == (3, "AAPL")


def test_versions(spark, trend, tmp_path):
    path = str(tmp_path / "features")
    df = splits.assign_split(features.price_features(trend()), BOUNDS)
    tables.write_features(df.limit(1), path, "v1", PRICE_FEATURES, TARGET)
    for _ in range(2):
        tables.write_features(df, path, "v2", PRICE_FEATURES, TARGET)
    assert tables.latest_version(spark, path) == "v2" and tables.latest_version(spark, path, "v1") == "v1"
    assert tables.read_version(spark, path).count() == 8 and tables.read_split(spark, path, "val").count() >= 2
    with pytest.raises(ValueError):
        tables.latest_version(spark, path, "v9")


def test_read_csv(spark, trend, tmp_path):
    trend(3).write.option("header", "true").csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_prices(spark, str(tmp_path / "csv"), "csv").collect())) == sorted(map(tuple, trend(3).collect()))


def test_stream_replays_merges(spark, tmp_path):
    def doc(close, *days):
        f = {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": close, "5. volume": "3"}
        return json.dumps({"Time Series (Daily)": {d: f for d in days}})

    landed, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for k, text in enumerate([doc("10", "2024-01-01", "2024-01-02"), doc("11", "2024-01-02", "2024-01-03")]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"ticker": "A", "payload": text}) + "\n")
        jobs.stream_prices(spark, landed, out, state).awaitTermination()
    got = {r["date"].day: r["close"] for r in jobs.history(spark, out).collect()}
    assert got == {1: 10.0, 2: 11.0, 3: 11.0}
    # a batch holds the months that it touches, merged
    assert {r["batch"]: r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy("batch").count().collect()} == {0: 2, 1: 3}


def test_stream_scoring(spark, tmp_path):
    f = spark.createDataFrame([("AAPL", D(2024, 1, 22), 1.0)], "ticker string, date date, x double")
    (tmp_path / "in").mkdir()
    rows = [{"request_id": i, "ticker": t, "as_of": "2024-01-24", "ts": "2024-01-24T00:00:00Z"} for i, t in (("1", "aapl"), ("1", "aapl"), ("2", "ZZ"))]
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    jobs.stream_scoring(spark, str(tmp_path / "in"), f, ["x"], F.col("x") / 2, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["request_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out/scores")).collect()}
    assert got == {"1": "ok", "2": "no_features"} and spark.read.parquet(str(tmp_path / "out/rejects")).first()["ticker"] == "ZZ"


def test_reporting(spark, trend):
    preds = spark.createDataFrame([("A", D(2024, 1, 2), 0.1, 0.2, "m", 0), ("A", D(2024, 1, 2), 0.1, 0.0, "n", 0), ("B", D(2024, 1, 9), 0.1, 0.0, "n", 1)], "ticker string, target_date date, y_true double, y_pred double, model_name string, fold_id int")
    assert reporting.series_long(preds, "A").count() == 3
    assert {r["model_name"]: round(r["error"], 6) for r in reporting.error_series(preds, "A").collect()} == {"m": 0.1, "n": -0.1}
    assert reporting.price_overlay(preds, trend(5, "A"), "A").count() == 1
    assert reporting.filter_values(preds).count() == 6
    r = spark.createDataFrame([("AAPL", D(2024, 1, 2), 0.1)], "ticker string, as_of date, prediction double")
    assert reporting.implied_price(r, trend(5)).first()["implied_price"] == pytest.approx(100.5 * 1.1)
    m = spark.createDataFrame([("m", 1.0, 1.0, 1.0, float("nan"), None, 0.5)], "model_name string, mse double, rmse double, mae double, r2 double, directional_accuracy double, ic double")
    assert reporting.metrics_long(m, ["model_name"]).count() == 4


def test_one_shuffle_for_all_price_windows(spark, trend):
    df = spark.createDataFrame(trend(40).collect(), trend(1).schema)
    plan = features.price_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [ticker") == 1


def test_checks_that_raise(spark, trend, tmp_path):
    from panelflow.operators import importance, modeling, quality
    from panelflow.schemas import PRICE_FEATURES
    from panelflow.sources import tables

    df = trend(20)
    no_dates = df.withColumn("date", F.lit("soon"))
    with pytest.raises(ValueError, match="can be read"):
        quality.dataset_manifest(no_dates, F.lit("all"))
    total = quality.manifest_total(quality.dataset_manifest(df.union(trend(10, "ABC")), F.col("ticker"))).first()
    assert (total["parts"], total["rows"], total["tickers"]) == (2, 30, "AAPL,ABC")

    up, down = F.unix_date("date"), -F.unix_date("date")
    assert quality.assert_ordered(df, up, F.lit("f")).count() == 20 and quality.assert_panel(df, seq=up).count() == 20
    with pytest.raises(ValueError, match="out of order"):
        quality.assert_panel(df, seq=down)
    mixed = df.withColumn("seq", up).union(trend(20, "ABC").withColumn("seq", down))
    assert [r["status"] for r in quality.file_ordering(mixed, F.col("seq"), F.lit("f")).collect()] == ["mixed"]
    with pytest.raises(ValueError, match="one order"):
        quality.assert_ordered(mixed, F.col("seq"), F.lit("f"))
    assert quality.order_violations(df, down).count() == 19

    for name in ("a", "b"):
        df.write.option("header", "true").csv(str(tmp_path / name))
    paths = lambda *names: spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")
    assert tables.read_listed_prices(spark, paths("a", "a")).count() == 20
    with pytest.raises(ValueError, match="duplicate"):
        tables.read_listed_prices(spark, paths("a", "b"))
    with pytest.raises(ValueError, match="no file"):
        tables.read_listed_prices(spark, paths())
    for version in ("v1", "v 2"):
        tables.write_version(df, str(tmp_path / "t"), version)
    assert tables.latest_version(spark, str(tmp_path / "t"), "v 2") == "v 2" and tables.latest_version(spark, str(tmp_path / "t")) == "v1"
    for hint in ("v3", None):
        with pytest.raises(ValueError, match="no version"):
            tables.latest_version(spark, str(tmp_path / ("t" if hint else "none")), hint)

    # an importance that follows a known model: only return_1d matters
    rows = df.select("ticker", "date", *[F.rand(k).alias(c) for k, c in enumerate(PRICE_FEATURES)]).withColumn("target_forward_return", F.col("return_1d") * 2)
    got = importance.model_importance(rows, lambda x: x.withColumn("y_pred", F.col("return_1d") * 2), PRICE_FEATURES, ["ticker", "date"], n_repeats=2).collect()
    assert got[0]["feature"] == "return_1d" and got[0]["importance"] > 0.1 and all(r["importance"] == 0 for r in got[1:])
    assert modeling.fit_regressor(rows, rows).stages[-1].getNumTrees <= 20


def test_asof_over_months(spark):
    """The last row of months before is carried, over empty months, ties and nulls."""
    from panelflow.functions.columns import latest_as_of

    day = dt.date
    right = spark.createDataFrame([("a", day(2024, 1, 5), 1), ("a", day(2024, 1, 20), 2), ("a", day(2024, 6, 1), 3), ("b", day(2024, 3, 1), 4), (None, day(2024, 1, 1), 5), ("a", None, 9)], "k string, at date, v int")
    asked = [("a", day(2024, 1, 4), None), ("a", day(2024, 1, 5), 1), ("a", day(2024, 1, 31), 2), ("a", day(2024, 5, 31), 2), ("a", day(2024, 6, 1), 3), ("a", day(2030, 1, 1), 3), ("b", day(2024, 2, 29), None), (None, day(2025, 1, 1), 5), ("c", day(2025, 1, 1), None), ("a", None, None)]
    left = spark.createDataFrame(asked, "k string, d date, want int")
    got = latest_as_of(left, right, ["k"], "d", "at", ["v"]).collect()
    assert len(got) == len(asked) and all(r["v"] == r["want"] for r in got)
