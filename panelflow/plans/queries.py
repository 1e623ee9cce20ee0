"""The registered queries: each runs one operator, or a short chain of them, over whole tables."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions.columns import number, round_digits
from panelflow.operators import baselines, encoders, features, files, importance, ingest, metrics, modeling, quality, reporting, sentiment, serving, splits, walkforward
from panelflow.plans import panel
from panelflow.schemas import KEY, PRICE_FEATURES, TARGET
from panelflow.session import materialize, scratch_path
from panelflow.sources import tables
from panelflow.streaming import jobs, scoring

FOLD, STEP, MIN_TRAIN = 63, 63, 60
_FLOATS = 8


def _rounded(df: DataFrame, digits: int = _FLOATS) -> DataFrame:
    """Doubles at a fixed number of digits, and no negative zero, so that results can be compared by value."""
    return df.select(*[round_digits(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _split(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return panel.feature_table(spark, sf_dir).where(F.col("split") == name)


# ------------------------------------------------------------ panel, features


def panel_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.prices(spark, sf_dir), 6)


def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.price_features(panel.prices(spark, sf_dir)))


def price_features_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through blocks with halos."""
    return _rounded(features.price_features(panel.prices(spark, sf_dir), halo_rows=256))


def returns_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.by_entity()
    p = F.col("adjusted_close")
    return _rounded(panel.prices(spark, sf_dir).select("ticker", "date", *[features.simple_return(p, k, w).alias(f"return_{k}d") for k in (1, 5, 10, 21)]))


def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.by_entity()
    df = panel.prices(spark, sf_dir).select("ticker", "date", features.simple_return(F.col("adjusted_close"), 1, w).alias("r"))
    return _rounded(df.select("ticker", "date", features.rolling_std(F.col("r"), 5, w).alias("volatility_5d"), features.rolling_std(F.col("r"), 21, w).alias("volatility_21d")))


def range_and_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.prices(spark, sf_dir).select("ticker", "date", features.range_hl().alias("range_hl"), features.volume_pct(features.by_entity()).alias("volume_pct_1d")))


def forward_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.by_entity()
    p = F.col("adjusted_close")
    return _rounded(panel.prices(spark, sf_dir).select("ticker", "date", features.forward_return(p, 1, w).alias("forward_1"), features.forward_return(p, 5, w).alias("forward_5")))


def clip_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.price_features(panel.prices(spark, sf_dir), date_range=("1996-01-01", "1996-12-31")))


def pad_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes of the busiest days only, padded forward."""
    df = panel.prices(spark, sf_dir).withColumn("sparse", F.when(F.col("volume") >= 50, F.col("close")))
    return _rounded(df.select("ticker", "date", features.pad_forward(F.col("sparse"), features.by_entity()).alias("padded")), 6)


def rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = panel.prices(spark, sf_dir)
    return features.row_accounting(prices, features.price_features(prices))


# ------------------------------------------------------------ splits, quality


def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.feature_table(spark, sf_dir).select("ticker", "date", "split")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_counts(panel.feature_table(spark, sf_dir))


def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries at shares of the calendar, checked, and the rows that each part gets."""
    df = features.price_features(panel.prices(spark, sf_dir))
    out = splits.assign_split(df, splits.boundaries_by_share(df, 0.6, 0.2))
    return out.groupBy("split").agg(F.count("*").alias("rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that importance is measured on: of val, and where a table has none (brands of the second kind), of test."""
    df = materialize(panel.feature_table(spark, sf_dir), "features")
    late = df.where("split <> 'val'")
    parts = [importance.evaluation_split(x).withColumn("table", F.lit(name)) for name, x in (("whole", df), ("without val", late))]
    return parts[0].unionByName(parts[1]).groupBy("table", "split", "ticker").agg(F.count("*").alias("rows"))


def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required columns that the driver's tables lack, when each is read as a price table under its own names."""
    tables_ = {n: panel.table(spark, sf_dir, n) for n in ("events", "lineitem", "orders")}
    tables_["events"] = tables_["events"].withColumnsRenamed({"event_type": "ticker", "value": "close"}).withColumn("date", F.to_date("ts"))
    rows = [(n, c, df.agg(F.count("*")).first()[0]) for n, df in tables_.items() for c in quality.check_columns(df, [*KEY, "close"])]
    return spark.createDataFrame(rows, "name string, missing string, rows long")


def provenance_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.provenance(panel.feature_table(spark, sf_dir))


def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(panel.table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


def dup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rows(panel.table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


def ordering_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the orders of each status and priority are in the order of their dates."""
    o = panel.table(spark, sf_dir, "orders").withColumn("ticker", F.col("o_orderpriority")).withColumn("date", F.to_date("o_orderdate"))
    return quality.ordering_status(o, F.col("o_orderkey"), F.col("o_orderstatus"))


def file_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all brands of a shipping mode have one order, by line items' place in the table of days."""
    days = panel.prices(spark, sf_dir).select("ticker", "date", F.when(F.col("ticker") < "Brand#3", -F.unix_date("date")).otherwise(F.unix_date("date")).alias("seq"))
    return quality.file_ordering(days, F.col("seq"), F.substring("ticker", 8, 1))


def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority that aren't dated after the order before them."""
    o = panel.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_orderkey")
    return quality.order_violations(o, F.col("o_orderkey")).groupBy("ticker").agg(F.count("*").alias("rows"), F.min("date").alias("date_min"), F.max("before").alias("before_max"))


def bad_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of events as text, some of them broken."""
    day = F.date_format("ts", "yyyy-MM-dd")
    text = F.when(F.col("event_id") % 50 == 0, F.concat(day, F.lit("Z"))).when(F.col("event_id") % 77 != 0, day)
    return quality.bad_dates(panel.table(spark, sf_dir, "events").select("event_id", text.alias("day")), "day")


def manifest_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.manifest_total(dataset_manifest(spark, sf_dir))


def numeric_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panel.table(spark, sf_dir, "events").select(F.col("value"), F.get_json_object("props", "$.k").alias("k"), F.col("event_type"))
    return quality.numeric_nulls(e, ["value", "k", "event_type"])


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panel.table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return quality.validation_summary(e, F.col("event_type"))


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panel.table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), (F.col("user_id") % 7).cast("string").alias("source"))
    return quality.dataset_manifest(e, F.col("source"))


def cutoff_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against raw data that ends early for some brands and lacks others."""
    prices = panel.prices(spark, sf_dir)
    raw = prices.where("ticker <> 'Brand#11' AND date <= DATE'2001-06-30'")
    return quality.cutoff_violations(raw, prices)


def sentiment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = sentiment.sentiment_features(panel.news(spark, sf_dir))
    return quality.sentiment_violations(daily, panel.event_prices(spark, sf_dir).where("date <= DATE'2024-01-20'"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dataset_fingerprint(panel.table(spark, sf_dir, "lineitem"))


def fingerprint_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash tree of line items, three levels deep."""
    return quality.hash_tree(panel.table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"), depth=2).withColumn("hash", F.col("hash").cast("string"))


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy in which some are changed, missing, new or there twice, by descending into unequal ranges."""
    o = panel.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    changed = o.where(key % 500 != 1).withColumn("o_totalprice", F.when(key % 700 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    more = o.where(key % 900 == 3).withColumn("o_orderkey", -key).unionByName(o.where(key % 1100 == 4))
    return quality.table_differences(o, changed.unionByName(more), ("o_orderkey",), depth=3)


# ------------------------------------------------------------ ingest


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event prices as landed documents, one a ticker and month half."""
    p = panel.event_prices(spark, sf_dir)
    day = F.struct(F.col("open").cast("string").alias("1. open"), F.col("high").cast("string").alias("2. high"), F.col("low").cast("string").alias("3. low"), F.when(F.dayofmonth("date") % 9 != 0, F.col("close").cast("string")).alias("4. close"), F.when(F.dayofmonth("date") % 7 == 0, "n/a").otherwise(F.col("volume").cast("string")).alias("5. volume"))
    rows = p.withColumn("half", F.when(F.dayofmonth("date") <= 15, 0).otherwise(1)).groupBy("ticker", "half").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), day))).alias("days"))
    return rows.select("ticker", "half", F.to_json(F.struct(F.col("days").alias("Time Series (Daily)"))).alias("payload"))


def flatten_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ingest.flatten_daily_prices(_payloads(spark, sf_dir)), 6)


def flatten_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed articles: entities name the event type, another one, or none."""
    e = panel.table(spark, sf_dir, "events")
    mine = F.struct(F.lower("event_type").alias("symbol"), F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.col("value").cast("string")).alias("sentiment_score"), F.lit("1.5").alias("match_score"))
    entities = F.when(F.col("event_id") % 3 == 0, F.array(mine)).when(F.col("event_id") % 3 == 1, F.array(mine, mine)).otherwise(F.array(F.struct(F.lit("other").alias("symbol"), F.lit("1").alias("sentiment_score"), F.lit("1").alias("match_score"))))
    title = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))).otherwise("")
    article = F.struct(F.col("event_id").cast("string").alias("uuid"), title.alias("title"), F.col("ts").cast("string").alias("published_at"), entities.alias("entities"))
    raw = e.select(F.upper("event_type").alias("ticker"), F.to_json(F.struct(F.array(article).alias("data"))).alias("payload"))
    out = ingest.flatten_news(raw)
    return out.select("ticker", F.col("article_uuid").cast("long").alias("article_uuid"), "headline", "sentiment_score", "match_score")


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brand prices known until 2000, and a later delivery that revises 1999 and adds the rest."""
    prices = panel.prices(spark, sf_dir)
    new = prices.where("date >= DATE'1999-01-01' AND ticker <> 'Brand#22'").withColumn("close", F.col("close") + 1).withColumn("high", F.lit(None).cast("double"))
    return prices.where("date < DATE'2000-01-01' AND ticker <> 'Brand#3'"), new


def merge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ingest.merge_history(*_batches(spark, sf_dir)), 6)


def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merge_stats(*_batches(spark, sf_dir))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the JSON of events, by event type."""
    e = panel.table(spark, sf_dir, "events").select("event_type", number(F.get_json_object("props", "$.k")).alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").cast("long").alias("k_sum"), F.max("k").cast("long").alias("k_max"))


# ------------------------------------------------------------ sentiment


def news_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.dedupe_articles(panel.news(spark, sf_dir)).groupBy("ticker", "pub_date").agg(F.count("*").alias("articles"))


def sentiment_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sentiment.sentiment_features(panel.news(spark, sf_dir)))


def sentiment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentiment.attach(panel.event_prices(spark, sf_dir), sentiment.sentiment_features(panel.news(spark, sf_dir)))
    return _rounded(out.select("ticker", "date", "close", "sentiment_avg", "sentiment_count", "sentiment_momentum"))


def sentiment_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as sentiment_join, by the name under which it was registered first."""
    return sentiment_join(spark, sf_dir)


def sentiment_asof_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as sentiment_asof, by the name under which it was registered first."""
    return sentiment_asof(spark, sf_dir)


def sentiment_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sentiment.sentiment_features(panel.news(spark, sf_dir), min_date="2024-01-08", max_date="2024-01-19"))


def sentiment_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentiment.attach_asof(panel.event_prices(spark, sf_dir), sentiment.sentiment_features(panel.news(spark, sf_dir)), max_age_days=3)
    return _rounded(out.select("ticker", "date", "close", "sentiment_avg", "sentiment_count", "sentiment_momentum"))


# ------------------------------------------------------------ baselines, metrics


def _preds(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("naive", "heuristic")) -> DataFrame:
    return baselines.predict(_split(spark, sf_dir, "train"), _split(spark, sf_dir, "test"), names)


def naive_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(baselines.predict(_split(spark, sf_dir, "train"), _split(spark, sf_dir, "test"), ("naive",), naive="mean"))


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_preds(spark, sf_dir))


def baseline_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(baselines.predict(_split(spark, sf_dir, "train"), _split(spark, sf_dir, "test"), ("heuristic",), trading_days=True))


def metrics_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-window backtest: metrics of each baseline over the test split."""
    return _rounded(metrics.compute_metrics(_preds(spark, sf_dir), ["model_name"]), 6)


def metrics_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.compute_metrics(_preds(spark, sf_dir, ("heuristic",)), ["ticker"]), 5)


def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(encoders.fit_scaler(_split(spark, sf_dir, "train"), PRICE_FEATURES), 6)


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of all feature rows by the slot that the training split gives them; those not in training have none."""
    df = panel.feature_table(spark, sf_dir)
    known = encoders.fit_one_hot(df.where("split = 'train' AND ticker <> 'Brand#4'"))
    slot = F.array_position(encoders.one_hot(F.col("ticker"), known), 1.0)
    return df.groupBy("ticker", slot.cast("int").alias("slot")).agg(F.count("*").alias("rows"))


def encoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of all encoded and scaled values by brand."""
    df = panel.feature_table(spark, sf_dir)
    train = df.where("split = 'train'")
    out = encoders.apply(df, encoders.fit_one_hot(train), encoders.fit_scaler(train, PRICE_FEATURES))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return out.groupBy("ticker").agg(F.round(F.sum(total), 3).alias("total"), F.max(F.size("vector")).alias("width"))


def ols_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = baselines.fit_ols(_split(spark, sf_dir, "train"), ["return_1d"])
    return _rounded(spark.range(1).select(F.lit(c[0]).alias("intercept"), F.lit(c[1]).alias("slope")), 6)


def ols_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_preds(spark, sf_dir, ("simple_ml",)))


def regressor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear Spark ML pipeline on train, its metrics on val."""
    df = materialize(panel.feature_table(spark, sf_dir), "features")
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    model = modeling.fit_regressor(train, val, kind="linear")
    scored = modeling.score(model, val).select(F.col(TARGET).alias("y_true"), "y_pred", F.lit("regressor").alias("model_name"))
    return _rounded(metrics.compute_metrics(scored, ["model_name"]), 6)


def boosting_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses on val of a boosted linear model, iteration by iteration, and where training ends."""
    return _rounded(modeling.fit_boosted_linear(_split(spark, sf_dir, "train"), _split(spark, sf_dir, "val"))[1], 5)


def staged_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses on val of boosted trees after each tree, and metrics of the model that is kept."""
    df = materialize(panel.feature_table(spark, sf_dir), "features")
    model, curve = modeling.fit_staged(df.where("split = 'train'"), df.where("split = 'val'"))
    kept = modeling.score(model, df.where("split = 'val'")).agg(F.avg((F.col("y_pred") - F.col(TARGET)) ** 2).alias("kept_mse"))
    return _rounded(curve.crossJoin(F.broadcast(kept)), 5)


def baseline_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-day-return heuristic against the zero baseline on val."""
    preds = baselines.predict(_split(spark, sf_dir, "train"), _split(spark, sf_dir, "val"), ("naive", "heuristic"))
    return _rounded(modeling.baseline_deltas(metrics.compute_metrics(preds, ["model_name"]), "heuristic"), 6)


def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(panel.feature_table(spark, sf_dir), "features")
    c = baselines.fit_ols(df.where("split = 'train'"))
    return _rounded(importance.permutation_importance(importance.evaluation_split(df), baselines.linear(c), PRICE_FEATURES, ["ticker", "date"]))


# ------------------------------------------------------------ walk-forward


def _walk(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("naive", "heuristic"), **more) -> tuple[DataFrame, DataFrame]:
    df = materialize(panel.feature_table(spark, sf_dir), "features")  # windows, folds and rows all come from it
    return walkforward.run(df.where("split = 'train'"), df.where("split = 'test'"), FOLD, STEP, MIN_TRAIN, names=names, **more)


def walk_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir)[0]


def walk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in each of overlapping windows."""
    test = _split(spark, sf_dir, "test")
    folds = walkforward.fold_map(test, 40, 15)
    return test.join(F.broadcast(folds), "date").groupBy("fold_id").agg(F.count("*").alias("rows"), F.min("date").alias("test_start"), F.max("date").alias("test_end"))


def walk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(walkforward.fold_metrics(_walk(spark, sf_dir)[1]), 5)


def walk_one_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(walkforward.fold_metrics(_walk(spark, sf_dir, panel="one_per_date")[1]), 5)


def walk_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.aggregate_folds(walkforward.fold_metrics(_walk(spark, sf_dir)[1])), 5)


def walk_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds, preds = _walk(spark, sf_dir)
    return _rounded(metrics.pooled_metrics(preds, folds.count()), 5)


def walk_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(walkforward.fold_metrics(_walk(spark, sf_dir, ("simple_ml",))[1]), 6)


def walk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that isn't refitted beside the zero baseline."""
    fixed = {"half": 0.5 * F.coalesce("return_1d", F.lit(0.0))}
    return _rounded(walkforward.fold_metrics(_walk(spark, sf_dir, ("naive",), fixed=fixed)[1]), 5)


def _boosted(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    df = materialize(panel.feature_table(spark, sf_dir), "features")
    return df, modeling.fit_regressor(df.where("split = 'train'"), df.where("split = 'val'"))


def walk_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees, stopped early on val, through the windows of test as a model that isn't refitted."""
    df, model = _boosted(spark, sf_dir)
    test = materialize(modeling.score(model, df.where("split = 'test'")), "scored")
    preds = walkforward.run(df.where("split = 'train'"), test, FOLD, STEP, MIN_TRAIN, names=("naive",), fixed={"regressor": F.col("y_pred")})[1]
    return _rounded(walkforward.fold_metrics(preds), 5)


def model_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation importance of the boosted trees on val."""
    df, model = _boosted(spark, sf_dir)
    return importance.model_importance(importance.evaluation_split(df), lambda rows: modeling.score(model, rows), PRICE_FEATURES, ["ticker", "date"])


def worst_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(walkforward.worst_windows(walkforward.fold_metrics(_walk(spark, sf_dir)[1])).select("fold_id", "model_name", "mse", "n_samples"), 6)


# ------------------------------------------------------------ serving


def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.asof_lookup(panel.requests(spark, sf_dir), panel.feature_table(spark, sf_dir), ["return_1d", "volatility_5d"])
    return _rounded(found.select("request_id", "ticker", "as_of", "feature_date", "return_1d", "volatility_5d"))


def unknown_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.unknown_tickers(panel.requests(spark, sf_dir), panel.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")))


def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(panel.feature_table(spark, sf_dir), "features")
    scored = serving.score_requests(panel.requests(spark, sf_dir), df, ["return_1d", "volatility_5d"], 0.5 * F.col("return_1d") - 0.1 * F.col("volatility_5d"))
    return scored.select("request_id", "feature_date", round_digits(F.col("prediction"), 5).alias("prediction"), round_digits(F.col("confidence"), 3).alias("confidence"), "status")


def check_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feature maps, some of which lack a feature or have one too many."""
    e = panel.table(spark, sf_dir, "events")
    fields = F.when(F.col("event_id") % 3 == 0, F.map_from_arrays(F.array(F.lit("a")), F.array("value"))).when(F.col("event_id") % 3 == 1, F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("value", F.lit(1.0)))).otherwise(F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array("value", F.lit(1.0), F.lit(2.0))))
    out = serving.check_schema(e.select("event_id", "event_type", fields.alias("features")), ["a", "b"])
    vector = serving.feature_vector(F.col("features"), ["a", "b"])
    return out.groupBy("event_type", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "ok").agg(F.count("*").alias("requests"), F.round(F.sum(serving.linear_score(vector, 0.0, [0.0, 2.0])), 3).alias("score"))


def lenient_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feature maps, where one name may be missing and others may be there."""
    e = panel.table(spark, sf_dir, "events")
    given = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("a"))).when(F.col("event_id") % 4 == 1, F.array(F.lit("a"), F.lit("b"))).when(F.col("event_id") % 4 == 2, F.array(F.lit("b"), F.lit("z"))).otherwise(F.array(F.lit("z")))
    fields = F.map_from_entries(F.transform(given, lambda n: F.struct(n, F.col("value"))))
    out = serving.check_schema(e.select("event_type", fields.alias("features")), ["a", "b"], strict=False, optional=["b"])
    return out.groupBy("event_type", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "ok").agg(F.count("*").alias("requests"))


def prediction_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.prediction_options(panel.feature_table(spark, sf_dir))
    return out.select("ticker", F.size("dates").cast("long").alias("n_dates"), F.element_at("dates", 1).alias("first_date"), F.element_at("dates", -1).alias("last_date"))


def filter_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(serving.filter_predictions(_preds(spark, sf_dir), "brand#12", "heuristic"))


def price_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(serving.price_slice(panel.prices(spark, sf_dir), "Brand#13", "1997-03-01", "1998-02-28"), 6)


def implied_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = panel.requests(spark, sf_dir).select("request_id", F.regexp_replace("ticker", "brand", "Brand").alias("ticker"), "as_of", F.lit(0.01).alias("prediction"))
    out = reporting.implied_price(r, panel.prices(spark, sf_dir))
    return _rounded(out.select("request_id", "ticker", "as_of", "price_date", "last_price", "implied_price"), 4)


# ------------------------------------------------------------ reporting


def series_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reporting.series_long(_preds(spark, sf_dir), "Brand#12"))


def error_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reporting.error_series(_preds(spark, sf_dir), "Brand#12"))


def price_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reporting.price_overlay(_preds(spark, sf_dir), panel.prices(spark, sf_dir), "Brand#12").select("ticker", "date", "close"), 6)


def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.filter_values(_walk(spark, sf_dir)[1])


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reporting.metrics_long(metrics.compute_metrics(_preds(spark, sf_dir), ["model_name"]), ["model_name"], 5), 5)


def fold_metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds, preds = _walk(spark, sf_dir)
    return _rounded(reporting.fold_metrics_table(walkforward.fold_metrics(preds), folds), 5)


def mean_std_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reporting.mean_std_rows(metrics.aggregate_folds(walkforward.fold_metrics(_walk(spark, sf_dir)[1])), 5), 5)


# ------------------------------------------------------------ sources, streaming


def feature_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as two versions, the second one twice; the latest version's test split read back."""
    path = scratch_path(spark, "feature-sink")
    df = materialize(panel.feature_table(spark, sf_dir), "features")
    for version, rows in (("v1", df.where("split = 'val'")), ("v2", df), ("v2", df)):
        tables.write_features(rows, path, version, PRICE_FEATURES, TARGET)
    read = tables.read_version(spark, path).where("split = 'test'")
    return read.groupBy("ticker", F.col("version").cast("string").alias("version")).agg(F.count("*").alias("rows"))


def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "prediction-sink")
    tables.write_predictions(_preds(spark, sf_dir), path, "v1")
    return tables.read_version(spark, path, "v1").groupBy("model_name").agg(F.count("*").alias("rows"))


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event prices through a CSV file and back."""
    path = scratch_path(spark, "csv")
    panel.event_prices(spark, sf_dir).write.option("header", "true").csv(path)
    return _rounded(tables.read_prices(spark, path, "csv"), 6)


def listed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event prices from the files that a manifest lists: one folder for each type, and one that isn't listed."""
    path = scratch_path(spark, "listed")
    df = materialize(panel.event_prices(spark, sf_dir), "prices")
    df.withColumn("part", F.col("ticker")).write.partitionBy("part").option("header", "true").csv(path)
    listed = df.where("ticker <> 'view'").select(F.concat(F.lit(f"{path}/part="), "ticker").alias("path")).distinct()
    return _rounded(tables.read_listed_prices(spark, listed), 6)


def _part(file: Column) -> Column:
    return F.regexp_extract(file, "part=([^/]*)", 1)


def _price_files(spark: SparkSession, sf_dir: str, straight: bool) -> str:
    """Brand prices as CSV files, one for each second digit of a brand: 1 and 2 descend, others ascend; unless straight, 4 is mixed and 5 in no order."""
    path = scratch_path(spark, "price-files")
    day, part = F.unix_date("date"), F.when(F.length("ticker") < 8, "0").otherwise(F.substring("ticker", 8, 1))
    seq = F.when(part.isin("1", "2"), -day)
    if not straight:
        seq = seq.when((part == "4") & (F.col("ticker") < "Brand#2"), -day).when(part == "5", F.xxhash64("date"))
    rows = panel.prices(spark, sf_dir).withColumn("part", part).withColumn("seq", seq.otherwise(day))
    rows.repartition("part").sortWithinPartitions("part", "ticker", "seq").drop("seq").write.partitionBy("part").option("header", "true").csv(path)
    return path


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order real files lie, from summaries of their splits."""
    orders = files.file_orders(files.file_summaries(tables.scan_prices(spark, _price_files(spark, sf_dir, straight=False))[0]))
    return orders.withColumn("file", _part(F.col("file")))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.files_manifest(files.file_summaries(tables.scan_prices(spark, _price_files(spark, sf_dir, straight=False))[0]))
    return rows.withColumn("part", _part(F.col("part")))


def repaired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files checked, and descending ones written anew: the summary, and the order of what has been written."""
    out = scratch_path(spark, "repaired")
    summary = files.validate_files(spark, _price_files(spark, sf_dir, straight=True), out, name=_part)
    written = files.file_orders(files.file_summaries(tables.scan_prices(spark, out, "parquet")[0]))
    after = written.groupBy(F.regexp_extract("file", "name=([^/]*)", 1).alias("of")).agg(F.sum("rows").alias("rows_after"), F.array_join(F.collect_set("status"), ",").alias("order_after"))
    return summary.join(after, F.col("file") == F.col("of"), "left").drop("of")


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event prices from CSV files with broken rows: what can be read, and what can't with the reasons."""
    path = scratch_path(spark, "broken")
    day = F.dayofmonth("date")
    rows = panel.event_prices(spark, sf_dir).select("ticker", F.when(day % 11 == 0, "a day").otherwise(F.col("date").cast("string")).alias("date"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "adjusted_close")], F.when(day % 9 == 0, "n/a").when(day % 5 != 0, F.col("volume").cast("string")).alias("volume"), day.alias("day"))
    rows = materialize(rows, "broken-rows")
    rows.where("day % 7 <> 0").drop("day").write.option("header", "true").csv(path)
    names = ",".join(rows.columns[:-1])
    short = rows.where("day % 7 = 0").select(F.concat_ws(",", "ticker", "date", "open").alias("line"))

    def with_header(batches):  # noqa: ANN001, ANN202
        for k, pdf in enumerate(batches):
            yield pd.concat([pd.DataFrame({"line": [names]}), pdf]) if k == 0 else pdf

    short.mapInPandas(with_header, "line string").write.mode("append").text(path)
    good, bad = tables.scan_prices(spark, path)
    read = good.select(F.lit("row").alias("kind"), "ticker", F.col("date").cast("string").alias("date"), "close", "volume", F.lit("").alias("reasons"))
    field = F.split("record", ",")
    rest = bad.select(F.lit("reject").alias("kind"), field[0].alias("ticker"), field[1].alias("date"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("long").alias("volume"), F.array_join("reasons", ",").alias("reasons"))
    return _rounded(read.unionByName(rest), 6)


def split_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    panel.feature_table(spark, sf_dir).select("ticker", "date", "split").write.parquet(path)
    return tables.read_split(spark, path, "val")


def stream_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed documents merged batch by batch by a stream."""
    landed, out, state = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    raw = materialize(_payloads(spark, sf_dir), "payloads")
    for half in (0, 1):
        raw.where(F.col("half") == half).select("ticker", "payload").coalesce(1).write.mode("append").json(landed)
    jobs.stream_prices(spark, landed, out, state).awaitTermination()
    return _rounded(jobs.history(spark, out), 6)


def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests scored by a stream, each of them sent twice."""
    landed, out, state = (scratch_path(spark, f"requests-{x}") for x in ("in", "out", "state"))
    r = panel.requests(spark, sf_dir)
    r.unionByName(r).write.json(landed)
    df = materialize(panel.feature_table(spark, sf_dir), "features")
    jobs.stream_scoring(spark, landed, df, ["return_1d", "volatility_5d"], 0.5 * F.col("return_1d") - 0.1 * F.col("volatility_5d"), out, state, late="4000 days").awaitTermination()
    return spark.read.parquet(f"{out}/scores").select("request_id", "feature_date", round_digits(F.col("prediction"), 5).alias("prediction"), round_digits(F.col("confidence"), 3).alias("confidence"), "status")


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in three deliveries, each sent twice, the last one mostly late; features arrive in part and are revised by the stream."""
    landed, updates, out, state = (scratch_path(spark, f"answers-{x}") for x in ("in", "updates", "out", "state"))
    first, columns = F.lit("1996-01-01").cast("date"), ["return_1d", "volatility_5d"]
    r = panel.requests(spark, sf_dir)
    part = F.when(F.col("request_id").cast("long") % 10 == 0, 2).when(F.col("as_of") < first, 0).otherwise(1)
    r = r.unionByName(r).withColumn("part", part)
    df = materialize(panel.feature_table(spark, sf_dir).select("ticker", "date", *columns), "features")
    revised = df.where("dayofmonth(date) = 15").withColumn("return_1d", 2 * F.col("return_1d"))
    prediction = 0.5 * F.col("return_1d") - 0.1 * F.col("volatility_5d")
    news = [df.where((F.col("date") >= first) & (F.dayofmonth("date") != 15)), revised]
    for k in range(3):  # a delivery lands whole, then the stream goes on from its checkpoint and takes it as a batch
        r.where(F.col("part") == k).drop("part").write.mode("append").json(landed)
        if k < len(news):
            news[k].write.mode("append").json(updates)
        scoring.score_stream(spark, landed, updates, df.where(F.col("date") < first), columns, prediction, out, state, late=dt.timedelta(days=200), files_per_batch=None).awaitTermination()
    return scoring.scores(spark, out).select("request_id", "sink", "status", "feature_date", round_digits(F.col("prediction"), 5).alias("prediction"), round_digits(F.col("confidence"), 3).alias("confidence"))
