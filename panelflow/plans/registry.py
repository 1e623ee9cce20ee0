"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelflow.plans import oracle
from panelflow.plans import queries as q

_ALL = (
    q.panel_ohlc, q.price_features, q.price_features_blocks, q.returns_multi, q.rolling_volatility, q.range_and_volume, q.forward_target, q.clip_dates, q.pad_forward, q.rows_dropped,
    q.split_assign, q.split_counts, q.provenance_pivot, q.dup_keys, q.dup_rows, q.ordering_status, q.numeric_nulls, q.validation_summary, q.dataset_manifest, q.cutoff_violations,
    q.sentiment_violations, q.fingerprint, q.flatten_prices, q.flatten_news, q.merge_history, q.merge_stats, q.props_json, q.news_dedupe, q.sentiment_window, q.sentiment_join,
    q.sentiment_asof, q.sentiment_join_all, q.sentiment_asof_all, q.naive_mean, q.baseline_predictions, q.baseline_trading_days, q.metrics_single, q.metrics_by_ticker, q.scaler_fit, q.one_hot, q.encoded_rows, q.ols_one_feature,
    q.ols_full, q.regressor_metrics, q.baseline_deltas, q.perm_importance, q.walk_folds, q.walk_overlap, q.walk_metrics, q.walk_one_per_date, q.walk_aggregate, q.walk_pooled, q.walk_ols,
    q.worst_windows, q.asof_lookup, q.unknown_tickers, q.score_requests, q.check_schema, q.prediction_options, q.filter_predictions, q.price_slice, q.implied_price, q.series_long,
    q.error_series, q.price_overlay, q.filter_values, q.metrics_long, q.fold_metrics_table, q.mean_std_rows, q.feature_sink, q.prediction_sink, q.csv_scan, q.listed_scan, q.split_subset, q.sentiment_clip, q.file_ordering, q.order_violations,
    q.bad_dates, q.manifest_total, q.walk_fixed, q.walk_regressor, q.model_importance, q.stream_prices, q.stream_scoring, q.stream_rejects, q.file_status, q.file_manifest, q.repaired_files, q.rejected_rows, q.fingerprint_tree, q.changed_rows, q.boosting_curve, q.staged_trees, q.split_shares, q.eval_split, q.missing_columns, q.lenient_schema,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
