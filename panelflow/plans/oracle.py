"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_PRICES = """
prices AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
    arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, arg_max(price, o) AS adjusted_close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS price, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS o FROM lineitem WHERE l_quantity <> 0)
  JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
_FEATURES = (
    _PRICES
    + """,
f0 AS (
  SELECT *, row_number() OVER w AS rn, adjusted_close / lag(adjusted_close) OVER w - 1 AS return_1d, adjusted_close / lag(adjusted_close, 5) OVER w - 1 AS return_5d,
    adjusted_close / lag(adjusted_close, 21) OVER w - 1 AS return_21d, (high - low) / nullif(close, 0) AS range_hl, coalesce(volume * 1.0 / lag(volume) OVER w - 1, 0) AS volume_pct_1d,
    lead(adjusted_close) OVER w / adjusted_close - 1 AS target_forward_return
  FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)),
f1 AS (
  SELECT *, CASE WHEN count(return_1d) OVER w5 >= 5 THEN stddev_samp(return_1d) OVER w5 END AS volatility_5d, CASE WHEN count(return_1d) OVER w21 >= 21 THEN stddev_samp(return_1d) OVER w21 END AS volatility_21d
  FROM f0 WINDOW w5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w21 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
features AS (
  SELECT ticker, date, round(return_1d, 10) AS return_1d, round(return_5d, 10) AS return_5d, round(return_21d, 10) AS return_21d, round(volatility_5d, 10) AS volatility_5d, round(volatility_21d, 10) AS volatility_21d,
    round(range_hl, 10) AS range_hl, round(volume_pct_1d, 10) AS volume_pct_1d, round(target_forward_return, 10) AS target_forward_return,
    CASE WHEN date <= DATE '1999-12-31' THEN 'train' WHEN date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' THEN 'val' WHEN date >= DATE '2000-07-01' THEN 'test' ELSE 'gap' END AS split
  FROM f1 WHERE rn > 21 AND target_forward_return IS NOT NULL)"""
)
_COLUMNS = ["return_1d", "return_5d", "return_21d", "volatility_5d", "volatility_21d", "range_hl", "volume_pct_1d", "target_forward_return"]
_FEATURE_LIST = ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in _COLUMNS)


def _preds(split: str = "test") -> str:
    return (
        _FEATURES
        + f""",
preds AS (
  SELECT ticker, date AS asof_date, date + 1 AS target_date, target_forward_return AS y_true, y_pred, model_name, CAST(-1 AS INTEGER) AS fold_id
  FROM (SELECT *, 0.0::DOUBLE AS y_pred, 'naive' AS model_name FROM features UNION ALL SELECT *, coalesce(return_1d, 0), 'heuristic' FROM features) WHERE split = '{split}')"""
    )


def _metrics(by: str, source: str = "preds") -> str:
    return f"""
metrics AS (
  SELECT {by}, round(avg((y_pred - y_true) ** 2), 10) AS mse, round(sqrt(avg((y_pred - y_true) ** 2)), 10) AS rmse, round(avg(abs(y_pred - y_true)), 10) AS mae,
    coalesce(round(CASE WHEN var_pop(y_true) > 0 THEN 1 - avg((y_pred - y_true) ** 2) / var_pop(y_true) END, 10), 'NaN'::DOUBLE) AS r2,
    round(avg(CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END), 6) AS directional_accuracy,
    coalesce(round(CASE WHEN stddev_pop(y_true) >= 1e-15 AND stddev_pop(y_pred) >= 1e-15 THEN covar_pop(y_true, y_pred) / (stddev_pop(y_true) * stddev_pop(y_pred)) END, 6), 0.0) AS ic, count(*) AS n_samples
  FROM {source} GROUP BY {by})"""


def _show(digits: int, ids: str, values: tuple[str, ...] = ("mse", "rmse", "mae", "r2", "directional_accuracy", "ic")) -> str:
    return f"SELECT {ids}, " + ", ".join(f"round({v}, {digits}) + 0.0 AS {v}" for v in values) + ", n_samples FROM metrics"


def _walk(test: str = "(SELECT * FROM features WHERE split = 'test')") -> str:
    return (
        _FEATURES
        + f""",
test AS (SELECT * FROM {test}),
d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM test)),
windows AS (SELECT date, CAST(i // 63 AS INTEGER) AS fold_id FROM d),
spans AS (SELECT fold_id, min(date) AS test_start, max(date) AS test_end FROM windows GROUP BY fold_id),
td AS (SELECT DISTINCT date FROM features WHERE split = 'train' UNION SELECT date FROM test),
folds AS (SELECT fold_id, min(td.date) AS train_start, max(td.date) AS train_end, CAST(count(*) AS INTEGER) AS n_train_dates, test_start, test_end
  FROM spans JOIN td ON td.date < test_start GROUP BY fold_id, test_start, test_end HAVING count(*) >= 60),
preds AS (SELECT ticker, y_true, y_pred, model_name, fold_id FROM (
    SELECT ticker, date, target_forward_return AS y_true, 0.0::DOUBLE AS y_pred, 'naive' AS model_name FROM test
    UNION ALL SELECT ticker, date, target_forward_return, coalesce(return_1d, 0), 'heuristic' FROM test) JOIN windows USING (date) WHERE fold_id IN (SELECT fold_id FROM folds)),"""
        + _metrics("fold_id, model_name")
    )


def _least_squares(rows: str) -> str:
    """Least squares of `rows` (with a fold_id), one fit a fold: sums of products, then one elimination step a recursion. The last table is `coefficients`."""
    width = len(_COLUMNS)  # the intercept and the features; one more for the target
    values = ", ".join(f"coalesce({c}, 0)" for c in _COLUMNS[:-1])
    return f""",
x AS (SELECT fold_id, [1.0, {values}, {_COLUMNS[-1]}] AS v FROM {rows} WHERE {_COLUMNS[-1]} IS NOT NULL),
sums AS (SELECT fold_id, i, j, sum(v[i] * v[j]) AS s FROM x, range(1, {width + 1}) t(i), range(1, {width + 2}) u(j) GROUP BY ALL),
matrix AS (SELECT fold_id, list(r ORDER BY i) AS m FROM (SELECT fold_id, i, list(s ORDER BY j) AS r FROM sums GROUP BY fold_id, i) GROUP BY fold_id),
steps AS (SELECT fold_id, 1 AS k, m FROM matrix UNION ALL
  SELECT fold_id, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda a: a / r[k]) ELSE list_transform(r, lambda a, j: a - r[k] * m[k][j] / m[k][k]) END) FROM steps WHERE k <= {width}),
coefficients AS (SELECT fold_id, list_transform(m, lambda r: r[{width + 1}]) AS c FROM steps WHERE k = {width + 1})"""


_LINEAR = "list_dot_product(c, [1.0, " + ", ".join(f"coalesce({c}, 0)" for c in _COLUMNS[:-1]) + "])"

_ONE_PER_DATE = "(SELECT * FROM features WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY date ORDER BY ticker) = 1)"
_LONG = "SELECT {ids}, unnest(['mse', 'rmse', 'mae', 'r2', 'directional_accuracy', 'ic']) AS metric, unnest([mse, rmse, mae, r2, directional_accuracy, ic]) AS value FROM metrics"
_AGGREGATE = (
    ", long AS (" + _LONG.format(ids="model_name") + " UNION ALL SELECT model_name, 'n_samples', CAST(n_samples AS DOUBLE) FROM metrics), "
    "agg AS (SELECT model_name, metric, avg(value) AS mean, stddev_pop(value) AS std FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)"
)

_EVENT_PRICES = """
ep AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, round(CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) AS close, max(value) AS high, min(value) AS low, count(*) AS volume
  FROM events GROUP BY ALL)"""
_NEWS = """
news AS (SELECT event_type AS ticker, ts AS pub_ts, CAST(ts AS DATE) AS pub_date, value AS score, 'a' || CAST(event_id // 3 AS VARCHAR) AS uuid FROM events)"""


def _sentiment(where: str = "TRUE") -> str:
    return (
        _NEWS
        + f""",
first AS (SELECT * FROM news WHERE {where} QUALIFY row_number() OVER (PARTITION BY ticker, uuid ORDER BY pub_date, pub_ts, score) = 1),
sd AS (SELECT ticker, pub_date AS date, sum(score) AS s, count(*) AS n FROM first GROUP BY ALL),
sw AS (SELECT a.ticker, a.date,
    sum(b.s) FILTER (b.date > a.date - 7) AS s1, sum(b.n) FILTER (b.date > a.date - 7) AS n1, sum(b.s) FILTER (b.date <= a.date - 7) AS s0, sum(b.n) FILTER (b.date <= a.date - 7) AS n0
  FROM sd a JOIN sd b ON a.ticker = b.ticker AND b.date <= a.date AND b.date > a.date - 14 GROUP BY ALL),
sent AS (SELECT ticker, date, round(s1 / n1, 10) AS sentiment_avg, CAST(n1 AS BIGINT) AS sentiment_count, round(s1 / n1 - coalesce(s0 / n0, 0), 10) AS sentiment_momentum FROM sw)"""
    )


_SENT = "round(coalesce(sentiment_avg, 0), 8) + 0.0 AS sentiment_avg, coalesce(sentiment_count, 0) AS sentiment_count, round(coalesce(sentiment_momentum, 0), 8) + 0.0 AS sentiment_momentum"
_REQUESTS = """
requests AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 'brand#' || CAST(o_custkey % 28 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS as_of FROM orders)"""
_BATCHES = """
old AS (SELECT * FROM prices WHERE date < DATE '2000-01-01' AND ticker <> 'Brand#3'),
new AS (SELECT ticker, date, open, NULL::DOUBLE AS high, low, close + 1 AS close, adjusted_close, volume FROM prices WHERE date >= DATE '1999-01-01' AND ticker <> 'Brand#22')"""
_PAYLOAD_ROWS = "SELECT ticker, date, close AS open, high, low, close, close AS adjusted_close, volume FROM ep WHERE day(date) % 9 <> 0 AND day(date) % 7 <> 0"
_SCORED = """
scored AS (SELECT r.request_id, f.date AS feature_date, 0.5 * return_1d - 0.1 * volatility_5d AS p FROM requests r ASOF LEFT JOIN features f ON r.ticker = lower(f.ticker) AND r.as_of >= f.date)"""
_SHOW_SCORED = "SELECT request_id, feature_date, round(round(p, 6), 5) AS prediction, round(round(0.5 + 0.5 * (1 - least(1, abs(p))), 4), 3) AS confidence, CASE WHEN feature_date IS NULL THEN 'no_features' ELSE 'ok' END AS status FROM scored"
_SUM_VECTOR = " + ".join(f"(coalesce({c}, 0) - (SELECT avg({c}) FROM features WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM features WHERE split = 'train')" for c in _COLUMNS[:-1])
_OHLC = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("open", "high", "low", "close", "adjusted_close"))

ORACLE_SQL: dict[str, str] = {
    "panel_ohlc": f"WITH {_PRICES} SELECT ticker, date, {_OHLC}, volume FROM prices",
    "price_features": f"WITH {_FEATURES} SELECT ticker, date, {_FEATURE_LIST} FROM features",
    "price_features_blocks": f"WITH {_FEATURES} SELECT ticker, date, {_FEATURE_LIST} FROM features",
    "returns_multi": f"WITH {_PRICES} SELECT ticker, date, " + ", ".join(f"round(adjusted_close / lag(adjusted_close, {k}) OVER w - 1, 8) + 0.0 AS return_{k}d" for k in (1, 5, 10, 21)) + " FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "rolling_volatility": f"WITH {_FEATURES} SELECT ticker, date, round(volatility_5d, 8) AS volatility_5d, round(volatility_21d, 8) AS volatility_21d FROM f1",
    "range_and_volume": f"WITH {_FEATURES} SELECT ticker, date, round(range_hl, 8) + 0.0 AS range_hl, round(volume_pct_1d, 8) + 0.0 AS volume_pct_1d FROM f0",
    "forward_target": f"WITH {_PRICES} SELECT ticker, date, round(lead(adjusted_close) OVER w / adjusted_close - 1, 8) + 0.0 AS forward_1, round(lead(adjusted_close, 5) OVER w / adjusted_close - 1, 8) + 0.0 AS forward_5 FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "clip_dates": f"WITH {_FEATURES} SELECT ticker, date, {_FEATURE_LIST} FROM features WHERE year(date) = 1996",
    "pad_forward": f"WITH {_PRICES} SELECT ticker, date, round(last_value(CASE WHEN volume >= 50 THEN close END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS padded FROM prices",
    "rows_dropped": f"WITH {_FEATURES} SELECT a AS rows_in, b AS rows_out, a - b AS rows_dropped FROM (SELECT count(*) AS a FROM prices), (SELECT count(*) AS b FROM features)",
    "split_assign": f"WITH {_FEATURES} SELECT ticker, date, split FROM features",
    "split_counts": f"WITH {_FEATURES} SELECT split, count(*) AS rows FROM features GROUP BY split",
    "provenance_pivot": f"WITH {_FEATURES} SELECT ticker, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows, count(*) FILTER (split = 'test') AS test_rows, min(date) AS date_min, max(date) AS date_max FROM features GROUP BY ticker",
    "dup_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "dup_rows": "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "ordering_status": """WITH o AS (SELECT o_orderstatus AS file, o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS b FROM orders)
        SELECT file, ticker, count(*) AS rows, CASE WHEN coalesce(bool_and(d > b) FILTER (b IS NOT NULL), TRUE) THEN 'ascending' WHEN bool_and(d < b) FILTER (b IS NOT NULL) THEN 'descending' ELSE 'unsorted' END AS status FROM o GROUP BY file, ticker""",
    "numeric_nulls": """SELECT 'value' AS "column", count(*) FILTER (value IS NULL) AS nulls FROM events UNION ALL SELECT 'k', count(*) FILTER (try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NULL) FROM events
        UNION ALL SELECT 'event_type', count(*) FILTER (try_cast(event_type AS DOUBLE) IS NULL) FROM events""",
    "validation_summary": "SELECT event_type AS file, count(*) AS rows, min(CAST(ts AS DATE)) AS date_min, max(CAST(ts AS DATE)) AS date_max FROM events GROUP BY ROLLUP (event_type)",
    "dataset_manifest": "SELECT CAST(user_id % 7 AS VARCHAR) AS part, count(*) AS rows, min(CAST(ts AS DATE)) AS date_min, max(CAST(ts AS DATE)) AS date_max, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tickers FROM events GROUP BY 1",
    "cutoff_violations": f"WITH {_PRICES}, r AS (SELECT ticker, max(date) AS raw_max FROM prices WHERE ticker <> 'Brand#11' AND date <= DATE '2001-06-30' GROUP BY ticker) SELECT p.ticker, p.date, raw_max FROM prices p LEFT JOIN r ON p.ticker = r.ticker WHERE raw_max IS NULL OR p.date > raw_max",
    "sentiment_violations": f"WITH {_sentiment()} SELECT ticker, date, DATE '2024-01-20' AS price_max FROM sent WHERE date > DATE '2024-01-20'",
    "flatten_prices": f"WITH {_EVENT_PRICES} SELECT ticker, date, {_OHLC}, volume FROM ({_PAYLOAD_ROWS})",
    "stream_prices": f"WITH {_EVENT_PRICES} SELECT ticker, date, {_OHLC}, volume FROM ({_PAYLOAD_ROWS})",
    "listed_scan": f"WITH {_EVENT_PRICES} SELECT ticker, date, {_OHLC}, volume FROM (SELECT *, close AS open, close AS adjusted_close FROM ep) WHERE ticker <> 'view'",
    "split_subset": f"WITH {_FEATURES} SELECT ticker, date, split FROM features WHERE split = 'val'",
    "sentiment_clip": f"WITH {_sentiment()} SELECT ticker, date, {_SENT} FROM sent WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-19'",
    "file_ordering": f"WITH {_FEATURES}, t AS (SELECT DISTINCT ticker, substr(ticker, 8, 1) AS file, ticker < 'Brand#3' AS down, count(*) OVER (PARTITION BY ticker) AS n FROM features) SELECT file, count(*) AS tickers, CASE WHEN bool_and(down) THEN 'descending' WHEN bool_or(down) THEN 'mixed' ELSE 'ascending' END AS status FROM t GROUP BY file",
    "order_violations": """WITH o AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS before FROM orders)
        SELECT ticker, count(*) AS rows, min(date) AS date_min, max(before) AS before_max FROM o WHERE before >= date GROUP BY ticker""",
    "bad_dates": "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN strftime(ts, '%Y-%m-%d') || 'Z' END AS day FROM events WHERE event_id % 50 = 0 OR event_id % 77 = 0",
    "manifest_total": "SELECT count(DISTINCT user_id % 7) AS parts, count(*) AS rows, min(CAST(ts AS DATE)) AS date_min, max(CAST(ts AS DATE)) AS date_max, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tickers FROM events",
    "walk_fixed": f"WITH {_walk().replace(chr(39) + 'heuristic' + chr(39), chr(39) + 'half' + chr(39)).replace('coalesce(return_1d, 0)', '0.5 * coalesce(return_1d, 0)')} {_show(5, 'fold_id, model_name')}",
    "csv_scan": f"WITH {_EVENT_PRICES} SELECT ticker, date, {_OHLC}, volume FROM (SELECT *, close AS open, close AS adjusted_close FROM ep)",
    "flatten_news": """SELECT upper(event_type) AS ticker, event_id AS article_uuid, CASE WHEN event_id % 2 = 0 THEN 't' || event_id ELSE '' END AS headline,
        CASE WHEN event_id % 3 <> 2 AND event_id % 5 <> 0 THEN value END AS sentiment_score, CASE WHEN event_id % 3 <> 2 THEN 1.5::DOUBLE END AS match_score
        FROM (SELECT *, unnest(range(CASE WHEN event_id % 3 = 1 THEN 2 WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN 1 ELSE 0 END)) AS copy FROM events)""",
    "merge_history": f"WITH {_PRICES}, {_BATCHES} SELECT ticker, date, {_OHLC}, volume FROM (SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (ticker, date))",
    "merge_stats": f"""WITH {_PRICES}, {_BATCHES}, k AS (SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.date, n.date) AS date, o.ticker IS NOT NULL AS had, n.ticker IS NOT NULL AS got FROM old o FULL JOIN new n ON o.ticker = n.ticker AND o.date = n.date)
        SELECT ticker, CASE WHEN bool_or(had) THEN 'updated' ELSE 'created' END AS status, count(*) FILTER (NOT had) AS new_rows, count(*) AS total_rows, min(date) AS date_min, max(date) AS date_max FROM k GROUP BY ticker HAVING bool_or(got)""",
    "props_json": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS k_sum, CAST(max(k) AS BIGINT) AS k_max FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY event_type",
    "news_dedupe": f"WITH {_sentiment()} SELECT ticker, pub_date, count(*) AS articles FROM first GROUP BY ALL",
    "sentiment_window": f"WITH {_sentiment()} SELECT ticker, date, {_SENT} FROM sent",
    "sentiment_join": f"WITH {_EVENT_PRICES}, {_sentiment()} SELECT ep.ticker, ep.date, round(close, 8) AS close, {_SENT} FROM ep LEFT JOIN sent ON ep.ticker = sent.ticker AND ep.date = sent.date",
    "sentiment_asof": f"WITH {_EVENT_PRICES}, {_sentiment()} SELECT ep.ticker, ep.date, round(close, 8) AS close, {_SENT} FROM ep LEFT JOIN sent ON ep.ticker = sent.ticker AND sent.date = (SELECT max(s.date) FROM sent s WHERE s.ticker = ep.ticker AND s.date <= ep.date AND s.date > ep.date - 3)",
    "sentiment_join_all": f"WITH {_EVENT_PRICES}, {_sentiment()} SELECT ep.ticker, ep.date, round(close, 8) AS close, {_SENT} FROM ep LEFT JOIN sent ON ep.ticker = sent.ticker AND ep.date = sent.date",
    "sentiment_asof_all": f"WITH {_EVENT_PRICES}, {_sentiment()} SELECT ep.ticker, ep.date, round(close, 8) AS close, {_SENT} FROM ep LEFT JOIN sent ON ep.ticker = sent.ticker AND sent.date = (SELECT max(s.date) FROM sent s WHERE s.ticker = ep.ticker AND s.date <= ep.date AND s.date > ep.date - 3)",
    "naive_mean": f"WITH {_FEATURES} SELECT ticker, date AS asof_date, date + 1 AS target_date, round(target_forward_return, 8) + 0.0 AS y_true, round((SELECT avg(target_forward_return) FROM features WHERE split = 'train'), 8) AS y_pred, 'naive' AS model_name, CAST(-1 AS INTEGER) AS fold_id FROM features WHERE split = 'test'",
    "baseline_predictions": f"WITH {_preds()} SELECT ticker, asof_date, target_date, round(y_true, 8) + 0.0 AS y_true, round(y_pred, 8) + 0.0 AS y_pred, model_name, fold_id FROM preds",
    "baseline_trading_days": f"WITH {_FEATURES} SELECT ticker, date AS asof_date, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS target_date, round(target_forward_return, 8) + 0.0 AS y_true, round(coalesce(return_1d, 0), 8) + 0.0 AS y_pred, 'heuristic' AS model_name, CAST(-1 AS INTEGER) AS fold_id FROM features WHERE split = 'test'",
    "metrics_single": f"WITH {_preds()}, {_metrics('model_name')} {_show(6, 'model_name')}",
    "metrics_by_ticker": f"WITH {_preds()}, {_metrics('ticker', chr(40) + 'SELECT * FROM preds WHERE model_name = ' + chr(39) + 'heuristic' + chr(39) + chr(41))} {_show(5, 'ticker')}",
    "scaler_fit": f"WITH {_FEATURES} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(coalesce({c}, 0)), 6) + 0.0 AS mean, round(stddev_pop(coalesce({c}, 0)), 6) AS scale FROM features WHERE split = 'train'" for c in _COLUMNS[:-1]),
    "one_hot": f"WITH {_FEATURES}, k AS (SELECT ticker, CAST(row_number() OVER (ORDER BY ticker) AS INTEGER) AS slot FROM (SELECT DISTINCT ticker FROM features WHERE split = 'train' AND ticker <> 'Brand#4')) SELECT f.ticker, coalesce(slot, 0) AS slot, count(*) AS rows FROM features f LEFT JOIN k ON f.ticker = k.ticker GROUP BY ALL",
    "encoded_rows": f"WITH {_FEATURES} SELECT ticker, round(sum(1 + {_SUM_VECTOR}), 3) AS total, CAST((SELECT count(DISTINCT ticker) FROM features WHERE split = 'train') + 7 AS INTEGER) AS width FROM features GROUP BY ticker",
    "ols_one_feature": f"WITH {_FEATURES} SELECT round(regr_intercept(target_forward_return, return_1d), 6) + 0.0 AS intercept, round(regr_slope(target_forward_return, return_1d), 6) + 0.0 AS slope FROM features WHERE split = 'train'",
    "baseline_deltas": f"WITH {_preds('val')}, {_metrics('model_name')} SELECT n.model_name AS baseline, round(h.mae - n.mae, 6) AS mae_delta, round(h.rmse - n.rmse, 6) AS rmse_delta FROM metrics h, metrics n WHERE h.model_name = 'heuristic' AND n.model_name = 'naive'",
    "walk_folds": f"WITH {_walk()} SELECT * FROM folds",
    "walk_overlap": f"""WITH {_FEATURES}, test AS (SELECT * FROM features WHERE split = 'test'), d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM test)),
        k AS (SELECT CAST(unnest(range((SELECT max(i) FROM d) // 15 + 1)) AS INTEGER) AS fold_id)
        SELECT fold_id, count(*) AS rows, min(date) AS test_start, max(date) AS test_end FROM k JOIN d ON i >= fold_id * 15 AND i < fold_id * 15 + 40 JOIN test USING (date) GROUP BY fold_id""",
    "walk_metrics": f"WITH {_walk()} {_show(5, 'fold_id, model_name')}",
    "walk_one_per_date": f"WITH {_walk(_ONE_PER_DATE)} {_show(5, 'fold_id, model_name')}",
    "walk_aggregate": f"WITH {_walk()}{_AGGREGATE} SELECT model_name, metric, round(mean, 5) + 0.0 AS mean, round(std, 5) + 0.0 AS std FROM agg",
    "mean_std_rows": f"WITH {_walk()}{_AGGREGATE} SELECT model_name, metric, round(mean, 5) + 0.0 AS mean, round(std, 5) + 0.0 AS std FROM agg",
    "worst_windows": f"WITH {_walk()} SELECT fold_id, model_name, round(mse, 6) AS mse, n_samples FROM metrics ORDER BY metrics.mse DESC, fold_id, model_name LIMIT 5",
    "asof_lookup": f"WITH {_FEATURES}, {_REQUESTS} SELECT r.request_id, r.ticker, r.as_of, f.date AS feature_date, round(return_1d, 8) + 0.0 AS return_1d, round(volatility_5d, 8) + 0.0 AS volatility_5d FROM requests r ASOF LEFT JOIN features f ON r.ticker = lower(f.ticker) AND r.as_of >= f.date",
    "unknown_tickers": f"WITH {_REQUESTS} SELECT upper(ticker) AS ticker, count(*) AS requests FROM requests WHERE upper(ticker) NOT IN (SELECT upper(p_brand) FROM part) GROUP BY 1",
    "score_requests": f"WITH {_FEATURES}, {_REQUESTS}, {_SCORED} {_SHOW_SCORED}",
    "stream_scoring": f"WITH {_FEATURES}, {_REQUESTS}, {_SCORED} {_SHOW_SCORED}",
    "check_schema": """SELECT event_type, CASE event_id % 3 WHEN 0 THEN 'b' ELSE '' END AS missing, CASE event_id % 3 WHEN 2 THEN 'c' ELSE '' END AS extra, event_id % 3 = 1 AS ok, count(*) AS requests, round(sum(CASE event_id % 3 WHEN 0 THEN 0.0 ELSE 2.0 END), 3) AS score FROM events GROUP BY ALL""",
    "prediction_options": f"WITH {_FEATURES} SELECT upper(ticker) AS ticker, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM features GROUP BY 1",
    "filter_predictions": f"WITH {_preds()} SELECT ticker, asof_date, target_date, round(y_true, 8) + 0.0 AS y_true, round(y_pred, 8) + 0.0 AS y_pred, model_name, fold_id FROM preds WHERE ticker = 'Brand#12' AND model_name = 'heuristic'",
    "price_slice": f"WITH {_PRICES} SELECT ticker, date, {_OHLC}, volume FROM prices WHERE ticker = 'Brand#13' AND date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'",
    "implied_price": f"WITH {_PRICES}, {_REQUESTS} SELECT request_id, replace(r.ticker, 'brand', 'Brand') AS ticker, as_of, p.date AS price_date, round(adjusted_close, 4) AS last_price, round(adjusted_close * 1.01, 4) AS implied_price FROM requests r ASOF LEFT JOIN prices p ON replace(r.ticker, 'brand', 'Brand') = p.ticker AND r.as_of >= p.date",
    "series_long": f"WITH {_preds()} SELECT target_date, 'y_true' AS series, round(max(y_true), 8) + 0.0 AS value FROM preds WHERE ticker = 'Brand#12' GROUP BY target_date UNION ALL SELECT target_date, model_name, round(y_pred, 8) + 0.0 FROM preds WHERE ticker = 'Brand#12'",
    "error_series": f"WITH {_preds()} SELECT target_date, model_name, round(y_pred - y_true, 8) + 0.0 AS error FROM preds WHERE ticker = 'Brand#12'",
    "price_overlay": f"WITH {_preds()} SELECT ticker, date, round(close, 6) AS close FROM prices WHERE ticker = 'Brand#12' AND date BETWEEN (SELECT min(target_date) FROM preds WHERE ticker = 'Brand#12') AND (SELECT max(target_date) FROM preds WHERE ticker = 'Brand#12')",
    "filter_values": f"WITH {_walk()} SELECT DISTINCT 'ticker' AS kind, ticker AS value FROM preds UNION SELECT 'model', model_name FROM preds UNION SELECT 'fold', CAST(fold_id AS VARCHAR) FROM preds",
    "metrics_long": f"WITH {_preds()}, {_metrics('model_name')} SELECT model_name, metric, round(value, 5) + 0.0 AS value FROM ({_LONG.format(ids='model_name')})",
    "fold_metrics_table": f"WITH {_walk()} SELECT fold_id, model_name, metric, round(round(value, 6), 5) + 0.0 AS value, test_start, test_end FROM ({_LONG.format(ids='fold_id, model_name')}) JOIN folds USING (fold_id)",
    "feature_sink": f"WITH {_FEATURES} SELECT ticker, 'v2' AS version, count(*) AS rows FROM features WHERE split = 'test' GROUP BY ticker",
    "prediction_sink": f"WITH {_preds()} SELECT model_name, count(*) AS rows FROM preds GROUP BY model_name",
}
ORACLE_SQL["walk_pooled"] = f"WITH {_walk().replace('metrics AS (', 'fold_metrics AS (')}, {_metrics('model_name')} {_show(5, 'model_name')}"
ORACLE_SQL["ols_full"] = f"""WITH RECURSIVE {_FEATURES}{_least_squares("(SELECT *, -1 AS fold_id FROM features WHERE split = 'train')")}
SELECT ticker, date AS asof_date, date + 1 AS target_date, round(target_forward_return, 8) + 0.0 AS y_true, round({_LINEAR}, 8) + 0.0 AS y_pred, 'simple_ml' AS model_name, CAST(-1 AS INTEGER) AS fold_id
FROM features, coefficients WHERE split = 'test'"""
ORACLE_SQL["walk_ols"] = f"""WITH RECURSIVE {_walk().replace("preds AS (", "plain AS (").replace("FROM preds", "FROM fitted").replace("metrics AS (", _least_squares("(SELECT features.*, fold_id FROM features JOIN folds ON date <= train_end WHERE split IN ('train', 'test'))").lstrip(", ") + """,
fitted AS (SELECT fold_id, 'simple_ml' AS model_name, target_forward_return AS y_true, """ + _LINEAR + """ AS y_pred FROM test JOIN windows USING (date) JOIN coefficients USING (fold_id)),
metrics AS (""")} {_show(6, "fold_id, model_name")}"""
# one-hot tickers and an intercept leave what deviations from each ticker's means leave
_SHIFTED = ", ".join(f"coalesce(f.{c}, 0) - t.{c} AS {c}" for c in _COLUMNS[:-1])
ORACLE_SQL["regressor_metrics"] = f"""WITH RECURSIVE {_FEATURES},
means AS (SELECT ticker, {", ".join(f"avg(coalesce({c}, 0)) AS {c}" for c in _COLUMNS)} FROM features WHERE split = 'train' GROUP BY ticker),
shifted AS (SELECT -1 AS fold_id, split, f.ticker, t.{_COLUMNS[-1]} AS level, f.{_COLUMNS[-1]} AS y_true, {_SHIFTED}, f.{_COLUMNS[-1]} - t.{_COLUMNS[-1]} AS {_COLUMNS[-1]} FROM features f JOIN means t USING (ticker)){_least_squares("(SELECT * FROM shifted WHERE split = 'train')")},
preds AS (SELECT 'regressor' AS model_name, y_true, level + {_LINEAR} AS y_pred FROM shifted, coefficients WHERE split = 'val'),{_metrics("model_name")}
{_show(6, "model_name")}"""
ORACLE_SQL["stream_rejects"] = f"""WITH {_FEATURES},
r AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 'brand#' || CAST(o_custkey % 28 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS as_of, CAST(o_orderdate AS TIMESTAMP) AS ts,
  CASE WHEN o_orderkey % 10 = 0 THEN 2 WHEN CAST(o_orderdate AS DATE) < DATE '1996-01-01' THEN 0 ELSE 1 END AS part FROM orders),
once AS (SELECT DISTINCT * FROM r),
marks AS (SELECT k AS part, (SELECT max(ts) FROM r WHERE part < k) - INTERVAL 200 DAY AS mark FROM range(3) t(k)),
known AS (SELECT 0 AS part, lower(ticker) AS ticker, date, return_1d, volatility_5d FROM features WHERE date < DATE '1996-01-01' OR day(date) <> 15
  UNION ALL SELECT k, lower(ticker), date, CASE WHEN day(date) = 15 THEN 2 * return_1d ELSE return_1d END, volatility_5d FROM features, range(1, 3) t(k)),
judged AS (SELECT once.*, CASE WHEN ts < mark THEN 'late' WHEN ticker NOT IN (SELECT ticker FROM known) THEN 'unknown' END AS bad FROM once JOIN marks USING (part)),
scored AS (SELECT j.request_id, j.bad, f.date AS feature_date, 0.5 * return_1d - 0.1 * volatility_5d AS p FROM judged j ASOF LEFT JOIN known f ON j.part = f.part AND j.ticker = f.ticker AND j.as_of >= f.date)
SELECT request_id, CASE WHEN bad IS NULL THEN 'scores' ELSE 'rejects' END AS sink, coalesce(bad, CASE WHEN feature_date IS NULL THEN 'no_features' ELSE 'ok' END) AS status,
  CASE WHEN bad IS NULL THEN feature_date END AS feature_date, CASE WHEN bad IS NULL THEN round(round(p, 6), 5) END AS prediction,
  CASE WHEN bad IS NULL THEN round(round(0.5 + 0.5 * (1 - least(1, abs(p))), 4), 3) END AS confidence FROM scored"""
_PARTS = _PRICES + ", parts AS (SELECT *, CASE WHEN length(ticker) < 8 THEN '0' ELSE substr(ticker, 8, 1) END AS part FROM prices)"
_SPAN = "CAST(count(*) AS BIGINT) AS rows, min(date) AS date_min, max(date) AS date_max"
ORACLE_SQL["file_status"] = f"""WITH {_PARTS} SELECT part AS file, count(DISTINCT ticker) AS tickers, {_SPAN},
  CASE WHEN part IN ('1', '2') THEN 'descending' WHEN part = '5' THEN 'unsorted' WHEN part = '4' AND bool_or(ticker < 'Brand#2') AND bool_or(ticker >= 'Brand#2') THEN 'mixed'
    WHEN part = '4' AND bool_or(ticker < 'Brand#2') THEN 'descending' ELSE 'ascending' END AS status FROM parts GROUP BY part"""
ORACLE_SQL["file_manifest"] = f"WITH {_PARTS} SELECT part, {_SPAN}, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM parts GROUP BY part"
ORACLE_SQL["repaired_files"] = f"""WITH {_PARTS} SELECT part AS file, {_SPAN}, bool_or(part IN ('1', '2')) AS corrected,
  CASE WHEN part IS NOT NULL THEN count(*) END AS rows_after, CASE WHEN part IS NOT NULL THEN 'ascending' END AS order_after FROM parts GROUP BY ROLLUP (part)"""
ORACLE_SQL["rejected_rows"] = f"""WITH {_EVENT_PRICES}, b AS (SELECT *, day(date) AS d, CASE WHEN day(date) % 11 = 0 THEN 'a day' ELSE CAST(date AS VARCHAR) END AS t FROM ep),
j AS (SELECT *, CASE WHEN d % 7 = 0 THEN 'fields' ELSE concat_ws(',', CASE WHEN d % 11 = 0 THEN 'date' END, CASE WHEN d % 9 = 0 THEN 'volume' END) END AS reasons FROM b)
SELECT CASE reasons WHEN '' THEN 'row' ELSE 'reject' END AS kind, ticker, t AS date, CASE reasons WHEN '' THEN round(close, 6) END AS close, CASE WHEN reasons = '' AND d % 5 <> 0 THEN volume END AS volume, reasons FROM j"""


def _bijection(source: str, seed: int = 42) -> str:
    """One step of the keyed bijection on a grid of a times b cells: (run, i, x, n, a, b) with a new x."""
    word = 1 << 32
    q = f"(SELECT run, i, n, a, b, x // b AS l, x % b AS r FROM {source})"
    for k in range(4):
        own, other, side = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        key = f"(run * {0x7FEB352D} + {(seed * 0x1000193 + k * 0x27D4EB2F) % word}) % {word}"
        q = f"(SELECT *, ({other} * {0x9E3779B1} + {key}) % {word} AS y{k} FROM {q})"
        q = f"(SELECT *, xor(y{k}, y{k} >> 15) * {0x05EBCA77} % {word} AS z{k} FROM {q})"
        q = f"(SELECT * REPLACE (({own} + xor(z{k}, z{k} >> 13)) % {side} AS {own}) FROM {q})"
    return f"(SELECT run, i, l * b + r AS x, n, a, b FROM {q})"


_WEIGHTED = " + ".join(f"CASE WHEN run // 5 = {k} THEN c[{k + 2}] * (coalesce(g.{c}, 0) - coalesce(e.{c}, 0)) ELSE 0 END" for k, c in enumerate(_COLUMNS[:-1]))
_NAMES = "[" + ", ".join(f"'{c}'" for c in _COLUMNS[:-1]) + "]"
ORACLE_SQL["perm_importance"] = f"""WITH RECURSIVE {_FEATURES}{_least_squares("(SELECT *, -1 AS fold_id FROM features WHERE split = 'train')")},
ev AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5(ticker || '|' || CAST(date AS VARCHAR))) - 1 AS num, count(*) OVER () AS n FROM features WHERE split = 'val'),
sides AS (SELECT DISTINCT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a, CAST(ceil(n / (floor(sqrt(n - 1)) + 1)) AS BIGINT) AS b FROM ev),
begin AS (SELECT run, i, i AS x, n, a, b FROM sides, range(35) t(run), range((SELECT n FROM sides)) u(i)),
walk AS (SELECT * FROM {_bijection("begin")} UNION ALL SELECT * FROM {_bijection("(SELECT * FROM walk WHERE x >= n)")}),
base AS (SELECT *, {_LINEAR} AS p FROM ev, coefficients),
runs AS (SELECT run, avg((e.p + {_WEIGHTED} - e.target_forward_return) ** 2) - avg((e.p - e.target_forward_return) ** 2) AS rise
  FROM walk JOIN base e ON e.num = walk.x JOIN ev g ON g.num = walk.i WHERE walk.x < walk.n GROUP BY run)
SELECT {_NAMES}[run // 5 + 1] AS feature, round(avg(rise), 8) + 0.0 AS importance, round(stddev_pop(rise), 8) + 0.0 AS std FROM runs GROUP BY 1"""


def _row_text(columns: dict[str, str]) -> str:
    """Values in order of column names, as row_text writes them; columns: name -> kind."""
    text = {"double": "CAST(CAST({} AS DECIMAL(28, 8)) AS VARCHAR)"}
    return "concat_ws('|', " + ", ".join("coalesce('=' || " + text.get(k, "CAST({} AS VARCHAR)").format(c) + ", '-')" for c, k in sorted(columns.items())) + ")"


_ITEM = {"l_orderkey": "", "l_partkey": "", "l_suppkey": "", "l_linenumber": "", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "", "l_linestatus": "", "l_shipdate": ""}
ORACLE_SQL["fingerprint_tree"] = f"""WITH leaf AS (SELECT substr(md5(concat_ws('|', '=' || l_orderkey, '=' || l_linenumber)), 1, 2) AS node, CAST('0x' || substr(md5({_row_text(_ITEM)}), 1, 15) AS BIGINT) AS h FROM lineitem)
SELECT CAST(level AS INTEGER) AS level, substr(node, 1, level) AS node, count(*) AS rows, CAST(sum(h) AS VARCHAR) AS hash FROM leaf, range(3) t(level) GROUP BY ALL"""
ORACLE_SQL["changed_rows"] = """WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 700 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 500 <> 1
  UNION ALL SELECT -o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 900 = 3 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 1100 = 4),
one AS (SELECT o_orderkey AS k, count(*) AS n, list_sort(list(o_totalprice)) AS p FROM orders GROUP BY k), two AS (SELECT k, count(*) AS n, list_sort(list(p)) AS p FROM b GROUP BY k)
SELECT coalesce(one.k, two.k) AS o_orderkey, coalesce(one.n, 0) AS n_one, coalesce(two.n, 0) AS n_other FROM one FULL JOIN two ON one.k = two.k WHERE one.p IS DISTINCT FROM two.p"""

_N = len(_COLUMNS) - 1
_X = "[" + ", ".join(f"coalesce({c}, 0)" for c in _COLUMNS[:-1]) + "]"
_UP_TO = "range(1, " + str(_N + 1) + ")"
ORACLE_SQL["boosting_curve"] = f"""WITH RECURSIVE {_FEATURES},
t AS (SELECT {_X} AS x, target_forward_return AS y FROM features WHERE split = 'train'),
size AS (SELECT list(r ORDER BY i) AS s FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, covar_pop(x[i], x[j]) AS v FROM t, {_UP_TO} a(i), {_UP_TO} b(j) GROUP BY ALL) GROUP BY i)),
first AS (SELECT list(v ORDER BY i) AS c, list(m ORDER BY i) AS mean, any_value(y) AS y FROM (SELECT i, covar_pop(x[i], t.y) AS v, avg(x[i]) AS m, avg(t.y) AS y FROM t, {_UP_TO} a(i) GROUP BY i)),
steps AS (SELECT 0 AS k, c, list_transform(c, lambda v: 0.0::DOUBLE) AS b FROM first UNION ALL
  SELECT k + 1, list_transform(c, lambda v, i: v - 0.3 * c[j] / s[j][j] * s[i][j]), list_transform(b, lambda v, i: CASE WHEN i = j THEN v + 0.3 * c[j] / s[j][j] ELSE v END)
  FROM (SELECT k, c, b, s, list_position(g, list_max(g)) AS j FROM (SELECT k, c, b, s, list_transform(c, lambda v, i: v * v / s[i][i]) AS g FROM steps, size WHERE k < 40))),
path AS (SELECT k, b, y - list_dot_product(b, mean) AS a FROM steps, first WHERE k > 0),
curve AS (SELECT CAST(k AS INTEGER) AS iteration, avg((a + list_dot_product(b, {_X}) - target_forward_return) ** 2) AS mse, avg(abs(a + list_dot_product(b, {_X}) - target_forward_return)) AS mae, count(*) AS n
  FROM path, (SELECT * FROM features WHERE split = 'val') GROUP BY k),
best AS (SELECT *, (SELECT min(iteration) FROM curve d WHERE d.mse = (SELECT min(e.mse) FROM curve e WHERE e.iteration <= c.iteration)) AS so_far FROM curve c),
stop AS (SELECT coalesce(min(iteration) FILTER (iteration - so_far >= 3), 40) AS last FROM best)
SELECT iteration, round(mse, 5) AS mse, round(mae, 5) AS mae, n, iteration = (SELECT so_far FROM best, stop WHERE iteration = last) AS best, iteration <= (SELECT last FROM stop) AS trained FROM curve"""
ORACLE_SQL["split_shares"] = f"""WITH {_FEATURES}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM features)),
p AS (SELECT date, CASE WHEN i < CAST(floor(n * 0.6::DOUBLE) AS BIGINT) THEN 'train' WHEN i < CAST(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM d)
SELECT p.split, count(*) AS rows, min(date) AS date_min, max(date) AS date_max FROM features JOIN p USING (date) GROUP BY p.split"""
ORACLE_SQL["eval_split"] = f"""WITH {_FEATURES} SELECT 'whole' AS "table", split, ticker, count(*) AS rows FROM features WHERE split = 'val' GROUP BY ALL
  UNION ALL SELECT 'without val', split, ticker, count(*) FROM features WHERE split = 'test' GROUP BY ALL"""
ORACLE_SQL["missing_columns"] = """SELECT 'lineitem' AS name, unnest(['ticker', 'date', 'close']) AS missing, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', unnest(['ticker', 'date', 'close']), count(*) FROM orders"""
ORACLE_SQL["lenient_schema"] = """SELECT event_type, CASE WHEN event_id % 4 >= 2 THEN 'a' ELSE '' END AS missing, CASE WHEN event_id % 4 >= 2 THEN 'z' ELSE '' END AS extra, event_id % 4 < 2 AS ok, count(*) AS requests FROM events GROUP BY ALL"""
