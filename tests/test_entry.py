"""The registered queries against their SQL, on the smallest tables, and the driver's contract."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from panelflow.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CHECKED = ["panel_ohlc", "price_features", "price_features_blocks", "merge_history", "sentiment_window", "metrics_single", "walk_metrics", "asof_lookup", "flatten_news", "stream_prices", "stream_scoring", "ordering_status", "one_hot", "ols_full", "walk_ols", "file_status", "repaired_files", "rejected_rows", "perm_importance", "changed_rows", "fingerprint_tree", "boosting_curve", "split_shares", "stream_rejects"]


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else str(v + 0.0 if isinstance(v, float) else v) for v in r) for r in frame.itertuples(index=False))


def test_contract(spark):
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLE_SQL[name])
    want = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(pd.DataFrame(df.collect(), columns=df.columns)) == _rows(want)


def test_linear_regressor_is_near_its_sql(spark):
    """Collinear columns leave the solver's eighth digit open on tables as small as these."""
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(registry.ORACLE_SQL["regressor_metrics"])
    want = dict(zip([c[0] for c in cur.description], cur.fetchone(), strict=True))
    (got,) = registry.QUERIES["regressor_metrics"](spark, SF).collect()
    assert got["n_samples"] == want["n_samples"]
    for k in ("mse", "rmse", "mae", "r2", "directional_accuracy", "ic"):
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("name", ["sentiment_join_all", "sentiment_asof_all"])
def test_sentiment_of_all_news_reaches_prices(spark, name):
    test_query_equals_sql(spark, name)
    news = registry.QUERIES["sentiment_window"](spark, SF)
    got = registry.QUERIES[name](spark, SF)
    # each day with news and a price has its whole window's articles
    both = got.join(news.withColumnRenamed("sentiment_count", "want").select("ticker", "date", "want"), ["ticker", "date"])
    assert both.count() > 0 and both.where("want <> sentiment_count").count() == 0
