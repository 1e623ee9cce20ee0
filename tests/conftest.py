import datetime as dt
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


PRICE_SCHEMA = "ticker string, date date, open double, high double, low double, close double, adjusted_close double, volume bigint"


@pytest.fixture(scope="session")
def trend(spark):
    """30 days of one ticker on a straight line."""

    def make(days=30, ticker="AAPL", volume=None, start=dt.date(2024, 1, 1)):
        rows = []
        for i in range(days):
            p = 100 + 0.5 * i
            rows.append((ticker, start + dt.timedelta(days=i), p, p + 1, p - 1, p, p, volume if volume is not None else 1_000_000 + 1000 * i))
        return spark.createDataFrame(rows, PRICE_SCHEMA)

    return make
