"""The driver's tables as panels: daily brand prices from line items, and news and a small panel from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.operators import features, splits
from panelflow.sources.tables import read_news

BOUNDARIES = {"train_end": "1999-12-31", "val_start": "2000-01-01", "val_end": "2000-06-30", "test_start": "2000-07-01"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of a brand: first, highest, lowest and last unit price, and the quantity sold."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    items = table(spark, sf_dir, "lineitem").withColumn("price", F.try_divide("l_extendedprice", "l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    day = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", F.to_date("l_shipdate").alias("date"))
    return day.agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.max_by("price", order).alias("adjusted_close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, target and split of the brand panel."""
    return splits.assign_split(features.price_features(prices(spark, sf_dir)), BOUNDARIES)


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of an event type: the average, greatest and least value as prices, and the number of events."""
    e = table(spark, sf_dir, "events")
    day = e.groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"))
    avg = F.round(F.avg(F.col("value").cast("decimal(20,6)")).cast("double"), 6)
    return day.agg(avg.alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), avg.alias("close"), avg.alias("adjusted_close"), F.count("*").alias("volume"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles: an article is told in up to three rows, of which the first counts."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("string").alias("publication_timestamp"),
        F.col("value").alias("sentiment_score"),
        F.concat(F.lit("a"), F.floor(F.col("event_id") / 3).cast("string")).alias("article_uuid"),
        "event_id",
    )
    return read_news(rows)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests for a brand on the day of the order; some brands don't exist."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        F.concat(F.lit("brand#"), (F.col("o_custkey") % 28).cast("string")).alias("ticker"),
        F.to_date("o_orderdate").alias("as_of"),
        F.col("o_orderdate").alias("ts"),
    )
