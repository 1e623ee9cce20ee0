"""Landed JSON to tables, and incremental history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import number
from panelflow.schemas import DAILY_JSON, KEY, NEWS_JSON


def flatten_daily_prices(raw: DataFrame) -> DataFrame:
    """From (ticker, payload JSON) to one row a day.

    A day without open or close is skipped; so is one with any field that is present but no number. Adjusted close
    falls back to close, volume to field 5 and is cut to whole numbers; empty high, low or volume are null.
    """
    days = raw.select("ticker", F.explode(F.from_json("payload", DAILY_JSON)["Time Series (Daily)"]).alias("day", "f"))
    given = lambda k: F.nullif(F.trim(F.col("f")[k]), F.lit(""))
    text = {"open": given("1. open"), "high": given("2. high"), "low": given("3. low"), "close": given("4. close")}
    text |= {"adjusted_close": F.coalesce(given("5. adjusted close"), text["close"]), "volume": F.coalesce(given("6. volume"), given("5. volume"))}
    days = days.select("ticker", F.try_to_date("day", "yyyy-MM-dd").alias("date"), *[v.alias(f"_{k}") for k, v in text.items()], *[number(v).alias(k) for k, v in text.items()])
    ok = F.col("open").isNotNull() & F.col("close").isNotNull()
    for k in text:
        ok = ok & (F.col(f"_{k}").isNull() | F.col(k).isNotNull())
    return days.where(ok).select(*KEY, "open", "high", "low", "close", "adjusted_close", F.col("volume").try_cast("bigint").alias("volume"))


def flatten_news(raw: DataFrame) -> DataFrame:
    """From (ticker, payload JSON) to one row for each entity that names the ticker.

    An article with a title that names no such entity gives one row without scores. A payload is one page or has several
    under `pages`.
    """
    doc = raw.select("ticker", F.from_json("payload", NEWS_JSON).alias("j"))
    pages = F.coalesce(F.col("j.pages"), F.array(F.struct(F.col("j.data").alias("data"))))
    articles = doc.select("ticker", F.explode(pages).alias("p")).select("ticker", F.explode("p.data").alias("a"))
    mine = F.filter(F.coalesce("a.entities", F.array()), lambda e: F.upper(F.trim(e["symbol"])) == F.upper(F.trim(F.col("ticker"))))
    rows = articles.withColumn("mine", mine).where((F.size("mine") > 0) | (F.trim(F.coalesce("a.title", F.lit(""))) != ""))
    rows = rows.select("ticker", "a", F.explode_outer("mine").alias("e"))
    return rows.select(
        "ticker",
        F.col("a.published_at").alias("publication_timestamp"),
        F.col("a.title").alias("headline"),
        F.col("a.source").alias("source"),
        number(F.col("e.sentiment_score")).alias("sentiment_score"),
        number(F.col("e.match_score")).alias("match_score"),
        number(F.col("a.relevance_score")).alias("relevance_score"),
        F.col("a.uuid").alias("article_uuid"),
        F.col("a.url").alias("url"),
    )


def merge_history(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = KEY, seq: Column | None = None) -> DataFrame:
    """One row a key: an incoming row wins whole, nulls included; of several incoming, the one with the greatest seq."""
    columns = existing.columns
    new = incoming.select(*columns, F.lit(1).alias("_batch"), (seq if seq is not None else F.lit(0)).cast("long").alias("_seq"))
    both = existing.select(*columns, F.lit(0).alias("_batch"), F.lit(0).cast("long").alias("_seq")).unionByName(new)
    rest = [F.col(c) for c in columns if c not in key]  # equal seq: any fixed choice
    last = Window.partitionBy(*key).orderBy(F.col("_batch").desc(), F.col("_seq").desc(), *rest)
    return both.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select(*columns)


def merge_stats(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """For each incoming ticker: status, keys that are new, rows after the merge, and its date range."""
    old = existing.select(*key).distinct().withColumn("_old", F.lit(1))
    new = incoming.select(*key).distinct().withColumn("_new", F.lit(1))
    both = old.join(new, list(key), "full")
    out = both.groupBy(key[0]).agg(
        F.max(F.coalesce("_old", F.lit(0))).alias("had"),
        F.max(F.coalesce("_new", F.lit(0))).alias("got"),
        F.sum(F.when(F.col("_old").isNull(), 1).otherwise(0)).alias("new_rows"),
        F.count("*").alias("total_rows"),
        F.min(key[1]).alias("date_min"),
        F.max(key[1]).alias("date_max"),
    )
    return out.where("got = 1").select(key[0], F.when(F.col("had") == 1, "updated").otherwise("created").alias("status"), "new_rows", "total_rows", "date_min", "date_max")
