"""News sentiment over calendar windows that never look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import latest_as_of, number, ratio, round_digits
from panelflow.operators.features import clip_dates
from panelflow.schemas import SENTIMENT_FEATURES


def dedupe_articles(news: DataFrame) -> DataFrame:
    """Of each ticker's rows with one article_uuid the first by time; rows without one count as one article.

    Equal times go by score, nulls last, then by the other columns' hash. Each task keeps one row for each article it meets before rows
    are dealt, so a ticker's rows without id, however many, are one row of each task.
    """
    columns = [c for c in news.columns if c not in ("ticker", "article_uuid")]
    order = F.struct(F.coalesce(F.unix_date("pub_date"), F.lit(-(2**31))), F.coalesce(F.unix_micros("pub_ts"), F.lit(-(2**63))), F.isnull("sentiment_score"), F.col("sentiment_score"), F.xxhash64(*columns))
    # the set of a constant keeps the aggregation hashed: rows of structs would be sorted otherwise
    first = news.groupBy("ticker", "article_uuid").agg(F.min_by(F.struct(*columns), order).alias("_row"), F.collect_set(F.lit(True)).alias("_hashed"))
    return first.where(F.size("_hashed") > 0).select("ticker", "article_uuid", "_row.*").select(*news.columns)


def coerce_score(score: Column) -> Column:
    """Scores that are null or no numbers count as 0."""
    return F.coalesce(number(score), F.lit(0.0))


def sentiment_features(news: DataFrame, lookback_days: int = 7, min_date: str | None = None, max_date: str | None = None) -> DataFrame:
    """(ticker, date, sentiment_avg, sentiment_count, sentiment_momentum) for each day with news.

    avg and count cover the last lookback_days days, today's news included; momentum is avg less the avg of the days before
    these (0 if none). Daily sums come first, so windows run over days, not articles.
    """
    day = dedupe_articles(news).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.sum(coerce_score(F.col("sentiment_score"))).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("ticker").orderBy(F.unix_date("date"))
    now, before = w.rangeBetween(1 - lookback_days, 0), w.rangeBetween(1 - 2 * lookback_days, -lookback_days)
    day = day.select("ticker", "date", F.sum("s").over(now).alias("s1"), F.sum("n").over(now).alias("n1"), F.sum("s").over(before).alias("s0"), F.sum("n").over(before).alias("n0"))
    avg = ratio(F.col("s1"), F.col("n1"))
    momentum = avg - F.coalesce(ratio(F.col("s0"), F.col("n0")), F.lit(0.0))
    out = day.select("ticker", "date", round_digits(avg, 10).alias("sentiment_avg"), F.col("n1").alias("sentiment_count"), round_digits(momentum, 10).alias("sentiment_momentum"))
    return clip_dates(out, min_date, max_date)


def attach(prices: DataFrame, sentiment: DataFrame) -> DataFrame:
    """prices with the sentiment of the same day; 0 on days without news."""
    return prices.join(sentiment.select("ticker", "date", *SENTIMENT_FEATURES), ["ticker", "date"], "left").fillna(0, SENTIMENT_FEATURES)


def attach_asof(prices: DataFrame, sentiment: DataFrame, max_age_days: int = 7) -> DataFrame:
    """prices with the last sentiment row at or before the day, at most max_age_days old; 0 if there is none."""
    s = sentiment.select("ticker", F.col("date").alias("sentiment_date"), *SENTIMENT_FEATURES)
    out = latest_as_of(prices, s, ["ticker"], "date", "sentiment_date", ["sentiment_date", *SENTIMENT_FEATURES])
    fresh = F.datediff("date", "sentiment_date") < max_age_days
    return out.withColumns({c: F.coalesce(F.when(fresh, F.col(c)), F.lit(0)) for c in SENTIMENT_FEATURES}).drop("sentiment_date")
