"""Schemas of the panel's tables. Names of columns, features and metrics, and of fields in landed documents."""

from pyspark.sql import types as T

PRICES = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adjusted_close")]
    + [T.StructField("volume", T.LongType())]
)
#: A landed daily-price document; fields of a day are numeric strings.
DAILY_JSON = T.StructType([T.StructField("Time Series (Daily)", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))])
_ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("symbol", "sentiment_score", "match_score")])
_ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in ("uuid", "title", "published_at", "source", "url", "relevance_score")] + [T.StructField("entities", T.ArrayType(_ENTITY))])
_PAGE = T.StructType([T.StructField("data", T.ArrayType(_ARTICLE))])
#: A landed news document: one page, or several under `pages`.
NEWS_JSON = T.StructType([T.StructField("pages", T.ArrayType(_PAGE)), T.StructField("data", T.ArrayType(_ARTICLE))])

KEY = ("ticker", "date")
PRICE_FEATURES = ["return_1d", "return_5d", "return_21d", "volatility_5d", "volatility_21d", "range_hl", "volume_pct_1d"]
SENTIMENT_FEATURES = ["sentiment_avg", "sentiment_count", "sentiment_momentum"]
TARGET = "target_forward_return"
METRICS = ["mse", "rmse", "mae", "r2", "directional_accuracy", "ic"]
