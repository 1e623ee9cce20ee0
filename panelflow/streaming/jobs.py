"""Structured Streaming: incremental price history, and scoring of a request stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelflow.operators.ingest import flatten_daily_prices, merge_history
from panelflow.operators.serving import score_requests, unknown_tickers
from panelflow.schemas import PRICES
from panelflow.session import materialize, scratch_scope


def _versions(spark: SparkSession, out_dir: str, before: int | None = None) -> dict[str, int]:
    """Of each month, the last batch (before the given one) that has written it: from a small table that each batch adds to."""
    try:
        rows = spark.read.schema("month string, batch long").parquet(f"{out_dir}/months")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return {r["month"]: r["batch"] for r in rows.groupBy("month").agg(F.max("batch").alias("batch")).collect()}  # a row a month of the calendar


def _read_months(spark: SparkSession, out_dir: str, versions: dict[str, int]) -> DataFrame:
    paths = [f"{out_dir}/rows/batch={n}/month={m}" for m, n in sorted(versions.items())]
    return spark.read.schema(PRICES).parquet(*paths) if paths else spark.createDataFrame([], PRICES)


def history(spark: SparkSession, out_dir: str) -> DataFrame:
    """The merged history of what stream_prices has written: the current version of each month; empty before the first batch."""
    return _read_months(spark, out_dir, _versions(spark, out_dir))


def merge_batch(spark: SparkSession, rows: DataFrame, out_dir: str, number: int) -> None:
    """Merge a batch's rows into the history: only the months that it touches are read and written anew, as this batch's versions.

    The versions are named once their rows are there, so a batch that fails leaves the history as it was; one that runs again reads
    what was there before it and overwrites its own.
    """
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none"))
    new = materialize(merge_history(spark.createDataFrame([], PRICES), rows), "batch")
    touched = [r["month"] for r in new.select(month.alias("month")).distinct().collect()]  # months of the calendar
    if not touched:
        return
    before = _versions(spark, out_dir, number)
    old = _read_months(spark, out_dir, {m: n for m, n in before.items() if m in touched})
    merged = merge_history(old, new).withColumn("month", month)
    # a month may be large: a day of it goes to one file at most
    merged.repartition("month", "date").write.mode("overwrite").partitionBy("month").parquet(f"{out_dir}/rows/batch={number}")
    spark.createDataFrame([(m,) for m in touched], "month string").coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/months/batch={number}")


def stream_prices(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Merge landed (ticker, payload) JSON lines into the history, as merge_history does batch by batch.

    A batch's work goes with the months it touches, not with the history (see merge_batch), and reading the history doesn't
    depend on how many batches there were. Files are taken in the order they landed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        with scratch_scope(spark):
            merge_batch(spark, flatten_daily_prices(batch), out_dir, number)

    raw = spark.readStream.schema("ticker string, payload string").option("maxFilesPerTrigger", files_per_batch).json(in_dir)
    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scoring(spark: SparkSession, requests_dir: str, features: DataFrame, columns: list[str], prediction: Column, out_dir: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Score (request_id, ticker, as_of, ts) JSON requests against a static feature table. Late requests are dropped: scoring.score_stream
    names them, and takes features by stream.

    A request id counts once inside the watermark. Scores go to out_dir/scores, unknown tickers to out_dir/rejects, each
    batch under its number.
    """

    def score(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read three times
        try:
            # of the feature table, rows that the batch can meet: its tickers, up to its last day
            asked = batch.groupBy(F.upper(F.trim("ticker")).alias("_asked")).agg(F.max("as_of").alias("_last"))
            near = (F.upper(F.trim(features["ticker"])) == F.col("_asked")) & (features["date"] <= F.col("_last"))
            with scratch_scope(spark):
                score_requests(batch, features.join(asked, near, "left_semi"), columns, prediction).write.mode("overwrite").parquet(f"{out_dir}/scores/batch={number}")
            unknown_tickers(batch, features).write.mode("overwrite").parquet(f"{out_dir}/rejects/batch={number}")
        finally:
            batch.unpersist()

    raw = spark.readStream.schema("request_id string, ticker string, as_of date, ts timestamp").json(requests_dir)
    once = raw.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])
    return once.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
