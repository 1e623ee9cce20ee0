"""Scoring a stream of requests with state: features that arrive as a stream too, and a sink for requests that get no score.

State is kept for each ticker, in shards: a request goes to one by the hash of its id, feature rows go to all. A shard holds the
feature rows that requests may still ask for, and the ids of requests it has seen. Event
time of the requests moves the watermark; timers on it forget ids and old feature rows, so state is bounded by the
lateness allowed, not by the stream's length. The requests' own times don't reach Spark's filter of late rows, so that late
requests come to the operator, which names them instead of dropping them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from panelflow.operators.serving import with_confidence

REQUESTS = "request_id string, ticker string, as_of date, ts timestamp"
_DAY_MS = 86_400_000
_BLOCK = 256  # days of feature rows that make one state
_OUT = "request_id string, ticker string, day int, us long, status string, feature_day int"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_PACK = 200_000  # rows of a task that are packed together at most
_PACKED = "key string, shard int, ids array<string>, tickers array<string>, days binary, us binary, vectors binary"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A row for each (key, shard), which holds its rows' columns; of feature rows ids, tickers and us are null, of requests vectors."""
    code = pdf.groupby(["key", "shard"], sort=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    ends = np.flatnonzero(np.diff(code[order], append=-1)) + 1
    pdf, bounds = pdf.iloc[order], list(zip([0, *ends[:-1]], ends, strict=True))
    out = pdf[["key", "shard"]].iloc[ends - 1].reset_index(drop=True)
    cut = lambda values, as_bytes: [values[a:b].tobytes() if as_bytes else values[a:b] for a, b in bounds]
    out["days"] = cut(pdf["day"].to_numpy("int32"), True)
    if "vector" in pdf:
        out["vectors"] = cut(np.stack(pdf["vector"].to_list()).astype("float64"), True)
        return out.assign(ids=None, tickers=None, us=None)
    out["ids"], out["tickers"] = cut(pdf["request_id"].to_numpy(object), False), cut(pdf["ticker"].to_numpy(object), False)
    out["us"] = cut(pdf["us"].to_numpy("int64"), True)
    return out.assign(vectors=None)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Few rows for many: Spark hands rows to a processor one by one."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= _PACK:
            yield _pack(pd.concat(held, ignore_index=True))
            held = []
    if sum(map(len, held)):
        yield _pack(pd.concat(held, ignore_index=True))


class TickerState(StatefulProcessor):
    """A shard of one ticker's requests, and the ticker's feature rows. Of a batch, feature rows come first, then requests.

    Each state that is read or written is a call out of Python, which costs more than hundreds of rows do. So feature rows are kept in
    blocks of days (of width columns: values, then 1 where a value is null), and ids by spans of days of event time, as long as what is
    remembered; ids of days that the next batch's watermark won't remember any more aren't kept.
    """

    def __init__(self, width: int, remember_ms: int, late_ms: int) -> None:
        self.width, self.remember_ms, self.late_ms = width, remember_ms, late_ms
        self.span = max(1, remember_ms // _DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "block int", "days binary, vectors binary")
        self.seen = handle.getMapState("seen", "span int", "days array<int>, ids array<string>")
        self.next = handle.getValueState("next", "at long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        for row in initialState.itertuples(index=False):
            self._learn(*self._unpacked((row.days, row.vectors)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        ids, tickers, days, us = [], [], [], []
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                if row.vectors is not None:
                    self._learn(*self._unpacked((row.days, row.vectors)))
                    continue
                ids.extend(row.ids)
                tickers.extend(row.tickers)
                days.append(np.frombuffer(row.days, "int32"))
                us.append(np.frombuffer(row.us, "int64"))
        if not ids:
            return
        asked = pd.DataFrame({"request_id": ids, "ticker": tickers, "day": np.concatenate(days), "us": np.concatenate(us)})
        watermark = timerValues.getCurrentWatermarkInMs()
        asked["of"] = asked["us"] // (1000 * _DAY_MS)
        asked = self._unseen(asked.drop_duplicates(["request_id", "of"], ignore_index=True), watermark)
        self._wake(timerValues)
        days, vectors = self._known()
        at = np.searchsorted(days, asked["day"].to_numpy("int32"), side="right") - 1
        late = (asked["us"] // 1000 < watermark).to_numpy()
        status = np.select([late, np.full(len(at), not len(days)), at < 0], ["late", "unknown", "no_features"], "ok").astype(object)
        ok = status == "ok"
        held = np.full(len(at), -1)
        held[ok] = at[ok]
        out = asked[["request_id", "ticker", "day", "us"]].assign(status=status)
        # one row more, of nulls, for requests without features
        out["feature_day"] = np.append(days, 0)[held]
        for i in range(self.width // 2):
            values, nulls = (np.append(vectors[:, j], 1.0)[held] for j in (i, self.width // 2 + i))
            out[f"v{i}"] = pd.arrays.FloatingArray(values, nulls > 0)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        self.next.clear()
        for span in [k[0] for k in self.seen.keys() if not self._remembered((k[0] + 1) * self.span - 1, watermark)]:
            self.seen.removeKey((span,))
        # a request in time is for the watermark's day or a later one: of the days up to it, the last is enough
        first = {k[0]: np.frombuffer(v[0], "int32")[0] for k, v in self.rows.iterator()}
        old = sorted(block for block, day in first.items() if day <= watermark // _DAY_MS)
        for block in old[:-1]:
            self.rows.removeKey((block,))
        if self.seen.exists():
            self._wake(timerValues)
        return iter([])

    def _learn(self, days: np.ndarray, vectors: np.ndarray) -> None:
        """Feature rows into their blocks; of rows of one day, the last counts."""
        for block in np.unique(days // _BLOCK).tolist():
            mine = days // _BLOCK == block
            old = self.rows.getValue((block,))
            before = self._unpacked(old) if old else (np.empty(0, "int32"), np.empty((0, self.width)))
            d, v = np.concatenate([before[0], days[mine]]), np.concatenate([before[1], vectors[mine]])
            d, last = np.unique(d[::-1], return_index=True)
            self.rows.updateValue((block,), (d.tobytes(), v[::-1][last].tobytes()))

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        """Days, ascending, and a row of width columns for each."""
        blocks = [self._unpacked(value) for _, value in sorted((k[0], v) for k, v in self.rows.iterator())]
        return np.concatenate([np.empty(0, "int32"), *[d for d, _ in blocks]]), np.concatenate([np.empty((0, self.width)), *[v for _, v in blocks]])

    def _unpacked(self, value: tuple) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(value[0], "int32"), np.frombuffer(value[1], "float64").reshape(-1, self.width)

    def _remembered(self, day: int | pd.Series, watermark: int) -> bool | pd.Series:
        return (day + 1) * _DAY_MS + self.remember_ms > watermark

    def _unseen(self, asked: pd.DataFrame, watermark: int) -> pd.DataFrame:
        """Requests whose ids weren't seen on their day; these are seen from now on."""
        then = max(watermark, int(asked["us"].max()) // 1000 - self.late_ms)  # the next batch's watermark is no earlier
        kept = {k[0] for k in self.seen.keys()}
        fresh = np.ones(len(asked), bool)
        asked["keep"], span = self._remembered(asked["of"], then), asked["of"] // self.span
        for k, part in asked[asked["keep"] | span.isin(kept)].groupby(span):
            days, ids = self.seen.getValue((int(k),)) if k in kept else ([], [])
            known = set(zip(days, ids, strict=True))
            new = np.array([x not in known for x in zip(part["of"], part["request_id"], strict=True)])
            fresh[part.index] = new
            add = part[new & part["keep"]]
            if len(add):
                self.seen.updateValue((int(k),), ([*days, *add["of"].tolist()], [*ids, *add["request_id"]]))
        return asked[fresh]

    def _wake(self, timerValues) -> None:  # noqa: ANN001, N803
        """One timer at a time: when the watermark has moved on by what is remembered."""
        if not self.next.exists():
            at = timerValues.getCurrentWatermarkInMs() + self.remember_ms
            self.handle.registerTimer(at)
            self.next.update((at,))

    def close(self) -> None:
        pass


def score_stream(
    spark: SparkSession,
    requests_dir: str,
    updates_dir: str,
    features: DataFrame,
    columns: list[str],
    prediction: Column,
    out_dir: str,
    checkpoint: str,
    late: dt.timedelta = dt.timedelta(days=1),
    remember: dt.timedelta = dt.timedelta(days=7),
    files_per_batch: int | None = 1,
    shards: int = 8,
) -> StreamingQuery:
    """Score JSON requests (request_id, ticker, as_of, ts) by the latest feature row at or before as_of that has arrived.

    features: the rows known at the start (a checkpoint knows them, too; they are read once); updates_dir: JSON rows (ticker,
    date, columns) that arrive later, a row of the same day replaces the old one. Each request gets one row, in out_dir/scores
    (status ok, or no_features where all the ticker's rows are later) or in out_dir/rejects (late: more than `late` behind the
    newest request of the batches before; unknown: a ticker without any row). Requests with an id that the ticker has seen, of the same day and within `remember` (of event
    time), are dropped, as are those without id, ticker, as_of or ts. as_of must not lie before the day of ts: older feature rows are forgotten.

    files_per_batch: files of requests, and of updates, that make a batch; None: all that are there. shards: a ticker's requests are dealt to so
    many tasks, each of which holds its requests of a batch and keeps a copy of the ticker's feature rows.

    A batch that runs again overwrites its own files; a restart from the checkpoint, with as many shards, goes on with the same state.
    """
    name = F.upper(F.trim("ticker"))
    values = [F.col(c).cast("double") for c in columns]
    vector = F.array(*[F.coalesce(v, F.lit(0.0)) for v in values], *[v.isNull().cast("double") for v in values])
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))

    def landed(schema: str, folder: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).json(folder)

    timed = landed(REQUESTS, requests_dir).withWatermark("ts", f"{int(late.total_seconds())} seconds").where("request_id IS NOT NULL AND ticker IS NOT NULL AND as_of IS NOT NULL AND ts IS NOT NULL")
    # times as plain numbers: without the watermark's mark, late rows aren't filtered
    asked = timed.select(
        name.alias("key"), F.pmod(F.xxhash64("request_id"), F.lit(shards)).cast("int").alias("shard"), "request_id", "ticker",
        F.unix_date("as_of").alias("day"), F.unix_micros("ts").alias("us"),
    ).mapInPandas(_packed, _PACKED)
    more = landed(", ".join(["ticker string", "date date", *[f"{c} double" for c in columns]]), updates_dir)

    def known(rows: DataFrame) -> DataFrame:
        rows = rows.where("ticker IS NOT NULL AND date IS NOT NULL").select(name.alias("key"), F.lit(0).alias("shard"), F.unix_date("date").alias("day"), vector.alias("vector"))
        return rows.mapInPandas(_packed, _PACKED).withColumn("shard", every)

    news, start = known(more), known(features).select("key", "shard", "days", "vectors")
    processor = TickerState(2 * len(columns), int(remember.total_seconds() * 1000), int(late.total_seconds()) * 1000)
    answer = ", ".join([_OUT, *[f"v{i} double" for i in range(len(columns))]])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)  # the only one with maps and timers
    try:
        told = asked.unionByName(news).groupBy("key", "shard").transformWithStateInPandas(processor, answer, "Append", "EventTime", start.groupBy("key", "shard"))
        found = F.when(F.col("status") == "ok", F.date_from_unix_date("feature_day")).alias("feature_date")
        values = told.select("request_id", "ticker", F.date_from_unix_date("day").alias("as_of"), F.timestamp_micros("us").alias("ts"), "status", found, *[F.col(f"v{i}").alias(c) for i, c in enumerate(columns)])

        def write(batch: DataFrame, number: int) -> None:
            scored = with_confidence(batch, F.when(F.col("status") == "ok", prediction))
            sink = F.when(F.col("status").isin("ok", "no_features"), "scores").otherwise("rejects")
            confidence = F.when(sink == "scores", F.col("confidence")).alias("confidence")
            rows = scored.select("request_id", "ticker", "as_of", "ts", "status", "feature_date", "prediction", confidence, sink.alias("sink"))
            rows.write.mode("overwrite").partitionBy("sink").parquet(f"{out_dir}/batch={number}")

        return values.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def scores(spark: SparkSession, out_dir: str) -> DataFrame:
    """What score_stream has written: scored requests and rejects, told apart by `sink`."""
    return spark.read.parquet(out_dir).drop("batch")
