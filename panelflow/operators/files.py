"""Validation of price files as they lie: order, dates, rows; repair of descending files; rows that can't be read.

Where a row stands in its file isn't in the data, so each task reads its splits in order and hands on a summary for each
ticker of a split: first and last date, whether dates ascend or descend all through, rows and range. Summaries of a file's
splits are folded in the order of the splits' places. No row is sorted, and none leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.schemas import PRICES
from panelflow.sources.tables import scan_prices

_SUMMARY = "file string, place long, ticker string, rows long, dated long, first int, last int, lo int, hi int, up boolean, down boolean"


def summarize_runs(file: np.ndarray, place: np.ndarray, ticker: np.ndarray, day: np.ndarray, null: np.ndarray, held: dict) -> None:
    """Add rows, in order, to the summaries held under (file, place, ticker): numbers that stand for names; null: rows without a date."""
    if not len(day):
        return
    order = np.lexsort((np.arange(len(day)), ticker, place, file))
    f, p, t, d, z = (x[order] for x in (file, place, ticker, day, null))
    new = np.flatnonzero(np.concatenate(([True], (f[1:] != f[:-1]) | (p[1:] != p[:-1]) | (t[1:] != t[:-1]))))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(f)], strict=True):
        x = d[a:b][~z[a:b]]
        step = np.diff(x)
        one = [b - a, len(x), *((int(x[0]), int(x[-1]), int(x.min()), int(x.max())) if len(x) else (None,) * 4), bool((step > 0).all()), bool((step < 0).all())]
        key = (f[a], p[a], t[a])
        held[key] = fold(held[key], one) if key in held else one


def fold(a: list, b: list) -> list:
    """Two summaries of neighbouring stretches as one."""
    if a[1] == 0 or b[1] == 0:
        rest = b if a[1] == 0 else a
        return [a[0] + b[0], *rest[1:]]
    return [a[0] + b[0], a[1] + b[1], a[2], b[3], min(a[4], b[4]), max(a[5], b[5]), a[6] and b[6] and a[3] < b[2], a[7] and b[7] and a[3] > b[2]]


def file_summaries(rows: DataFrame, date: str = "date", entity: str = "ticker") -> DataFrame:
    """Of a scan of files (with `_metadata`), in file order: (file, ticker, rows, date_min, date_max, status). status: ascending, descending or
    unsorted, as the dates of a ticker stand in the file; equal neighbours are unsorted, one row is ascending; rows without a
    date count, but have no order."""
    placed = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"), F.col(entity).alias("ticker"), F.unix_date(F.col(date)).alias("day"))

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        names: list[dict] = [{}, {}]
        for batch in batches:
            coded = []
            for known, column in zip(names, (batch.column(0), batch.column(2)), strict=True):
                d = column.dictionary_encode()
                to = np.array([known.setdefault(v, len(known)) for v in d.dictionary.to_pylist()] + [known.setdefault(None, len(known))])
                coded.append(to[d.indices.fill_null(len(to) - 1).to_numpy(zero_copy_only=False)])
            day = batch.column(3)
            summarize_runs(coded[0], batch.column(1).to_numpy(zero_copy_only=False), coded[1], day.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(day.is_null()), held)
        back = [list(known) for known in names]
        rows = [(back[0][f], int(p), back[1][t], *one) for (f, p, t), one in held.items()]
        if rows:
            fields = [c.rsplit(" ", 1) for c in _SUMMARY.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    parts = placed.mapInArrow(summarize, _SUMMARY)
    # a file has a summary for each of its splits, so few meet
    stretch = F.struct("place", "dated", "first", "last", "up", "down")
    each = parts.groupBy("file", "ticker").agg(F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(stretch)).alias("parts"))
    parts_ = F.filter("parts", lambda p: p["dated"] > 0)
    inside = lambda way: F.forall(parts_, lambda p: p[way])
    joints = lambda ok: F.forall(F.transform(parts_, lambda p, i: F.when(i > 0, ok(F.get(parts_, i - 1)["last"], p["first"])).otherwise(F.lit(True))), lambda x: x)
    status = F.when(inside("up") & joints(lambda a, b: a < b), "ascending").when(inside("down") & joints(lambda a, b: a > b), "descending").otherwise("unsorted")
    day = lambda c: F.date_from_unix_date(c)
    return each.select("file", "ticker", "rows", day("lo").alias("date_min"), day("hi").alias("date_max"), status.alias("status"))


def file_orders(summaries: DataFrame) -> DataFrame:
    """(file, tickers, rows, date_min, date_max, status) of each file: the order that all its tickers have, or else mixed (unsorted if one is).

    A ticker with one row fits either order.
    """
    both = F.col("rows") > 1
    unsorted = F.max((F.col("status") == "unsorted").cast("int")) == 1
    up, down = (F.max((both & (F.col("status") == s)).cast("int")) == 1 for s in ("ascending", "descending"))
    status = F.when(unsorted, "unsorted").when(up & down, "mixed").when(down, "descending").otherwise("ascending")
    return summaries.groupBy("file").agg(F.count("*").alias("tickers"), F.sum("rows").alias("rows"), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"), status.alias("status"))


def files_summary(orders: DataFrame) -> DataFrame:
    """file_orders' rows as (file, rows, date_min, date_max, corrected) and one for all files (file is null): corrected says that the file
    descends and has to be rewritten, or that some file has."""
    corrected = F.max((F.col("status") == "descending").cast("int")) == 1
    return orders.rollup("file").agg(F.sum("rows").alias("rows"), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"), corrected.alias("corrected"))


def files_manifest(summaries: DataFrame) -> DataFrame:
    """(part, rows, date_min, date_max, tickers) of each file, tickers sorted; raises if no file has a date."""
    if summaries.where("date_min IS NOT NULL").isEmpty():
        raise ValueError("no date in any file")
    tickers = F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers")
    return summaries.groupBy(F.col("file").alias("part")).agg(F.sum("rows").alias("rows"), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"), tickers)


def file_stem(file: Column) -> Column:
    """The name of a file without folders and ending."""
    return F.regexp_extract(file, r"([^/]*?)(\.[^/.]*)*$", 1)


def write_ascending(rows: DataFrame, path: str, file: str, entity: str = "ticker", date: str = "date") -> None:
    """Write rows as Parquet, a folder for each value of the column `file`, ascending by entity and date in each file written.

    Ranges of (file, entity, date) are sampled, so neither a file nor an entity is one task.
    """
    ranged = rows.repartitionByRange(file, entity, date).sortWithinPartitions(file, entity, date)
    ranged.write.mode("overwrite").partitionBy(file).parquet(path)


def validate_files(spark: SparkSession, path: str, out: str, fmt: str = "csv", name: Callable[[Column], Column] = file_stem) -> DataFrame:
    """Check price files and write them, ascending, to out; returns files_summary.

    Files of mixed orders or unsorted ones, rows that can't be read and keys that occur twice in a file raise, and nothing is
    written. Files go by `name` of their path, the stem if not given; the parts of out are folders by it (`name=...`).
    """
    rows, rejects = scan_prices(spark, path, fmt)
    if some := rejects.limit(3).collect():
        raise ValueError(f"rows that can't be read: {[(r['file'], r['reasons']) for r in some]}")
    orders = file_orders(file_summaries(rows)).cache()  # a row a file
    try:
        if some := orders.where("status IN ('unsorted', 'mixed')").limit(3).collect():
            raise ValueError(f"files without one order: {[(r['file'], r['status']) for r in some]}")
        placed = rows.select(*PRICES.names, name(F.col("_metadata.file_path")).alias("name"))
        if some := placed.groupBy("name", "ticker", "date").count().where("count > 1").limit(3).collect():
            raise ValueError(f"duplicate keys: {[tuple(r)[:3] for r in some]}")
        write_ascending(placed, out, "name")
        return spark.createDataFrame(files_summary(orders.withColumn("file", name(F.col("file")))).collect(), "file string, rows long, date_min date, date_max date, corrected boolean")
    finally:
        orders.unpersist()
