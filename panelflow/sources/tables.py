"""Scans and sinks: prices, news, feature and prediction tables, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.operators.quality import assert_panel
from panelflow.schemas import KEY, PRICES

_BAD = "_corrupt_record"


def read_prices(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Daily prices with the schema of the panel; a CSV's dates are yyyy-MM-dd, others become null. Duplicate keys stay (see quality)."""
    if fmt == "csv":
        text = spark.read.option("header", "true").csv(paths)
        return text.select(*[(F.try_to_date(F.col(f.name), "yyyy-MM-dd") if f.name == "date" else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in PRICES.fields])
    return spark.read.schema(PRICES).format(fmt).load(paths)


def scan_prices(spark: SparkSession, paths: str | list[str], fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of price files: no row is lost. rows have the panel's schema and `_metadata`; rejects are (file, place, record, reasons).

    A row is rejected if its number of fields isn't the header's (reason `fields`), if ticker or date is missing, or if a
    field that is there is no value of its column's kind (reasons name the columns). place is where the row's split begins in the
    file. A header that lacks a column, or another format than csv, has null there or no bad fields.
    """
    if fmt == "csv":
        names = spark.read.option("header", "true").csv(paths).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(_BAD, T.StringType())])
        raw = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).csv(paths)
        text = {f.name: F.nullif(F.trim(F.col(f.name)), F.lit("")) if f.name in names else F.lit(None).cast("string") for f in PRICES.fields}
        kept = F.coalesce(F.col(_BAD), F.concat_ws(",", *[F.coalesce(F.col(n), F.lit("")) for n in names]))
    else:
        raw = spark.read.format(fmt).load(paths)
        text = {f.name: F.col(f.name).cast("string") if f.name in raw.columns else F.lit(None).cast("string") for f in PRICES.fields}
        raw = raw.withColumn(_BAD, F.lit(None).cast("string"))
        kept = F.to_json(F.struct(*raw.columns))
    value = {f.name: F.try_to_date(text[f.name], "yyyy-MM-dd") if f.name == "date" else text[f.name].try_cast(f.dataType) for f in PRICES.fields}
    wrong = [F.when(F.col(_BAD).isNotNull(), F.lit("fields"))]
    wrong += [F.when(F.col(_BAD).isNull() & (value[n].isNull() & (text[n].isNotNull() if n not in KEY else F.lit(True))), F.lit(n)) for n in PRICES.names]
    both = raw.select("_metadata", kept.alias("record"), F.array_compact(F.array(*wrong)).alias("reasons"), *[value[n].alias(n) for n in PRICES.names])
    rejects = both.where("size(reasons) > 0").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"), "record", "reasons")
    return both.where("size(reasons) = 0").select(*PRICES.names, "_metadata"), rejects


def read_listed_prices(spark: SparkSession, manifest: DataFrame, fmt: str = "csv") -> DataFrame:
    """Prices from the files that a manifest (path) lists, and no others; an empty list and keys that occur twice raise.

    A manifest has a row for each file, so its paths go to the driver, which hands them to the scan.
    """
    paths = sorted({r["path"] for r in manifest.where("path IS NOT NULL").select("path").collect()})
    if not paths:
        raise ValueError("the manifest lists no file")
    return assert_panel(read_prices(spark, paths, fmt))


def read_news(news: DataFrame) -> DataFrame:
    """Normalized news with pub_ts and pub_date; rows whose timestamp can't be read are dropped."""
    ts = F.try_to_timestamp(F.col("publication_timestamp").cast("string"))
    return news.withColumn("pub_ts", ts).where("pub_ts IS NOT NULL").withColumn("pub_date", F.to_date("pub_ts"))


def latest_version(spark: SparkSession, path: str, hint: str | None = None) -> str:
    """The greatest version of a table partitioned by version, or the hinted one, which must exist. Lists folders, opens no file."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    versions = [spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(n[len("version=") :]) for n in names if n.startswith("version=")]
    if hint is not None:
        if hint not in versions:
            raise ValueError(f"no version {hint}")
        return hint
    if not versions:
        raise ValueError("no version")
    return max(versions)


def read_version(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    return spark.read.parquet(path).where(F.col("version").cast("string") == latest_version(spark, path, hint))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The rows of one split; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_version(df: DataFrame, path: str, version: str) -> None:
    """Write df as one version of a table; writing it again replaces that version only."""
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def write_features(df: DataFrame, path: str, version: str, features: list[str], target: str) -> None:
    """Feature table in its fixed column order: ids, split, features, target."""
    write_version(df.select("ticker", "date", "split", *features, target), path, version)


def write_predictions(df: DataFrame, path: str, version: str) -> None:
    write_version(df.select("ticker", "asof_date", "target_date", "y_true", "y_pred", "model_name", "fold_id"), path, version)
