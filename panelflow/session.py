"""Session defaults and shared scratch space."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def build_session(app: str = "panelflow", **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, and adaptive execution with skew handling (on by default)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # first rows of groups are kept in hash tables: let them grow before they are sorted
    builder = builder.config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only a local session may do without: it gets one of its own."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark).rstrip('/')}/panelflow-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables that are made inside, by this thread, at its end: for a stream's batches, whose results are written by then."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for made in scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this session has written, and return how many. Call it once results have been written:
    a result that hasn't is still read from them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark).rstrip('/')}/panelflow-{spark.sparkContext.applicationId}-*")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(path) or []
    for status in found:
        files.delete(status.getPath(), True)
    return len(found)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
