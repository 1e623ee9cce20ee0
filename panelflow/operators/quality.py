"""Checks of panels: keys, order, completeness, leakage, fingerprints. Each returns rows to look at; assert_* raise."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.columns import number, with_previous
from panelflow.schemas import KEY


def check_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that are missing."""
    return [c for c in required if c not in df.columns]


def bad_dates(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value isn't a yyyy-MM-dd date; null counts as such."""
    return df.where(F.try_to_date(F.col(column).cast("string"), "yyyy-MM-dd").isNull())


def check_dates(df: DataFrame, column: str, examples: int = 5) -> list[str]:
    """Up to `examples` values that aren't yyyy-MM-dd dates; null counts as such."""
    return [r[0] for r in bad_dates(df, column).select(F.col(column).cast("string")).limit(examples).collect()]


def duplicate_keys(df: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Keys that several rows have, with their number n of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_rows(df: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """How many rows belong to duplicated keys, all of them counted, and how many such keys there are."""
    return duplicate_keys(df, key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"))


def ordering_status(df: DataFrame, seq: Column, file: Column, date: str = "date") -> DataFrame:
    """(file, ticker, rows, status): ascending, descending or unsorted by date in the order of seq; equal neighbours are unsorted."""
    rows = with_previous(df.select(file.alias("file"), "ticker", F.col(date).alias("_d"), seq.alias("_seq")), ["file", "ticker"], "_seq", "_d", "_p")
    before = F.col("_p")
    rows = rows.withColumn("_up", F.when(before.isNotNull(), (F.col("_d") > before).cast("int"))).withColumn("_down", F.when(before.isNotNull(), (F.col("_d") < before).cast("int")))
    status = F.when(F.coalesce(F.min("_up"), F.lit(1)) == 1, "ascending").when(F.min("_down") == 1, "descending").otherwise("unsorted")
    return rows.groupBy("file", "ticker").agg(F.count("*").alias("rows"), status.alias("status"))


def file_ordering(df: DataFrame, seq: Column, file: Column, date: str = "date") -> DataFrame:
    """(file, tickers, status): what all tickers of a file have in common: ascending, descending, or else mixed (unsorted if one is)."""
    each = ordering_status(df, seq, file, date)
    status = F.when(F.max((F.col("status") == "unsorted").cast("int")) == 1, "unsorted").when(F.min("status") == F.max("status"), F.min("status")).otherwise("mixed")
    return each.groupBy("file").agg(F.count("*").alias("tickers"), status.alias("status"))


def assert_ordered(df: DataFrame, seq: Column, file: Column, date: str = "date") -> DataFrame:
    """df, if each of its files has one order: unsorted rows and files of mixed orders raise."""
    assert_empty(file_ordering(df, seq, file, date).where("status IN ('unsorted', 'mixed')"), "files without one order")
    return df


def order_violations(df: DataFrame, seq: Column, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of a panel that aren't after the row before them (by seq) of the same entity, with that row's date."""
    entity, date = key
    rows = with_previous(df.select(*key, seq.alias("_seq")), [entity], "_seq", date, "before")
    return rows.select(*key, "before").where(F.col("before") >= F.col(date))


def rewrite_sorted(df: DataFrame, path: str, key: tuple[str, ...] = KEY) -> None:
    """Write rows ascending by entity and date, by sampled ranges of both, so no entity is one task."""
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


def numeric_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls): values that are null or no numbers; one pass for all columns."""
    counts = df.agg(*[F.count(F.when(number(F.col(c)).isNull(), 1)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "nulls")


def validation_summary(df: DataFrame, file: Column, date: str = "date") -> DataFrame:
    """Rows and date range of each file, and of all (file is null)."""
    return df.withColumn("file", file).rollup("file").agg(F.count("*").alias("rows"), F.min(date).alias("date_min"), F.max(date).alias("date_max"))


def dataset_manifest(df: DataFrame, by: Column, date: str = "date") -> DataFrame:
    """Of each part: rows, range of the dates that can be read, and sorted tickers. Raises if no date can be read."""
    parsed = F.try_to_date(F.col(date).cast("string"), "yyyy-MM-dd")
    if df.where(parsed.isNotNull()).isEmpty():
        raise ValueError(f"no date in {date} can be read")
    rows = df.withColumn("part", by).withColumn("_date", parsed)
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.min("_date").alias("date_min"), F.max("_date").alias("date_max"), F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))


def manifest_total(manifest: DataFrame) -> DataFrame:
    """One row from dataset_manifest's: parts, rows, the whole range of dates, and all tickers, sorted."""
    known = manifest.select(F.explode(F.split("tickers", ",")).alias("t")).distinct().agg(F.array_join(F.sort_array(F.collect_list("t")), ",").alias("tickers"))
    total = manifest.agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"))
    return total.crossJoin(F.broadcast(known))  # one row each


def assert_panel(df: DataFrame, key: tuple[str, ...] = KEY, seq: Column | None = None) -> DataFrame:
    """df, if it has the key columns and no key twice and, where seq says how rows lie, each entity's dates ascend; an empty table passes."""
    if missing := check_columns(df, list(key)):
        raise ValueError(f"missing columns: {missing}")
    if some := duplicate_keys(df, key).limit(3).collect():
        raise ValueError(f"duplicate keys: {[tuple(r)[: len(key)] for r in some]}")
    if seq is not None:
        assert_empty(order_violations(df, seq, key), "rows out of order")
    return df


def cutoff_violations(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Processed rows beyond the raw data: their ticker isn't there, or their date is after its last one."""
    last = raw.groupBy("ticker").agg(F.max("date").alias("raw_max"))
    return processed.select("ticker", "date").join(last, "ticker", "left").where("raw_max IS NULL OR date > raw_max")


def sentiment_violations(sentiment: DataFrame, prices: DataFrame) -> DataFrame:
    """Sentiment rows after the last price date of their ticker; tickers without prices are left alone."""
    last = prices.groupBy("ticker").agg(F.max("date").alias("price_max"))
    return sentiment.select("ticker", "date").join(last, "ticker").where("date > price_max")


def assert_empty(violations: DataFrame, what: str) -> None:
    if some := violations.limit(3).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in some]}")


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, hash_sum, hash_xor): equal for equal rows in any order and partitioning."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def row_text(df: DataFrame, digits: int = 8) -> Column:
    """All values of a row as one text, columns in order of their names: floating numbers at a fixed number of digits (none that is
    too large for a decimal), nulls told apart from empty texts."""
    parts = []
    for name, kind in sorted(df.dtypes):
        c = F.col(name)
        text = F.coalesce(c.try_cast(f"decimal(28,{digits})").cast("string"), c.cast("string")) if kind in ("double", "float") else c.cast("string")
        parts.append(F.coalesce(F.concat(F.lit("="), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def _key_text(key: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in key])


def _number(md5: Column) -> Column:
    """15 hex digits of a hash as a number: such add up in a decimal."""
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("decimal(38,0)")


def hash_tree(df: DataFrame, key: tuple[str, ...] = KEY, depth: int = 4) -> DataFrame:
    """(level, node, rows, hash): a tree over ranges of the key's md5. A node of level l is the range of its first l hex digits; its hash is the
    sum of its rows' hashes, so nodes are equal where their rows are, in any order and partitioning. Level 0 is the whole table.

    One pass: leaves are added up by task, upper levels from leaves; there are at most 16**depth leaves.
    """
    leaf = df.select(F.substring(F.md5(_key_text(key)), 1, depth).alias("node"), _number(F.md5(row_text(df))).alias("h")).groupBy("node").agg(F.count("*").alias("rows"), F.sum("h").alias("hash"))
    each = leaf.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "node", "rows", "hash")
    each = each.withColumn("node", F.substring("node", F.lit(1), F.col("level")))
    return each.groupBy("level", "node").agg(F.sum("rows").alias("rows"), F.sum("hash").alias("hash"))


def unequal_leaves(one: DataFrame, other: DataFrame) -> list[str]:
    """The leaves in which two trees differ, found from the root down: of each level, only children of unequal nodes are read.

    A tree has few nodes; write it as a table (`session.materialize`) if it is to be compared more often.
    """
    depth = max(one.agg(F.max("level")).first()[0] or 0, other.agg(F.max("level")).first()[0] or 0)
    nodes = [""]
    for level in range(depth + 1):
        under = lambda t: t.where((F.col("level") == level) & (F.substring("node", 1, max(0, level - 1)).isin(nodes) if level else F.lit(True)))  # noqa: B023, E731
        a, b = under(one).select("node", "rows", "hash"), under(other).select("node", F.col("rows").alias("r"), F.col("hash").alias("h"))
        same = F.col("rows").eqNullSafe(F.col("r")) & F.col("hash").eqNullSafe(F.col("h"))
        nodes = sorted(r["node"] for r in a.join(b, "node", "full").where(~same).select("node").collect())
        if not nodes:
            break
    return nodes


def table_differences(one: DataFrame, other: DataFrame, key: tuple[str, ...] = KEY, depth: int = 4) -> DataFrame:
    """(key columns, n_one, n_other): keys whose rows differ between two tables of the same columns, and how many rows each has there.

    Only rows in ranges where the trees differ are compared.
    """
    from panelflow.session import materialize

    leaves = unequal_leaves(materialize(hash_tree(one, key, depth), "tree"), materialize(hash_tree(other, key, depth), "tree"))
    near = lambda df: df.where(F.substring(F.md5(_key_text(key)), 1, depth).isin(leaves)) if leaves else df.limit(0)
    summed = lambda df, n, h: near(df).select(*key, _number(F.md5(row_text(df))).alias("_h")).groupBy(*key).agg(F.count("*").alias(n), F.sum("_h").alias(h))
    a, b = summed(one, "n_one", "_ha"), summed(other, "n_other", "_hb").toDF(*[f"_{k}" for k in key], "n_other", "_hb")
    met = a.join(b, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), "full")
    differ = met.where(~(F.col("n_one").eqNullSafe(F.col("n_other")) & F.col("_ha").eqNullSafe(F.col("_hb"))))
    here = F.col("n_one").isNotNull()
    return differ.select(*[F.when(here, F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in key], F.coalesce("n_one", F.lit(0)).alias("n_one"), F.coalesce("n_other", F.lit(0)).alias("n_other"))
