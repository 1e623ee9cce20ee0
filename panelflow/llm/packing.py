"""Packing by optimal length buckets.

The histogram of document lengths over the whole corpus goes to a dynamic programme that chooses bucket boundaries with the
least padding; inside each bucket, documents in a shuffled order fill batches of a token budget: as many documents as
fit when each is padded to the bucket's boundary, one at least.

A length is a document's number of words unless a column is named. The histogram is exact: a row for each different length.
Texts of n words in all have at most sqrt(2 n) different lengths (some millions for 10**13 words), so it goes to the
driver as it is.

Edge cases: null and empty texts have length 0 and share the first bucket, padded like all others; documents longer than
the budget make a batch of one; an empty table gives an empty result; null ids count as the empty text in the shuffle,
repeated rows are packed each; very long texts are a length like any other. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.common import materialize, words

BUCKETS = 8
BUDGET = 16_384


def choose_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most `buckets` ranges of the ascending lengths, so that sum(count * (end - length)) is least.

    A longer prefix's last bucket never begins earlier than a shorter one's (its cost satisfies the quadrangle inequality),
    so each layer is filled by halving: the choice for a middle length bounds those on either side. n log n for each bucket.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, ahead = lengths.astype(np.int64), np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    # the padded size of lengths i..j-1 in one bucket is their count times lengths[j-1]; the sum of lengths is constant
    best, choice = np.concatenate(([0], ahead[1:] * lengths)), [np.zeros(n + 1, np.int64)]
    for used in range(2, min(buckets, n) + 1):
        new, at = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        # prefixes lo..hi whose last bucket begins between low and high
        lo, hi, low, high = (np.array([x]) for x in (used, n, used - 1, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            size = np.minimum(high, mid - 1) - low + 1
            start = np.cumsum(size) - size
            of = np.repeat(np.arange(len(mid)), size)
            begin = np.arange(size.sum()) - start[of] + low[of]
            total = best[begin] + (ahead[mid[of]] - ahead[begin]) * lengths[mid[of] - 1]
            least = np.minimum.reduceat(total, start)
            hit = np.flatnonzero(total == least[of])
            first = hit[np.concatenate(([True], of[hit][1:] != of[hit][:-1]))]
            new[mid], at[mid] = least, begin[first]
            lo, hi, low, high = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (low, at[mid]), (at[mid], high)))
            some = lo <= hi
            lo, hi, low, high = lo[some], hi[some], low[some], high[some]
        choice.append(at)
        best = new
    ends, j = [], n
    for at in reversed(choice):
        ends.append(int(lengths[j - 1]))
        j = at[j]
    return ends[::-1]


def pack(documents: DataFrame, length: str | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, length, bucket, boundary, batch): batch numbers the batches of a bucket from 0."""
    size = F.size(words(F.col("text"))) if length is None else F.coalesce(F.col(length), F.lit(0))
    df = documents.select("doc_id", size.cast("long").alias("length"))
    df = df.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    df = materialize(df, "lengths")
    histogram = df.groupBy("length").agg(F.count("*").alias("n")).toArrow().sort_by("length")
    ends = choose_boundaries(histogram.column("length").to_numpy(), histogram.column("n").to_numpy(), buckets)
    if not ends:
        return df.select("doc_id", "length", F.lit(0).alias("bucket"), F.col("length").alias("boundary"), F.col("length").alias("batch"))
    of = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        of = F.when(F.col("length") <= ends[k], F.lit(k)).otherwise(of)
    df = df.withColumn("bucket", of).withColumn("boundary", F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1))
    df = df.withColumn("part", F.substring("key", 1, 3))
    parts = df.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    parts = parts.select("bucket", "part", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("bucket", "part").orderBy("key", "length")) - 1
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1))))
    return df.join(parts, ["bucket", "part"]).withColumn("batch", F.floor(place / fits)).select("doc_id", "length", "bucket", "boundary", "batch")


def oracle_sql(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same in DuckDB SQL, for corpora of at least `buckets` different lengths."""
    best = "b1 AS (SELECT j, a * len AS c, CAST(0 AS BIGINT) AS i FROM r)"
    for k in range(2, buckets + 1):
        best += f""",
x{k} AS (SELECT r.j, min(row(p.c + (r.a - q.a) * r.len, p.j)) AS s FROM r JOIN b{k - 1} p ON p.j < r.j JOIN r q ON q.j = p.j GROUP BY r.j), b{k} AS (SELECT j, s[1] AS c, s[2] AS i FROM x{k})"""
    ends = f"e{buckets} AS (SELECT max(j) AS j FROM r)"
    for k in range(buckets - 1, 0, -1):
        ends += f", e{k} AS (SELECT b.i AS j FROM b{k + 1} b JOIN e{k + 1} e ON b.j = e.j)"
    chosen = " UNION ALL ".join(f"SELECT {k - 1} AS bucket, len AS boundary FROM r JOIN e{k} USING (j)" for k in range(1, buckets + 1))
    return rf"""
WITH d AS (SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS length FROM documents),
r AS (SELECT row_number() OVER (ORDER BY length) AS j, length AS len, CAST(sum(count(*)) OVER (ORDER BY length) AS BIGINT) AS a FROM d GROUP BY length),
{best},
{ends},
ends AS ({chosen}),
b AS (SELECT bucket, boundary, lag(boundary, 1, -1) OVER (ORDER BY boundary) AS below FROM ends),
p AS (SELECT d.*, bucket, boundary FROM d JOIN b ON length <= boundary AND length > below)
SELECT doc_id, length, CAST(bucket AS INTEGER) AS bucket, boundary,
  CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY k, length) - 1) / greatest(1, floor({budget} / greatest(boundary, 1)))) AS BIGINT) AS batch FROM p
"""
