"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame expressions.

Points of the golden-ratio sequence, mapped through the cumulative target shares, say which source fills each slot of the
schedule. With a Fibonacci number of slots, the sequence puts into every share as many slots as its length asks for, to
about one; a source too small for any point gets the one slot at its share's place. Documents of a source are shuffled by
a hash of their id and laid end to end, as often as the source may be repeated, up to the source's target in whole words;
this tape is cut into as many blocks of equal token counts (to the word) as the source has slots, and its r-th slot takes block
r. So what is taken of a source is its target to less than one word, however small the source is, blocks of all sources
are of about the same size, and a document's first slot is where training first meets it. Work for a source is split by
ranges of the shuffle hash and of slots, so no task holds a source.

Edge cases: null text has size 0 and is taken 0 times; the null source is a source of its own, last in order; a corpus
without words has target 0 everywhere; repeated rows are laid out one after another; null ids count as the empty text; very
long texts may lie in many blocks. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.common import materialize, words

GOLDEN = 0.6180339887498949
MAX_EPOCHS = 3
#: Slots of a schedule, the 26th Fibonacci number; sources smaller than a slot get one each besides.
SLOTS = 121_393
#: Sources up to which their table is broadcast; beyond, adaptive execution splits large sources' join.
MOST_SOURCES = 100_000
#: Ranges of the shuffle hash: 16**3.
_RANGE_DIGITS = 3


def target_sizes(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size) to (source, source_size, target): the total shared by weight, none above max_epochs times its size.

    Sharing the excess again and again ends where every source has min(cap, level * weight); the level follows from sums
    over the sources in order of cap per weight.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_code_point) - 1) % len(weights) + 1)
    df = sizes.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    # running sums in whole numbers and small weights are exact, whatever the order of ties
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    df = df.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level)).withColumn("level", F.max("level").over(Window.partitionBy()))
    return df.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"), "weight")


def lay_out(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, first, key): first is the word position of a document in its source's shuffled order."""
    df = documents.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    df = df.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    df = materialize(df.withColumn("part", F.substring("key", 1, _RANGE_DIGITS)), "sizes")
    parts = df.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return df.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", "source", "size", (F.col("ahead") + F.col("inside")).alias("first"))


def golden_point(slot: Column) -> Column:
    """The place of a slot in [0, 1): fractional part of slot * golden ratio."""
    return slot * F.lit(GOLDEN) - F.floor(slot * F.lit(GOLDEN))


def schedule(targets: DataFrame, slots: int = SLOTS, point: Callable[[Column], Column] = golden_point) -> DataFrame:
    """(source, rank, slot): the slots that each source fills, ranked within the source from 0; every source with a target has one."""
    spark = targets.sparkSession
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    to = F.sum("target").over(by_code_point.rowsBetween(Window.unboundedPreceding, 0))
    shares = targets.where("target > 0").select("source", (F.row_number().over(by_code_point) - 1).alias("no"), to.alias("to"), (to - F.col("target")).alias("from"))
    whole = F.max("to").over(Window.partitionBy())
    shares = materialize(shares.select("source", "no", (F.col("from") / whole).alias("from"), (F.col("to") / whole).alias("to")), "shares")
    # a slot's cell of 1/4096 holds the few sources that it may fall to: an equi-join, never a range join
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * 4096), F.least(F.floor(F.col("to") * 4096), F.lit(4095)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    hit = points.withColumn("cell", F.floor(F.col("u") * 4096)).join(cells, "cell").where("u >= `from` AND u < `to`")
    hit = hit.select("no", "slot", F.floor(F.col("slot") / 4096).alias("chunk"))
    counts = hit.groupBy("no", "chunk").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("no", "chunk", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    ranked = hit.withColumn("in_chunk", F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1).join(counts, ["no", "chunk"])
    filled = ranked.select("no", (F.col("ahead") + F.col("in_chunk")).alias("rank"), "slot").join(shares.select("no", "source"), "no").select("source", "rank", "slot")
    missed = shares.join(hit.select("no").distinct(), "no", "left_anti")
    place = F.floor((F.col("from") + F.col("to")) / 2 * slots).cast("long")
    return filled.unionByName(missed.select("source", F.lit(0).cast("long").alias("rank"), place.alias("slot")))


def mix_sources(
    documents: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = MAX_EPOCHS, slots: int = SLOTS, point: Callable[[Column], Column] = golden_point
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot): taken counts the words of a document that the mix takes,
    first_slot is the first slot that takes some of them (null if none does)."""
    placed = materialize(lay_out(documents).withColumn("row", F.monotonically_increasing_id()), "placed")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(target_sizes(sizes, weights, max_epochs), "targets")
    filled = materialize(schedule(targets, slots, point), "schedule")
    counts = filled.groupBy("source").agg(F.count("*").alias("blocks")).select(F.col("source").alias("s1"), "blocks")
    by = targets.join(counts, F.col("source").eqNullSafe(F.col("s1")), "left").select(F.col("source").alias("s2"), "source_size", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    if targets.count() <= MOST_SOURCES:  # so that no source's documents meet in one task
        by = F.broadcast(by)
    sized = placed.join(by, F.col("source").eqNullSafe(F.col("s2")), "left").withColumn("words_to_take", F.floor(F.col("target") + 0.5))
    # block b of a source holds the words from b * words_to_take / blocks on, rounded down; long products need decimals
    most = targets.agg(F.max("target")).first()[0] or 0
    kind = "BIGINT" if (most + 2) * (slots + 1) < 2**62 else "DECIMAL(20,0)"
    edge = lambda b: F.expr(f"(CAST({b} AS {kind}) * CAST(words_to_take AS {kind})) div CAST(blocks AS {kind})")
    block = lambda word: F.expr(f"(CAST({word} + 1 AS {kind}) * CAST(blocks AS {kind}) - 1) div CAST(words_to_take AS {kind})")
    turns = sized.where("size > 0 AND words_to_take > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    turns = turns.select("row", "source", (F.col("turn") * F.col("source_size") + F.col("first")).alias("at"), "size", "words_to_take", "blocks").where("at < words_to_take")
    held = turns.withColumn("b", F.explode(F.sequence(block("at"), block("least(at + size, words_to_take) - 1"))))
    held = held.select("row", "source", "b", (F.least(edge("b + 1"), F.col("at") + F.col("size")) - F.greatest(edge("b"), F.col("at"))).alias("words"))
    taken = filled.select(F.col("source").alias("s"), F.col("rank").alias("r"), "slot")
    got = held.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("r"))).groupBy("row").agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"))
    got = got.withColumnRenamed("row", "taker")
    out = sized.join(got, F.col("row") == F.col("taker"), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "first_slot")


#: Slots by the sequence, ranked within sources; a source's slots take its tape up to its target.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM d),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
m AS (SELECT *, max(CASE WHEN lvl * weight <= cap THEN lvl END) OVER () AS level FROM l),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(least(cap, level * weight) AS DOUBLE) AS target FROM m),
a AS (SELECT source, target, sum(target) OVER (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t WHERE target > 0),
b AS (SELECT source, (upto - target) / max(upto) OVER () AS lo, upto / max(upto) OVER () AS hi FROM a),
u AS (SELECT slot, slot * CAST({GOLDEN!r} AS DOUBLE) - floor(slot * CAST({GOLDEN!r} AS DOUBLE)) AS u FROM (SELECT unnest(range({SLOTS})) AS slot)),
h AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM u JOIN b ON u >= lo AND u < hi),
r AS (SELECT source, slot, rank FROM h UNION ALL SELECT source, CAST(floor((lo + hi) / 2 * {SLOTS}) AS BIGINT), 0 FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source IS NOT DISTINCT FROM b.source)),
c AS (SELECT source, count(*) AS filled FROM r GROUP BY source),
j AS (SELECT p.rid, p.doc_id, p.source, p.size, p.first, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS tape,
    CASE WHEN p.size > 0 AND p.first < floor(t.target + 0.5) THEN ((p.first + 1) * filled - 1) // CAST(floor(t.target + 0.5) AS BIGINT) END AS rank
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, slot AS first_slot,
  CAST(coalesce(greatest(0, least(tape, first + size) - first) + greatest(0, least(tape, source_size + first + size) - source_size - first)
    + greatest(0, least(tape, 2 * source_size + first + size) - 2 * source_size - first), 0) AS BIGINT) AS taken
FROM j LEFT JOIN r ON j.source IS NOT DISTINCT FROM r.source AND j.rank = r.rank
"""
