"""N-gram Jaccard join by rare-first prefix filtering, with length, positional and suffix filters.

Rows with equal shingle sets form a class with a number of its own; pairs are found and verified between classes, and only
the result goes back to doc_id. Shingles are ordered rare first by counts over the whole corpus (a count sketch of fixed
size decides the order; any order gives the same links). Two sets can only be similar if their prefixes share a shingle,
so the join runs on prefix shingles.

Pairs are tried in two rounds, so that a group of n near copies doesn't make n * n pairs. First each class meets the
earliest (by its smallest doc_id) of those it shares a prefix shingle with. Links that hold make components. Then every pair that
shares a prefix shingle, passes the filters and isn't yet in one component is tried. So pairs inside a component are left
out, which cannot change the components, and no others. A frequent shingle's rows are dealt to as many salts as its count
asks for, on both rounds.

Edge cases: null, empty and blank texts have no shingles and link with nothing; shorter texts than n words are one
shingle; rows that repeat a doc_id with other texts are one document as far as links go (what one of them reaches, all
reach); rows with a null id get null as component; an empty table gives an empty result. Very long texts are hashed in pieces,
whole; a text's shingle set is held in one task. Only doc_id and text are read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import components, filter_has, gather_blocks, materialize, membership_filter, mix, shingles, split_blocks, word_hashes

#: Slots of the count sketch, 16 MB.
SKETCH_BITS = 22
_SOME = 512
#: Rows of a prefix shingle that a salt takes.
_SALT_ROWS = 1000


def shingle_counts(documents: DataFrame, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """In how many documents the shingles of each slot occur, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << bits, np.uint32)
        for pdf in batches:
            texts = list(pdf["text"])
            for at in range(0, len(texts), _SOME):
                slots = np.concatenate([shingles(word_hashes(t), n) for t in texts[at : at + _SOME]]) >> np.uint64(64 - bits)
                np.add.at(table, slots.astype(np.int64), 1)
        yield split_blocks(table, 64)

    return gather_blocks(documents.select("text").mapInPandas(count, "block int, data binary"), 1 << bits, "uint32", np.add)


#: What tells two shingle sets apart: 128 bits of fingerprint and the size.
KEY = ("fp1", "fp2", "n_shingles")


def fingerprints(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    one = [int(np.add.reduce(mix(s)).astype(np.int64)) if len(s) else 0 for s in sets]
    two = [int(np.bitwise_xor.reduce(mix(s + np.uint64(0x632BE59BD9B4E019))).astype(np.int64)) if len(s) else 0 for s in sets]
    return one, two


def prefix_rows(documents: DataFrame, n: int, num: int, den: int, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, prefix): a fingerprint of the set and its rarest shingles, rare first."""
    shared = documents.sparkSession.sparkContext.broadcast(shingle_counts(documents, n, bits))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = shared.value
        for pdf in batches:
            size, one, two, prefix, last_count, last = [], [], [], [], [], []
            for text in pdf["text"]:
                s = shingles(word_hashes(text), n)
                size.append(len(s))
                for put, value in zip((one, two), fingerprints([s]), strict=True):
                    put += value
                often = seen[(s >> np.uint64(64 - bits)).astype(np.int64)]
                rare = np.lexsort((s.astype(np.int64), often))[: len(s) - -(-num * len(s) // den) + 1]
                prefix.append(s[rare].astype(np.int64))
                last_count.append(int(often[rare[-1]]) if len(s) else 0)
                last.append(prefix[-1][-1] if len(s) else 0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": size, "fp1": one, "fp2": two, "last_count": last_count, "last": last, "prefix": prefix})

    # ids travel as text: with a null among them, pandas would make them floats
    out = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(rows, "doc_id string, n_shingles long, fp1 long, fp2 long, last_count long, last long, prefix array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _may_link(num: int, den: int, n: Column, pos: Column, m: Column, mpos: Column) -> Column:
    """Length filter, and positional filter at a shared prefix shingle."""
    need = F.ceil((F.lit(num) * (n + m)) / F.lit(num + den))
    return (F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)) & (F.least(n - pos, m - mpos) >= need)


def _prefixes_allow(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose overlap can still be large enough, given how many prefix shingles they share.

    Up to the earlier of the two prefixes' ends, in the common order, both prefixes are complete; so the overlap is at most
    the shared prefix shingles and what follows the prefix that ends first.
    """
    side = lambda name, k: classes.select(F.col("cid").alias(name), F.struct("n_shingles", F.struct("last_count", "last").alias("end"), "prefix").alias(k))
    joined = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    shared = F.size(F.array_intersect("x.prefix", "y.prefix"))
    rest = F.when(F.col("x.end") <= F.col("y.end"), F.col("x.n_shingles") - F.size("x.prefix")).otherwise(F.col("y.n_shingles") - F.size("y.prefix"))
    need = F.ceil((F.lit(num) * (F.col("x.n_shingles") + F.col("y.n_shingles"))) / F.lit(num + den))
    return joined.where(shared + rest >= need).select(*pairs.columns)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the number of elements that only one of two sorted sets holds, from how they fall apart at medians."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def _verify(pairs: DataFrame, documents: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets are similar; every pair is compared once.

    Sets are built for the classes in pairs only, from rows that have the class's doc_id and fingerprint.
    """
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    ids = materialize(classes.join(ids, "cid", "left_semi").select("cid", "doc_id", *KEY), "ids")
    chosen = membership_filter(ids.select("doc_id"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[filter_has(chosen.value, pdf["doc_id"].to_numpy(np.int64))]
            items = [shingles(word_hashes(t), n) for t in pdf["text"]]
            one, two = fingerprints(items)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp1": one, "fp2": two, "n_shingles": list(map(len, items)), "items": [s.tobytes() for s in items]})

    rows = documents.where("doc_id IS NOT NULL").mapInPandas(build, "doc_id long, fp1 long, fp2 long, n_shingles long, items binary")
    sets = rows.join(ids, ["doc_id", *KEY]).groupBy("cid").agg(F.first("items").alias("items"))
    sets = materialize(sets, "sets")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for k, (left, right) in enumerate(zip(pdf["left"], pdf["right"], strict=True)):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                need = -(-num * (len(x) + len(y)) // (num + den))
                if len(x) + len(y) - suffix_bound(x, y) < 2 * need:
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[k] = den * both >= num * (len(x) + len(y) - both)
            yield pdf.loc[keep, ["a", "b"]]

    joined = pairs.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("right")), "b").join(sets.select(F.col("cid").alias("a"), F.col("items").alias("left")), "a")
    return materialize(joined.mapInPandas(check, "a long, b long"), "links")


def join_documents(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents link if den * intersection >= num * union of their n-word
    shingle sets; component_id is the smallest doc_id that links reach."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(prefix_rows(documents, n, num, den), "prefixes")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.first("last_count").alias("last_count"), F.first("last").alias("last"), F.first("prefix").alias("prefix"))
    # the number is drawn while the table is written, once; from then on it is read
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # prefix shingles of two classes or more; the bitmap spares the shuffle of all others
    index = classes.select("cid", F.explode("prefix").alias("gram"))
    common = materialize(index.groupBy("gram").agg(F.count("*").alias("grams")).where("grams > 1"), "common")
    held = membership_filter(common.select("gram"))

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), _SOME):
                part = pdf.iloc[at : at + _SOME]
                size = part["prefix"].str.len().to_numpy(np.int64)
                gram = np.concatenate(part["prefix"].to_list()).astype(np.int64)
                start = np.repeat(np.cumsum(size) - size, size)
                out = pd.DataFrame({"cid": np.repeat(part["cid"].to_numpy(), size), "first": np.repeat(part["doc_id"].to_numpy(), size), "n": np.repeat(part["n_shingles"].to_numpy(), size), "pos": np.arange(len(gram)) - start, "gram": gram})
                yield out[filter_has(held.value, gram)]

    index = classes.select("cid", "doc_id", "n_shingles", "prefix").mapInPandas(prune, "cid long, first long, n long, pos long, gram long").join(common, "gram")
    salts = F.floor((F.col("grams") - 1) / _SALT_ROWS) + 1
    index = materialize(index.select("gram", "cid", "first", "n", "pos", salts.alias("salts"), F.pmod(F.xxhash64("cid"), salts).alias("salt")), "index")
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))

    # first round: the earliest class met at a prefix shingle
    leaders = index.groupBy("gram", "salt").agg(F.min(F.struct("first", "cid", "n", "pos", "salts")).alias("lead")).groupBy("gram").agg(F.min("lead").alias("lead"))
    leaders = leaders.select("gram", "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lead.salts") - 1)).alias("salt"))
    later = F.struct("first", "cid") > F.struct(F.col("lead.first").alias("first"), F.col("lead.cid").alias("cid"))
    met = index.join(leaders, ["gram", "salt"]).where(later & _may_link(num, den, F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
    met = _prefixes_allow(met.select(F.col("lead.cid").alias("a"), F.col("lead.first").alias("order"), F.col("cid").alias("b")).distinct(), classes, num, den)
    tried = met.groupBy("b").agg(F.min(F.struct("order", "a")).alias("to"))
    tried = materialize(tried.select(F.least("b", "to.a").alias("a"), F.greatest("b", "to.a").alias("b")), "tried")
    links = _verify(tried, documents, classes, n, num, den)

    # classes of one document belong together
    members = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id", *KEY).agg(F.lit(1))
    shared = members.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    members = materialize(members.join(shared, "doc_id", "left_semi").join(classes.select("cid", *KEY), list(KEY)).select("doc_id", "cid"), "members")
    same = members.join(members.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").where("a < cid").select("a", F.col("cid").alias("b"))
    links = links.union(same)

    # second round: all pairs across components
    found = components(links).withColumnRenamed("id", "cid")
    placed = index.join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
    placed = materialize(placed.join(mixed, "gram"), "placed")
    x, y = placed.alias("x"), placed.drop("salt").withColumn("salt", every_salt).alias("y")
    across = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.component") < F.col("y.component")) & _may_link(num, den, F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
    pairs = across.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = _verify(materialize(_prefixes_allow(pairs, classes, num, den), "pairs"), documents, classes, n, num, den)

    final = components(links.union(more)).withColumnRenamed("id", "cid")
    named = materialize(classes.select(*KEY, "cid", "doc_id").join(final, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select(*KEY, "component_id")
    out = rows.select("doc_id", *KEY).join(named, list(KEY), "left")
    # a row without shingles belongs to what other rows with its doc_id link with
    blank = rows.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    others = rows.where("n_shingles > 0").join(blank, "doc_id", "left_semi").join(named, list(KEY)).groupBy("doc_id").agg(F.min("component_id").alias("by_id"))
    out = out.join(others, "doc_id", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "by_id", "doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


#: All pairs, for small data.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (WITH RECURSIVE c AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.id WHERE c.root < p.b)
  SELECT id, min(root) AS component_id FROM c GROUP BY id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, r.component_id FROM s JOIN r ON s.doc_id = r.id
"""
