"""Centroid clustering over zone maps along a space-filling curve.

Vectors are turned into the frame of their principal directions (from sums over all of them), laid along a Hilbert curve
through the first few, and cut into blocks; a block keeps the least and greatest value of each turned component: a box.
In each round, a block takes the exact distances of its rows to the centroid nearest to the box's middle. A centroid whose
box is further away than that can't be nearer for that row, so the block's candidates are the centroids whose box
distance reaches the largest of them; only those are compared, exactly and for all rows at once. What a round adds up
(rows and sums of each cluster, by task) doesn't grow with the data, and every task reads blocks as they were written.

The order and the frame only decide how much is left out; distances and sums are whole numbers. Components of 2**22 or more
take Python's integers instead of doubles. Sums are kept in two parts, so they are exact for any finite input.

Edge cases: vectors that are null, of another length, or hold null or non-finite components (256 times a component must be
finite too) take no part; a null id starts no centroid but is clustered; of equal hashes (repeated ids) the lesser vector
comes first; fewer vectors than centroids give fewer centroids; equal vectors may start two, the smaller number gets their
rows and the other stays empty; ties go to the smaller number; distances beyond a long are given as the largest long, inertias too;
an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import gather_blocks, materialize
from panelflow.llm.topk import quantize

CENTROIDS = 40
ROUNDS = 5
SEED = 2
BLOCK_ROWS = 256
#: Directions and bits of each that the curve runs through: 60 bits.
DIRECTIONS, BITS = 10, 6
#: Lesser components have squared distances below 2**53, so doubles hold them.
_EXACT = 1 << 22
_LIMB = 1 << 60
_LONG = 2**63 - 1


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, none of them null, and 256 times each is a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * 256) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & F.coalesce(F.forall(vector, finite), F.lit(False))


def hilbert_key(levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of whole coordinates below 2**bits along a Hilbert curve (at most 63 bits in all)."""
    x = levels.astype(np.int64).T.copy()
    n = len(x)
    # from coordinates to the transposed index: undo rotations from the highest bit down, then Gray code
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            up = (x[i] >> b & 1).astype(bool)
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[n - 1] >> b & 1, turn ^ ((1 << b) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _frame(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, directions as columns, spread along each) of all vectors: one array of fixed size, added up on the executors."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        total = np.zeros((dim + 1, dim + 1))
        for pdf in batches:
            x = np.concatenate((np.ones((len(pdf), 1)), np.clip(_doubles(pdf["x"], dim), -1e9, 1e9)), axis=1)
            total += x.T @ x
        yield pd.DataFrame({"block": np.zeros(1, np.int32), "data": [zlib.compress(total.tobytes(), 1)]})

    total = gather_blocks(vectors.select("x").mapInPandas(sums, "block int, data binary"), (dim + 1) ** 2, "float64", np.add).reshape(dim + 1, dim + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    size, turn = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return mean, turn[:, ::-1].copy(), np.sqrt(np.maximum(size[::-1], 1e-12))


def _doubles(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


_BLOCK = "ids binary, nulls binary, x binary, lo binary, hi binary"


def build_blocks(vectors: DataFrame, dim: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Blocks of vectors (vec_id, x: dim doubles as bytes) along the curve, and the frame that their boxes lie in."""
    mean, turn, spread = _frame(vectors, dim)
    k = min(DIRECTIONS, dim)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            along = (np.clip(_doubles(pdf["x"], dim), -1e9, 1e9) - mean) @ turn[:, :k] / spread[:k]
            levels = np.clip((along + 2) * (1 << BITS) / 4, 0, (1 << BITS) - 1)
            yield pdf.assign(key=hilbert_key(levels.astype(np.int64)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < block_rows:
                continue
            rows = pd.concat(held)
            whole = len(rows) // block_rows * block_rows
            yield pd.DataFrame([block(rows.iloc[at : at + block_rows]) for at in range(0, whole, block_rows)], columns=names)
            held = [rows.iloc[whole:]]
        rows = pd.concat(held) if held else []
        if len(rows):
            yield pd.DataFrame([block(rows)], columns=names)

    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def block(rows: pd.DataFrame) -> list[bytes]:
        x = _doubles(rows["x"], dim)
        turned = x @ turn
        return [rows["vec_id"].fillna(0).to_numpy(np.int64).tobytes(), rows["vec_id"].isna().to_numpy().tobytes(), x.tobytes(), turned.min(axis=0).tobytes(), turned.max(axis=0).tobytes()]

    placed = materialize(vectors.mapInPandas(place, "vec_id long, x binary, tie long, key long"), "placed")
    # ties of the curve are dealt by a hash of the row, so copies of one vector spread over tasks and blocks
    laid = placed.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("vec_id", "x")
    return materialize(laid.mapInPandas(cut, _BLOCK), "blocks"), turn


def box_distance(lo: np.ndarray, hi: np.ndarray, points: np.ndarray) -> np.ndarray:
    """A lower bound of the squared distance from each point to what lies in the box, small enough for rounding."""
    out = np.maximum(np.maximum(lo - points, points - hi), 0.0)
    return (out * out).sum(axis=1) * (1 - 1e-9) - 1e-9 * (points * points).sum(axis=1) - 1e-9 * max(lo @ lo, hi @ hi)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances as int64, beyond it the largest; whole numbers in, exact out."""
    if max(np.abs(x).max(initial=0), max((abs(int(v)) for v in centroids.ravel()), default=0)) < _EXACT:
        c = centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.minimum(_wide_distances(x, centroids), _LONG).astype(np.int64)


def _wide_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    whole = np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return np.array([[sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids.tolist()] for row in whole.tolist()], dtype=object).reshape(len(x), len(centroids))


def nearest(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row of a block, and how many centroids were compared with all its rows."""
    wide = max(np.abs(x).max(initial=0), max(abs(int(v)) for v in centroids.ravel())) >= _EXACT
    measure = _wide_distances if wide else distances
    first = int(((turned - (lo + hi) / 2) ** 2).sum(axis=1).argmin())
    reach = measure(x, centroids[first : first + 1])[:, 0]
    bound = box_distance(lo, hi, turned)
    some = np.flatnonzero((bound <= float(max(reach))) | (np.arange(len(centroids)) == first))
    d = measure(x, centroids[some])
    best = d.argmin(axis=1)  # the first of equals, and `some` ascends
    return some[best], np.minimum(d[np.arange(len(x)), best], _LONG).astype(np.int64), len(some)


def _load(row, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    return np.frombuffer(row.x).reshape(-1, dim), np.frombuffer(row.lo), np.frombuffer(row.hi)


def _move(blocks: DataFrame, centroids: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """One round: the centroids as the whole means, rounded down, of the vectors nearest to each."""
    dim, k = centroids.shape[1], len(centroids)
    shared = blocks.sparkSession.sparkContext.broadcast((centroids, centroids.astype(np.float64) @ turn))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, turned = shared.value
        high, low, count = np.zeros((k, dim), object), np.zeros((k, dim), object), np.zeros(k, np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, lo, hi = _load(row, dim)
                cluster = nearest(x, lo, hi, c, turned)[0]
                count += np.bincount(cluster, minlength=k)
                if np.abs(x).max(initial=0) < _EXACT:
                    for j in np.unique(cluster):
                        low[j] += x[cluster == j].sum(axis=0).astype(np.int64).astype(object)
                else:
                    for j, values in zip(cluster, x.tolist(), strict=True):
                        parts = [divmod(int(v), _LIMB) for v in values]
                        high[j], low[j] = high[j] + np.array([p[0] for p in parts], object), low[j] + np.array([p[1] for p in parts], object)
        used = np.flatnonzero(count)
        of, at = np.repeat(used, dim), np.tile(np.arange(dim), len(used))
        yield pd.DataFrame({"cluster": of.astype(np.int32), "i": at.astype(np.int32), "n": count[of], "high": [Decimal(int(v)) for v in high[used].ravel()], "low": [Decimal(int(v)) for v in low[used].ravel()]})

    parts = blocks.mapInPandas(add, "cluster int, i int, n long, high decimal(38,0), low decimal(38,0)")
    moved = centroids.copy()
    for row in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # k * dim rows
        moved[row["cluster"], row["i"]] = (int(row["high"]) * _LIMB + int(row["low"])) // row["n"]
    return moved


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = 64, scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors: (vec_id, embedding). Returns (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, candidates):
    after `rounds` rounds from k starting vectors; candidates is how many centroids the row's block was compared with."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding"), dim)).select(F.col("vec_id").cast("long").alias("vec_id"), quantize(F.col("embedding"), scale).alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim) + 0.0  # no negative zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["vec_id", "x"])

    rows = materialize(kept.mapInArrow(whole, "vec_id long, x binary").withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    # the starting vectors: k rows, of the least hashes
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.where("vec_id IS NOT NULL").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([[int(v) for v in r["v"]] for r in start], dtype=object).reshape(len(start), dim)
    out = "vec_id long, cluster int, distance long, candidates int"
    if not len(centroids):
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "candidates")
    blocks, turn = build_blocks(rows, dim, block_rows)
    for _ in range(rounds):
        centroids = _move(blocks, centroids, turn)
    shared = spark.sparkContext.broadcast((centroids, centroids.astype(np.float64) @ turn))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, turned = shared.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, lo, hi = _load(row, dim)
                of, d, n = nearest(x, lo, hi, c, turned)
                ids = pd.Series(np.frombuffer(row.ids, np.int64)).astype("Int64").mask(np.frombuffer(row.nulls, bool))
                yield pd.DataFrame({"vec_id": ids, "cluster": of.astype(np.int32), "distance": d, "candidates": np.full(len(x), n, np.int32)})

    placed = materialize(blocks.mapInPandas(assign, out), "assigned")
    as_long = lambda c: F.least(c, F.lit(Decimal(_LONG))).cast("long")
    each = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    names = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())], "c int, centroid_sha256 string")
    # a row for each centroid
    of = each.crossJoin(F.broadcast(each.agg(F.sum("s").alias("total")))).join(F.broadcast(names), F.col("cluster") == F.col("c"))
    of = of.select("c", as_long(F.col("s")).alias("cluster_inertia"), as_long(F.col("total")).alias("inertia"), "centroid_sha256")
    joined = placed.join(F.broadcast(of), F.col("cluster") == F.col("c"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "candidates")



def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = 64) -> str:
    """The same in DuckDB SQL, every distance computed."""
    steps = ""
    for r in range(rounds + 1):
        steps += f""",
d{r} AS MATERIALIZED (SELECT rid, min(row(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c)) AS s FROM v, c{r} c GROUP BY rid)"""
        if r < rounds:
            steps += f""",
m{r} AS (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
  SELECT s[2] AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM v JOIN d{r} USING (rid), range(1, {dim + 1}) t(i) GROUP BY ALL)),
c{r + 1} AS MATERIALIZED (SELECT c0.c, coalesce(n.v, c0.v) AS v FROM c{r} c0 LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM m{r} GROUP BY c) n ON n.c = c0.c)"""
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL) WHERE c < {k}){steps},
o AS (SELECT vec_id, CAST(s[2] AS INTEGER) AS cluster, CAST(s[1] AS BIGINT) AS distance FROM v JOIN d{rounds} USING (rid))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM o JOIN c{rounds} c ON c.c = o.cluster
"""
