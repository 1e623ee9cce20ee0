"""Exact top-k search by inner product: a ball tree in each shard, searched by branch and bound.

Vectors are dealt to shards by the nearest of some pivots (and by a hash of the id where a pivot has many), so a shard is a
ball of its own. Its tree is built once and kept as one row of a table. A query first goes down the tree of the shard with
the greatest bound `query . centre + |query| * radius`; the kth score found there is shared, and then it visits only those
other shards whose ball can still reach it. In a tree, queries go down together: each takes the child with the greater
bound first, comes back for the other one, and leaves a node as soon as its bound is below the query's current kth score.

Scores are exact whole numbers. Where components are so large that products leave 2**53, leaves are scored in Python's
integers; a score beyond the range of long is given as the nearest long, but ranked (by its leading 106 bits) as it is.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; vectors of another
length than the query's aren't its candidates; equal scores are ordered by id; a query's own id is no candidate. Rows that
repeat an id and its vector count once; rows that repeat an id with other vectors are candidates each, and as a query
the least of them stands for the id. Fewer than k candidates give fewer rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.common import materialize

#: Vectors in a shard, queries that visit it at once, rows in a leaf.
SHARD_ROWS = 8192
QUERY_ROWS = 8192
LEAF_ROWS = 128
#: Shards get larger rather than more than this, so that their balls can be broadcast.
MOST_SHARDS = 16_384
MOST_PIVOTS = 1024


def usable(vector: Column) -> Column:
    """Whether a vector isn't null and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def quantize(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component: whole numbers, kept as doubles (from 2**52 on, every double is whole)."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))


class BallTree:
    """Balls over rows of x: node 0 holds all; a node's rows are order[lo:hi], its children halve them along the line between two far rows."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(x))
        spans, children, todo = [(0, len(x))], [(-1, -1)], [0]
        while todo:
            node = todo.pop()
            lo, hi = spans[node]
            if hi - lo <= leaf_rows:
                continue
            rows = x[self.order[lo:hi]]
            far = rows[((rows - rows[0]) ** 2).sum(axis=1).argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            mid = (lo + hi) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argsort(rows @ (other - far), kind="stable")]
            children[node] = (len(spans), len(spans) + 1)
            todo += children[node]
            spans += [(lo, mid), (mid, hi)]
            children += [(-1, -1), (-1, -1)]
        self.spans, self.children = np.array(spans), np.array(children)
        self.centre = np.array([x[self.order[a:b]].mean(axis=0) for a, b in spans])
        self.radius = np.array([np.sqrt(((x[self.order[a:b]] - c) ** 2).sum(axis=1).max(initial=0)) for (a, b), c in zip(spans, self.centre, strict=True)])


def ball_bound(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """An upper bound of the inner products of each query with what lies in each ball, wide enough for rounding."""
    size = np.sqrt((q * q).sum(axis=1))[:, None]
    return q @ centre.T + size * radius[None, :] + 1e-9 * size * (radius + np.sqrt((centre * centre).sum(axis=1)))[None, :] + 1e-6


def _whole(x: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers."""
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _exact_scores(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products as the nearest double and what is left, from Python integers."""
    product = _whole(q) @ _whole(x).T
    high = product.astype(np.float64)
    low = np.array([[float(p - int(h)) for p, h in zip(ps, hs, strict=True)] for ps, hs in zip(product.tolist(), high.tolist(), strict=True)]).reshape(high.shape)
    return high, low


def search(tree: BallTree, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, rest of the score, id) of each query among x; missing ones have score -inf. floor: scores known to be reached by k others."""
    score, rest, found = np.full((len(q), k), -np.inf), np.zeros((len(q), k)), np.full((len(q), k), np.iinfo(np.int64).max)
    mine = np.arange(len(q))
    todo = [(0, mine, ball_bound(q, tree.centre[:1], tree.radius[:1])[:, 0])]
    while todo:
        node, mine, bound = todo.pop()
        mine = mine[bound >= np.maximum(score[mine, -1], floor[mine])]
        if not len(mine):
            continue
        left, right = tree.children[node]
        if left >= 0:
            both = ball_bound(q[mine], tree.centre[[left, right]], tree.radius[[left, right]])
            first = both[:, 0] >= both[:, 1]
            for child, some in ((1, first), (0, ~first), (1, ~first), (0, first)):  # the last is done first
                if some.any():
                    todo.append(((left, right)[child], mine[some], both[some, child]))
            continue
        rows = tree.order[slice(*tree.spans[node])]
        new, low = _exact_scores(q[mine], x[rows]) if exact else (q[mine] @ x[rows].T, None)
        new[query_ids[mine][:, None] == ids[rows][None, :]] = -np.inf
        better = new.max(axis=1) >= score[mine, -1]
        mine, new = mine[better], new[better]
        low = np.zeros(new.shape) if low is None else low[better]
        scores, rests = np.concatenate((score[mine], new), axis=1), np.concatenate((rest[mine], low), axis=1)
        names = np.concatenate((found[mine], np.broadcast_to(ids[rows], new.shape)), axis=1)
        best = np.lexsort((names, -rests, -scores), axis=1)[:, :k]
        score[mine], rest[mine], found[mine] = (np.take_along_axis(v, best, 1) for v in (scores, rests, names))
    return score, rest, found


_ONE = "shard long, dim int, big boolean, ids binary, x binary, order binary, spans binary, children binary, centre binary, radius binary"
_FOUND = "query_id long, vec_id long, score double, rest double"


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row for each shard of vectors (vec_id, vector, dim): its rows and its tree."""
    n = vectors.count()
    shard_rows = max(shard_rows, -(-n // MOST_SHARDS))
    # any rows serve as pivots: they only say what lies together
    some = vectors.orderBy(F.xxhash64("vec_id", "vector")).limit(max(1, min(MOST_PIVOTS, -(-n // shard_rows)))).select("dim", "vector").collect()
    pivots = {d: np.array([r["vector"] for r in some if r["dim"] == d], dtype=np.float64) for d in {r["dim"] for r in some}}

    def assign(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            pivot = np.full(len(pdf), -1, np.int32)
            big = np.zeros(len(pdf), bool)
            for d in pdf["dim"].unique():
                at = np.flatnonzero(pdf["dim"].to_numpy() == d)
                x = _matrix(pdf["vector"].iloc[at])
                big[at] = np.abs(x).max(axis=1, initial=0) >= _most(d)
                if d and d in pivots:
                    p = pivots[d]
                    pivot[at] = ((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
            yield pdf.assign(pivot=pivot, big=big)

    dealt = materialize(vectors.mapInPandas(assign, "vec_id long, vector array<double>, dim int, pivot int, big boolean"), "dealt")
    parts = dealt.groupBy("dim", "big", "pivot").agg((F.floor((F.count("*") - 1) / shard_rows) + 1).alias("parts"))
    dealt = dealt.join(parts, ["dim", "big", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["vector"])
        tree = BallTree(x, leaf_rows)
        first = pdf.iloc[0]
        shard = (int(first["pivot"]) + 1) << 32 | int(first["part"]) << 1 | int(first["big"])
        kept = [pdf["vec_id"].to_numpy(np.int64), x, tree.order, tree.spans, tree.children, tree.centre, tree.radius]
        return pd.DataFrame([[shard, int(first["dim"]), bool(first["big"]), *(np.ascontiguousarray(v).tobytes() for v in kept)]], columns=[c.split()[0] for c in _ONE.split(", ")])

    return materialize(dealt.groupBy("dim", "big", "pivot", "part").applyInPandas(build, _ONE), "shards")


def _most(dim: int) -> float:
    """Products of vectors with lesser components than this add up to less than 2**53."""
    return np.sqrt(2.0**53 / max(1, dim)) / 2


def _load(row) -> tuple[BallTree, np.ndarray, np.ndarray]:  # noqa: ANN001
    tree = BallTree.__new__(BallTree)
    ids, order = np.frombuffer(row.ids, np.int64), np.frombuffer(row.order, np.int64)
    tree.order, tree.spans, tree.children = order, np.frombuffer(row.spans, np.int64).reshape(-1, 2), np.frombuffer(row.children, np.int64).reshape(-1, 2)
    tree.radius = np.frombuffer(row.radius)
    tree.centre = np.frombuffer(row.centre).reshape(len(tree.radius), -1)
    return tree, ids, np.frombuffer(row.x).reshape(len(ids), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors, queries: (vec_id long, vector array<double> of whole numbers). Returns (query_id, rank, vec_id, score)."""
    whole = lambda df: df.where("vec_id IS NOT NULL AND vector IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))
    vectors = materialize(whole(vectors).dropDuplicates(["vec_id", "vector"]), "vectors")
    queries = materialize(whole(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")), "queries")
    index = build_index(vectors, shard_rows)
    # balls of all shards: at most MOST_SHARDS and some for large components, so small enough to broadcast
    balls: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    found = index.select("shard", "dim", "centre", "radius").mapInPandas(
        lambda batches: (pd.DataFrame({"shard": b["shard"], "dim": b["dim"], "centre": [c[: 8 * d] for c, d in zip(b["centre"], b["dim"], strict=True)], "radius": [r[:8] for r in b["radius"]]}) for b in batches),
        "shard long, dim int, centre binary, radius binary",
    ).collect()
    for d in {r["dim"] for r in found}:
        of = [r for r in found if r["dim"] == d]
        balls[d] = (np.array([r["shard"] for r in of]), np.array([np.frombuffer(r["centre"]) for r in of]).reshape(len(of), d), np.array([np.frombuffer(r["radius"])[0] for r in of]))
    shared = vectors.sparkSession.sparkContext.broadcast(balls)

    def visits(batches):  # noqa: ANN001, ANN202
        """Queries with each shard to visit: where `near` is null the best one, else all others that can reach `floor`."""
        for pdf in batches:
            for d, part in pdf.groupby("dim"):
                if d not in shared.value:
                    continue
                shard, centre, radius = shared.value[d]
                for at in range(0, len(part), 256):
                    some = part.iloc[at : at + 256]
                    bound, near = ball_bound(_matrix(some["vector"]), centre, radius), some["near"].to_numpy()
                    keep = (bound >= some["floor"].to_numpy()[:, None]) & (near[:, None] >= 0) & (shard[None, :] != near[:, None])
                    new = np.flatnonzero(near < 0)
                    keep[new, bound[new].argmax(axis=1)] = True
                    row, col = np.nonzero(keep)
                    yield some.iloc[row].drop(columns="near").assign(shard=shard[col])

    def run(asked: DataFrame) -> DataFrame:
        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in left.itertuples(index=False):
                tree, ids, x = _load(row)
                q = _matrix(right["vector"])
                large = np.abs(q).max(axis=1, initial=0) >= _most(row.dim)
                for exact in (False, True):
                    at = np.flatnonzero((large | row.big) == exact)
                    if len(at):
                        score, rest, found = search(tree, ids, x, right["vec_id"].to_numpy()[at], q[at], right["floor"].to_numpy(float)[at], k, exact)
                        i, j = np.nonzero(np.isfinite(score))
                        out.append(pd.DataFrame({"query_id": right["vec_id"].to_numpy()[at[i]], "vec_id": found[i, j], "score": score[i, j], "rest": rest[i, j]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "rest": []}).astype({"query_id": np.int64, "vec_id": np.int64})

        used = asked.select(*(F.col(c).alias(f"to_{c}") for c in ("shard", "dim", "block"))).distinct()
        used = used.join(index, (F.col("shard") == F.col("to_shard")) & (F.col("dim") == F.col("to_dim")))
        return used.groupBy("to_shard", "to_dim", "to_block").cogroup(asked.groupBy("shard", "dim", "block")).applyInPandas(meet, _FOUND)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rest").desc(), "vec_id")

    def to_shards(df: DataFrame, name: str) -> DataFrame:
        """Queries with their shards, and in blocks of query_rows: a shard's rows go out once for each block of those that visit it."""
        out = materialize(df.mapInPandas(visits, "vec_id long, vector array<double>, dim int, floor double, shard long"), name)
        parts = out.groupBy("shard", "dim").agg((F.floor((F.count("*") - 1) / query_rows) + 1).alias("parts"))
        parts = parts.select(F.col("shard").alias("to"), F.col("dim").alias("of"), "parts")
        # a row a shard: at most MOST_SHARDS and some
        met = out.join(F.broadcast(parts), (F.col("shard") == F.col("to")) & (F.col("dim") == F.col("of")))
        return met.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("to", "of", "parts")

    first = to_shards(queries.withColumn("floor", F.lit(float("-inf"))).withColumn("near", F.lit(-1).cast("long")), "first")
    near = materialize(run(first), "near")
    reached = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    asked = first.join(reached, "vec_id", "left").select("vec_id", "vector", "dim", F.coalesce("reached", "floor").alias("floor"), F.col("shard").alias("near"))
    every = near.unionByName(run(to_shards(asked, "others"))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    limit = F.lit(2.0**63)
    as_long = F.when(F.col("score") >= limit, F.lit(2**63 - 1)).when(F.col("score") <= -limit, F.lit(-(2**63))).otherwise(F.col("score").cast("long") + F.col("rest").cast("long"))
    return every.select("query_id", "rank", "vec_id", as_long.alias("score"))


#: Brute force over all pairs, for small data.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
