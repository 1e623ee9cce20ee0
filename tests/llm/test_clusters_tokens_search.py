"""Clustering, token counts and ranked search against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.llm import centroids, queries, ranked_search, token_counts
from tests.llm import brute

SF = "/root/testdata/sf0.001"
VOCABULARY = token_counts.public_vocabulary("byte_bpe_50k.json")


def _bag(rows):
    return sorted(map(repr, rows))


VECTORS = "vec_id long, embedding array<double>"


def _vectors(n, rng, spread=1.0, groups=5):
    centre = rng.normal(size=(groups, 64)) * spread
    return [(k, (centre[k % groups] + 0.05 * rng.normal(size=64)).tolist()) for k in range(n)]


def test_clusters(spark):
    """Groups, copies of one vector, repeated and null ids, odd vectors, ties; columns of other names."""
    rows = _vectors(300, np.random.default_rng(3))
    rows += [(1000 + k, rows[0][1]) for k in range(150)] + [(7, rows[8][1]), (7, rows[9][1]), (7, rows[9][1]), (None, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None, *[1.0] * 63]), (2005, [float("nan"), *[1.0] * 63]), (2006, [float("inf"), *[1.0] * 63]), (2007, [-0.0] * 64)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    odd = df.withColumns({c: F.lit("x") for c in ("x", "key", "tie", "cluster", "v", "label", "i", "n")})
    for table, size in ((df, 256), (odd, 16)):
        got = centroids.cluster(table, block_rows=size).collect()
        assert _bag((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == _bag(brute.clusters(rows))
    assert np.mean([r["candidates"] for r in got]) < 25  # boxes of small blocks leave centroids of other groups out


def test_clusters_of_few_and_large_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    for rows in ([(5, [0.5] * 64)], [(k, [float(k % 3)] * 64) for k in range(10)], [(k, [(-1.0) ** k * 2e4 * (1 + k / 60)] * 64) for k in range(60)], [(None, [1.0] * 64)]):
        got = centroids.cluster(spark.createDataFrame(rows, VECTORS), rounds=2).collect()
        want = brute.clusters(rows, rounds=2) if rows[0][0] is not None else []
        assert _bag(tuple(r)[:6] for r in got) == _bag(want)
    huge = centroids.cluster(spark.createDataFrame([(k, [1e30 * (k - 30)] * 64) for k in range(60)], VECTORS), k=2, rounds=1).collect()
    assert len(huge) == 60 and max(r["distance"] for r in huge) == 2**63 - 1


def test_hilbert_keys_are_a_walk():
    """Each cell once, and neighbours along the curve differ by one in one coordinate."""
    for dims, bits in ((2, 4), (3, 3), (4, 2), (5, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = centroids.hilbert_key(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_box_distance_is_a_bound():
    rng = np.random.default_rng(9)
    for _ in range(50):
        x, points = np.round(rng.normal(size=(30, 8)) * 10 ** rng.integers(0, 6)), np.round(rng.normal(size=(6, 8)) * 10 ** rng.integers(0, 6))
        turn = np.linalg.qr(rng.normal(size=(8, 8)))[0]
        t = x @ turn
        bound = centroids.box_distance(t.min(axis=0), t.max(axis=0), points @ turn)
        assert (bound <= centroids.distances(x, points.astype(object)).min(axis=0)).all()


TEXTS = [None, "", " ", "a", "hello world", "don't we'll I'M", "  two  spaces \n\n\tx ", "x<|endoftext|>y <|endoftext|>", "1234567 \u0661\u2167", "\u4e00\u4e01 na\u00efve caf\u00e9 \U0001f600\u200d", "\x1c\x85\xa0\u3000a",
         "\u0558\u088f \U000323b0x", "word" * 5000, "a" * 20000, "ab " * 20000, "\n" * 3000]


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(6)
    pool = [chr(c) for c in [*range(0x250), 0x558, 0x3000, 0x2028, 0x1F600, 0x301, 0x4E00, 0x323B0]] + ["<|endoftext|>", " ", "  ", "\n", "'s", "'ll"] * 20
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(800)]
    rows = [(k if k != 5 else None, t) for k, t in enumerate(texts)] + [(1, ""), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit(-1), "n_bytes": F.lit("x")}).repartition(3)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert _bag(map(tuple, token_counts.count_tokens(df, VOCABULARY).collect())) == _bag(want)
    assert token_counts.count_tokens(df.limit(0), VOCABULARY).count() == 0


def test_token_counts_in_stretches(monkeypatch):
    """Where a long text is cut, and whether counts are forgotten, changes nothing."""
    v = token_counts.load(VOCABULARY)
    want = [token_counts.Counter(v)(t) for t in TEXTS]
    monkeypatch.setattr(token_counts, "STRETCH", 7)
    monkeypatch.setattr(token_counts, "CACHE", 2)
    assert [token_counts.Counter(v)(t) for t in TEXTS] == want


def test_token_counts_refuse_other_vocabularies():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.load(token_counts.public_vocabulary("word_bpe_49k.json"))


def _search_case(seed, n_docs=400, n_items=30):
    rng = random.Random(seed)
    common, rare = [f"c{k}" for k in range(12)], [f"R{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(n))
    docs = [(k * 7 % 1009, text(rng.randrange(1, 120))) for k in range(n_docs)]
    docs += [(2000, None), (2001, ""), (2002, " ,;"), (None, text(30)), (None, docs[3][1]), (3, docs[3][1]), docs[5], docs[5], (2003, text(20_000)), (2004, "\u00c9tude c1_C2\x00c3 \u00e9")]
    items = [(k, text(rng.randrange(1, 40))) for k in range(n_items)] + [(50, None), (51, "..."), (52, "nowhere"), (3, items_text := text(10)), (3, items_text), (53, "\u00c9TUDE C2"), (None, text(5))]
    return docs, items


def test_ranked_search(spark):
    for seed in (1, 2):
        docs, items = _search_case(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        i = spark.createDataFrame(items, "item_id long, text string")
        want = _bag(brute.ranked(docs, items))
        extra = {c: F.lit("x") for c in ("terms", "item", "score", "n", "rank", "words", "block")}
        assert _bag(map(tuple, ranked_search.search(d.withColumns(extra), i.withColumns(extra), shard_rows=32).collect())) == want
        assert _bag(map(tuple, ranked_search.search(d, i, query_terms=40).collect())) == want  # items in several blocks
    assert ranked_search.search(d.limit(0), i).count() == 0 and ranked_search.search(d, i.limit(0)).count() == 0


def test_pair_bounds_hold_and_open_fewer_lists():
    """A set's bound is never below what a document reaches; with pairs, fewer postings are opened and the same documents found.

    Half of the documents have one word, half another, and few have both: together they reach less than their maxima's sum.
    """
    docs, items = _search_case(4, n_docs=600)
    docs += [(k, "left" if k % 2 else "right") for k in range(3000, 4000)] + [(k, f"rare{k % 3} " + "filler " * 79) for k in range(5000, 5036)]
    items += [(k, f"left right rare{k % 3}") for k in range(60, 66)]
    held = [t for t in (ranked_search.terms(t) for _, t in docs) if t]
    q = ranked_search.Queries([(k, sorted(set(ranked_search.terms(t)))) for k, (_, t) in enumerate(items) if ranked_search.terms(t)])
    df = {q.number[w]: sum(w in set(d) for d in held) for w in q.number}
    q.weigh(len(held), df)
    assert q.pairs
    place = np.array([p for p, d in enumerate(held) for w in set(d) if w in q.number])
    of = np.array([q.number[w] for d in held for w in set(d) if w in q.number])
    tf = np.array([d.count(w) for d in held for w in set(d) if w in q.number])
    n = np.array([len(d) for d in held])
    m = ranked_search.length_factor(n, len(held), int(n.sum()))
    shard = ranked_search.Shard(q, place, of, q.weight[of] * (10**9 * tf // (1000 * tf + 8 * m[place])))
    score = np.zeros((len(held), len(q.number)), np.int64)
    score[shard.place, np.repeat(np.arange(len(q.number)), np.diff(shard.start))] = shard.score
    opened = [0, 0]
    for query, pairs in zip(q.of, q.pairs_of, strict=True):
        low = [t for t in query[np.argsort(shard.most[query], kind="stable")].tolist() if shard.most[t]]
        bound, _ = shard.bounds(low, pairs)
        assert all(score[:, low[:j]].sum(axis=1).max() <= bound[j] for j in range(1, len(low) + 1))
        total = score[:, query].sum(axis=1)
        floor = int(np.sort(total)[-10])
        for k, some in enumerate((pairs, [])):
            at, got, read = shard.find(query, some, max(floor, 1), len(held))
            assert at.tolist() == np.flatnonzero(total >= max(floor, 1)).tolist() and (got == total[at]).all()
            opened[k] += read
    assert opened[0] < opened[1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_of_the_tables(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    assert _bag(map(tuple, queries.op11_centroids(spark, SF).collect())) == _bag(brute.clusters(read("embeddings", "vec_id", "embedding")))
    assert _bag(map(tuple, queries.op13_ranked_search(spark, SF).collect())) == _bag(brute.ranked(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")))
