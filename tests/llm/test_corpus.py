"""Each corpus operator against a plain version: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelflow.llm import common, html_extract, jaccard, langid, lm_score, mixing, packing, quality, queries, suffix_dedup, topk, toxicity
from panelflow.llm.common import components, filter_has, learn_fold, membership_filter, shingles, word_hashes
from tests.llm import brute

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _text(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, long and odd texts; the ids aren't in order of place."""
    rng = random.Random(4)
    rows = []

    def add(text, source="a", lang="en"):
        rows.append((None if text == "no id" else len(rows) * 7 % 1009, text, lang, source, len(text or "")))

    base = [_text(rng, 120, 5000) for _ in range(8)]
    for b in base:
        add(b)
        add(b, "b")
        w = b.split()
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = f"x{rng.randrange(99)}"
            add(" ".join(v), "c")
        add(b.upper(), "a")
    passage = _text(rng, 60, 5000)
    for k in range(10):
        add(_text(rng, 30 + k, 5000) + "\n" + passage + "\n" + _text(rng, 20, 5000), "b" if k % 2 else "c")
    add(None)
    add("")
    add(" \n\t ", None)
    add("one")
    add("two words", None)
    add("a" * 400)
    add("ab" * 300, "d")
    add("é" * 200 + " " + "é" * 120, "d")
    add("no id")
    add(_text(rng, 30_000, 300), "d")
    add("Line one is here\nLine one is here\nLine one is here\nanother line of words that is fine and long", "d")
    add(" ".join(f"{x}%%%" for x in _text(rng, 40).split()))
    add(" | ".join(str(rng.randrange(10**6)) for _ in range(60)))
    rows += rows[:3]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(docs):
    """The same with extra columns that operators use names like."""
    return docs.withColumns({c: F.lit("x") for c in ("key", "part", "first", "size", "a", "b", "spans", "n", "rep", "_row", "_text", "found", "d", "f")})


def _empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _bag(rows):
    return sorted(map(repr, rows))


def test_word_hashes_follow_words():
    for text in (None, "", "  a b\x0b\x0cc ", "A a", "x" * 5000 + " y", "é b\x1fc"):
        w = brute.words(brute.lower(text))
        h = word_hashes(text)
        assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
    assert len(shingles(word_hashes("a b"), 3)) == 1 and len(shingles(word_hashes("a b c d a b c d"), 3)) == 4


def test_words_of_a_column_are_those_of_its_texts(monkeypatch):
    texts = [None, "", "  a b\x0b\x0cc ", "A a", "x" * 5000 + " y", "é b\x1fc", "ab", "cd", " lead", "trail "] * 3
    for stretch in (1, 8, 1 << 17):
        monkeypatch.setattr(common, "_STRETCH", stretch)
        column = pa.array(["skipped", *texts], pa.string())[1:]
        got = [(k + i, h.tolist()) for k, n, every in common.column_words(column) for i, h in enumerate(np.split(every, np.cumsum(n)[:-1]))]
        assert got == [(i, word_hashes(t).tolist()) for i, t in enumerate(texts)]


def test_membership_filter(spark):
    keys = np.random.default_rng(3).integers(-(2**62), 2**62, 5000)
    held = membership_filter(spark.createDataFrame([(int(k),) for k in keys], "k long")).value
    assert filter_has(held, keys).all() and filter_has(held, keys + 1).mean() < 0.1
    assert not filter_has(membership_filter(spark.createDataFrame([], "k long")).value, keys).any()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in links)}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(docs, corpus, odd, spark):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = _bag((i, *brute.quality(t), brute.kept(t)) for i, t, *_ in corpus)
    for df in (docs, odd):
        assert _bag(tuple(r[c] for c in [*cols, "kept"]) for r in quality.score_documents(df).collect()) == want
    left = quality.filter_documents(odd)
    assert left.columns == odd.columns and _bag(r["doc_id"] for r in left.collect()) == _bag(i for i, t, *_ in corpus if brute.kept(t))
    assert quality.score_documents(_empty(spark)).count() == 0 and quality.filter_documents(_empty(spark)).count() == 0


def test_quality_runs_no_python(docs):
    for df in (quality.score_documents(docs), quality.filter_documents(docs)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Pandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_rule_order_changes_no_verdict(docs):
    orders = [list(quality.RULES), list(quality.RULES)[::-1], quality.order_rules(docs)]
    got = [_bag((r["doc_id"], r["rejected_by"] is None) for r in quality.cascade(docs, o, ["doc_id", "text"]).collect()) for o in orders]
    assert got[0] == got[1] == got[2]


def test_rules_are_measured(docs, spark):
    sample = spark.createDataFrame([("one two",)] * 30 + [("a b c d e f g h i j k l " * 20,)] * 10, "text string")
    got = quality.measure_rules(sample, quality.RULES)
    assert got["short"][0] == 0.75 and got["repeats"][0] == 0.25 and got["symbols"][0] == 0 and all(seconds > 0 for _, seconds in got.values())
    # a rule that rejects nothing goes behind one that rejects much for as little
    assert [r.name for r in quality.order_rules(sample)].index("short") < [r.name for r in quality.order_rules(sample)].index("letters")


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard(docs, corpus, odd, spark, n, num):
    want = brute.components([(i, t) for i, t, *_ in corpus], n, num, 100)
    rows = _bag((i, len(brute.shingle_set(t, n)), want.get(i)) for i, t, *_ in corpus)
    assert _bag(map(tuple, jaccard.join_documents(odd if n == 3 else docs, n, num, 100).collect())) == rows
    if n == 3:
        assert jaccard.join_documents(_empty(spark)).count() == 0


def test_jaccard_group_of_near_copies(spark):
    """A large group whose members link through others only."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        v = list(base)
        for _ in range(rng.randrange(1, 5)):
            v[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(v)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute.components(rows, 3, 90, 100)


def test_jaccard_ids_with_several_texts(spark):
    """Rows that repeat an id with other texts: no link is lost, whichever row comes first."""
    word = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(5, word("a")), (5, word("b")), (6, word("a") + " x"), (7, word("b") + " x"), (8, ""), (8, word("c")), (3, word("c") + " y"), (9, None)]
    for some in (rows, rows[::-1]):
        got = Counter(tuple(r) for r in jaccard.join_documents(spark.createDataFrame(some, "doc_id long, text string"), 3, 90, 100).select("doc_id", "component_id").collect())
        assert got == Counter([(5, 5), (5, 5), (6, 5), (7, 5), (8, 3), (8, 3), (3, 3), (9, 9)])


def test_jaccard_large_group(spark, monkeypatch):
    """2,000 near copies of one text, each with a word of its own, and as many just below the threshold; salted."""
    monkeypatch.setattr(jaccard, "_SALT_ROWS", 150)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(2000):
        v = list(base)
        for j in range(1 if k % 40 else 4):
            v[10 + 20 * j] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(v)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    # copies with one changed word share 95 of 101 shingles; with four changed words, 86 of 110
    assert got == {k: 1 if k % 40 else k for k in range(2000)}


def test_suffix_bound_is_a_bound():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert jaccard.suffix_bound(x, y) <= len(np.setxor1d(x, y))


def test_suffix_dedup(docs, corpus, odd, spark):
    want = _bag((i, n, gone, runs, brute.digest(kept)) for (i, *_), (kept, n, gone, runs) in zip(corpus, brute.removed([(i, t) for i, t, *_ in corpus]), strict=True))
    assert _bag(map(tuple, suffix_dedup.removal_digest(docs).collect())) == want
    cut = suffix_dedup.remove_repeats(odd)
    assert cut.columns == odd.columns
    text = _bag((i, kept.decode("utf-8", "ignore") if gone else t) for (i, t, *_), (kept, _, gone, _) in zip(corpus, brute.removed([(i, t) for i, t, *_ in corpus]), strict=True))
    assert _bag((r["doc_id"], r["text"]) for r in cut.collect()) == text
    assert suffix_dedup.removal_digest(_empty(spark)).count() == 0


def test_suffix_dedup_frequent_passages(docs, corpus, monkeypatch):
    """With every shared minimizer dealt window by window, and tiny shards."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", 50)
    monkeypatch.setattr(suffix_dedup, "MOST_KEYS", 10)  # too many keys for a bitmap: the join
    want = _bag((i, n, gone, runs, brute.digest(kept)) for (i, *_), (kept, n, gone, runs) in zip(corpus, brute.removed([(i, t) for i, t, *_ in corpus]), strict=True))
    assert _bag(map(tuple, suffix_dedup.removal_digest(docs).collect())) == want


def test_suffix_dedup_with_colliding_keys(docs, corpus):
    """First hashes of 8 bits: segments that agree in them are still told apart."""
    want = _bag((i, n, gone, runs, brute.digest(kept)) for (i, *_), (kept, n, gone, runs) in zip(corpus, brute.removed([(i, t) for i, t, *_ in corpus]), strict=True))
    assert _bag(map(tuple, suffix_dedup.removal_digest(docs, key_bits=8).collect())) == want


def test_first_texts():
    rng = random.Random(2)
    texts = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 120))) for _ in range(300)}, key=lambda _: rng.random())
    for length in (6, 20):
        which, offset, least = suffix_dedup.first_texts(pa.array(texts, pa.binary()), length)
        want = [(k, p, next(j for j, x in enumerate(texts) if t[p : p + length] in x)) for k, t in enumerate(texts) for p in range(len(t) - length + 1)]
        assert list(zip(which.tolist(), offset.tolist(), least.tolist(), strict=True)) == want


def test_run_index_steps():
    """Streaming a text backwards visits its suffixes' rows, with the length that each has in common with the row above."""
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    body = np.frombuffer(b"".join(bytes(c + 1 for c in t) + b"\0" for t in texts), np.uint8)
    index = suffix_dedup.RunIndex(body, np.cumsum([len(t) + 1 for t in texts]) - 1)
    rows = sorted((t[p:], k, p) for k, t in enumerate(texts) for p in range(len(t) + 1))
    place = {(k, p): i for i, (_, k, p) in enumerate(rows)}
    common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    assert len(index.start) < len(rows)
    for k, t in enumerate(texts):
        row, match = np.array([k], np.int32), np.zeros(1, np.int16)
        for p in range(len(t) - 1, -1, -1):
            row, match = index.step(row, match)
            at = place[k, p]
            assert row[0] == at and match[0] == common(rows[at][0], rows[at - 1][0])


def test_segments_cover_all_windows():
    rng = np.random.default_rng(1)
    for raw in (rng.integers(97, 100, 5000).astype(np.uint8), np.full(700, 97, np.uint8), rng.integers(0, 255, 50).astype(np.uint8)):
        h, at, n = suffix_dedup.segments(raw)
        assert at[0] == 0 and (at[1:] == at[:-1] + n[:-1]).all() and at[-1] + n[-1] == len(raw) - 49 and n.max() <= 64


@pytest.mark.parametrize("slots", [121_393, 50, 3])
def test_mixing(docs, corpus, odd, spark, slots):
    want = brute.taken([(i, t, s) for i, t, _, s, _ in corpus], slots=slots)
    rows = _bag((i, n, size, round(goal, 4), took, first) for (i, *_), (n, size, goal, took, first) in zip(corpus, want, strict=True))
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 4), r["taken"], r["first_slot"]) for r in mixing.mix_sources(odd if slots == 50 else docs, slots=slots).collect()]
    assert _bag(got) == rows
    assert all(t <= 3 * n for _, n, _, _, t, _ in got)
    took, goal = Counter(), {}
    for (*_, s, _), r in zip(corpus, want, strict=True):
        took[s] += r[3]
        goal[s] = r[2]
    assert all(abs(took[s] - goal[s]) < 1 for s in goal)  # however few slots
    if slots < 1000:
        assert mixing.mix_sources(_empty(spark), slots=slots).count() == 0
        assert mixing.mix_sources(docs.where("text IS NULL"), slots=slots).first()["taken"] == 0


def test_mixing_follows_its_schedule(docs, corpus):
    """Another sequence takes other words, at other times."""
    half = {"points": lambda i: (i * 0.5) % 1.0, "columns": lambda c: (c * F.lit(0.5)) % F.lit(1.0)}
    got = _bag((r["doc_id"], r["taken"], r["first_slot"]) for r in mixing.mix_sources(docs, slots=40, point=half["columns"]).collect())
    rows = [(i, t, s) for i, t, _, s, _ in corpus]
    assert got == _bag((i, *r[3:]) for (i, *_), r in zip(corpus, brute.taken(rows, slots=40, point=half["points"]), strict=True))
    assert got != _bag((i, *r[3:]) for (i, *_), r in zip(corpus, brute.taken(rows, slots=40), strict=True))


def test_mixing_loses_no_small_source(spark):
    """Sources of 30 words beside one of 200,000: each meets its target."""
    rows = [(k, "w " * 2000, "en", "large", 0) for k in range(100)] + [(1000 + k, "word " * 30, "en", f"small{k}", 0) for k in range(6)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), slots=500).collect()
    small = [(r["target"], r["taken"]) for r in got if r["source"] != "large"]
    assert len(small) == 6 and all(took == pytest.approx(goal, abs=1) and took >= 30 for goal, took in small)
    large = [r for r in got if r["source"] == "large"]
    assert sum(r["taken"] for r in large) == pytest.approx(large[0]["target"], abs=1)


def test_clashing_names_change_no_verdict(spark, corpus):
    """Extra columns named like features and helpers: verdicts are the same, and the columns come back as they were."""
    prose = [(5000 + k, f"the river ran past an old stone house and the garden wall near the quiet town on day {'abcdefghij'[k]}", "en", "a", 0) for k in range(10)]
    df = spark.createDataFrame(corpus + prose, SCHEMA)
    extra = {c: F.lit(0) for c in ("n_words", "word_chars", "n_symbols", "_words", "_text", "rejected_by", "row", "c0", "_row", "base_failed")}
    plain, left = quality.filter_documents(df), quality.filter_documents(df.withColumns(extra))
    assert left.columns == [*df.columns, *extra] and plain.count() > 0
    assert _bag(map(tuple, left.collect())) == _bag((*r, *[0] * len(extra)) for r in map(tuple, plain.collect()))
    named = quality.cascade(df.withColumns(extra), list(quality.RULES), ["doc_id", "rejected_by"], "why").collect()
    assert all(r["rejected_by"] == 0 for r in named) and any(r["why"] for r in named)


def test_schedule_is_spread(spark):
    targets = spark.createDataFrame([("a", 1000, 2000.0), ("b", 3000, 1000.0), (None, 1000, 2000.0), ("d", 0, 0.0)], "source string, source_size long, target double")
    slots = [(r["slot"], r["source"], r["rank"]) for r in mixing.schedule(targets, 610).orderBy("slot").collect()]
    assert [x for x, _, _ in slots] == list(range(610))
    for source, share in (("a", 0.4), ("b", 0.2), (None, 0.4)):
        ranks = [r for _, s, r in slots if s == source]
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - share * 610) <= 1.5
        for n in (50, 200, 400):
            assert abs(sum(1 for at, s, _ in slots if s == source and at < n) - share * n) <= 4


def test_packing(docs, corpus, odd, spark):
    got = packing.pack(odd, budget=300).collect()
    assert _bag((r["doc_id"], r["length"]) for r in got) == _bag((i, len(brute.words(t))) for i, t, *_ in corpus)
    batches = {}
    for r in got:
        assert r["length"] <= r["boundary"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rows in batches.values():
        assert len(rows) * rows[0]["boundary"] <= 300 or len(rows) == 1
    for bucket in {r["bucket"] for r in got}:
        own = sorted((k[1], len(v)) for k, v in batches.items() if k[0] == bucket)
        assert [k for k, _ in own] == list(range(len(own))) and len({n for _, n in own[:-1]}) <= 1
    assert packing.pack(_empty(spark)).count() == 0


def test_packing_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(7)
    for _ in range(20):
        lengths = np.unique(rng.integers(0, 60, 9))
        counts = rng.integers(1, 20, len(lengths))

        def padding(ends):
            return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))

        best = min(padding((*x, lengths[-1])) for k in range(3) for x in combinations(lengths[:-1], k))
        ends = packing.choose_boundaries(lengths, counts, 3)
        assert len(ends) <= 3 and ends == sorted(ends) and padding(ends) == best
    assert packing.choose_boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


def test_packing_boundaries_of_many_lengths():
    """Halving finds what the plain programme finds, long lengths too."""
    rng = np.random.default_rng(11)
    lengths = np.unique(rng.integers(0, 20_000, 700))
    counts = rng.integers(1, 50, len(lengths))
    ahead = np.concatenate(([0], np.cumsum(counts)))
    best = np.concatenate(([0], np.full(len(lengths), 1 << 60)))
    for _ in range(8):
        best = np.array([0] + [(best[:j] + (ahead[j] - ahead[:j]) * lengths[j - 1]).min() for j in range(1, len(lengths) + 1)])
    ends = np.array(packing.choose_boundaries(lengths, counts))
    assert (ends[np.searchsorted(ends, lengths)] * counts).sum() == best[-1] and set(ends) <= set(lengths)


def test_language_id(spark):
    rng = random.Random(3)
    kinds = {"en": "the of and to in that".split(), "de": "der die und nicht über schön".split(), "fr": "le des été où ça être".split()}
    rows = [(k, " ".join(rng.choice(w) for _ in range(20)), lang, "s", 0) for k, (lang, w) in enumerate([x for x in kinds.items() for _ in range(30)])]
    extra = [(900, None, "en", None, 0), (901, "123 !!", "en", None, 0), (902, "", None, None, 0), (903, "the of and", None, None, 0), (904, "über " * 300_000, None, None, 0), (None, "le des", None, None, 0)]
    df = spark.createDataFrame(rows + extra, SCHEMA).withColumn("score", F.lit("x"))
    model = langid.fit(df.where(learn_fold(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert model.languages == ["de", "en", "fr"] and all(got[k]["lang_pred"] == lang for k, _, lang, _, _ in rows)
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "en", "de", "fr"]
    assert got[900]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    # naive Bayes by hand for one text
    counts = {lang: sum(langid.gram_counts(langid.code_points(t)) for k, t, x, *_ in rows + extra if x == lang and t is not None and _fold(k)) for lang in kinds}
    g = langid.gram_counts(langid.code_points(rows[0][1]))
    n = {lang: sum(1 for k, t, x, *_ in rows + extra if x == lang and t is not None and _fold(k)) for lang in kinds}
    total = {lang: (g * np.log((c + langid.ALPHA) / (c + langid.ALPHA).sum())).sum() + np.log(n[lang] / sum(n.values())) for lang, c in counts.items()}
    top = max(total.values())
    assert got[0]["score"] == pytest.approx(1 / sum(np.exp(v - top) for v in total.values()), abs=1e-9)
    untaught = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, untaught).collect()} == {"und"} and langid.predict(df.limit(0), model).count() == 0


def _fold(k):
    import zlib

    return zlib.crc32(str("" if k is None else k).encode()) % 4 != 2


def test_fold(spark):
    got = {r["doc_id"]: r["x"] for r in spark.createDataFrame([(k,) for k in (None, 0, 5, 12345, -3)], "doc_id long").withColumn("x", learn_fold(F.col("doc_id"))).collect()}
    assert got == {k: _fold(k) for k in got}


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        w = [f"{rng.choice(['stone', 'river', 'garden', 'window'])}{rng.choice(['', 's', 'ly'])}" for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["grubwort", "snarlop"])
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    rows += [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "you grubwort snarlop", None, None, 0), (1003, "the river " * 200_000, None, None, 0)]
    labels += [(0, 1, 1), (7, 1, None), (None, 1, 1), (5555, 0, 1)]
    docs, lab = spark.createDataFrame(rows, SCHEMA).withColumn("toxic", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.where("doc_id % 4 <> 1"), lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, model).collect()}
    held = [k for k in range(400) if k % 4 == 1]
    assert all((got[k] >= 0.3) == (k % 5 == 0) for k in held)
    assert got[1002] >= 0.3 and got[1000] == got[1001] < 0.3 and got[1003] < 0.3
    assert {r["score"] for r in toxicity.predict(docs, toxicity.fit(docs, lab.where("toxic = 0"))).collect()} < {0.0, *[x for x in [1 / (1 + np.exp(40.0))]]} | {4.248354255291589e-18}
    assert toxicity.predict(docs.limit(0), model).count() == 0


def test_toxicity_against_plain_version(spark):
    """Features, ratios and scores from sets of hashed n-grams in plain Python; the weights make the regression's gradient vanish."""
    import math

    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice(("vile", "rotten", "scum") if k % 3 == 0 and rng.random() < 0.3 else ("lamp", "river", "stone", "walks", "under", "bright")) for _ in range(12))) for k in range(240)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, steps=4000)

    def grams(text):
        points = [32, *(ord(c) if c.isalpha() else 32 for c in text.lower()), 32]
        out = set()
        for n in (3, 4, 5, 6):
            for i in range(len(points) - n + 1):
                h = n
                for x in points[i : i + n]:
                    h = (h ^ x) * 0x9E3779B1 % 2**32
                    h ^= h >> 15
                out.add(h >> 14)
        return out

    held = {k: grams(t) for k, t in rows}
    count = [Counter(g for k, gs in held.items() if (k % 3 == 0) == toxic for g in gs) for toxic in (False, True)]
    n = [160, 80]
    strong = {}
    for g in set(count[0]) | set(count[1]):
        both, gap = count[0][g] + count[1][g], abs(count[1][g] / n[1] - count[0][g] / n[0])
        share = both / 240
        if both >= 3 and gap >= 4 * math.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1])):
            strong[g] = math.log((count[1][g] + 1) / (n[1] + 2)) - math.log((count[0][g] + 1) / (n[0] + 2))
    assert len(strong) >= 64 and set(np.flatnonzero(model.weight).tolist()) <= set(strong)
    p = {k: 1 / (1 + math.exp(-(sum(model.weight[g] for g in gs) + model.intercept))) for k, gs in held.items()}
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(df, model).collect()}
    assert all(got[k] == pytest.approx(p[k], abs=1e-9) for k in p)
    for g, ratio in strong.items():
        slope = sum(ratio * (p[k] - (k % 3 == 0)) for k, gs in held.items() if g in gs) / 240 + 1e-4 * model.weight[g] / ratio
        assert abs(slope) < 2e-3
    assert abs(sum(p[k] - (k % 3 == 0) for k in p)) / 240 < 2e-3


def test_toxicity_weights_lower_the_loss():
    rng = np.random.default_rng(0)
    indices = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(300)]
    y = np.array([float(2 in x) for x in indices])
    w, b = toxicity._logistic(indices, y, np.ones(6), 1e-4, 400)
    z = np.array([w[x].sum() + b for x in indices])
    assert ((z > 0) == (y > 0)).all() and np.argmax(np.abs(w)) == 2


def _top_k(rows, k, every):
    out = []
    for i, q in rows:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(k, [rng.randrange(-20, 20) for _ in range(6)]) for k in range(600)]
    rows += [(1000 + k, [3, -2, 1, 0, 5, 5]) for k in range(300)] + [(5000, [1, 2]), (5001, [2, 2]), (5050, [0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("dim", F.lit(1))
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=100, query_rows=7)
    assert sorted(map(tuple, got.collect())) == _top_k(rows, 5, 50)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_large_components_and_repeated_ids(spark):
    """Scores beyond 2**53 are ranked exactly and given as the nearest long."""
    raw = [(0, [1e20, 1.0]), (1, [0.5, 0.25]), (2, [1e20, 2.0]), (3, [-1e20, 0.0]), (4, [2.0**45, 3.0]), (5, [2.0**45, 3.0 + 2**-8]), (50, [1.0, 1.0]), (6, None), (50, [1.0, 1.0])]
    df = spark.createDataFrame(raw, "vec_id long, v array<double>").where(topk.usable(F.col("v"))).select("vec_id", topk.quantize(F.col("v")).alias("vector"))
    whole = {i: [int(256 * x) for x in v] for i, v in raw if v}
    want = []
    for i in (0, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), j) for j in whole if j != i)[:5]
        want += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores)]
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())) == want
    two = spark.createDataFrame([(1, [1.0]), (1, [9.0]), (2, [3.0]), (0, [2.0]), (0, [1.0])], "vec_id long, vector array<double>")
    assert sorted(map(tuple, topk.top_k(two, two.where("vec_id = 0"), 2).collect())) == [(0, 1, 1, 9), (0, 2, 2, 3)]


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0, None],), ([nan],), ([inf, 0.0],), ([-0.001, 0.999],)], "v array<float>")
    assert [r["x"] for r in df.select(topk.usable(F.col("v")).alias("x")).collect()] == [True, False, False, False, False, True]
    assert df.where(topk.usable(F.col("v"))).select(topk.quantize(F.col("v")).alias("q")).collect()[1]["q"] == [-1, 255]


def test_tree_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    tree = topk.BallTree(x, 20)
    assert sorted(tree.order) == list(range(500)) and tuple(tree.spans[0]) == (0, 500)
    q = rng.normal(size=(3, 8))
    bound = topk.ball_bound(q, tree.centre, tree.radius)
    for node, (a, b) in enumerate(tree.spans):
        assert ((x[tree.order[a:b]] @ q.T).max(axis=0) <= bound[:, node]).all()
        if (kids := tree.children[node])[0] >= 0:
            assert tree.spans[kids[0]][0] == a and tree.spans[kids[0]][1] == tree.spans[kids[1]][0] and tree.spans[kids[1]][1] == b
        else:
            assert b - a <= 20


def test_search_leaves_out_balls():
    """Vectors in far groups: most leaves are never opened, and results are those of all pairs."""
    rng = np.random.default_rng(8)
    x = np.round(np.concatenate([rng.normal(size=(400, 6)) + 40 * rng.normal(size=6) for _ in range(10)]))
    tree, ids, q = topk.BallTree(x, 50), np.arange(len(x)), x[::200]
    opened = []
    tree.order = type("Order", (), {"__getitem__": lambda self, at, order=tree.order: opened.append(1) or order[at]})()
    score, _, found = topk.search(tree, ids, x, ids[::200], q, np.full(len(q), -np.inf), 5)
    for k, i in enumerate(ids[::200]):
        want = sorted((-int(q[k] @ x[j]), j) for j in ids if j != i)[:5]
        assert [(-int(s), int(j)) for s, j in zip(score[k], found[k], strict=True)] == want
    assert len(opened) < 10 * len(q)


def test_lm_scores(docs, corpus, spark):
    vocabulary = lm_score.count_words(docs)
    net = lm_score.train(docs, vocabulary)
    got = lm_score.score(docs, vocabulary, net).collect()
    assert _bag((r["doc_id"], r["n_tokens"]) for r in got) == _bag((i, len(brute.words(t))) for i, t, *_ in corpus)
    by_id = {r["doc_id"]: r["log_prob"] for r in got}
    for i, t, *_ in corpus[:20] + corpus[-8:]:
        if i is None:
            continue
        slots = (word_hashes(t) >> np.uint64(64 - vocabulary.bits)).astype(np.int64)
        c = [int(vocabulary.class_of[s]) for s in slots]
        total = 0.0
        for p in range(len(c)) if len(c) < 500 else ():
            h = net.hidden_bias.astype(float).copy()
            for place, d in enumerate((-2, -1, 1, 2)):
                h += net.context[place][c[p + d] if 0 <= p + d < len(c) else len(vocabulary.log_prior)]
            z = np.tanh(h) @ net.out + net.out_bias
            total += z[c[p]] - np.log(np.exp(z).sum()) + vocabulary.log_share[slots[p]]
        if len(c) < 500:
            assert by_id[i] == pytest.approx(total, rel=1e-3, abs=1e-2)
    assert lm_score.score(docs.limit(0), vocabulary, net).count() == 0 and lm_score.train(docs.limit(0), vocabulary).out.shape == net.out.shape


def test_lm_of_more_words_than_a_table_holds(docs, spark, monkeypatch):
    """With a head of frequent slots and a join for the rest, classes and scores are those of the whole table."""
    whole = lm_score.count_words(docs)
    net = lm_score.train(docs, whole)
    want = {(r["doc_id"], r["n_tokens"]): r for r in lm_score.score(docs, whole, net).collect()}
    monkeypatch.setattr(lm_score, "TABLE_BITS", 10)
    for head in (0, 300):
        monkeypatch.setattr(lm_score, "HEAD", head)
        parts = lm_score.count_words(docs)
        assert parts.class_of is None and len(parts.head[0]) <= head and parts.log_prior == pytest.approx(whole.log_prior, abs=1e-5)
        slots = np.arange(0, 1 << whole.bits, 977)
        assert (parts.look_up(slots)[0] == whole.look_up(slots)[0]).all()
        got = lm_score.score(docs, parts, net).collect()
        assert len(got) == docs.count()
        assert all(r["log_prob"] == pytest.approx(want[r["doc_id"], r["n_tokens"]]["log_prob"], rel=1e-5, abs=1e-3) for r in got)


def test_lm_learns_context(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        t = []
        for _ in range(60):
            a = rng.randrange(8)
            t += [f"left{a}", f"mid{a}", f"right{a}"]
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    v = lm_score.count_words(df)
    net = lm_score.train(df, v)
    got = lm_score.score(df, v, net).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    plain = np.mean([v.log_prior[v.class_of[int(h >> np.uint64(64 - v.bits))]] for _, t in rows[:20] for h in word_hashes(t)])
    print("PER TOKEN", got[0] / got[1], plain)
    assert got[0] / got[1] > plain / 20


def test_lm_predicts_every_token_once(spark):
    for n in (np.arange(12), np.array([5]), np.zeros(0, np.int64)):
        assert (sum(lm_score.targets(n, turn).astype(int) for turn in range(lm_score.STRIDE)) == np.ones(n.sum())).all()
    df = spark.createDataFrame([(0, "lone")] * 40, "doc_id long, text string").coalesce(1)
    v = lm_score.count_words(df)
    lone = v.class_of[int(word_hashes("lone")[0] >> np.uint64(64 - v.bits))]
    assert lm_score.train(df, v).out_bias[lone] != v.log_prior[lone]  # texts of one word teach, too


def test_lm_grows_with_the_words(spark, docs, corpus):
    from collections import Counter

    want = Counter(int(h) for _, t, *_ in corpus for h in word_hashes(t))
    got = {}
    for r in lm_score.count_exactly(docs).collect():
        got |= dict(zip(np.frombuffer(r["words"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True))
    assert got == want
    for n in (10**5, 10**6, 10**7, 10**8):
        bits, fold = lm_score.table_sizes(n)
        assert 2**bits >= 2 * n and fold * lm_score.GROUPS >= n**0.5 - 1
    df = spark.createDataFrame([(k, " ".join(f"x{k * 300 + i}" for i in range(300))) for k in range(140)], "doc_id long, text string").coalesce(2)
    v = lm_score.count_words(df)
    assert len(v.log_prior) == 256 and np.exp(v.log_prior).sum() == pytest.approx(1, abs=1e-3)
    rng = np.random.default_rng(1)
    net = lm_score.train(df.limit(3), v)
    around, every = np.repeat(rng.integers(0, 257, (4, 5)), 256, axis=1), np.tile(np.arange(256), 5)
    p = np.exp(lm_score.log_probabilities(net, around, every)).reshape(5, 256)
    assert p.sum(axis=1) == pytest.approx(np.ones(5), abs=1e-3)
    inside = p[:, 7::128] / p[:, 7::128].sum(axis=1, keepdims=True)
    assert np.ptp(inside[:, 0]) > 1e-4  # within its group, too, a class depends on the context


def test_lm_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    net = lm_score.Network(*[rng.standard_normal(s).astype(np.float32) * 0.3 for s in ((4, 13, 5), (5,), (5, 4), (4,), (4, 3, 5), (4, 3))])
    around, target = rng.integers(0, 13, (4, 30)), rng.integers(0, 12, 30)
    loss = lambda m: -lm_score.log_probabilities(m, around, target).mean()
    stepped, squares = net.of(net.flat()), [np.zeros(x.shape) for x in net.parts()]
    lm_score._learn(stepped, squares, around, target, 1e-3)
    for k, part in enumerate(net.parts()):
        for i in range(0, part.size, 7):
            sides = []
            for d in (0.01, -0.01):
                moved = net.of(net.flat())
                moved.parts()[k].flat[i] += d
                sides.append(loss(moved))
            assert np.sqrt(squares[k].flat[i]) == pytest.approx(abs(sides[0] - sides[1]) / 0.02, abs=2e-4)
    assert loss(stepped) < loss(net)


PAGE = "<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>{menu}</a></li></ul></nav><div class=\"ad\">buy</div>{main}<div class='comments'><p>nice one</p></div><form><p>mail</p></form><footer>&copy; all &middot; {menu}</footer></body></html>"


def test_html(spark):
    rows = []
    for k in range(12):
        body = f"<article><h1>Title {k}</h1><p>Fish &amp; chips {k}\n  and <b>more</b><br>tea</p><p>same on every page</p><aside>see also</aside><p class='notice'>We use cookies</p><div id=share-bar>Share</div><ul><li>one<li>two {k}</ul></article>"
        rows.append((k, f"http://A.example/{k}", PAGE.format(menu=f"m{k}", main=body)))
    for k in range(12):
        main = f"<div id=content><p>About us</p><div class=text><p>Story number {k} is quite a bit longer than the rest {'x ' * 50}</p><p>second {k}</p></div></div>"
        rows.append((100 + k, f"https://b.example/{k}?q", PAGE.format(menu="home", main=main)))
    rows += [(200, None, None), (201, "nonsense", ""), (202, "http://c.example/", "just <b>text"), (203, "http://d.example/", "<p>a&nbsp;b<p>&#65;<!-- no --><script>x"), (203, "http://d.example/", "<p>a&nbsp;b<p>&#65;<!-- no --><script>x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    by_id = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by_id[3] == "Title 3\nFish & chips 3 and more tea\nsame on every page\none\ntwo 3"
    assert by_id[104] == f"Story number 4 is quite a bit longer than the rest {'x ' * 50}".strip() + "\nsecond 4"
    assert by_id[200] == by_id[201] == "" and by_id[202] == "just text" and by_id[203] == "a b\nA"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_all_main_text(spark):
    long, short = "long " * 60, "short " * 40
    mains = {
        "post": (f"<div class=post><h1>Head {{k}}</h1><p>lead {{k}}</p><div class=body><p>{long}{{k}}</p></div></div>", f"Head {{k}}\nlead {{k}}\n{long}{{k}}"),
        "parts": (f"<div class=part1><p>{long}{{k}}</p></div><div class=part2><p>{short}{{k}}</p></div>", f"{long}{{k}}\n{short}{{k}}"),
        "articles": (f"<main><article class=a><p>{long}{{k}}</p></article><article class=b><p>{short}{{k}}</p></article></main>", f"{long}{{k}}\n{short}{{k}}"),
    }
    rows = [(k, f"http://{host}.example/{k}", PAGE.format(menu="m", main=main.format(k=k))) for host, (main, _) in mains.items() for k in range(10)]
    for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r["text"] == mains[r["url"][7:].split(".")[0]][1].format(k=r["page_id"])


def test_html_template_of_different_pages(spark):
    rows = []

    def add(host, k, body):
        rows.append((len(rows), f"http://{host}.example/{len(rows)}", f"<body><script>at={len(rows)}</script><div class=site><p>Welcome to us</p></div><div class=text>{body}</div></body>"))
        return f"{host} {k}"

    want = []
    for k in range(24):  # half of the pages are copies of one
        want.append(add("copies", k if k % 2 else "hot", f"<p>copies {k if k % 2 else 'hot'}</p><p>more {k if k % 2 else 'hot'}</p>") + f"\nmore {k if k % 2 else 'hot'}")
    for k in range(3):
        want.append(add("small", k, f"<p>small {k}</p>"))
    for _ in range(9):
        want.append("Welcome to us\n" + add("same", 0, "<p>same 0</p>"))
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(want))


def test_html_names_only_break_ties(spark):
    """Pages without article or main, whose only text is in containers named like adverts; and real adverts beside an article."""
    text = "The market closed higher today and analysts expect more of the same tomorrow"
    rows, want = [], {}
    for k, name in enumerate(("share-prices", "promotion", "alert", "banner", "search", "footer", "post")):
        rows.append((k, f"http://n{k}.example/", f"<body><div class=ad>buy</div><div class='{name}'><h1>Head {k}</h1><p>{text} {k}</p></div><div class=comments><p>{text * 3}</p></div></body>"))
        want[k] = f"Head {k}\n{text} {k}"
    rows.append((50, "http://m.example/", f"<body><div class=promo><p>{text * 4}</p></div><article><p>short</p></article></body>"))
    rows.append((51, "http://m.example/", f"<body><svg><div><p>{text}</p></div><noscript><iframe><p>more</p>"))
    rows.append((52, "http://m.example/", "<body>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>out</p>"))
    want |= {50: "short", 51: f"{text}\nmore", 52: "deep\nout"}
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_no_name_empties_a_page(spark):
    text = "The market closed higher today and analysts expect more of the same tomorrow"
    names = ("comments-enabled", "nav-open content", "menu-page", "has-sidebar", "cookie-notice-on", "login", "comment-free")
    rows = [(k, f"http://e{k}.example/", f"<body><div class='{name}'><h1>Head</h1><p>{text}</p></div></body>") for k, name in enumerate(names)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(names) and {r["text"] for r in got} == {f"Head\n{text}"}


@pytest.mark.parametrize("part", ['<a "x ', "<a 'x\">", "<div ", "<svg>", "<div class='a'>x", "</p><p>", "<li>", "a=", "<!", "<a b" + "c" * 100, "<td><p>", "<![CDATA["])
def test_html_is_linear_in_broken_pages(part):
    import time

    page = "<body><p>start</p>" + part * (400_000 // len(part))
    start = time.process_time()
    html_extract.page_tokens(page)
    html_extract.extract_page(page, frozenset())
    assert time.process_time() - start < 5


def test_html_template_against_plain_version(spark):
    """Occurrence vectors page by page, instead of sums of hashes."""
    rng = random.Random(12)
    rows = []
    for k in range(40):
        parts = [f"<div class=c{j}><p>{'same' if rng.random() < 0.8 else rng.random()} {j}</p><div class=d>{rng.randrange(3)}</div></div>" for j in range(6) if rng.random() < 0.8]
        rows.append((k, f"http://h{k % 2}.example/{k}", "<body><p>top</p>" + "".join(parts) + "</body>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in ("h0", "h1"):
        own = {k: html_extract.page_tokens(page) for k, url, page in rows if host in url}
        pages = dict(own.values())
        vectors = {t: tuple(found.get(t, 0) for found in pages.values()) for t in {t for found in pages.values() for t in found}}
        often = {t: v for t, v in vectors.items() if 2 * sum(map(bool, v)) >= len(pages)}
        classes = Counter(often.values())
        outer = {path: around for path, around, text in often if text == 0}

        def nested(path, outer=outer):
            while path:
                if path not in outer:
                    return False
                path = outer[path]
            return True

        template = {0} | {p for (p, _, text), v in often.items() if text == 0 and max(v) == 1 and nested(p) and classes[v] > 1}
        texts = {text for (p, _, text), v in often.items() if text and p in template and sum(map(bool, v)) >= html_extract.SUPPORT}
        assert texts
        for k, url, page in rows:
            if host in url:
                blocks = html_extract.parse(page)[1]
                left = [b[3] for b in blocks if html_extract._number(b[3]) not in texts] or [b[3] for b in blocks]
                assert got[k] == "\n".join(left)


@needs_data
def test_html_of_all_pages(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op9_html_extract(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h[1-6]|ul|li)>", inner)]
        assert r["text"] == "\n".join(x for x in blocks if x)


@needs_data
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95


def test_large_ids_stay_exact_beside_null(spark):
    text = "the river runs by the old stone house and the garden wall near the quiet town today"
    ids = [2**60 + 1, None, 2**60 + 3]
    df = spark.createDataFrame([(i, text, "en", "s", None if i else 7) for i in ids], SCHEMA).coalesce(1)
    vocabulary = lm_score.count_words(df)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.col("text").alias("html"))
    frames = [
        langid.predict(df, langid.fit(df)),
        toxicity.predict(df, toxicity.fit(df, df.select("doc_id", F.lit(0).alias("toxic")))),
        lm_score.score(df, vocabulary, lm_score.train(df, vocabulary)),
        jaccard.join_documents(df),
        suffix_dedup.removal_digest(df),
        suffix_dedup.remove_repeats(df),
        html_extract.extract(pages).withColumnRenamed("page_id", "doc_id"),
    ]
    for frame in frames:
        assert _bag(r["doc_id"] for r in frame.collect()) == _bag(ids)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join_documents(df).collect()} == {2**60 + 1: 2**60 + 1, 2**60 + 3: 2**60 + 1, None: None}
