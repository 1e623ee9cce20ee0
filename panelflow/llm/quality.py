"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects documents by a condition on one feature. On a sample, the share that each rule rejects and the work that
its features take are measured, in one job: a feature's work is what it goes through (characters, words, windows) times
what one of these takes, so an order is the same in each run on the same sample. Rules then run by rejection per cost, and
a document that a rule has rejected skips the features of all later rules.

Edge cases: a null text counts as empty (no words: rejected as short); repeated rows each get their own row; columns
other than doc_id and text are ignored or carried as they are, whatever their names; ties in the order of rules go by name; an empty table
gives an empty result; a very long text's words are held as an array, and its five-word windows are sorted, in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import SYMBOLS, words

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """reject: a condition on the features named."""

    name: str
    features: tuple[str, ...]
    reject: Callable[[], Column]


RULES = (
    Rule("short", ("n_words",), lambda: F.col("n_words") < 10),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule("symbols", ("n_words", "n_symbols"), lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("word_length", ("n_words", "word_chars"), lambda: ~F.col("word_chars").between(2 * F.col("n_words"), 15 * F.col("n_words"))),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda: (F.col("n_dup_lines") >= 2) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
    Rule("letters", ("word_chars", "n_other_chars"), lambda: 10 * F.col("n_other_chars") > 7 * F.col("word_chars")),
)
BASE = ("short", "repeats")


def _when(alive: Column | None, value: Column) -> Column:
    return value if alive is None else F.when(alive, value)


def _words(df: DataFrame, alive: Column | None) -> DataFrame:
    return df.withColumn("_words", _when(alive, words(F.col("_text"))))


def _repeat_words(df: DataFrame, alive: Column | None) -> DataFrame:
    """n_repeat_words: words inside a five-word window that the text has twice or more.

    Windows are compared by a 64-bit hash. Only where some window repeats are windows sorted with their positions, so
    that the work is n log n for the longest text and a hash set for the others.
    """
    n = F.size("_words")
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice("_words", i + 1, WINDOW)))
    df = df.withColumn("_grams", _when(alive, F.when(n > WINDOW, grams).otherwise(F.array().cast("array<long>"))))
    df = df.withColumn("_sorted", F.when(F.size("_grams") > F.size(F.array_distinct("_grams")), F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, i, by: F.coalesce(F.get("_sorted", i + by)["g"] == x["g"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: F.when(i > 0, same(x, i, -1)).otherwise(F.lit(False)) | same(x, i, 1))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW))))
    total = F.when(F.size("_at") > 0, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0))
    return df.withColumn("n_repeat_words", _when(alive, F.coalesce(total, F.lit(0)).cast("long")))


def _lines(df: DataFrame, alive: Column | None) -> DataFrame:
    df = df.withColumn("_lines", _when(alive, F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    return df.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))


#: Features, and how to add each; those of a document that is no longer alive are null.
FEATURES: dict[str, Callable[[DataFrame, Column | None], DataFrame]] = {
    "n_words": lambda df, a: df.withColumn("n_words", _when(a, F.size("_words").cast("long"))),
    "word_chars": lambda df, a: df.withColumn("word_chars", _when(a, F.length(F.array_join("_words", "")).cast("long"))),
    "n_symbols": lambda df, a: df.withColumn("n_symbols", _when(a, F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"))),
    "n_repeat_words": _repeat_words,
    "n_lines": _lines,
    "n_dup_lines": _lines,
    "n_other_chars": lambda df, a: df.withColumn("n_other_chars", _when(a, F.length(F.regexp_replace("_text", r"[\p{L}\x20\x09-\x0D]+", "")).cast("long"))),
}


def _costs() -> dict[str, Column]:
    """What adding a feature costs a document, as nanoseconds: measured once on plain prose, by what it goes through."""
    chars, n = F.length("_text"), F.size("_words")
    return {"n_words": F.lit(1), "word_chars": 20 * n, "n_symbols": 12 * chars, "n_repeat_words": 160 * n, "n_lines": 8 * chars, "n_dup_lines": F.lit(1), "n_other_chars": 30 * chars}


def _start(df: DataFrame, text: str = "text") -> DataFrame:
    return _words(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), None)


def _add(df: DataFrame, names: tuple[str, ...], alive: Column | None) -> DataFrame:
    for name in names:
        if name not in df.columns:
            df = FEATURES[name](df, alive)
    return df


def measure_rules(sample: DataFrame, rules: tuple[Rule, ...]) -> dict[str, tuple[float, float]]:
    """Of each rule: the share of sample (a table with text) that it rejects, and what its features cost a document, as nanoseconds."""
    df = _add(_start(sample.select("text")), tuple(dict.fromkeys(f for r in rules for f in r.features)), None)
    costs = _costs()
    values = [F.avg(r.reject().cast("double")) for r in rules] + [F.avg(sum((costs[f] for f in r.features), F.lit(1)).cast("double")) for r in rules]
    got = df.agg(*[v.alias(f"v{i}") for i, v in enumerate(values)]).first()
    return {r.name: (got[i] or 0.0, got[len(rules) + i] or 1.0) for i, r in enumerate(rules)}


def order_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 4000, seed: int = 11) -> list[Rule]:
    """rules by the share they reject per cost, both measured on a sample of about sample_rows documents.

    The order changes the work only, never a verdict, as a document is kept if no rule rejects it.
    """
    fraction = min(1.0, sample_rows / max(1, documents.count()))
    got = measure_rules(documents.select("text").sample(fraction=fraction, seed=seed), rules)
    return sorted(rules, key=lambda r: (-(got[r.name][0] + 1e-4) / got[r.name][1], r.name))


def _judge(documents: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[str]]:
    """documents under the names c0, c1, ..., with `rejected_by`; and these names. No column of documents can clash with a feature.

    A feature is computed once it is needed, for documents alive at that point.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]
    df = _start(documents.toDF(*names), names[documents.columns.index("text")]).withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        alive = F.col("rejected_by").isNull()
        df = _add(df, rule.features, alive)
        df = df.withColumn("rejected_by", F.when(alive & rule.reject(), F.lit(rule.name)).otherwise(F.col("rejected_by")))
    return df, names


def cascade(documents: DataFrame, rules: list[Rule], columns: list[str], name: str = "rejected_by") -> DataFrame:
    """columns of documents, and under `name` the first rule in the given order that rejects a document, or null."""
    df, names = _judge(documents, rules)
    return df.select(*[names[documents.columns.index(c)] for c in columns], "rejected_by").toDF(*columns, name)


def filter_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    judged, names = _judge(documents, order_rules(documents, rules))
    # a filter pushed below the cascade would compute every feature inside its condition; the row number keeps it above
    judged = judged.withColumn("row", F.monotonically_increasing_id())
    return judged.where("rejected_by IS NULL AND row >= 0").select(*names).toDF(*documents.columns)


def score_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document's base features, whether the base rules reject it, and the cascade's verdict."""
    ordered = order_rules(documents, rules)
    df = _start(documents.select("doc_id", "text"))
    df = _add(df, ("n_words", "word_chars", "n_symbols", "n_lines", "n_repeat_words"), None)
    failed = F.lit(False)
    for rule in (r for r in rules if r.name in BASE):
        failed = failed | rule.reject()
    df = df.withColumn("base_failed", failed).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")))
    for rule in (r for r in ordered if r.name not in BASE):
        alive = F.col("rejected_by").isNull()
        df = _add(df, rule.features, alive)
        df = df.withColumn("rejected_by", F.when(alive & rule.reject(), F.lit(rule.name)).otherwise(F.col("rejected_by")))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))


#: `kept` is what RULES say; the order of the cascade doesn't matter to it.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, ws[i:i+4] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
p AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM c, range(5) AS r(k) WHERE n >= 2 GROUP BY rid),
l AS (SELECT rid, doc_id, ws, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
f AS (SELECT l.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(t, '[\p{L}\x20\x09-\x0D]+', '', 'g')) AS n_other
  FROM l LEFT JOIN p ON l.rid = p.rid),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words
       OR (n_dup_lines >= 2 AND 2 * n_dup_lines > n_lines) OR 10 * n_other > 7 * word_chars) AS kept
FROM b
"""
