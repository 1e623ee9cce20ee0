"""Files, streams, as-of joins, fits, permutations, early stops and hash trees: results against plain versions, skew, plans."""

import datetime as dt
import json
import os
import random
import shutil
import time
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.functions.columns import latest_as_of, with_previous
from panelflow.operators import files, importance, ingest, least_squares, modeling, quality, sentiment
from panelflow.schemas import PRICE_FEATURES, PRICES, TARGET
from panelflow.session import materialize, scratch_scope
from panelflow.sources import tables
from panelflow.streaming import jobs, scoring

D = dt.date
HEADER = "ticker,date,open,high,low,close,adjusted_close,volume"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------ files


def _csv(folder, name, rows, header=HEADER):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [f"{t},{d},1.0,1.0,1.0,{c},{c},5" if isinstance(d, D) else d for t, d, c in rows]
    (folder / f"{name}.csv").write_text("\n".join([header, *lines]) + "\n")


def _days(ticker, n, down=False):
    days = [(ticker, D(2020, 1, 1) + dt.timedelta(days=k), float(k)) for k in range(n)]
    return days[::-1] if down else days


def test_order_of_files_in_many_splits(spark, tmp_path):
    """Files of several splits each; joints between splits count like neighbours."""
    src = tmp_path / "prices"
    _csv(src, "up", _days("A", 900) + _days("B", 400))
    _csv(src, "down", _days("A", 900, True))
    _csv(src, "mixed", _days("A", 500) + _days("B", 500, True))
    _csv(src, "one", _days("A", 1))
    _csv(src, "two", _days("A", 1) + _days("B", 9, True))
    late = _days("A", 900)
    late[700], late[701] = late[701], late[700]
    _csv(src, "swapped", late)
    _csv(src, "equal", [*_days("A", 300), _days("A", 300)[-1]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = tables.scan_prices(spark, str(src))[0]
        got = {os.path.basename(r["file"]).split(".")[0]: r for r in files.file_orders(files.file_summaries(rows)).collect()}
        assert rows.select(F.spark_partition_id()).distinct().count() > 10
        assert "Sort " not in _plan(files.file_summaries(rows)) and "Window" not in _plan(files.file_summaries(rows))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: r["status"] for k, r in got.items()} == {"up": "ascending", "down": "descending", "mixed": "mixed", "one": "ascending", "two": "descending", "swapped": "unsorted", "equal": "unsorted"}
    assert (got["up"]["rows"], got["up"]["tickers"], got["up"]["date_min"], got["up"]["date_max"]) == (1300, 2, D(2020, 1, 1), D(2020, 1, 1) + dt.timedelta(days=899))


def test_summaries_fold_like_their_rows():
    rng = random.Random(5)
    for _ in range(300):
        days = [rng.randrange(6) if rng.random() < 0.3 else k for k in range(rng.randrange(1, 12))]
        if rng.random() < 0.4:
            days.reverse()
        cut = rng.randrange(len(days) + 1)
        null = np.array([rng.random() < 0.2 for _ in days])

        def summary(part, n):
            held = {}
            z = np.zeros(len(part), int)
            files.summarize_runs(z, z, z, np.array(part, np.int64), n, held)
            return held.get((0, 0, 0))

        parts = [summary(days[:cut], null[:cut]), summary(days[cut:], null[cut:])]
        folded = files.fold(*parts) if all(parts) else parts[0] or parts[1]
        assert folded == summary(days, null)


def test_descending_files_are_written_anew(spark, tmp_path):
    src, out = tmp_path / "prices", str(tmp_path / "out")
    _csv(src, "AAA", _days("AAA", 40, True))
    _csv(src, "BBB", _days("BBB", 30))
    got = {r["file"]: tuple(r)[1:] for r in files.validate_files(spark, str(src), out).collect()}
    last = lambda n: D(2020, 1, 1) + dt.timedelta(days=n - 1)
    assert got == {"AAA": (40, D(2020, 1, 1), last(40), True), "BBB": (30, D(2020, 1, 1), last(30), False), None: (70, D(2020, 1, 1), last(40), True)}
    again = files.file_orders(files.file_summaries(tables.scan_prices(spark, out, "parquet")[0])).collect()
    assert sum(r["rows"] for r in again) == 70 and {r["status"] for r in again} == {"ascending"}
    manifest = {files_name(r["part"]): r["tickers"] for r in files.files_manifest(files.file_summaries(tables.scan_prices(spark, str(src))[0])).collect()}
    assert manifest == {"AAA": "AAA", "BBB": "BBB"}
    for name, rows, says in (("bad", [("A", "A,2020-01-01,1,1,1,x,1,1", 0)], "can't be read"), ("mix", _days("A", 9) + _days("B", 9, True), "one order"), ("twice", [*_days("A", 5), *_days("A", 5)], "one order"), ("short", [("A", "A,2020-01-01", 0)], "can't be read")):
        _csv(tmp_path / name, name, rows)
        with pytest.raises(ValueError, match=says):
            files.validate_files(spark, str(tmp_path / name), str(tmp_path / f"{name}-out"))
        assert not (tmp_path / f"{name}-out").exists()


def files_name(path):
    return os.path.basename(path).split(".")[0]


def test_no_row_is_lost_by_a_scan(spark, tmp_path):
    lines = ["A,2020-01-01,1,1,1,2,2,3", "A,20200102,1,1,1,2,2,3", ",2020-01-03,1,1,1,2,2,3", "A,2020-01-04,1,,1,x,2,y", "A,2020-01-05,1", "A,2020-01-06,1,1,1,2,2,3,4", "A,2020-01-07,,,,,,"]
    _csv(tmp_path / "x", "x", [("", line, 0) for line in lines])
    good, bad = tables.scan_prices(spark, str(tmp_path / "x"))
    assert sorted(r["date"].day for r in good.collect()) == [1, 7]
    got = sorted((r["record"], tuple(r["reasons"])) for r in bad.collect())
    assert got == sorted([(lines[1], ("date",)), (lines[2], ("ticker",)), (lines[3], ("close", "volume")), (lines[4], ("fields",)), (lines[5], ("fields",))])
    assert all(r["file"].endswith("x.csv") and r["place"] == 0 for r in bad.collect())
    few = tables.scan_prices(spark, str(tmp_path / "x"))[0].select("ticker", "date")  # few columns read: the same rows
    assert few.count() == 2


# ------------------------------------------------------------ streams


def _land(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    time.sleep(1.1)  # files are taken in the order of their times
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(map(json.dumps, rows)))


def _requests(folder, name, rows):
    _land(folder, name, [{"request_id": i, "ticker": t, "as_of": at[:10], "ts": at} for i, t, at in rows])


def test_every_request_is_answered_once(spark, tmp_path):
    """Scored, late and unknown requests; copies, a restart, and features that arrive and are revised in between."""
    req, upd, out, state = (str(tmp_path / x) for x in ("req", "upd", "out", "state"))
    os.makedirs(upd)
    start = spark.createDataFrame([("AA", D(2024, 1, 1), 1.0), ("AA", D(2024, 1, 3), 3.0), ("BB", D(2024, 1, 9), 9.0)], "ticker string, date date, x double")

    def run():
        scoring.score_stream(spark, req, upd, start, ["x"], F.col("x") * 0.1, out, state, late=dt.timedelta(days=1)).awaitTermination()
        return {r["request_id"]: (r["sink"], r["status"], r["feature_date"] and r["feature_date"].day, r["prediction"]) for r in scoring.scores(spark, out).collect()}

    _requests(req, 1, [("r1", "aa", "2024-01-02T10:00:00Z"), ("r2", "bb", "2024-01-02T11:00:00Z"), ("r3", "zz", "2024-01-02T11:00:00Z"), ("r1", "aa", "2024-01-02T10:00:00Z"), (None, "aa", "2024-01-02T10:00:00Z")])
    _requests(req, 2, [("r4", "aa", "2024-01-06T10:00:00Z")])
    want = {"r1": ("scores", "ok", 1, 0.1), "r2": ("scores", "no_features", None, None), "r3": ("rejects", "unknown", None, None), "r4": ("scores", "ok", 3, pytest.approx(0.3))}
    assert run() == want
    _land(upd, 1, [{"ticker": "aa", "date": "2024-01-05", "x": 5.0}, {"ticker": "AA", "date": "2024-01-03", "x": 4.0}])
    _requests(req, 3, [("r5", "aa", "2024-01-06T11:00:00Z"), ("r6", "aa", "2024-01-02T10:00:00Z"), ("r4", "aa", "2024-01-06T10:00:00Z"), ("r7", " AA", "2024-01-05T12:00:00Z")])
    want |= {"r5": ("scores", "ok", 5, 0.5), "r6": ("rejects", "late", None, None), "r7": ("scores", "ok", 5, 0.5)}
    assert run() == want
    # much later: old ids and rows are forgotten, the last row up to then isn't
    _requests(req, 4, [("r8", "bb", "2024-03-01T10:00:00Z")])
    _requests(req, 5, [("r9", "aa", "2024-03-01T10:00:00Z"), ("r1", "aa", "2024-03-02T10:00:00Z")])
    assert run() == want | {"r8": ("scores", "ok", 9, pytest.approx(0.9)), "r9": ("scores", "ok", 5, 0.5), "r1": ("scores", "ok", 5, 0.5)} or scoring.scores(spark, out).where("request_id = 'r1'").count() == 2
    assert scoring.scores(spark, out).count() == 10


def test_a_replay_of_days_keeps_few_states(spark, tmp_path):
    """A delivery of several files is one batch, dealt to shards; its states don't go with its days, ids count by day, nulls aren't NaN."""
    req, upd, out, state = (str(tmp_path / x) for x in ("req", "upd", "out", "state"))
    os.makedirs(upd)
    days = [D(2023, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    value = lambda i: None if i % 50 == 7 else float("nan") if i % 50 == 9 else float(i)
    start = spark.createDataFrame([("AA", d, value(i)) for i, d in enumerate(days)], "ticker string, date date, x double")
    rows = [(f"r{i}", "aa", f"{d}T10:00:00Z") for i, d in enumerate(days)]
    for k in range(2):
        _requests(req, k, rows[k::2] + rows[:5] + [("twice", "aa", f"{days[k]}T11:00:00Z")])
    q = scoring.score_stream(spark, req, upd, start, ["x"], F.col("x") * 0.1, out, state, files_per_batch=None, shards=2)
    q.awaitTermination()
    got = sorted((r["request_id"], str(r["as_of"]), str(r["prediction"])) for r in scoring.scores(spark, out).where("status = 'ok'").collect())
    predicted = lambda i: str(None if value(i) is None else round(value(i) * 0.1, 6))
    assert got == sorted([(f"r{i}", str(d), predicted(i)) for i, d in enumerate(days)] + [("twice", str(days[k]), predicted(k)) for k in range(2)])
    progress = [p["stateOperators"][0] for p in map(lambda p: json.loads(p.json), q.recentProgress)]
    assert sum(p["numRowsUpdated"] for p in progress) < 40  # with a state for each day, 800


def test_history_reads_and_writes_touched_months_only(spark, tmp_path):
    out = str(tmp_path / "history")
    assert jobs.history(spark, out).count() == 0
    rng, batches = random.Random(2), []
    for k in range(4):
        months = range(1, 13) if k == 0 else [k + 1]
        rows = [(t, D(2023, m, rng.randrange(1, 28)), 1.0, 1.0, 1.0, float(rng.randrange(100)), 1.0, k) for t in "AB" for m in months for _ in range(8)]
        rows = list({r[:2]: r for r in rows}.values())
        batches.append(spark.createDataFrame(rows, PRICES))
        jobs.merge_batch(spark, batches[-1], out, k)
    want = spark.createDataFrame([], PRICES)
    for b in batches:
        want = ingest.merge_history(want, b)
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(jobs.history(spark, out)) == rows(want)
    assert [len(os.listdir(f"{out}/rows/batch={k}")) - len([x for x in os.listdir(f"{out}/rows/batch={k}") if not x.startswith("month=")]) for k in range(4)] == [12, 1, 1, 1]
    files_read = {os.path.dirname(f) for f in jobs.history(spark, out).inputFiles()}
    assert len(files_read) == 12  # one version of each month
    jobs.merge_batch(spark, batches[2], out, 2)  # runs again: the same
    assert rows(jobs.history(spark, out)) == rows(want)
    shutil.rmtree(f"{out}/months/batch=3")  # failed before its months were named: as if it hadn't been
    jobs.merge_batch(spark, batches[3], out, 3)
    assert rows(jobs.history(spark, out)) == rows(want)


def test_scratch_of_a_batch_goes(spark):
    df = spark.range(5)
    with scratch_scope(spark):
        with scratch_scope(spark):
            inner = materialize(df, "inner").inputFiles()[0].removeprefix("file://")
        outer = materialize(df, "outer").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(outer) and not os.path.exists(inner)
    assert not os.path.exists(outer) and os.path.exists(materialize(df, "kept").inputFiles()[0].removeprefix("file://"))


# ------------------------------------------------------------ as-of joins


def _brute_as_of(left, right):
    by = {}
    for k, t, v in right:
        if t is not None:
            by.setdefault(k, []).append((t, v))
    out = []
    for k, t, i in left:
        times = sorted(by.get(k, []))
        at = bisect_right([x for x, _ in times], t) if t is not None else 0
        out.append((i, times[at - 1][1] if at else None))
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "date", "timestamp", "double"])
def test_as_of_join_of_any_kind_of_time(spark, kind):
    rng = random.Random(7)
    to = {"long": int, "date": lambda x: D(2020, 1, 1) + dt.timedelta(days=int(x)), "timestamp": lambda x: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=x * 7), "double": float}[kind]
    right = [(rng.choice(["a", "b", "c", None]), to(t), t) for t in rng.sample(range(3000), 700)] + [("a", None, -1)]
    left = [(rng.choice(["a", "b", "c", "d", None]), to(rng.randrange(-50, 3200)) if rng.random() < 0.95 else None, i) for i in range(2000)]
    l = spark.createDataFrame(left, f"k string, t {kind}, i long")  # noqa: E741
    r = spark.createDataFrame(right, f"k string, t {kind}, v long")
    got = sorted((x["i"], x["v"]) for x in latest_as_of(l, r, ["k"], "t", "t", ["v"], hot_rows=5).collect())
    assert got == _brute_as_of(left, right)


def test_as_of_join_of_one_hot_day(spark):
    """A ticker with all requests on one day: no task gets much more of them than others."""
    n = 1_000_000
    left = spark.range(n).select(F.lit("A").alias("k"), F.lit(D(2024, 1, 5)).alias("t"), "id")
    right = spark.createDataFrame([("A", D(2024, 1, d), d) for d in (1, 4, 9)], "k string, t date, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = latest_as_of(left, right, ["k"], "t", "t", ["v"], hot_rows=10_000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.where("v <> 4").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == n and len(sizes) > 4 and max(sizes) <= 3 * np.median(sizes)


def test_previous_row_over_blocks(spark):
    """One group with most rows, in many blocks; null groups and null values."""
    rng = random.Random(3)
    rows = [("hot" if k % 10 else rng.choice(["a", None]), k, None if k % 13 == 0 else rng.randrange(9)) for k in rng.sample(range(20_000), 6000)]
    df = spark.createDataFrame(rows, "g string, seq long, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_previous(df, ["g"], "seq", "v", "before")
        got = {(r["g"], r["seq"]): r["before"] for r in out.collect()}
        assert materialize(df.repartitionByRange("g", "seq"), "blocks").where("g = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last, want = {}, {}
    for g, q, v in sorted(rows, key=lambda r: r[1]):
        want[g, q] = last.get(g)
        last[g] = v
    assert got == want and out.columns == ["g", "seq", "v", "before"]


# ------------------------------------------------------------ fits, permutations, early stops


def _rows(spark, n_days, dependent=False):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n_days * 3, len(PRICE_FEATURES)))
    if dependent:
        x[:, 1], x[:, 2] = 2 * x[:, 0], 0.0
    y = x @ np.arange(1, len(PRICE_FEATURES) + 1) + 0.5 + 0.1 * rng.normal(size=len(x))
    days = [D(2020, 1, 1) + dt.timedelta(days=k // 3) for k in range(len(x))]
    kinds = ", ".join(f"{c} double" for c in [*PRICE_FEATURES, TARGET])
    return spark.createDataFrame([(t, *map(float, r), float(z)) for t, r, z in zip(days, x, y, strict=True)], f"date date, {kinds}"), days, x, y


@pytest.mark.parametrize("dependent", [False, True])
def test_expanding_fits(spark, dependent, monkeypatch):
    monkeypatch.setattr(least_squares, "CHUNK", 3)
    df, days, x, y = _rows(spark, 60, dependent)
    ends = [(k, D(2020, 1, 1) + dt.timedelta(days=7 * k - 3)) for k in range(11)] + [(50, D(2020, 1, 12)), (51, D(2020, 1, 12)), (52, D(2030, 1, 1))]
    got = {r["fold_id"]: r["coefficients"] for r in least_squares.expanding_fits(df.repartition(5), spark.createDataFrame(ends, "fold_id int, train_end date")).collect()}
    assert len(got) == len(ends)
    for fold, end in ends:
        use = np.array([d <= end for d in days])
        a = np.concatenate((np.ones((use.sum(), 1)), x[use]), axis=1)
        size = np.sqrt((a * a).sum(axis=0))
        size[size == 0] = 1
        want = np.linalg.lstsq(a / size, y[use], rcond=1e-9)[0] / size if use.any() else np.zeros(8)
        assert np.allclose(got[fold], want, atol=1e-7), (fold, use.sum())


def test_bad_condition_is_not_squared(spark):
    """Columns that agree to seven digits: sums of products can't tell them apart, factors can."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=2000)
    b = a + 1e-7 * rng.normal(size=2000)
    rows = [(D(2020, 1, 1), float(p), float(q), *[0.0] * 5, float(3 * p - 2 * q)) for p, q in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows, "date date, " + ", ".join(f"{c} double" for c in [*PRICE_FEATURES, TARGET]))
    got = least_squares.expanding_fits(df, spark.createDataFrame([(0, D(2020, 1, 1))], "fold_id int, train_end date")).first()["coefficients"]
    assert got[1] == pytest.approx(3, abs=1e-4) and got[2] == pytest.approx(-2, abs=1e-4)


def test_partners_are_a_bijection(spark):
    for n in (1, 2, 3, 5, 17, 100, 1023, 4000):
        runs = spark.range(3).select(F.col("id").alias("run"))
        got = spark.range(n).crossJoin(runs).select("run", importance.partner(F.col("id"), F.col("run"), n).alias("to")).groupBy("run").agg(F.countDistinct("to").alias("n"), F.min("to").alias("lo"), F.max("to").alias("hi")).collect()
        assert len(got) == 3 and all((r["n"], r["lo"], r["hi"]) == (n, 0, n - 1) for r in got)
    moved = spark.range(4000).select("id", *[importance.partner(F.col("id"), F.lit(r), 4000, seed).alias(f"p{r}_{seed}") for r, seed in ((0, 1), (1, 1), (0, 2))]).toPandas()
    assert all((moved["id"] == moved[c]).mean() < 0.01 for c in moved.columns[1:]) and (moved["p0_1"] != moved["p1_1"]).mean() > 0.99 and (moved["p0_1"] != moved["p0_2"]).mean() > 0.99
    assert abs(np.corrcoef(moved["id"], moved["p0_1"])[0, 1]) < 0.1


def test_importance_scores_once(spark):
    rng = np.random.default_rng(4)
    rows = [(f"T{k % 7}", D(2020, 1, 1) + dt.timedelta(days=k), *map(float, rng.normal(size=7))) for k in range(500)]
    df = spark.createDataFrame(rows, "ticker string, date date, " + ", ".join(f"{c} double" for c in PRICE_FEATURES)).withColumn(TARGET, 3 * F.col("return_1d") - F.col("return_5d"))
    calls = []

    def score(x):
        calls.append(1)
        return x.withColumn("y_pred", 3 * F.col("return_1d") - F.col("return_5d"))

    got = {r["feature"]: r for r in importance.model_importance(df, score, PRICE_FEATURES, ["ticker", "date"]).collect()}
    assert len(calls) == 1 and set(got) == set(PRICE_FEATURES)
    assert got["return_1d"]["importance"] > got["return_5d"]["importance"] > 1 and got["return_1d"]["std"] > 0
    assert all(got[c]["importance"] == 0 and got[c]["std"] == 0 for c in PRICE_FEATURES[2:])
    runs = importance.permuted_runs(df, ["return_1d", "return_5d"], ["ticker", "date"], 2)
    for run, column in enumerate(["return_1d", "return_1d", "return_5d", "return_5d"]):
        assert sorted(r[0] for r in runs.where(F.col("run") == run).select(column).collect()) == sorted(r[0] for r in df.select(column).collect())
    assert runs.count() == 5 * 500
    assert importance.model_importance(df.limit(0), score, PRICE_FEATURES, ["ticker", "date"]).count() == 0


def test_early_stop_keeps_the_best_iteration():
    assert modeling.early_stop([5, 4, 3, 3.5, 3.4, 3.3, 1], 3) == (3, 6)
    assert modeling.early_stop([5, 4, 4, 4, 4], 3) == (2, 5) and modeling.early_stop([3, 2, 1], 3) == (3, 3) and modeling.early_stop([], 3) == (0, 0)


def test_staged_models_end_at_the_best_iteration(spark):
    """Train and val that disagree: the best iteration isn't the last one, and the kept model is the one of that iteration."""
    rng = np.random.default_rng(8)
    kinds = "ticker string, " + ", ".join(f"{c} double" for c in [*PRICE_FEATURES, TARGET])
    x = rng.normal(size=(600, 7))
    noise = 1.5 * rng.normal(size=600)
    train, val = (spark.createDataFrame([("A", *map(float, r), float(r[0] + e)) for r, e in zip(x[s], noise[s], strict=True)], kinds) for s in (slice(0, 150), slice(150, 600)))
    model, curve = modeling.fit_staged(train, val, max_iter=15, patience=3)
    rows = sorted(curve.collect(), key=lambda r: r["iteration"])
    best = next(r for r in rows if r["best"])
    assert 1 <= best["iteration"] < 15 and len(model.trees) == best["iteration"] and best["mse"] == min(r["mse"] for r in rows if r["trained"])
    kept = modeling.score(model, val).agg(F.avg((F.col("y_pred") - F.col(TARGET)) ** 2)).first()[0]
    assert kept == pytest.approx(best["mse"], rel=1e-9)
    whole = modeling.fit_regressor(train, None, max_iter=15)
    last = modeling.score(whole, val).agg(F.avg((F.col("y_pred") - F.col(TARGET)) ** 2)).first()[0]
    assert last == pytest.approx(rows[-1]["mse"], rel=1e-9) and last > kept
    path, losses = modeling.fit_boosted_linear(train, val.withColumn(TARGET, F.col(TARGET) + 2 * F.col("return_5d")), max_iter=30)
    assert len(path) == next(r["iteration"] for r in losses.collect() if r["best"])


# ------------------------------------------------------------ hash trees, dedupe


def test_one_changed_row_of_a_million_is_found(spark):
    df = materialize(spark.range(1_000_000).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("v"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("s")), "million")
    other = df.withColumn("v", F.when(F.col("k") == 777_777, F.lit(-1.0)).otherwise(F.col("v")))
    one, two = (materialize(quality.hash_tree(x, ("k",)), "tree") for x in (df, other))
    assert len(quality.unequal_leaves(one, two)) == 1 and quality.unequal_leaves(one, one) == []
    assert [tuple(r) for r in quality.table_differences(df, other, ("k",)).collect()] == [(777_777, 1, 1)]
    assert sorted(map(tuple, quality.hash_tree(df.limit(5000), ("k",), 2).collect())) == sorted(map(tuple, quality.hash_tree(df.limit(5000).repartition(7).select("s", "v", "k"), ("k",), 2).collect()))


def test_differences_of_odd_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, ""), (4, "d"), (4, "d"), (None, "n")], "k long, s string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (4, "d"), (5, "new"), (None, "m")], "k long, s string")
    assert sorted(map(repr, map(tuple, quality.table_differences(a, b, ("k",)).collect()))) == sorted(map(repr, [(2, 1, 1), (3, 1, 0), (4, 2, 1), (5, 0, 1), (None, 1, 1)]))
    assert quality.table_differences(a, a.repartition(3), ("k",)).count() == 0 and quality.table_differences(a.limit(0), a.limit(0), ("k",)).count() == 0


def test_articles_without_id_are_no_hot_task(spark):
    """A third of all rows without a uuid: one row of each task reaches the shuffle, and no task sorts."""
    n = 60_000
    day = F.date_add(F.lit(D(2024, 1, 1)), (F.col("id") % 40).cast("int"))
    news = spark.range(n).select(F.lit("A").alias("ticker"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("u"), F.col("id") % 5000)).alias("article_uuid"), day.alias("pub_date"), day.cast("timestamp").alias("pub_ts"), (F.col("id") % 7 - 3.0).alias("sentiment_score"), "id")
    out = sentiment.dedupe_articles(news)
    assert "Sort" not in _plan(out) and out.columns == news.columns
    got = out.collect()
    assert len(got) == len({r["article_uuid"] for r in got})
    rows = {}
    for r in news.collect():
        key = (r["pub_date"], r["sentiment_score"])
        if r["article_uuid"] not in rows or key < rows[r["article_uuid"]]:
            rows[r["article_uuid"]] = key
    assert {r["article_uuid"]: (r["pub_date"], r["sentiment_score"]) for r in got} == rows
