"""The title join against all pairs."""

import random

from pyspark.sql import functions as F

from lawmill.operators import title_match as M
from lawmill.sources import scratch

KIND = "k long, law string"


def f1(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    c = len(a & b)
    return 2 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)) if c else 0.0


def made(seed, n, low, high, words=60):
    rng = random.Random(seed)
    return [" ".join(f"w{min(int(rng.paretovariate(0.6)), words)}" for _ in range(rng.randint(low, high))) for _ in range(n)]


def test_best_of_short_and_long_texts(spark):
    titles = made(1, 60, 1, 12)
    laws = [*made(2, 120, 1, 15), *made(3, 30, 50, 200), "", "nothing here"]
    got = {r["k"]: r["best_f1"] for r in M.best_title(spark.createDataFrame(list(enumerate(laws)), KIND), spark.createDataFrame([(t,) for t in titles], "title string"), "k").collect()}
    assert len(got) == len(laws)
    for k, x in enumerate(laws):
        assert abs(got[k] - max(f1(x, t) for t in titles)) < 1e-12 if x else got[k] == 0.0


def test_threshold(spark):
    titles, laws = made(4, 80, 2, 10), made(5, 150, 2, 12)
    rows = spark.createDataFrame(list(enumerate(laws)), KIND)
    every = spark.createDataFrame([(t,) for t in titles], "title string")
    for least in (0.4, 0.7, 1.0):
        for r in M.best_title(rows, every, "k", least=least).collect():
            want = max(f1(laws[r["k"]], t) for t in titles)
            assert abs(r["best_f1"] - want) < 1e-12 if want >= least else r["best_f1"] == 0.0


def test_a_word_that_all_have_makes_no_pairs(spark):
    """Every text and title holds three hot words; only texts that share a rare one, or nothing better, may meet a title."""
    titles = [f"the law of t{i} u{i}" for i in range(200)]
    laws = [f"the law of t{i % 200} x{i}" for i in range(400)]
    rows = scratch.written(spark.createDataFrame(list(enumerate(laws)), "x long, law string").select("x", F.array_distinct(F.split("law", " ")).alias("w")), "hot")
    index = M.TitleIndex(spark.createDataFrame([(t,) for t in titles], "title string"), rows, "title")
    texts = rows.select("x", F.size("w").alias("n"), "w").withColumn("low", F.lit(0.7))
    assert M.candidates(texts, index, M.most() >= F.col("low")).count() == 400
    whole = M.best_title(spark.createDataFrame(list(enumerate(laws)), KIND), spark.createDataFrame([(t,) for t in titles], "title string"), "k")
    assert whole.select(F.min("best_f1"), F.max("best_f1")).first() == (2 * 0.8 * 0.8 / (0.8 + 0.8),) * 2


def test_no_exchange_of_pairs(spark):
    rows = spark.createDataFrame(list(enumerate(made(6, 20, 2, 9))), KIND)
    plan = M.best_title(rows, spark.createDataFrame([("w1 w2",)], "title string"), "k")._jdf.queryExecution().toString()
    assert "hashpartitioning(x" in plan and not any(f"hashpartitioning({a}#" in line and f", {b}#" in line for line in plan.split("\n") for a, b in (("x", "y"), ("y", "x")))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_BROADCAST", 0)
    monkeypatch.setattr(M, "SLOT", 7)
    titles, laws = made(7, 40, 1, 8), made(8, 60, 1, 20)
    got = M.best_title(spark.createDataFrame(list(enumerate(laws)), KIND), spark.createDataFrame([(t,) for t in titles], "title string"), "k").collect()
    assert all(abs(r["best_f1"] - max(f1(laws[r["k"]], t) for t in titles)) < 1e-12 for r in got)


def test_nulls_repeats_and_no_titles(spark):
    rows = spark.createDataFrame([(1, None), (1, "a b"), (None, "a"), (2, "")], KIND)
    none = spark.createDataFrame([(None,), ("",), ("!!",)], "title string")
    assert [r["best_f1"] for r in M.best_title(rows, none, "k").collect()] == [0.0] * 4
    some = spark.createDataFrame([("A b",), ("a B",), (None,)], "title string")
    assert sorted((str(r["k"]), round(r["best_f1"], 3)) for r in M.best_title(rows, some, "k").collect()) == [("1", 0.0), ("1", 1.0), ("2", 0.0), ("None", 0.667)]


def test_few_titles_are_counted_where_the_texts_are(spark, tmp_path):
    """Sets of candidates once moved to be scored: twenty times the texts. Now only the texts are dealt out."""
    titles, laws = made(9, 50, 1, 12), [*made(10, 70, 1, 40), "none of these", ""]
    got = M.best_title(spark.createDataFrame(list(enumerate(laws)), KIND), spark.createDataFrame([(t,) for t in titles], "title string"), "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan and "Join" not in plan
    for r in got.collect():
        assert r["best_f1"] == max(f1(laws[r["k"]], t) for t in titles) if laws[r["k"]] else r["best_f1"] == 0.0


def test_counters_are_bounded(spark, monkeypatch):
    titles, laws = made(11, 30, 1, 12), made(12, 50, 1, 20)
    sets = [sorted(set(t.split())) for t in titles]
    texts = spark.createDataFrame([(k, list(dict.fromkeys(x.split()))) for k, x in enumerate(laws)] + [(99, None)], "k long, w array<string>")
    monkeypatch.setattr(M, "COUNTERS", 1)
    for r in M.counted(texts, sets).collect():
        assert r["f"] == (max(f1(laws[r["k"]], t) for t in titles) if r["k"] < 99 else 0.0)
