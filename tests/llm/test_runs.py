"""The log-structured index: buckets read where they lie, anchors of many documents, compaction inside the query."""

import collections
import random

import pytest

from lawmill.llm import substring_runs


def test_old_runs_are_not_shuffled(spark, tmp_path):
    index = substring_runs.Index(spark, str(tmp_path / "plan"))
    run = index.append(spark.range(500).selectExpr("id % 90 as anchor", "id as unit", "id as doc"))
    wanted = spark.range(40).selectExpr("id as anchor")
    plan = index.under(run, index.hot[0], wanted)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :].split("\n:- ")[-1]
    left = plan[plan.index("SortMergeJoin") : plan.index("Exchange")]
    assert "Bucketed: true" in left and "NestedLoop" not in side
    assert index.under(run, index.hot[0], wanted).count() == sum(1 for i in range(500) if i % 90 < 40)


def test_compaction_is_not_shuffled(spark, tmp_path):
    """Rows of the runs go bucket by bucket: neither their counting nor their union has an exchange."""
    index = substring_runs.Index(spark, str(tmp_path / "merge"), most_runs=1)
    for k in range(2):
        index.append(spark.range(300).selectExpr("id % 70 as anchor", f"id + {1000 * k} as unit", "id as doc"))
    rows = substring_runs.union_all(index.runs)
    plans = [rows.groupBy("anchor", "salt").count()._jdf.queryExecution().executedPlan().toString(), rows._jdf.queryExecution().executedPlan().toString()]
    assert all("Exchange" not in p for p in plans)
    index.compact()
    assert len(index.runs) == 1 and index.runs[0].count() == 600
    assert {r["unit"] for r in index.under(index.runs[0], index.hot[0], spark.sql("select 5L as anchor")).collect()} == {u + 1000 * k for u in range(5, 300, 70) for k in range(2)}


def test_anchors_that_fill_up_are_salted_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_runs, "_HOT", 10)
    index, want = substring_runs.Index(spark, str(tmp_path / "full"), most_runs=1), {}
    for k in range(6):
        rows = [(a, 1000 * k + 100 * a + i, i) for a, n in ((1, 8), (2, 3), (3, 35)) for i in range(n)]
        for a, u, d in rows:
            want.setdefault(a, set()).add((u, d))
        index.append(spark.createDataFrame(rows, "anchor long, unit long, doc long"))
        index.compact()
    assert len(index.runs) == 1
    salts = {(r["anchor"], r["salt"]): r["count"] for r in index.runs[0].groupBy("anchor", "salt").count().collect()}
    assert len([a for a, _ in salts if a == 1]) > 1 and len([a for a, _ in salts if a == 3]) > 9 and max(salts.values()) <= 30
    assert index.hot[0].groupBy("anchor").count().where("count > 1").count() == 0
    for a, rows in want.items():
        got = index.under(index.runs[0], index.hot[0], spark.sql(f"select {a}L as anchor")).collect()
        assert sorted((r["unit"], r["doc"]) for r in got) == sorted(rows)


@pytest.mark.parametrize("hot", [1 << 16, 7])
def test_batches_and_compaction(spark, monkeypatch, hot):
    """Five batches with compaction on the way give what a plain scan gives, whether or not anchors are salted."""
    monkeypatch.setattr(substring_runs, "_HOT", hot)
    merged = []
    compact = substring_runs.Index.compact
    monkeypatch.setattr(substring_runs.Index, "compact", lambda self: (merged.append(len(self.runs)), compact(self)))
    rng = random.Random(hot)
    passages = [[f"p{k}-{i}" for i in range(60)] for k in range(3)]
    texts = {}
    for i in range(60):
        words = [f"{i}-{rng.randrange(10**6)}" for _ in range(rng.choice([5, 40, 70]))]
        if rng.random() < 0.6:
            cut = rng.randrange(len(words))
            words[cut:cut] = passages[rng.randrange(3)][rng.randrange(8) :]
        texts[i] = words
    starts = collections.defaultdict(lambda: 10**9)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            starts[tuple(w[k : k + 50])] = min(i, starts[tuple(w[k : k + 50])])
    want = {i: len({j for k in range(len(w) - 49) if starts[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}) for i, w in texts.items()}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_runs.dedup(docs, batches=5).collect()}
    assert got == want and sum(want.values()) > 500
    assert max(merged) > substring_runs.MOST_RUNS
