"""Entities and their metrics from arrays against the forms over rows, and plans that must not shuffle tokens."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lawmill.operators import tagging as B

_KINDS = ["O", "B-LAW", "I-LAW", "B-ART", "I-ART", "X", None]


def _made(spark, seed):
    """Documents of random tags, an empty one and one without tags."""
    r = random.Random(seed)
    rows = [(k, [f"w{r.randrange(9)}" for _ in range(n)], [r.choice(_KINDS) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 40, 400])]
    return spark.createDataFrame([*rows, (9, ["a", "b"], ["O", "X"])], "k long, tokens array<string>, tags array<string>")



def test_entities_are_the_spans_of_rows(spark):
    docs = _made(spark, 1)
    named = docs.select("k", F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("tags").alias("tag"))).alias("pos", "z")).select("k", "pos", "z.token", "z.tag")
    want = sorted(map(tuple, B.spans(named, "k").select("k", "label", "first", "last", "text").collect()))
    got = docs.select("k", F.explode(B.entities(F.col("tags"), F.col("tokens"))).alias("e")).select("k", "e.*")
    assert got.columns == ["k", "label", "first", "last", "text"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_metrics_beside_are_those_of_rows(spark):
    both = _made(spark, 2).select("k", "tokens", F.col("tags").alias("a")).join(_made(spark, 3).select("k", F.col("tags").alias("b")), "k")
    made = both.select("k", F.col("a").alias("gold"), F.transform("b", lambda t, i: F.when(i % 3 == 0, t).otherwise(F.get("a", i))).alias("found"))
    side = lambda c: made.select("k", F.explode(B.entities(F.col(c))).alias("e")).select("k", "e.*")
    want = B.metrics(side("gold"), side("found"), ["k", "first", "last"])
    told = lambda df: sorted(map(tuple, df.collect()))
    got = B.metrics_beside(made, "gold", "found")
    assert got.columns == want.columns and told(got) == told(want)
    assert {r["label"] for r in got.collect()} == {"LAW", "ART", "micro", "avg"} and all(r["tp"] for r in got.collect() if r["label"] != "avg")
    assert told(B.metrics_beside(made.limit(0), "gold", "found")) == told(B.metrics(side("gold").limit(0), side("found").limit(0), ["k", "first", "last"]))


def test_entities_of_documents_are_not_shuffled(spark):
    plan = entry.queries()["bio_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1
