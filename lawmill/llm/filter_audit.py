"""Filter interaction audit: what each of five filters removes, in every order, for every part of a corpus.

Each document's failures are five flags; documents are counted once for each combination of flags and part, by partial sums
before anything moves. A CUBE over the flags and the part of that small table holds the survivors of every subset of filters:
the grouping set of the subset's flags and the part, in the row where these flags are all false. A step of an order is the pair
of the subsets before and after it, so all figures come from joins of such pairs.

Failures: A under 100 words, B fewer than 80 distinct in 100 words, C over 10 of `[A-Z]` in 100 code points, D any of `[#$%&*|]`,
E the text of a smaller doc_id, table-wide.

Defined results: null texts are empty ones; part is lang, null as the empty string; null ids are never copies and never have
copies; of rows that share an id and a text none is the other's copy; a document counts as good (toxic) if any label row of its
id says 1; very long texts cost their length, in the JVM; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm.common import materialize, table

FILTERS = "ABCDE"
COUNTS = ["n", "good", "toxic"]
_GAP = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """A to D of a text that is not null."""
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    n = F.col("__words")
    return {
        "__list": words, "__words": F.size(F.col("__list")),
        "A": n < 100, "B": 100 * F.size(F.array_distinct("__list")) < 80 * n,
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, good, toxic) of each document, from docs(doc_id, text, lang) and labels(doc_id, quality, toxic).

    A text is its SHA-256 from here on. The smallest id of each text comes back by a join on text and id together, so a text
    with any number of copies is no hot key.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    found = failures(F.col("text"))
    for name in ("__list", "__words"):
        rows = rows.withColumn(name, found.pop(name))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = materialize(rows.select("doc_id", "part", digest.alias("digest"), *(c.alias(k) for k, c in found.items())), "audit-flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int").alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    both = rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    one = lambda c: F.coalesce(c, F.lit(0))
    return both.select("part", *FILTERS[:4], copy.alias("E"), one("quality").alias("good"), one("toxic").alias("toxic"))


def survivors(flags: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): what passes every filter of a subset (bit i: FILTERS[i]), zeros included."""
    total = flags.groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    total = materialize(total, "audit-combinations")
    cube = total.cube(*FILTERS, "part").agg(*(F.sum(c).alias(c) for c in COUNTS), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"not_{f}") for f in FILTERS))
    clean = F.lit(True)
    subset = F.lit(0)
    for i, f in enumerate(FILTERS):
        clean &= (F.col(f"not_{f}") == 1) | ~F.col(f)
        subset += F.when(F.col(f"not_{f}") == 0, 1 << i).otherwise(0)
    passed = cube.where((F.col("all_parts") == 0) & clean).select("part", subset.alias("subset"), *COUNTS)
    every = total.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))).alias("subset"))
    return every.join(passed, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, filter, before, after) of all orders: 600 rows whatever the corpus."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        done = 0
        for k, i in enumerate(order, 1):
            rows.append(("".join(FILTERS[j] for j in order), k, 1 << i, done, done | 1 << i))
            done |= 1 << i
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    subsets = materialize(survivors(flagged(docs, labels)), "audit-subsets")
    side = lambda name: subsets.select("part", F.col("subset").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in COUNTS))
    pairs = side("before").join(F.broadcast(steps(docs.sparkSession)), "before").join(side("after"), ["part", "after"])
    lost = lambda c: F.col(f"before_{c}") - F.col(f"after_{c}")
    removed = pairs.withColumns({"removed": lost("n"), "good_lost": lost("good"), "toxic_lost": lost("toxic")})
    # alone: before is empty; failing no other: after is everything
    full = 2 ** len(FILTERS) - 1
    totals = removed.groupBy("part", "filter").agg(
        F.sum("removed").alias("shapley"), F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("after") == full, F.col("removed"))).alias("unique_fails"),
    )
    out = removed.join(totals, ["part", "filter"])
    return out.select(
        "part", "filter_order", "step", F.col("after_n").alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
