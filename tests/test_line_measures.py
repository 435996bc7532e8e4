"""Counts of a line from one pass, and the faster patterns of lines, against the plain patterns; lines are made once."""

import random

from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators import sections as S

SIGNS = "aZéĐđ09٣²Ⅳ_ǅʰªßΩж中😀𝒜́-.,;#%$ \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  ​   　﻿"


def texts(spark, count=3000):
    rng = random.Random(5)
    made = ["".join(rng.choice(SIGNS if rng.random() < 0.5 else "ab \n") for _ in range(rng.randrange(30))) for _ in range(count)]
    return spark.createDataFrame([(i, x) for i, x in enumerate([None, "", " ", *made])], "doc_id long, text string")


def differing(df, a, b):
    return df.where(~a.eqNullSafe(b)).collect()


def test_measures_equal_patterns(spark):
    x = F.col("text")
    plain = {
        "letters": T.letter_count(x), "capitals": T.upper_count(x), "digits": F.length(F.regexp_replace(x, r"[^\p{Nd}]+", "")),
        "marks": F.length(F.regexp_replace(x, r"(?U)[\p{L}\p{N}\s]+", "")), "tokens": F.size(T.tokens(x)),
    }
    made = texts(spark).withColumn("m", T.measures(x))
    for k, c in plain.items():
        assert differing(made, F.col("m")[k], F.when(x.isNotNull(), c)) == []
    assert made.where("text IS NOT NULL AND m.tokens > 3").count() > 1000


def test_lines_equal_plain_patterns(spark):
    x, docs = F.col("text"), texts(spark)
    assert differing(docs, T.collapse(x), F.trim(F.regexp_replace(x, P.SPACE, " "))) == []
    raw = F.split(F.coalesce(x, F.lit("")), P.LINE_END)
    plain = F.filter(F.transform(raw, lambda y: F.trim(F.regexp_replace(F.replace(y, F.lit("﻿"), F.lit(" ")), P.SPACE, " "))), lambda y: y != "")
    assert differing(docs, T.lines(x, False), plain) == []
    assert differing(docs, T._odd(x).isNotNull(), F.coalesce(x.rlike(f"[^{T.COMPOSED}]"), F.lit(False))) == []


def test_lines_are_made_once(spark):
    """A filter on the number of lines was once put below them, which made all lines twice; and no row carries its document's whole array."""
    docs = texts(spark, 9)
    for made in (S.line_rows(docs, "doc_id"), S.line_rows(docs, "doc_id", around=2), S.features(S.line_rows(docs, "doc_id"), P.LICENSE_EN)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        after = [x.split("], false")[0].rsplit("[", 1)[1] for x in plan.splitlines() if "Generate posexplode" in x]
        assert "Filter" not in plan and len(after) == 1 and "n_lines#" in after[0] and "line#" not in after[0]
