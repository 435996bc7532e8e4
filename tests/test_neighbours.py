"""Lines with their neighbours beside them: the same as windows, and without a shuffle."""

import time

from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators import sections as S

TEXTS = [(1, "Licensed under x\n\nALL RIGHTS reserved\nThis work is licensed under é"), (2, ""), (3, None), (4, "one line"), (5, "a\nb"), (6, "\n".join(f"released under {i % 3} Quyết định" * (i % 5 + 1) for i in range(40)))]


def docs(spark):
    return spark.createDataFrame(TEXTS, "file_name long, text string")


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_wide_features_need_no_shuffle(spark):
    beside = S.wide_features(S.line_rows(docs(spark), around=1), pack=P.LICENSE_EN).drop("previous_1", "next_1")
    by_window = S.wide_features(S.line_rows(docs(spark)), pack=P.LICENSE_EN)
    assert exchanges(beside) == 0 and exchanges(by_window) > 0
    assert rows(beside) == rows(by_window)


def test_context_needs_no_shuffle(spark):
    beside, by_window = S.with_context(S.line_rows(docs(spark), around=2)), S.with_context(S.line_rows(docs(spark)))
    assert exchanges(beside) == 0 and rows(beside) == rows(by_window)


def test_composed_texts_are_told_fast(spark):
    """A text of ASCII costs about as much as a plain search through it; it once cost thirty times that."""
    long = spark.range(8).select(F.repeat(F.concat(F.lit("some plain words "), F.col("id").cast("string")), 100_000).alias("x")).cache()
    long.count()

    def seconds(c):
        spent = []
        for _ in range(3):
            begun = time.perf_counter()
            long.select(F.count(c)).collect()
            spent.append(time.perf_counter() - begun)
        return min(spent)

    assert seconds(T._odd(F.col("x"))) < 8 * (seconds(F.regexp_replace("x", r"[\x00-\x7F]+", "")) + 0.05)
    assert long.where(T._odd(F.col("x")).isNotNull()).count() == 0
    long.unpersist()
