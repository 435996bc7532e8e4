"""Every language that has training rows is learned."""

import random
import string

from pyspark.sql import functions as F

from lawmill.llm import language_mixture


def test_more_than_200_languages(spark):
    rng = random.Random(6)
    words = [["".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(12)] for _ in range(230)]
    rows = [(4 * k + n, " ".join(words[k]), f"l{k:03}") for k in range(230) for n in range(1 + (k < 200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mixture.fit(frame)
    assert model[0] == [f"l{k:03}" for k in range(230)]
    got = language_mixture.identify(frame.withColumn("held_out", F.lit(False)), model).collect()
    want = {i: lang for i, _, lang in rows}
    assert {r["doc_id"]: r["lang_pred"] for r in got} == want
