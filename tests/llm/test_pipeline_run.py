"""The whole pipeline on small tables: rows of the last stage agree with what the stages before it keep."""

import corpus_pipeline
from lawmill.llm.common import materialize


def test_run(spark, docs, tables):
    marked = spark.range(0, 160, 2).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS INT) AS quality", "0 AS toxic")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    folder = tables(documents=docs.selectExpr("*", "length(text) AS n_chars"), labels=marked, benchmark=bench)
    got = corpus_pipeline.run(spark, folder).collect()
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, folder), name)
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in kept.collect())
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
