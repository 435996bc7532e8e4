"""Every operator and stage on nulls, empty and very long texts, repeats, empty tables and clashing column names."""

import pytest
from conftest_names import BENCH, LABELS, VECTORS
from pyspark.sql import functions as F

import corpus_pipeline
from lawmill.llm import registry

PER_DOCUMENT = [n for n in registry.QUERIES if not n.startswith(("op3_", "op10_", "op12_"))]


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, None), (6, None, 1), (None, 1, 0), (99, 0, 0)], LABELS)


def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "lorem ipsum"), (3, "one two three four five six seven"), (3, "!!")], BENCH)


@pytest.fixture
def folder(spark, messy, tables):
    return tables(documents=messy, labels=labels(spark), benchmark=bench(spark))


@pytest.fixture
def empty(spark, messy, tables):
    return tables(documents=messy.limit(0), labels=labels(spark).limit(0), benchmark=bench(spark).limit(0), embeddings=spark.createDataFrame([], VECTORS))


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_every_row_comes_back(spark, messy, folder, name):
    got = registry.QUERIES[name](spark, folder).toPandas()
    assert len(got) == messy.count()
    want = sorted(-1 if r[0] is None else r[0] for r in messy.select("doc_id").collect())
    assert sorted(got["doc_id"].fillna(-1).astype(int)) == want


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_benchmark_of_odd_items(spark, folder):
    assert registry.QUERIES["op10_latent_leaks"](spark, folder).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns(spark, messy, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, messy, folder)
    assert out.count() >= 0
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == messy.columns
        assert out.select(F.count("row")).first()[0] == out.count()


def test_stages_on_nothing(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty).count() == 0


def test_vectors_that_cannot_link(spark, tables):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (None, [1.0, 1e-3], 0), (12, [-0.0, 1.0], 0), (13, [0.0, 1.0], 0), (14, [1e30, 1.0], 0)]
    got = registry.QUERIES["op3_embedding_tiles"](spark, tables(embeddings=spark.createDataFrame(rows, VECTORS))).toPandas()
    by = {(-1 if r.vec_id != r.vec_id else int(r.vec_id)): (r.n_links, r.component_id, r.kept) for r in got.itertuples()}
    assert len(got) == len(rows)
    assert all(by[i][0] == 0 and by[i][2] for i in (1, 2, 3, 4, 5, 6, 7, 11))
    assert by[8][:2] == by[9][:2] == by[10][:2] == by[14][:2] == (4, 8) and by[12][:2] == by[13][:2] == (1, 12)
