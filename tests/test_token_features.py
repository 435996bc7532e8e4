"""Features and tags beside their text are those of a row a token, without windows, joins or gathered rows."""

import numpy as np
from pyspark.sql import functions as F

from lawmill.functions import text as T
from lawmill.operators import inference as I
from lawmill.operators import models as M
from lawmill.operators import tagging as B
from lawmill.operators import token_features as K
from tests.test_model_path import token_model

ODD = [
    "Theo điểm a, b khoản 2 Điều 5, 6 và Điều 7 của Luật Đất đai năm 2013; căn cứ BLHS 2015.", "", None, " ", "điều5 ĐIỀU 7a ĐÊ9 năm nămx x_năm", "luật đất đai luật đất",
    "a￿điều 5 luật x￿ y", "İstanbul ΣΑΣ ß ½điều5 é 𝒳𝟙 😀 ́ á", "Luật Đất đai", "của", "các điều 1. 2019 1899 (12345) 12đ “Luật” — …", "đất đai Luật",
    "các các điều 1, điều 2; thuộc luật đất đai Điều 3 " * 40, "áp dụng Án lệ số 5/2017 ; theo nghị định 12/2020/NĐ-CP. x" * 3,
]


def test_features_beside_the_text_are_those_of_rows(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (98, "".join(chr(c) + " " for c in range(0xA1, 0x250)))], "k int, text string")
    titles = spark.createDataFrame([("Luật Đất đai",), ("Luật Đất",), ("Điều 5 luật x",)], "title string")
    made = {r["k"]: r for r in I.token_samples(docs, titles, "k").collect()}
    assert set(made) == {*range(len(ODD)), 98} and made[1]["tokens"] == made[2]["features"] == []
    norm = docs.select("k", T.normalize_legal(T.safe_text(F.col("text")), "tagger").alias("text"))
    want: dict = {k: [] for k in made}
    for r in sorted(B.features(norm, B.gazetteer(titles), "k").collect(), key=lambda r: r["pos"]):
        want[r["k"]].append((r["token"], *(r[f] for f in B.FEATURES)))
    for k, r in made.items():
        assert [(t, *f) for t, f in zip(r["tokens"], r["features"], strict=True)] == want[k]
    assert sum(f[12] for f in made[5]["features"]) == 2


def test_keys_of_tokens(spark):
    tokens = ["Điều5", "ĐIỀU5", "đê5", "xđiều5", "năm", "NĂM", "năm5", "İ", "ΑΣ", "½", "/", "-", "“", "_", "A1", "Đ", "Å", "ǆ", "é", "", *map(chr, range(0x100, 0x180))]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", T.normalize_key(F.col("t"), False).alias("k"))
    assert [(r["t"], K.token_key(r["t"])) for r in rows.collect()] == [(r["t"], r["k"]) for r in rows.collect()]


def test_a_large_gazetteer_takes_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ODD[0]), (2, None)], "k int, text string")
    titles = spark.createDataFrame([("Luật Đất đai",)], "title string")
    small = sorted(map(tuple, I.token_samples(docs, titles, "k").collect()))
    tags = sorted(map(tuple, I.tag_texts(docs, titles, "k", token_model()).collect()))
    monkeypatch.setattr(B, "MOST_PHRASES", 3)
    assert sorted(map(tuple, I.token_samples(docs, titles, "k").collect())) == small
    assert sorted(map(tuple, I.tag_texts(docs, titles, "k", token_model()).collect())) == tags


def test_tagging_moves_texts_once(spark):
    """A row a token once went through windows, a join and a gathering."""
    docs = spark.createDataFrame([(1, "a")], "k int, text string")
    plan = I.tag_texts(docs, spark.createDataFrame([("Luật Đất đai",)], "title string"), "k", token_model())._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1


def test_mended_tags_are_repaired_ones(spark):
    tags = [*B.TAGS, "I-Z"]
    mended, known = I._mending(tags)
    rng = np.random.default_rng(2)
    seqs = [rng.integers(1, len(tags), n).tolist() for n in (0, 9, 1, 0, 30, 2, 0)]
    flat, starts = np.concatenate([[], *seqs]).astype(int), np.cumsum([0, *map(len, seqs)])[:-1]
    got = [known[k] for k in mended(flat, starts)]
    rows = spark.createDataFrame([(i, [tags[t] for t in s]) for i, s in enumerate(seqs)], "k int, tags array<string>").select("k", I.repaired(F.col("tags")).alias("tags"))
    assert got == [t for r in sorted(rows.collect()) for t in r["tags"]]


def test_losses_side_by_side():
    rng = np.random.default_rng(4)
    chain = M.Crf(rng.normal(size=5), rng.normal(size=5), rng.normal(size=(5, 5)))
    es = [rng.normal(size=(n, 5)) for n in (3, 0, 7, 1, 12, 12)]
    gold = [rng.integers(1, 5, len(e)).tolist() for e in es]
    got = I.sequence_losses(chain, es, gold, 0.15)
    assert np.allclose([x[0] for x in got], [chain.loss(e, g) if len(e) else 0 for e, g in zip(es, gold, strict=True)])
    assert got[1] == (0.0, 0.0, 0.0) and got[0][2] == sum(8.0 if t >= 2 else 1.0 for t in gold[0])


def test_slices_follow_rows_and_tokens(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(K, "ROWS", 3)
    monkeypatch.setattr(K, "TOKENS", 5)
    n = [0, 9, 2, 2, 2, 0, 0, 0, 0, 5, 1, 6]
    batch = pa.RecordBatch.from_arrays([pa.array([["x"] * k for k in n], pa.list_(pa.string()))], ["t"])
    got = [x.column("t").value_lengths().to_pylist() for x in K.slices([batch, batch.slice(0, 0)], "t")]
    assert sum(got, []) == n and all(len(x) == 1 or (sum(x) <= 5 and len(x) <= 3) for x in got)


def test_evaluation_runs_the_model_once(spark, monkeypatch):
    runs = []
    real = I.tagging
    monkeypatch.setattr(I, "tagging", lambda *a, **k: runs.append(1) or real(*a, **k))
    b, config = token_model()
    df = spark.createDataFrame([(1, ["điều", "5"], [[0.0] * 16] * 2, ["B-LAW", "I-LAW"]), (2, [], [], []), (3, None, None, None)], "k int, tokens array<string>, features array<array<double>>, gold array<string>")
    loss, metrics = I.evaluate(df, "k", (b, config))
    assert len(runs) == 1 and loss.first()["loss"] is not None and "Window" not in metrics._jdf.queryExecution().executedPlan().toString()
    assert {r["label"]: r["tp"] + r["fn"] for r in metrics.collect()}["LAW"] == 1


def test_own_tags_as_the_truth(spark):
    """Samples, gold tags and the evaluation are one pass over the texts: nothing is gathered or joined between them."""
    docs, titles = spark.createDataFrame([*enumerate(ODD)], "k int, text string"), spark.createDataFrame([("Luật Đất đai",)], "title string")
    rows, told = I.told_samples(docs, titles, "k", token_model())
    made = I.token_samples(docs, titles, "k")
    want = {r["k"]: r["tags"] for r in I.tag_sequences(made, "k", token_model(), probs=False).collect()}
    got = rows.mapInArrow(lambda b: (x.select(["k", "gold"]) for x in told(b)), "k int, gold array<string>")
    assert {r["k"]: r["gold"] for r in got.collect()} == want
    _, metrics = I.evaluate(rows, "k", token_model(), before=told)
    assert all(r["fp"] == r["fn"] == 0 for r in metrics.collect())
