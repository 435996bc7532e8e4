import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.operators import inference as I
from lawmill.operators import models as M
from lawmill.operators import sections as S
from lawmill.operators import tagging as B
from lawmill.plans.model_queries import copying

CHARS = {c: i + 2 for i, c in enumerate("abcđiều")}


def token_model(feats=16):
    b = M.new_bundle(6, 2 + len(CHARS), feats, 6, 5, 4, 3, 3, 4, seed=3)
    return b, {"words": {"điều": 2, "luật": 3, "Luật": 4, "5": 5}, "chars": CHARS, "tags": B.TAGS, "max_word_len": 6}


def plain_scores(b, config, tokens, feats, lower=True):
    """One step at a time, one gate at a time."""
    rows = []
    for i, t in enumerate(tokens):
        w = config["words"].get(t, config["words"].get(t.lower(), 1) if lower else 1)
        ids = ([config["chars"].get(c, 1) for c in t] + [0] * 6)[:6]
        x = np.vstack([np.zeros((1, 4)), b["char"][ids], np.zeros((1, 4))])
        conv = np.array([[(x[k : k + 3].T * kernel).sum() for kernel in b["conv"]] for k in range(6)]) + b["conv_bias"]
        act = np.tanh if feats is None else lambda v: np.maximum(v, 0)
        parts = [b["word"][w], act(conv).max(0)]
        rows.append(np.concatenate(parts if feats is None else [*parts, np.maximum(b["feat"] @ feats[i] + b["feat_bias"], 0)]))
    sig = lambda v: 1 / (1 + np.exp(-v))
    halves = []
    for w, order in ((b["forward"], range(len(rows))), (b["backward"], reversed(range(len(rows))))):
        h = c = np.zeros(4)
        out = [None] * len(rows)
        for t in order:
            z = w["ih"] @ rows[t] + w["bih"] + w["hh"] @ h + w["bhh"]
            c = sig(z[4:8]) * c + sig(z[:4]) * np.tanh(z[8:12])
            h = sig(z[12:]) * np.tanh(c)
            out[t] = h
        halves.append(out)
    return np.array([b["out"] @ np.concatenate([f, g]) + b["out_bias"] for f, g in zip(*halves, strict=True)])


def test_scores_against_single_steps():
    b, config = token_model()
    rng = np.random.default_rng(0)
    seqs = [["Điều", "5", "LUẬT"], [], ["abc"], ["điều"] * 9]
    feats = [[rng.integers(0, 2, 16).astype(float) for _ in s] for s in seqs]
    for most in (1, 10, 1000):
        taken = [r for p in I.packs(np.array([3, 0, 1, 9]), most) for r in p.tolist()]
        assert sorted(taken) == [0, 2, 3]
    for s, f, e in zip(seqs, feats, I.emissions(b, config, seqs, feats), strict=True):
        assert len(e) == len(s) and (not s or e == pytest.approx(plain_scores(b, config, s, f)))
    plain, conf = M.new_bundle(6, 2 + len(CHARS), 0, 6, 5, 4, 3, 3, 4, seed=4), config
    for s, e in zip(seqs, I.emissions(plain, conf, seqs, None, lower=False), strict=True):
        assert not s or e == pytest.approx(plain_scores(plain, conf, s, None, lower=False))


def test_texts_to_tags(spark):
    model = token_model()
    docs = spark.createDataFrame([(1, "Theo Điều 5 của Luật Đất đai năm 2013"), (2, ""), (3, None), (4, "abc " * 400)], "k int, text string")
    titles = spark.createDataFrame([("Luật Đất đai",)], "title string")
    got = {r["k"]: r for r in I.tag_texts(docs, titles, "k", model).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2]["tags"] == got[3]["tags"] == [] and len(got[4]["tags"]) == 400
    made = {r["k"]: r for r in I.token_samples(docs, titles, "k").collect()}
    e = plain_scores(*model, made[1]["tokens"], np.array([list(x) for x in made[1]["features"]], float))
    raw = [B.TAGS[i] for i in M.Crf(model[0]["start"], model[0]["end"], model[0]["move"]).decode(e)]
    for i in range(len(raw)):
        if raw[i].startswith("I-") and (i == 0 or raw[i - 1][2:] != raw[i][2:]):
            raw[i] = "B-" + raw[i][2:]
    assert got[1]["tags"] == raw
    assert I.tag_texts(docs.limit(0), titles, "k", model).count() == 0


def test_snippets_to_citations(spark):
    model = copying(B.TAGS, {}, {"Luật": "B-LAW", "Đất": "I-LAW", "5": "I-ART", "6": "I-ART"}, [])
    docs = spark.createDataFrame([("a", "các\nđiều  5, 6 xx Luật Đất 5 và 6. Điều 5 không. KHOẢN 2 Luật 6 Đất Luật."), ("b", None), ("c", "Điều năm Luật 5."), ("d", "Điều 7 Luật abc.")], "pdf_path string, ocr_text string")
    got = {r["pdf_path"]: [(c["law_name"], list(c["articles"])) for c in r["citations"]] for r in I.snippet_citations(docs, model).collect()}
    assert got == {"a": [("Luật Đất", ["5", "6"]), ("Luật", ["6"])]}


def test_evaluation(spark):
    b, config = token_model()
    b["move"] = np.random.default_rng(5).normal(size=(6, 6))
    rng = np.random.default_rng(6)
    rows = [(i, ["điều", "5", "abc"][: n], [[float(x) for x in rng.integers(0, 2, 16)] for _ in range(n)], ["B-LAW", "I-LAW", "O"][:n]) for i, n in enumerate([3, 2, 1, 3, 2])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, features array<array<double>>, gold array<string>")
    loss, metrics = I.evaluate(df, "k", (b, config), batch=2, aux=0.15)
    crf, at = M.Crf(b["start"], b["end"], b["move"]), {t: i for i, t in enumerate(B.TAGS)}
    batches = []
    for part in (rows[:2], rows[2:4], rows[4:]):
        path, ce, weight = [], 0.0, 0.0
        for _, tokens, feats, gold in part:
            e, y = plain_scores(b, config, tokens, np.array(feats)), [at[t] for t in gold]
            path.append(crf.loss(e, y))
            for row, t in zip(e, y, strict=True):
                w = 8.0 if t >= 2 else 1.0
                ce, weight = ce - w * np.log(np.exp(row[t]) / np.exp(row).sum()), weight + w
        batches.append(np.mean(path) + 0.15 * ce / weight)
    assert loss.first()["loss"] == pytest.approx(np.mean(batches))
    assert {r["label"] for r in metrics.collect()} >= {"LAW", "micro", "avg"}


@pytest.mark.parametrize("wide", [False, True])
def test_documents_to_sections(spark, wide):
    names = [f"regex_{m}" for m in P.MARKERS]
    model = copying(["<PAD>", "O", *P.MARKERS], {n: m for n, m in zip(names, P.MARKERS, strict=True)}, {}, names, widths=(3, 5))
    text = "NHÂN DANH\na\nNỘI DUNG VỤ ÁN\nb\nNHẬN ĐỊNH CỦA TÒA ÁN\nc\nd\nQUYẾT ĐỊNH:\ne"
    docs = spark.createDataFrame([("x", text), ("empty", " \n"), ("none", None)], "file_name string, text string")
    rows = I.tag_lines(docs, model, wide=wide).cache()
    lines = text.split("\n")
    for r in rows.collect():
        want = next((m for m in P.MARKERS if re.search(P.LEGAL_VI.markers[m].replace("(?iuU)", "(?i)").replace(r"\p{Nd}", r"\d"), r["line"])), "O")
        assert r["line"] == lines[r["line_index"]] and r["tag"] == want
    got = {r["file_name"]: r for r in I.predict_sections(docs, model, wide=wide).collect()}
    assert got["empty"]["warnings"] == got["none"]["warnings"] == ["empty_file"] and got["empty"]["sections"]["preamble"] == ""
    s = got["x"]["sections"]
    assert s["preamble"] == "NHÂN DANH\na" and s["nhan_dinh"] == "NHẬN ĐỊNH CỦA TÒA ÁN\nc\nd" and s["quyet_dinh"] == "QUYẾT ĐỊNH:\ne"
    assert "missing_marker:dai_dien_vks" in got["x"]["warnings"]
    p = I.line_predictions(rows).first()["line_predictions"]
    assert [x["line_index"] for x in p] == list(range(len(lines))) and set(p[0]["scores"]) == set(P.MARKERS) and p[0]["tag"] == "preamble"
    assert S.predict(docs, rows).count() == 3 and rows.agg(F.count("*")).first()[0] == len(lines)


def test_phrases_beside_their_tokens_need_no_join_of_rows(spark):
    """Hits once came back by a join of all tokens on key and place, which shuffled every feature."""
    from lawmill.operators import tagging as B

    rows = spark.createDataFrame([(k, i, t) for k in range(3) for i, t in enumerate("a b c a b a b c d x".split()[k:])], "k long, pos int, token string")
    phrases = spark.createDataFrame([("a b", 2), ("a b c", 3), ("b c", 2), ("x", 1), ("d x y", 3)], "phrase string, n int")
    got = B.with_phrases(rows, phrases, "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(k#" in plan and not any("hashpartitioning(k#" in x and ", pos#" in x for x in plan.split("\n"))
    hits = {(r["k"], r["pos"]): (r["begin"], r["inside"]) for r in B.phrase_hits(rows, phrases, "k").collect()}
    for r in got.collect():
        assert (r["begin"] or 0, r["inside"] or 0) == hits.get((r["k"], r["pos"]), (0, 0))


def test_few_sequences_at_a_time(spark, monkeypatch):
    """Answers leave in small record batches, whatever comes in, and paths found side by side are those found alone."""
    import numpy as np

    from lawmill.operators import inference as I
    from lawmill.operators import models as M

    rng = np.random.default_rng(3)
    chain = M.Crf(rng.normal(size=5), rng.normal(size=5), rng.normal(size=(5, 5)))
    es = [rng.normal(size=(n, 5)) for n in (3, 0, 7, 1, 12, 12, 5, 2)]
    assert I.best_paths(chain, es) == [chain.decode(e) for e in es]
    b = M.new_bundle(4, 2, 0, 3, 4, 2, 2, 1, 4)
    config = {"words": {"a": 2, "b": 3}, "chars": {}, "tags": ["<PAD>", "O", "B-X"], "max_word_len": 4}
    rows = spark.createDataFrame([(i, ["a", "b", "z"][: i % 4]) for i in range(600)] + [(600, None)], "k long, tokens array<string>").coalesce(1)
    whole = I.tag_sequences(rows, "k", (b, config), feats=None, probs=False)
    assert whole.columns == ["k", "tokens", "tags"]
    assert sorted((r["k"], len(r["tokens"]), len(r["tags"])) for r in whole.collect()) == [(i, *[min(i % 4, 3)] * 2) for i in range(600)] + [(600, 0, 0)]
