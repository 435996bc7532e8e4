"""The distributed CRF trainer against finite differences, all paths, and held-out tags."""

import itertools

import numpy as np
import pytest

from lawmill.operators import crf_training as R
from lawmill.operators import inference as I
from lawmill.operators import models as M

TAGS = ["<PAD>", "O", "A", "B"]


def random_weights(rng, features=3):
    w = R.Weights.zero(features, len(TAGS))
    return w.like(rng.normal(0, 0.7, len(w.flat())))


def sequences(rng, count, most=6):
    return [(rng.normal(0, 1, (n, 3)), rng.integers(1, 4, n)) for n in rng.integers(1, most, count)]


def frame(spark, data):
    rows = [(k, [list(map(float, r)) for r in x], [TAGS[t] for t in y]) for k, (x, y) in enumerate(data)]
    return spark.createDataFrame(rows, "id long, features array<array<double>>, gold array<string>")


def padded(data):
    n = np.array([len(y) for _, y in data])
    x, y = np.zeros((len(data), n.max(), 3)), np.zeros((len(data), n.max()), np.int64)
    for k, (a, b) in enumerate(data):
        x[k, : n[k]], y[k, : n[k]] = a, b
    return n, x, y


def plain_loss(w, data):
    """One sequence at a time, by the single steps."""
    each = [I.sequence_loss(w.chain(), x @ w.score + w.bias, y.tolist(), I.AUX) for x, y in data]
    return np.mean([p for p, _, _ in each]) + I.AUX * sum(c for _, c, _ in each) / sum(t for _, _, t in each)


def test_totals_over_tasks_equal_finite_differences(spark):
    rng = np.random.default_rng(3)
    data, w = sequences(rng, 12), random_weights(rng)
    made = R.encoded(frame(spark, data).repartition(5), "id", TAGS).selectExpr("*", "false AS held")
    loss, g = R.loss_and_gradient(R.totals(made, w), w)
    assert loss == pytest.approx(plain_loss(w, data))
    flat, fixed = w.flat(), w.like(np.arange(len(w.flat())))
    never = {int(i) for i in [fixed.start[0], fixed.end[0], *fixed.move[0], *fixed.move[:, 0]]}  # padding's own scores are set
    for i in set(range(len(flat))) - never:
        d = np.zeros(len(flat))
        d[i] = 1e-5
        assert g[i] == pytest.approx((plain_loss(w.like(flat + d), data) - plain_loss(w.like(flat - d), data)) / 2e-5, abs=1e-6)


def test_sums_and_best_equal_all_paths():
    rng = np.random.default_rng(4)
    data, w = sequences(rng, 9, 5), random_weights(rng)
    n, x, _ = padded(data)
    e, chain = x @ w.score + w.bias, w.chain()
    z, p, _ = R.sums(chain, e, n)
    found = R.best(chain, e, n)
    for k, length in enumerate(n):
        paths = list(itertools.product(range(1, 4), repeat=int(length)))
        score = np.array([chain.path_score(e[k, :length], list(q)) for q in paths])
        assert z[k] == pytest.approx(np.log(np.exp(score).sum()))
        assert tuple(found[k, :length]) == paths[int(score.argmax())]
        share = np.exp(score - z[k])
        assert p[k, 0, 2] == pytest.approx(sum(s for s, q in zip(share, paths, strict=True) if q[0] == 2))
        assert not p[k, length:].any()


def learnable(rng, count):
    """A tag that only the order tells: features say marker or not, A and B take turns."""
    data = []
    for _ in range(count):
        y, turn = [], 2
        for _ in range(int(rng.integers(1, 9))):
            if rng.random() < 0.6:
                y.append(turn)
                turn = 5 - turn
            else:
                y.append(1)
        y = np.array(y)
        data.append((np.stack([np.ones(len(y)), (y > 1) + rng.normal(0, 0.05, len(y)), rng.normal(0, 1, len(y))], 1), y))
    return data


@pytest.mark.parametrize("batches,select", [(1, "micro"), (2, "avg")])
def test_training(spark, batches, select):
    data = learnable(np.random.default_rng(6), 120)
    made = frame(spark, data).repartition(3)
    seen = []
    w, history = R.train(made, "id", TAGS, 3, epochs=14, batches=batches, rate=0.3, select=select, note=seen.append)
    assert seen == history and len(history) <= 15
    assert history[-1]["loss"] < 0.7 * history[0]["loss"] and max(h["f1"] for h in history) > history[0]["f1"]
    found = {r["id"]: r["tags"] for r in R.label(made, "id", w, TAGS).collect()}
    held = {r["id"] for r in made.where(R.held_out("id", 5)).collect()}
    right = [a == TAGS[b] for k in held for a, b in zip(found[k], data[k][1], strict=True)]
    assert np.mean(right) > 0.8


def test_edges(spark):
    none = spark.createDataFrame([], "id long, features array<array<double>>, gold array<string>")
    w, history = R.train(none, "id", TAGS, 2, epochs=1)
    assert not w.flat().any() and [h["loss"] for h in history] == [0, 0] and R.label(none, "id", w, TAGS).count() == 0
    rows = [(1, [], []), (2, None, None), (None, [[1.0, None]], ["A"]), (3, [[0.0, 1.0]], ["O"]), (3, [[0.0, 1.0]], ["O"])]
    odd = spark.createDataFrame(rows, none.schema)
    w, history = R.train(odd, "id", TAGS, 2, epochs=3, fold=0)
    assert history[-1]["loss"] < history[0]["loss"]
    assert sorted(len(r["tags"]) for r in R.label(odd, "id", w, TAGS).collect()) == [0, 0, 1, 1, 1]
    for tag in ("C", None):
        with pytest.raises(Exception, match="unknown tag"):
            R.encoded(spark.createDataFrame([(1, [[1.0]], [tag])], none.schema), "id", TAGS).collect()
    with pytest.raises(Exception, match="differ in number"):
        R.encoded(spark.createDataFrame([(1, [[1.0]], ["O", "O"])], none.schema), "id", TAGS).collect()


def test_registered_training(spark):
    import __spark_entry__ as e

    rows = e.queries()["crf_training"](spark, "/root/testdata/sf0.001").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 10 and sum(r["n_right"] for r in held) > 0.97 * sum(r["n_lines"] for r in held)
    assert M.parameters(R.Weights.zero(2, 3).__dict__) == 6 + 9 + 9


def test_long_sequences_are_as_exact_as_short_ones():
    """At zero weights every tag but padding is equally likely; sums over the whole sequence once drifted with its length."""
    import numpy as np

    from lawmill.operators import crf_training as R

    n = np.array([30_000, 10_000, 1])
    z, p, moves = R.sums(R.Weights.zero(1, 7).chain(), np.zeros((3, 30_000, 7)), n)
    assert np.abs(z / (n * np.log(6)) - 1).max() < 1e-11
    assert all(np.abs(p[k, : n[k], 1:] - 1 / 6).max() < 1e-14 and not p[k, n[k] :].any() for k in range(3))
    assert not p[:, :, 0].any() and np.abs(moves[1:, 1:] - (n - 1).sum() / 36).max() < 1e-8


def test_long_held_out_sequences_beside_short_ones(spark):
    """A pack whose longest sequences are all held out once stopped the training; what is learnt must not depend on them."""
    rng = np.random.default_rng(8)
    data = [(rng.normal(0, 1, (n, 3)), rng.integers(1, 4, n)) for n in (9, 7, 3, 2, 2)]
    made = R.encoded(frame(spark, data).coalesce(1), "id", TAGS).selectExpr("*", "id < 2 AS held")
    w = random_weights(rng)
    total = R.totals(made, w)
    assert total[: -3 * len(TAGS)] == pytest.approx(R.gradient(w, *padded(data[2:])))
    assert total[-3 * len(TAGS) :] == pytest.approx(R.counts(w, *padded(data[:2])))


def test_samples_need_no_shuffle(spark):
    from pyspark.sql import functions as F

    from lawmill.operators import sections as S
    from lawmill.plans import training_queries as Q

    docs = spark.createDataFrame([(1, "Licensed under x\n\nplain\nALL RIGHTS reserved"), (2, None), (3, " \n"), (4, "one")], "doc_id long, text string")
    made = Q.samples(docs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Filter" not in plan
    rows = S.features(S.line_rows(docs, "doc_id"), Q.P.LICENSE_EN).withColumn("gold", Q._marker(F.col("line"))).orderBy("doc_id", "line_index").collect()
    got = {r["doc_id"]: (r["features"], r["gold"]) for r in made.collect()}
    assert got.pop(2) == got.pop(3) == ([], []) and got == {k: ([[r[c] for c in Q._NAMES] for r in rows if r["doc_id"] == k], [r["gold"] for r in rows if r["doc_id"] == k]) for k in (1, 4)}
