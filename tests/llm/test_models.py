"""Learned operators against plain versions: expectation-maximisation, FTRL, the suffix tree's scores, latent recall."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lawmill.llm import language_mixture, latent_leaks, quality, suffix_tree


def plain_em(p, n, steps=5000):
    share = [1 / len(p[0])] * len(p[0])
    for _ in range(steps):
        new = [0.0] * len(share)
        for row, c in zip(p, n, strict=True):
            z = sum(s * x for s, x in zip(share, row, strict=True))
            for k, x in enumerate(row):
                new[k] += c * share[k] * x / z
        share = [x / sum(n) for x in new]
    return share, sum(c * math.log(sum(s * x for s, x in zip(share, row, strict=True))) for row, c in zip(p, n, strict=True))


def test_mixture_is_the_penalised_maximum():
    rng = np.random.default_rng(3)
    for mix in ([1, 0, 0], [0.7, 0.3, 0], [0.5, 0.2, 0.3], [0.97, 0.03, 0]):
        langs = rng.choice(3, 300, p=mix)
        ll = rng.normal(-6, 1, (300, 3))
        ll[np.arange(300), langs] += 5
        n = rng.integers(1, 4, 300).astype(float)
        got = language_mixture.mixture(ll.astype(np.float32), n)
        use = np.flatnonzero(got)
        p = np.exp(ll - ll.max(1, keepdims=True))
        share, value = plain_em(p[:, use].tolist(), n.tolist(), 400)
        assert got[use] == pytest.approx(share, abs=2e-3) and got.sum() == pytest.approx(1)
        assert {*use.tolist()} == {k for k in range(3) if mix[k]}
        for k in set(range(3)) - {*use.tolist()}:  # no wider set pays for itself
            assert plain_em(p[:, [*use, k]].tolist(), n.tolist(), 400)[1] - value <= 0.5 * math.log(n.sum()) + 2.0


def test_training_is_plain_ftrl():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{'good' if i % 2 else 'bad'}{k}" for k in rng.integers(9, size=12)).encode() for i in range(40)] + [b"", None]
    labels = [i % 2 for i in range(42)]
    order = [int(x) for x in rng.permutation(42)]
    group = pa.table({"all": pa.array([0] * 42), "h": pa.array(order, pa.int64()), "label": pa.array(labels, pa.int32()), "raw": pa.array(texts, pa.binary())})
    got = np.frombuffer(quality.train(group).column("weights")[0].as_py(), "<f4")

    def weight(z, n):
        return 0.0 if abs(z) <= quality.L1 else (math.copysign(quality.L1, z) - z) / ((quality.BETA + math.sqrt(n)) / quality.ALPHA + quality.L2)

    z, n = collections.defaultdict(float), collections.defaultdict(float)
    for _ in range(quality.EPOCHS):
        for i in sorted(range(42), key=lambda i: order[i]):
            f = quality.features(texts[i])
            x = collections.Counter(f.tolist())
            value = {k: c * quality._SCALE / len(f) for k, c in x.items()}
            if 0 not in value:
                value[0] = 1.0
            w = {k: weight(z[k], n[k]) for k in value}
            g = 1 / (1 + math.exp(-sum(w[k] * v for k, v in value.items()))) - labels[i]
            for k, v in value.items():
                sigma = (math.sqrt(n[k] + (g * v) ** 2) - math.sqrt(n[k])) / quality.ALPHA
                z[k] += g * v - sigma * w[k]
                n[k] += (g * v) ** 2
    want = np.zeros(1 << quality.BITS)
    for k in z:
        want[k] = weight(z[k], n[k])
    np.testing.assert_allclose(got, want, atol=1e-5)


def plain_scores(texts, train, least, prior):
    """Scores of the suffix tree of depth two, written with dictionaries."""
    split = {i: [*(t or "").lower().split(), "$"] for i, t in texts.items()}
    n1 = collections.Counter(w for i in train for w in split[i])
    total, space = sum(n1.values()), math.log(sum(n1.values()) + len(n1) + 1)
    often = {w for w, n in n1.items() if n >= least}
    root = {w: math.log(n1[w] + 1) - space for w in often}
    # as each text begins after an end, so does its first pair; triples lie inside a text
    n2 = collections.Counter(p for i in train for p in zip(["$", *split[i]], split[i], strict=False) if p[0] in often and p[1] in often)
    n2 = {p: n for p, n in n2.items() if n >= least}
    seen = collections.Counter()
    for i in train:
        s = ["$", *split[i]]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            if (a, b) in n2 and (b, c) in n2:
                seen[(a, b), c] += 1
    n3 = {k: n for k, n in seen.items() if n >= least}

    def follow(counts, n_context, below):
        by = collections.defaultdict(dict)
        for (context, last), n in counts.items():
            by[context][last] = n
        back, p, stays = {}, {}, set()
        for context, rows in by.items():
            listed = sum(rows.values())
            t = float(max(n_context[context], listed))
            rest = t - listed
            under = {w: below(context, w) for w in rows}
            gain = sum(n * (math.log(n) - under[w]) for w, n in rows.items()) - listed * math.log(t)
            if rest > 0:
                gain += rest * (math.log(rest / t) - math.log(min(max(1 - sum(map(math.exp, under.values())), 1e-12), 1.0)))
            back[context] = math.log((rest + prior) / (t + prior))
            if gain > 0.5 * (len(rows) + 1) * math.log(t + 1):
                stays.add(context)
            for w, n in rows.items():
                p[context, w] = math.log(n / (t + prior) + math.exp(back[context] + under[w]))
        return back, p, stays

    back1, p2, stay1 = follow(n2, n1, lambda a, w: root[w])
    back2, p3, stay2 = follow(n3, n2, lambda ab, w: p2[ab[1], w])
    stay1 |= {ab[1] for ab in stay2}
    out = {}
    for i, s in split.items():
        score, history = 0.0, ["$", *s]
        for k, w in enumerate(s):
            a, ab = history[k], (history[k - 1], history[k]) if k else None
            value = root.get(w, math.log(n1.get(w, 0) + 1) - space)
            if a in stay1 and a in back1:
                value = p2[a, w] if (a, w) in p2 else back1[a] + value
            if ab in stay2:
                value = p3[ab, w] if (ab, w) in p3 else back2[ab] + value
            score += value
        out[i] = score / math.log(10)
    return out


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_suffix_tree_scores(spark, texts, docs, most):
    want = plain_scores({i: t for i, t, *_ in texts}, [i for i, *_ in texts if i % 7 != 2], 4, suffix_tree.PRIOR)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(docs, F.col("doc_id") % 7 == 2, min_count=4, most=most).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_latent_recall(spark):
    """Items of which a third of the words is changed, dropped or added: what whole comparison finds, retrieval finds to nine tenths."""
    rng = np.random.default_rng(8)
    word = lambda k: f"q{k}"
    items = [[word(int(2000 * x**3)) for x in rng.random(int(rng.integers(20, 60)))] for _ in range(25)]
    rows = []
    for d in range(100):
        body = [word(int(2000 * x**3)) for x in rng.random(int(rng.integers(30, 200)))]
        copy = []
        for w in items[d % 25]:
            u, rate = rng.random(), (0.1, 0.2, 0.3, 0.4)[d % 4]
            if u >= rate:
                copy.append(w)
            elif u < 0.6 * rate:
                copy.append(word(int(2000 * rng.random() ** 3)))
        at = int(rng.integers(len(body)))
        rows.append((d, " ".join([*body[:at], *copy, *body[at:]])))
    bench = [(i, " ".join(x)) for i, x in enumerate(items)]
    starts = [latent_leaks.answer_start(t) for _, t in bench]
    every = set()
    for d, text in rows:
        words = text.split()
        for i, x in enumerate(items):
            bits, n = latent_leaks.bits_of(x), len(x)
            for s in range(0, max(1, len(words) - n + 1), 4):
                hit = latent_leaks.common(bits, n, words[s : s + n + n // 4])
                if hit.bit_count() >= latent_leaks.LCS * n and (hit >> starts[i]).bit_count() >= latent_leaks.ANSWER * (n - starts[i]):
                    every.add((d, i))
                    break
    got = latent_leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block=10).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(every) > 70
    assert len(found & every) / len(every) >= 0.9
    # a cosine does not depend on the blocks
    one = latent_leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["cosine"], 4) for r in one} == {(r["doc_id"], r["item_id"]): round(r["cosine"], 4) for r in got}
