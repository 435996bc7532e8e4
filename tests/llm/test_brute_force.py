"""The operators against plain versions on a small corpus."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from conftest_names import BENCH, LABELS, VECTORS

from lawmill.llm import embedding_tiles, language_mixture, latent_leaks, license_join, mixing, quality, registry, simhash, substring_runs, suffix_tree, token_bins
from lawmill.llm.common import components


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_token_bins(spark, texts, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    index = token_bins.write_token_bins(docs, f"{tmp_path}/bins", path)
    got, start, all_ids = by_id(token_bins.digest(index)), 0, {}
    for i, text, *_ in texts:
        ids = all_ids[i] = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    mixed = token_bins.read_shuffled(spark, f"{tmp_path}/bins", 1).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in mixed} == all_ids
    assert [r["doc_id"] for r in mixed] != sorted(all_ids)


def test_damaged_records_are_seen():
    data = bytearray(token_bins.frame(token_bins.pack(1, np.array([1, 70000], np.uint32))) + b"\n")
    assert [list(token_bins.unpack(p)[1]) for _, _, p in token_bins.unframe(bytes(data))] == [[1, 70000]]
    for at in (0, 9, 14, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_bins.unframe(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_bins.unframe(bytes(data[:-2])))


def test_suffix_tree_base_and_model(spark, texts, docs, tables):
    got = by_id(registry.QUERIES["op2_suffix_tree"](spark, tables(documents=docs)))
    counts, split = collections.Counter(), {}
    for i, text, *_ in texts:
        split[i] = [*text.encode().lower().split(), None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(split[i])
    n, v = sum(counts.values()), len(counts)
    for i, symbols in split.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(symbols), sum(counts[w] > 0 for w in symbols), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in symbols))
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_suffix_tree_states_sum_to_one(spark, docs):
    tree, counts = suffix_tree.fit(docs.selectExpr("cast(text as binary) raw"), min_count=4)
    assert tree.stays1.any() and tree.stays2.any()
    n = {r["k"]: r["n"] for r in counts.collect()}
    rare = [c for k, c in n.items() if k not in set(tree.known.tolist())]
    states = [[int(np.flatnonzero(tree.stays1)[0])], [int(np.flatnonzero(~tree.stays1)[0])]]
    p = int(np.flatnonzero(tree.stays2)[0])
    states.append([int(tree.pairs[p] >> suffix_tree._SHIFT), int(tree.pairs[p] & suffix_tree._MASK)])
    for history in states:
        total = 0.0
        for w in range(len(tree.known)):
            s = np.array([*history, w], np.int64)
            total += math.exp(tree.score(s, np.array([len(s) - 1]))[0][-1])
        s = np.array([*history, -7], np.int64)  # a symbol never seen stands for all rare ones but for its count
        unseen = math.exp(tree.score(s, np.array([len(s) - 1]))[0][-1])
        total += unseen * (1 + sum(c + 1 for c in rare))
        assert total == pytest.approx(1, abs=1e-9)


def test_embedding_tiles(spark, tables):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([centers[rng.integers(12, size=200)] + rng.normal(0, 0.08, (200, 16)), rng.normal(size=(60, 16))]).astype(np.float32)
    x[20:60] = x[3]
    label = rng.integers(2, size=len(x))
    frame = spark.createDataFrame([(i, [float(v) for v in row], int(k)) for i, (row, k) in enumerate(zip(x, label, strict=True))], VECTORS)
    got = {r["vec_id"]: r for r in embedding_tiles.link_vectors(frame, tile=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = groups(len(x), zip(*np.nonzero(near), strict=True))
    assert near.sum() > 500
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), root[i], root[i] == i) for i in range(len(x)))


def test_substring_runs(spark, texts, docs):
    got = by_id(substring_runs.dedup(docs, batches=3))
    first, removed = {}, 0
    split = {i: text.encode().split() for i, text, *_ in texts}
    for i, w in split.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        removed += sum(gone)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert removed > 500


def test_runs_compact(spark, tmp_path):
    index = substring_runs.Index(spark, str(tmp_path / "runs"), most_runs=1)
    for k in range(3):
        index.append(spark.createDataFrame([(k, k, k), (5, k, k)], "anchor long, unit long, doc long"))
        index.compact()
    assert len(index.runs) == 1 and index.runs[0].count() == 6


def test_language_mixture(spark):
    a, b = "der die und nicht eine ist das wir", "the and not with this that have from"
    rows = [(i, " ".join((a if i % 2 else b).split()[k % 8] for k in range(i, i + 12)), "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, None, "de"), (101, "12 !?", "en"), (102, (a + " ") * 3 + b + " with this", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mixture.fit(frame)
    from pyspark.sql import functions as F

    got = by_id(language_mixture.identify(frame.withColumn("held_out", F.lit(False)), model))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:60])
    assert (got[100]["lang_pred"], got[101]["lang_pred"]) == ("und", "und")
    assert got[102]["lang_pred"] == "de" and [x["lang"] for x in got[102]["languages"]] == ["de", "en"] and 0.5 < got[102]["score"] < 0.95


def test_quality(spark, texts, docs, tables):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        base = [f"w{k}" for k in rng.integers(60, size=40)]
        rows.append((i, " ".join([base[0]] * 30 + base[:5] if bad else base)))
        marks.append((i, int(not bad), 0))
    folder = tables(documents=spark.createDataFrame(rows, "doc_id long, text string"), labels=spark.createDataFrame(marks, LABELS))
    got = by_id(registry.QUERIES["op6_quality_ftrl"](spark, folder))
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0] == held
    assert np.mean([got[i]["predicted"] == marks[i][1] for i in held]) > 0.97


def test_ftrl_is_sparse():
    model = quality.Ftrl(8)
    for _ in range(50):
        model.learn(np.array([1]), np.array([1.0]), 1)
        model.learn(np.array([2]), np.array([1.0]), 0)
    w = model.weights()
    assert w[1] > 0 > w[2] and not w[[0, 3, 4]].any()


def test_simhash(spark, texts, docs):
    got = by_id(simhash.group_documents(docs.select("doc_id", "text")))
    fps = []
    for _, text, *_ in texts:
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = groups(len(fps), pairs)
    assert len(pairs) > 10 and all((got[i]["fp"] % 2**64, got[i]["component_id"]) == (fps[i], root[i]) for i in range(len(fps)))


def test_links_of_random_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a = np.unique(np.concatenate([a, a ^ np.uint64(5), a ^ np.uint64(1 << 40)]))
    steps = {tuple(s) for s in simhash._near(4).tolist()}
    tiles = simhash.tile_of(a)
    for i in range(0, len(a), 7):
        for j in range(len(a)):
            if (int(a[i]) ^ int(a[j])).bit_count() <= 4:
                d = tuple((tiles[j] - tiles[i]).tolist())
                assert d in steps or tuple(-x for x in d) in steps


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 103), (103, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_mixing(spark, docs):
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    rows = mixing.mix_sources(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again
    taken, aim = collections.Counter(), {}
    for r in rows:
        aim[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["size"] == len(docs.where(f"doc_id = {r['doc_id']}").first()["text"].split()) if r["doc_id"] < 5 else True
        taken[source[r["doc_id"]]] += r["taken"]
    sizes = collections.Counter()
    for r in rows:
        sizes[source[r["doc_id"]]] += r["size"]
    assert [aim[s] for s in sizes] == pytest.approx(mixing.targets(list(sizes.items())))
    assert all(abs(aim[s] - n) <= 2 for s, n in taken.items())


def test_targets():
    got = mixing.targets([("b", 100), (None, 10), ("a", 1000), ("c", 400)])
    assert sum(got) == pytest.approx(1.5 * 1510) and got[0] == 200 and got[1] <= 20
    assert mixing.targets([("a", 0)]) == [0]


def test_targets_of_a_table(spark):
    sizes = [(f"s{i}", 1 + (i * 7919) % 1000) for i in range(40)] + [(None, 10_000), ("é", 0), ("z", 30_000)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long").repartition(5), 1.5).collect()}
    assert [got[s] for s, _ in sizes] == mixing.targets(sizes)


@pytest.mark.parametrize("n", [30, 3000])
def test_every_length_gives_its_share(n):
    lengths = np.arange(1, n)
    counts = np.random.default_rng(n).integers(1, 9, n - 1)
    size = int((lengths * counts).sum())
    for part in (0.1, 0.45, 0.9):
        whole, take = mixing.quotas(part * size, lengths, counts)
        assert whole == 0 and abs((take * lengths).sum() - part * size) <= 1
        assert (np.abs(take - part * counts) <= 6).all()
        assert (take <= counts).all() and (take >= 0).all()


@pytest.mark.parametrize("budget", [0, 1, 7, 23, 50])
def test_fill_is_best(budget):
    lengths, counts = [3, 5, 8], [2, 3, 2]
    reach = {3 * a + 5 * b + 8 * c for a in range(3) for b in range(4) for c in range(3)}
    take = mixing.fill(budget, lengths, counts)
    assert all(t <= c for t, c in zip(take, counts, strict=True))
    assert sum(t * n for t, n in zip(take, lengths, strict=True)) == max(x for x in reach if x <= budget)


def test_license_join(spark):
    texts = ["Released under the MIT License.", "cc by cc by", "All rights reserved\nall RIGHTS reserved", "Licensed under CC BY-NC 4.0.", "x licensed under the Apache License version two", "", None, "a general public license"]
    got = by_id(license_join.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    pick = lambda i: tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert pick(0) == (5, 0, None, None, "", "mit")
    assert pick(1) == (4, 2, 0, 2, "cc-by", "cc-by")
    assert pick(2) == (6, 2, 0, 3, "reserved", "reserved")
    assert pick(3) == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc")
    assert pick(4) == (8, 0, None, None, "", "")
    assert pick(5) == pick(6) == (0, 0, None, None, "", "")
    assert pick(7) == (4, 1, 1, 1, "gpl", "gpl")


def test_latent_leaks(spark):
    rng = np.random.default_rng(5)
    word = lambda k: f"q{k}"
    items = [[word(k) for k in rng.integers(3000, size=int(rng.integers(15, 55)))] for _ in range(30)]
    rows, want = [], set()
    for d in range(120):
        body = [word(k) for k in rng.integers(3000, size=int(rng.integers(20, 400)))]
        if d % 4 == 0:
            item, at = items[d % 30], int(rng.integers(len(body)))
            kept = [w if rng.random() > 0.15 else "changed" for w in item] if d % 8 == 0 else item
            body = body[:at] + [w.upper() for w in kept] + body[at:]
            want.add((d, d % 30))
        rows.append((d, " ".join(body)))
    got = latent_leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], BENCH))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    halves = latent_leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], BENCH), block=16)
    assert {(r["doc_id"], r["item_id"]) for r in halves.collect()} == want


def test_common_subsequence():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ([f"{k}" for k in rng.integers(6, size=int(rng.integers(1, 14)))] for _ in range(2))
        bits = {}
        for i, w in enumerate(a):
            bits[w] = bits.get(w, 0) | 1 << i
        assert latent_leaks.common(bits, len(a), b).bit_count() == plain(a, b)


@pytest.mark.parametrize("large", [20, 1 << 17])
def test_full_tiles_are_cut(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "_LARGE", large)
    rng = random.Random(large)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(12)} | {0, 1, (1 << 64) - 1})
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = groups(len(fps), linked)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r["fp"]: r["root"] for r in simhash.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert len({(got.get(x, x), w) for x, w in zip(signed, want, strict=True)}) == len(set(want)) == len({got.get(x, x) for x in signed})
