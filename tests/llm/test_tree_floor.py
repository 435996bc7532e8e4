"""What the suffix tree learns must not depend on what is broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawmill.llm import suffix_tree


@pytest.mark.parametrize("most", [0, 8, 60, 300])
def test_contexts_beyond_the_broadcast_are_learned(spark, docs, most):
    held_out = F.col("doc_id") % 7 == 2
    get = lambda **more: {r["doc_id"]: r for r in suffix_tree.score_documents(docs, held_out, min_count=4, **more).collect()}
    want, got = get(), get(most=most)
    assert set(got) == set(want)
    for i, r in want.items():
        assert got[i]["n_known"] == r["n_known"]
        assert got[i]["base_score"] == pytest.approx(r["base_score"], abs=1e-8)
        assert got[i]["score"] == pytest.approx(r["score"], abs=1e-8)
    assert sum(r["score"] for r in want.values()) > sum(r["base_score"] for r in want.values())


def test_finder_finds_all_and_nothing_else():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 4096):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        x = np.concatenate([keys, keys + 1, rng.integers(-(1 << 62), 1 << 62, 50)])
        where = rng.random(len(x)) < 0.9
        place = {int(k): i for i, k in enumerate(keys)}
        assert suffix_tree.Finder(keys)(x, where).tolist() == [place.get(int(v), -1) if w else -1 for v, w in zip(x, where, strict=True)]
