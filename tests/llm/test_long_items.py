"""Benchmark items longer than the widest fixed window."""

import numpy as np
import pytest
from conftest_names import BENCH

from lawmill.llm import latent_leaks

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("size", [1100, 2000])
def test_long_item_is_found(spark, tables, size):
    rng = np.random.default_rng(size)
    draw = lambda n: [f"z{min(int(k), 20_000)}" for k in rng.zipf(1.3, size=n)]
    item, other = draw(size), draw(40)
    changed = [w if rng.random() > 0.15 else "changed" for w in item]
    rows = [(0, item), (1, draw(3003) + item + draw(1500)), (2, draw(501) + changed + draw(77)), (3, draw(6000)), (4, item[: size // 3]), (5, draw(90) + other)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], DOCS)
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other))], BENCH)
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in latent_leaks.find_leaks(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 0), (5, 1)}
    assert got[0, 0] == got[1, 0] == 1.0
    kept = latent_leaks.decontamination_stage(spark, docs, tables(benchmark=bench))
    assert {r["doc_id"] for r in kept.collect()} == {3, 4}
