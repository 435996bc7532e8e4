"""Array Viterbi against all paths and against the numpy decoder."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from lawmill.operators import models as M
from lawmill.operators import viterbi as V


def decoded(spark, seqs, start, end, move):
    rows = spark.createDataFrame([(i, [[float(x) for x in r] for r in s] if s is not None else None) for i, s in enumerate(seqs)], "i int, e array<array<double>>")
    return {r["i"]: r["p"] for r in rows.select("i", V.path(F.col("e"), start, end, move).alias("p")).collect()}


def test_against_all_paths_and_the_decoder(spark):
    rng = np.random.default_rng(0)
    start, end, move = rng.normal(size=3), rng.normal(size=3), rng.normal(size=(3, 3))
    seqs = [rng.normal(size=(n, 3)) for n in (1, 2, 5, 6)]
    got = decoded(spark, seqs, list(start), list(end), move.tolist())
    crf = M.Crf(start, end, move, pad=None)
    for i, e in enumerate(seqs):
        paths = list(itertools.product(range(3), repeat=len(e)))
        assert got[i] == list(paths[int(np.argmax([crf.path_score(e, list(p)) for p in paths]))]) == list(crf.decode(e))


def test_ends_of_runs_and_long_sequences(spark):
    rng = np.random.default_rng(1)
    start, end, move = rng.normal(size=4), rng.normal(size=4), rng.normal(size=(4, 4))
    seqs = [rng.normal(size=(n, 4)) for n in (V.RUN, V.RUN + 1, V.RUN + 2, 2 * V.RUN + 1, 20_000)]
    got, crf = decoded(spark, seqs, list(start), list(end), move.tolist()), M.Crf(start, end, move, pad=None)
    for i, e in enumerate(seqs):
        assert got[i] == list(crf.decode(e))


def test_empty_null_and_ties(spark):
    got = decoded(spark, [[], None, [[0, 0], [0, 0], [0, 0]]], [0, 0], [0, 0], [[0, 0], [0, 0]])
    assert got == {0: [], 1: None, 2: [0, 0, 0]}
