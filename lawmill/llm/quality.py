"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

A text is its words (split at ASCII white space, A-Z lowered); features are hashed words, pairs of words and pairs of
word shapes, where a word equal to the one before it is the same mark whichever word it is, so that junk made of words
never seen in training is still recognised. Feature values are shares of the text's tokens, so long and short texts compare, and a score is a sparse dot product with one dense weight vector of fixed size, the only
thing that is broadcast.

The trainer is sequential; it reads a seeded sample of about `sample` labelled rows (each row is in it by the hash of
its id alone) and runs in one task whose input is bounded by that, and takes texts one by one as features.

Null and empty texts have a score, that of no words. Rows that repeat a doc_id each come back; a doc_id with two labels
trains with both, the 0 first. Equal texts have equal scores. Without labels every score is 0.5; an empty table gives no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm.common import HashedWords, fold_mod, free_name, mix, table

BITS = 20
SAMPLE = 8192
EPOCHS = 4
#: FTRL-proximal (McMahan et al. 2013): learning rate, its offset, L1, L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
THRESHOLD = 0.3
_SCALE = 16.0
_SAME = np.uint64(0xA5A5A5A55A5A5A5A)
_EDGE = np.uint64(0x3C3C3C3CC3C3C3C3)


class Shapes(dict):
    """bytes -> (hash of the lowered word, hash of its shape)."""

    def __init__(self, most: int = 300_000):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.digest, self.most = xxh64_intdigest, most
        self.forms = HashedWords(seed=7, most=50_000)

    def __missing__(self, word: bytes) -> tuple[int, int]:
        core = word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        text = core.decode("utf-8", "replace")
        case = b"U" if text.isupper() and len(text) > 1 else b"T" if text[:1].isupper() else b"l" if text.isalpha() else b"d" if text else b"-"
        tail = word[word.rfind(core) + len(core) :][-2:] if core else word[:2]
        size = b"0123456789"[min(len(text) // 3, 5) :][:1]
        value = self.digest(word.lower(), 6), self.forms[case + size + b" " + tail]
        if len(self) < self.most:
            self[word] = value
        return value


_SHAPES: list[Shapes] = []


def features(raw: bytes | None) -> np.ndarray:
    """Hashed positions, one for each n-gram in the text, repeats included."""
    if not _SHAPES or len(_SHAPES[0]) >= _SHAPES[0].most:
        _SHAPES[:] = [Shapes()]
    got = _SHAPES[0]
    words = raw.split() if raw else []
    if not words:
        return np.zeros(1, np.int64)
    both = np.array(list(map(got.__getitem__, words)), np.uint64)
    word, shape = both[:, 0], both[:, 1]
    before = np.concatenate([[_EDGE], word[:-1]])
    same = before == word
    pair = np.where(same, _SAME, mix(before, word))
    one = np.where(same, _SAME, word)
    shapes = mix(np.concatenate([[_EDGE], shape[:-1]]), shape)
    return (np.concatenate([one, pair, shape, shapes]) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression over hashed positions."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def vector(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    f = features(raw)
    at, n = np.unique(f, return_counts=True)
    return at, n * (_SCALE / len(f))


def train(group: pa.Table) -> pa.Table:
    """Weights from rows (all, h, label, raw) in the order of h, EPOCHS times."""
    group = group.sort_by([("h", "ascending"), ("label", "ascending")])
    rows = [vector(x) for x in group.column("raw").to_pylist()]
    labels = group.column("label").to_pylist()
    model, bias = Ftrl(), np.zeros(1, np.int64)
    for _ in range(EPOCHS):
        for (at, value), label in zip(rows, labels, strict=True):
            model.learn(np.append(at, bias) if at[0] else at, np.append(value, 1.0) if at[0] else value, label)
    return pa.table({"weights": pa.array([model.weights().astype("<f4").tobytes()], pa.binary())})


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 6) -> np.ndarray:
    """Weights from labelled(doc_id, text, label in 0, 1). No row gives zero weights."""
    h = F.xxhash64("doc_id", F.lit(seed))
    n = labelled.count()
    part = labelled.where(F.pmod(h, F.lit(1 << 30)) < F.lit(min(1 << 30, (sample << 30) // max(n, 1))))
    rows = part.select(F.lit(0).alias("all"), h.alias("h"), F.col("label").cast("int"), F.col("text").cast("binary").alias("raw"))
    got = rows.groupBy("all").applyInArrow(train, "weights binary").first()
    return np.frombuffer(got[0], "<f4").copy() if got else np.zeros(1 << BITS, np.float32)


def score_texts(weights, name: str):
    def run(batches: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            out = []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                f = features(raw)
                x = float(w[f].sum(dtype=np.float64)) * _SCALE / len(f) + (float(w[0]) if raw and f.any() else 0.0)
                out.append(1 / (1 + np.exp(-np.clip(x, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*batch.schema.names[:-1], name])

    return run


def classify(docs: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of docs and the score under `name`; null and empty texts have a score too, that of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(*keep, F.col("text").cast("string").cast("binary").alias(free_name("raw", [*keep, name])))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(score_texts(shared, name), f"{kinds}, `{name}` double")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(fold_mod(doc_id, 5) == 0, F.lit(False))


def fit_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> np.ndarray:
    """Learn from labels.quality of the documents that aren't held out; rows without label or id are left out."""
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").where(~held_out())
    rows = docs.select("doc_id", F.col("text").cast("string")).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    return fit(rows)


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs.withColumn("held_out", held_out()), fit_on_labels(spark, docs, sf_dir), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the threshold, all columns kept."""
    names, score = docs.columns, free_name("score", docs.columns)
    scored = classify(docs, fit_on_labels(spark, docs, sf_dir), names, score)
    return scored.where(F.col(score) >= THRESHOLD).select(*names)
