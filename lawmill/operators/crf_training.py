"""[MDL-7, MDL-8] Training a feature-based CRF where the samples lie.

Each step is one Spark job: tasks run forward and backward sums over their own sequences, padded by length in numpy, and
send one row of sums each (losses, gradients, counts of right and wrong tags); Spark adds these up place by place, so what reaches the
driver is as long as the weights, whatever the number of samples or tasks. The driver only takes the step (AdamW with a
clipped gradient) and sends the weights back as a broadcast. Samples are written once, in a folder a batch, so a step
reads its own batch; the batches are the same in every epoch. Held-out samples are judged in the first job of an epoch,
by the weights that the epoch begins with; the best of those weights are returned.

Sums of doubles are added in the order in which tasks end, so two runs may differ in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.operators import inference as I
from lawmill.operators import models as M
from lawmill.sources.scratch import folder

#: Sums before the gradients: sequences, path loss, cross-entropy and its weight; then right, wrong and missed of each tag.
_HEAD = 4


@dataclass
class Weights:
    """Scores of (feature, tag), of a tag, of the first and the last tag, and of a move from tag to tag; tag 0 is padding."""

    score: np.ndarray
    bias: np.ndarray
    start: np.ndarray
    end: np.ndarray
    move: np.ndarray

    @classmethod
    def zero(cls, features: int, tags: int) -> Weights:
        return cls(np.zeros((features, tags)), np.zeros(tags), np.zeros(tags), np.zeros(tags), np.zeros((tags, tags)))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.score, self.bias, self.start, self.end, self.move)])

    def like(self, flat: np.ndarray) -> Weights:
        """Weights of this shape with the given values."""
        parts = np.split(flat, np.cumsum([x.size for x in (self.score, self.bias, self.start, self.end)]))
        return Weights(parts[0].reshape(self.score.shape), *parts[1:4], parts[4].reshape(self.move.shape))

    def chain(self) -> M.Crf:
        return M.Crf(self.start, self.end, self.move)


def sums(chain: M.Crf, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log partition of each sequence, tag probabilities, summed move probabilities) of padded scores e [sequence, place, tag].

    Sums are brought back to 1 at every place, so a long sequence is as exact as a short one.
    """
    rows, longest, _ = e.shape
    a, b = np.zeros_like(e), np.broadcast_to(chain.end, e.shape).copy()
    z = np.zeros(rows)
    for i in range(longest):
        now = chain.start + e[:, 0] if i == 0 else M.logsumexp(a[:, i - 1, :, None] + chain.move, 1) + e[:, i]
        size = M.logsumexp(now, 1)
        a[:, i] = now - size[:, None]
        z += np.where(i < n, size, 0.0)
    for i in range(longest - 2, -1, -1):
        inside = i + 1 < n
        back = M.logsumexp(chain.move + (e[inside, i + 1] + b[inside, i + 1])[:, None, :], 2)
        b[inside, i] = back - back.max(1, keepdims=True)
    z += M.logsumexp(a[np.arange(rows), n - 1] + chain.end, 1)
    moves = np.zeros_like(chain.move)
    for i in range(longest - 1):
        inside = i + 1 < n
        pair = a[inside, i, :, None] + chain.move + (e[inside, i + 1] + b[inside, i + 1])[:, None, :]
        moves += M.softmax(pair.reshape(len(pair), moves.size)).sum(0).reshape(moves.shape)
    return z, M.softmax(a + b) * (np.arange(longest) < n[:, None])[..., None], moves


def best(chain: M.Crf, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Best tags [sequence, place] of padded scores; places behind a sequence hold its last tag."""
    rows, longest, tags = e.shape
    score, back = chain.start + e[:, 0], np.tile(np.arange(tags, dtype=np.int16), (longest, rows, 1))
    order = np.argsort(-n, kind="stable")
    score, steps = score[order], np.ascontiguousarray(np.swapaxes(e[order], 0, 1))
    # longest first, so those that go on are the first ones
    for i, k in enumerate(np.searchsorted(-n[order], -np.arange(1, longest)).tolist(), 1):
        every = score[:k, :, None] + chain.move
        back[i, :k] = every.argmax(1)
        np.add(every.max(1), steps[i, :k], score[:k])
    path, every = np.zeros((longest, rows), np.int64), np.arange(rows)
    path[-1] = (score + chain.end).argmax(1)
    for i in range(longest - 1, 0, -1):
        path[i - 1] = back[i, every, path[i]]
    out = np.empty((rows, longest), np.int64)
    out[order] = path.T
    return out


def padded(batch: pa.RecordBatch, width: int, gold: bool = True) -> Iterator[tuple]:
    """(rows, lengths, features, gold or None) of batches padded by length; empty sequences are left out."""
    seqs = batch.column("features")
    n = seqs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = seqs.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    y = batch.column("gold").flatten().to_numpy(zero_copy_only=False) if gold else None
    at = np.cumsum(n) - n
    for rows in I.packs(n):
        longest = int(n[rows[0]])
        fx, fy = np.zeros((len(rows), longest, width)), np.zeros((len(rows), longest), np.int64)
        for k, r in enumerate(rows):
            fx[k, : n[r]] = x[at[r] : at[r] + n[r]]
            if gold:
                fy[k, : n[r]] = y[at[r] : at[r] + n[r]]
        yield rows, n[rows], fx, fy if gold else None


def gradient(w: Weights, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of padded samples: sequences, path loss, cross-entropy, its weight, gradient of the path loss, of the cross-entropy."""
    tags, chain = len(w.bias), w.chain()
    real = np.arange(x.shape[1]) < n[:, None]
    e = x @ w.score + w.bias
    z, p, moves = sums(chain, e, n)
    one = np.eye(tags)[y] * real[..., None]
    weight = np.where(y >= 2, I.MARKER_WEIGHT, 1.0) * (y != 0) * real
    q = M.softmax(e)
    ce = -(np.log(np.take_along_axis(q, y[..., None], 2)[..., 0] + 1e-300) * weight).sum()
    rows = np.arange(len(n))
    first, last = y[:, 0], y[rows, n - 1]
    steps = real[:, 1:]
    path = (e * one).sum() + chain.start[first].sum() + chain.end[last].sum() + chain.move[y[:, :-1][steps], y[:, 1:][steps]].sum()
    np.subtract.at(moves, (y[:, :-1][steps], y[:, 1:][steps]), 1)
    by_path, by_ce = p - one, (q - one) * weight[..., None]
    flat = lambda g, s, t, m: Weights(np.einsum("bif,bit->ft", x, g), g.sum((0, 1)), s, t, m).flat()
    none = np.zeros(tags)
    g1 = flat(by_path, by_path[:, 0].sum(0), by_path[rows, n - 1].sum(0), moves)
    g2 = flat(by_ce, none, none, np.zeros((tags, tags)))
    return np.concatenate([[len(n), z.sum() - path, ce, weight.sum()], g1, g2])


def counts(w: Weights, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Right, wrong and missed places of each tag."""
    found, real, tags = best(w.chain(), x @ w.score + w.bias, n), np.arange(x.shape[1]) < n[:, None], len(w.bias)
    a, b = found[real], y[real]
    right = np.bincount(b[a == b], minlength=tags)
    return np.concatenate([right, np.bincount(a, minlength=tags) - right, np.bincount(b, minlength=tags) - right]).astype(float)


def picked(mine: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen sequences of a pack, padded to the longest of them only."""
    n = n[mine]
    return n, x[mine, : n.max()], y[mine, : n.max()]


def totals(samples: DataFrame, w: Weights) -> np.ndarray:
    """gradient() of the rows of samples(features, gold, held) that are not held, then counts() of those that are."""
    shared, width = samples.sparkSession.sparkContext.broadcast(w), w.score.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        size, tags = len(now.flat()), len(now.bias)
        learnt, judged = np.zeros(_HEAD + 2 * size), np.zeros(3 * tags)
        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False)
            for rows, n, x, y in padded(batch, width):
                mine = held[rows]
                if not mine.all():
                    learnt += gradient(now, *picked(~mine, n, x, y))
                if mine.any():
                    judged += counts(now, *picked(mine, n, x, y))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([learnt, judged])], pa.list_(pa.float64()))], ["v"])

    added = samples.select("features", "gold", "held").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    got, out = added.toArrow(), np.zeros(_HEAD + 2 * len(w.flat()) + 3 * len(w.bias))
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    shared.unpersist()
    return out


def loss_and_gradient(total: np.ndarray, w: Weights, aux: float = I.AUX) -> tuple[float, np.ndarray]:
    """[MDL-7] Mean path loss and aux of the weighted cross-entropy, with their gradient; no sequences give 0."""
    size = len(w.flat())
    n, path, ce, weight = total[:_HEAD]
    g1, g2 = total[_HEAD : _HEAD + size], total[_HEAD + size : _HEAD + 2 * size]
    n, weight = max(n, 1.0), weight or 1.0
    return float(path / n + aux * ce / weight), g1 / n + aux * g2 / weight


def f1(total: np.ndarray, tags: int, select: str = "micro") -> float:
    """Of all places whose tag is neither padding nor the second, which stands for none; "avg" is the mean over tags that occur."""
    right, wrong, missed = (x[2:] for x in np.split(total[-3 * tags :], 3))
    if select == "avg":
        some = right + wrong + missed > 0
        return float((2 * right[some] / (2 * right + wrong + missed)[some]).mean()) if some.any() else 0.0
    return float(2 * right.sum() / max(1.0, (2 * right + wrong + missed).sum()))


def encoded(samples: DataFrame, key: str, tags: list[str], gold: str = "gold") -> DataFrame:
    """(key, features, gold as numbers) of samples with as many features as tags; an unknown tag raises an error, empty and null sequences go, a null feature is 0."""
    known = F.array(*map(F.lit, tags))
    number = lambda t: F.coalesce(F.nullif(F.array_position(known, t), F.lit(0)), F.raise_error(F.lit("unknown tag")).cast("long")) - 1
    whole = F.when(F.size("features") == F.size(gold), F.transform(gold, number)).otherwise(F.raise_error(F.lit("features and tags differ in number")).cast("array<long>"))
    return samples.where((F.size("features") > 0) & F.col(gold).isNotNull()).select(key, numbers(F.col("features")).alias("features"), whole.alias("gold"))


def numbers(features: Column) -> Column:
    return F.transform(features, lambda row: F.transform(row, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))))


def held_out(key: str, fold: int):
    """Every fold-th sample by crc32 of its key as text; none if fold is 0. Null keys are learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % fold == 0, F.lit(False)) if fold else F.lit(False)


def train(
    samples: DataFrame, key: str, tags: list[str], features: int, epochs: int = 40, batches: int = 1, fold: int = 5, rate: float = 0.1, decay: float = 0.01, clip: float = 5.0,
    aux: float = I.AUX, select: str = "micro", halve: int = 3, patience: int = 8, note: Callable[[dict], None] | None = None,
) -> tuple[Weights, list[dict]]:
    """[MDL-8] (best weights, one entry an epoch) from samples(key, features array<array<number>>, gold array<string>).

    tags begin with the padding tag and the one that stands for none. The rate halves when held-out F1 has not risen for
    more than `halve` epochs, and training ends after `patience` such epochs. Without held-out samples (fold=0) the loss
    takes the place of F1. Entries: epoch, rate, loss (of the first batch) and f1, all of the weights that the epoch begins with.
    """
    spark, path = samples.sparkSession, folder(samples.sparkSession, "crf-samples")
    made = encoded(samples, key, tags).withColumn("held", held_out(key, fold))
    made = made.withColumn("batch", F.when(F.col("held"), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(batches))).cast("int"))
    made.select("features", "gold", "held", "batch").write.partitionBy("batch").parquet(path)
    kept = spark.read.schema("features array<array<double>>, gold array<long>, held boolean, batch int").parquet(path)
    w = Weights.zero(features, len(tags))
    first, second = np.zeros_like(w.flat()), np.zeros_like(w.flat())
    top, best_w, bad, stale, step, history = -np.inf, w, 0, 0, 0, []
    for epoch in range(epochs + 1):
        for k in range(batches if epoch < epochs else 1):
            total = totals(kept.where(F.col("batch").isin(-1, k) if k == 0 else F.col("batch") == k), w)
            loss, g = loss_and_gradient(total, w, aux)
            if k == 0:
                judged = f1(total, len(tags), select)
                history.append({"epoch": epoch, "rate": rate, "loss": loss, "f1": judged})
                if note:
                    note(history[-1])
                value = judged if fold else -loss
                if value > top:
                    top, best_w, bad, stale = value, w, 0, 0
                else:
                    bad, stale = bad + 1, stale + 1
                    if bad > halve:
                        rate, bad = rate / 2, 0
                if stale >= patience or epoch == epochs:
                    return best_w, history
            g = g * min(1.0, clip / (float(np.sqrt(g @ g)) + 1e-12))
            step += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            w = w.like(w.flat() * (1 - rate * decay) - rate * move)
    return best_w, history


def label(samples: DataFrame, key: str, w: Weights, tags: list[str]) -> DataFrame:
    """(key, tags) by the best path through samples(key, features); an empty or null sequence has no tags."""
    shared, width = samples.sparkSession.sparkContext.broadcast(w), w.score.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            out: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for rows, n, x, _ in padded(batch, width, gold=False):
                path = best(now.chain(), x @ now.score + now.bias, n)
                for k, r in enumerate(rows):
                    out[r] = [tags[t] for t in path[k, : n[k]]]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.string()))], [key, "tags"])

    seqs = F.coalesce(numbers(F.col("features")), F.array().cast("array<array<double>>"))
    return samples.select(key, seqs.alias("features")).mapInArrow(run, f"`{key}` {samples.schema[key].dataType.simpleString()}, tags array<string>")
