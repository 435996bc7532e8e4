"""Sequence labelling in numpy: character convolutions, recurrent encoders, a linear-chain CRF, and batches for Spark.

A bundle is a dict of arrays and a configuration; weights go to the executors once, as a broadcast, and each Arrow batch
is one padded numpy batch sorted by length. Recurrent weights are stacked in the order input, forget, cell, output
(GRU: reset, update, new) with the two bias vectors of the usual layout.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = -10000.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def char_features(ids: np.ndarray, table: np.ndarray, kernel: np.ndarray, bias: np.ndarray, act=lambda x: np.maximum(x, 0)) -> np.ndarray:
    """[MDL-1] ids [..., chars] to [..., filters]: embed, convolve with padding, activate, maximum over characters."""
    x = table[ids]
    width = kernel.shape[2]
    edge = [(0, 0)] * (x.ndim - 2) + [(width // 2, width // 2), (0, 0)]
    x = np.pad(x, edge)
    windows = np.lib.stride_tricks.sliding_window_view(x, width, axis=-2)  # [..., chars, emb, width]
    return act(np.einsum("...ew,few->...f", windows, kernel) + bias).max(-2)


def lstm(x: np.ndarray, w: dict, reverse: bool) -> np.ndarray:
    """[batch, time, in] to [batch, time, hidden], one direction.

    Gates are halved beforehand, which is exact, so a step has one tanh for all of them; a long sequence pays for each call of a step.
    """
    n = w["hh"].shape[1]
    half = np.repeat([0.5, 0.5, 1.0, 0.5], n)
    given, back = np.ascontiguousarray(np.swapaxes((x @ w["ih"].T + w["bih"] + w["bhh"]) * half, 0, 1)), w["hh"].T * half
    h, c = np.zeros((len(x), n)), np.zeros((len(x), n))
    out = np.zeros((x.shape[1], len(x), n))
    for t in range(x.shape[1])[:: -1 if reverse else 1]:
        z = h @ back
        z += given[t]
        np.tanh(z, z)
        gates = 0.5 * z
        gates += 0.5
        c *= gates[:, n : 2 * n]
        c += gates[:, :n] * z[:, 2 * n : 3 * n]
        h = np.tanh(c, out[t])
        h *= gates[:, 3 * n :]
    return np.swapaxes(out, 0, 1)


def gru(x: np.ndarray, w: dict, reverse: bool) -> np.ndarray:
    hidden = w["hh"].shape[1]
    h, out = np.zeros((len(x), hidden)), np.zeros((*x.shape[:2], hidden))
    for t in range(x.shape[1])[:: -1 if reverse else 1]:
        (ir, iz, inn), (hr, hz, hn) = np.split(x[:, t] @ w["ih"].T + w["bih"], 3, 1), np.split(h @ w["hh"].T + w["bhh"], 3, 1)
        r, z = sigmoid(ir + hr), sigmoid(iz + hz)
        h = (1 - z) * np.tanh(inn + r * hn) + z * h
        out[:, t] = h
    return out


def both_ways(x: np.ndarray, lengths: np.ndarray, cell, forward: dict, backward: dict) -> np.ndarray:
    """A bidirectional layer over padded sequences; padding neither reads nor writes state.

    Padding stands at the end, so the forward pass meets it last, and the backward pass reads each sequence turned round
    within its own length.
    """
    at = np.arange(x.shape[1])[None, :]
    real = at < lengths[:, None]
    turned = np.where(real, lengths[:, None] - 1 - at, at)[..., None]
    back = np.take_along_axis(cell(np.take_along_axis(x, turned, 1), backward, False), turned, 1)
    return np.concatenate([cell(x, forward, False), back], 2) * real[..., None]


def distinct_vectors(f, ids: np.ndarray, size: int = 1024) -> np.ndarray:
    """f of ids [..., k], once for each distinct row and in slices, so that memory follows the result."""
    rows, back = np.unique(ids.reshape(-1, ids.shape[-1]), axis=0, return_inverse=True)
    made = np.concatenate([f(rows[i : i + size]) for i in range(0, len(rows), size)])
    return made[back.reshape(-1)].reshape(*ids.shape[:-1], -1)


class Crf:
    """[MDL-2] Linear-chain scores: start [tag], end [tag], move [from, to]."""

    def __init__(self, start: np.ndarray, end: np.ndarray, move: np.ndarray, pad: int | None = 0):
        self.start, self.end, self.move = (np.array(x, float) for x in (start, end, move))
        if pad is not None:
            self.start[pad] = self.end[pad] = NEVER
            self.move[pad, :] = self.move[:, pad] = NEVER

    def path_score(self, e: np.ndarray, tags: list[int]) -> float:
        total = self.start[tags[0]] + self.end[tags[-1]] + sum(e[i, t] for i, t in enumerate(tags))
        return float(total + sum(self.move[a, b] for a, b in zip(tags, tags[1:], strict=False)))

    def log_partition(self, e: np.ndarray) -> float:
        a = self.start + e[0]
        for row in e[1:]:
            a = logsumexp(a[:, None] + self.move, 0) + row
        return float(logsumexp(a + self.end, 0))

    def loss(self, e: np.ndarray, tags: list[int]) -> float:
        """Negative log-likelihood."""
        return self.log_partition(e) - self.path_score(e, tags)

    def decode(self, e: np.ndarray) -> list[int]:
        """[WIN-10] The best path."""
        if not len(e):
            return []
        score, back = self.start + e[0], []
        for row in e[1:]:
            every = score[:, None] + self.move
            back.append(every.argmax(0))
            score = every.max(0) + row
        path = [int((score + self.end).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag and transition probabilities by forward and backward sums."""
        n, k = e.shape
        a, b = np.zeros((n, k)), np.zeros((n, k))
        a[0], b[-1] = self.start + e[0], self.end
        for i in range(1, n):
            a[i] = logsumexp(a[i - 1][:, None] + self.move, 0) + e[i]
        for i in range(n - 2, -1, -1):
            b[i] = logsumexp(self.move + (e[i + 1] + b[i + 1])[None, :], 1)
        z = logsumexp(a[-1] + self.end, 0)
        pairs = np.zeros((k, k))
        for i in range(n - 1):
            pairs += np.exp(a[i][:, None] + self.move + (e[i + 1] + b[i + 1])[None, :] - z)
        return np.exp(a + b - z), pairs


def word_mean(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """[AGG-19] Mean embedding of a line's words, padding left out."""
    real = (ids != 0)[..., None]
    return (table[ids] * real).sum(-2) / np.maximum(real.sum(-2), 1)


def token_emissions(b: dict, words: np.ndarray, chars: np.ndarray, feats: np.ndarray | None, lengths: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
    """[MDL-3] word and character features (and the given ones) through a BiLSTM to tag scores. [MDL-4] without feats: tanh.

    With codes [batch, time], words and chars are those of the distinct tokens that codes number.
    """
    act = np.tanh if feats is None else (lambda x: np.maximum(x, 0))
    parts = [b["word"][words], distinct_vectors(lambda c: char_features(c, b["char"], b["conv"], b["conv_bias"], act), chars)]
    if codes is not None:
        parts = [p[codes] for p in parts]
    if feats is not None:
        parts.append(np.maximum(feats @ b["feat"].T + b["feat_bias"], 0))
    h = both_ways(np.concatenate(parts, -1), lengths, lstm, b["forward"], b["backward"])
    return h @ b["out"].T + b["out_bias"]


def line_emissions(b: dict, words: np.ndarray, chars: np.ndarray, feats: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[MDL-5, MDL-6] mean word, two character convolutions and features through a BiLSTM or BiGRU to marker scores."""
    of = lambda k: lambda c: char_features(c, b["char"], b[f"conv{k}"], b[f"conv{k}_bias"])
    parts = [distinct_vectors(lambda w: word_mean(w, b["word"]), words), *(distinct_vectors(of(k), chars) for k in (3, 5)), np.maximum(feats @ b["feat"].T + b["feat_bias"], 0)]
    cell = gru if b["forward"]["ih"].shape[0] == 3 * b["forward"]["hh"].shape[1] else lstm
    h = both_ways(np.concatenate(parts, -1), lengths, cell, b["forward"], b["backward"])
    return h @ b["out"].T + b["out_bias"]


def cell_weights(rng, size: int, hidden: int, gates: int) -> dict:
    s = 1 / np.sqrt(hidden)
    u = lambda *shape: rng.uniform(-s, s, shape)
    return {"ih": u(gates * hidden, size), "hh": u(gates * hidden, hidden), "bih": u(gates * hidden), "bhh": u(gates * hidden)}


def new_bundle(words: int, chars: int, features: int, tags: int, word_dim=96, char_dim=32, filters=48, feat_dim=24, hidden=96, seed=0, widths=(3,), gates=4) -> dict:
    """Random weights in the shape of a token model (widths=(3,)) or a line model (widths=(3, 5); gates=3 for a GRU)."""
    rng = np.random.default_rng(seed)
    r = lambda *shape: rng.normal(0, 0.1, shape)
    b = {"word": r(words, word_dim), "char": r(chars, char_dim), "out": r(tags, 2 * hidden), "out_bias": np.zeros(tags)}
    b["word"][0] = b["char"][0] = 0
    names = ["conv"] if len(widths) == 1 else [f"conv{w}" for w in widths]
    for name, w in zip(names, widths, strict=True):
        b |= {name: r(filters, char_dim, w), f"{name}_bias": np.zeros(filters)}
    if features:
        b |= {"feat": r(feat_dim, features), "feat_bias": np.zeros(feat_dim)}
    size = word_dim + filters * len(widths) + (feat_dim if features else 0)
    b |= {"forward": cell_weights(rng, size, hidden, gates), "backward": cell_weights(rng, size, hidden, gates)}
    return b | {"start": np.zeros(tags), "end": np.zeros(tags), "move": r(tags, tags)}


def parameters(b: dict) -> int:
    """[AGG-20]"""
    return sum(parameters(x) if isinstance(x, dict) else int(np.size(x)) for x in b.values())


def save_bundle(b: dict, config: dict, folder: str) -> None:
    """[SNK-12] Weights as one npz, configuration and dictionaries as JSON, on the driver's side."""
    import os

    os.makedirs(folder, exist_ok=True)
    flat = {f"{k}.{j}" if isinstance(x, dict) else k: y for k, x in b.items() for j, y in (x.items() if isinstance(x, dict) else [("", x)])}
    np.savez(f"{folder}/weights.npz", **flat)
    with open(f"{folder}/config.json", "w", encoding="utf-8") as f:
        json.dump(config, f, ensure_ascii=False, indent=2)


def load_bundle(folder: str) -> tuple[dict, dict]:
    """[SRC-19]"""
    b: dict = {}
    for k, x in np.load(f"{folder}/weights.npz").items():
        name, _, part = k.partition(".")
        if part:
            b.setdefault(name, {})[part] = x
        else:
            b[k] = x
    with open(f"{folder}/config.json", encoding="utf-8") as f:
        return b, json.load(f)


def decode_emissions(rows: DataFrame, key: str, crf: Crf, tags: list[str], emissions: str = "emissions") -> DataFrame:
    """(key, tags, probs): best paths and softmax scores of rows(key, emissions array<array<double>>). Empty stays empty."""
    shared = rows.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            es = [np.array([list(r) for r in e], float) if e is not None and len(e) else np.zeros((0, len(tags))) for e in pdf[emissions]]
            yield pd.DataFrame({key: pdf[key], "tags": [[tags[i] for i in shared.value.decode(e)] for e in es], "probs": [softmax(e).tolist() if len(e) else [] for e in es]})

    kind = f"`{key}` {rows.schema[key].dataType.simpleString()}, tags array<string>, probs array<array<double>>"
    return rows.select(key, emissions).mapInPandas(run, kind)


def label_tokens(rows: DataFrame, key: str, bundle: dict, tags: list[str], char_len: int = 24) -> DataFrame:
    """[SEM-16, SEM-12, MDL-9, MDL-10] (key, tags, emissions) of rows(key, word_ids, char_ids, features): one padded batch for each Arrow batch."""
    shared = rows.sparkSession.sparkContext.broadcast(bundle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        crf = Crf(b["start"], b["end"], b["move"])
        for pdf in batches:
            n = np.array([len(x) for x in pdf["word_ids"]], np.int64)
            longest = int(n.max()) if len(n) else 0
            words, chars = np.zeros((len(n), longest), np.int64), np.zeros((len(n), longest, char_len), np.int64)
            feats = np.zeros((len(n), longest, b["feat"].shape[1])) if "feat" in b else None
            for i, (w, c, f) in enumerate(zip(pdf["word_ids"], pdf["char_ids"], pdf["features"], strict=True)):
                if n[i]:
                    words[i, : n[i]] = w
                    chars[i, : n[i]] = np.array([list(x) for x in c])
                    if feats is not None:
                        feats[i, : n[i]] = np.array([list(x) for x in f], float)
            e = token_emissions(b, words, chars, feats, n) if longest else np.zeros((len(n), 0, len(tags)))
            paths = [crf.decode(e[i, :k]) if "feat" in b else e[i, :k].argmax(-1).tolist() for i, k in enumerate(n)]
            yield pd.DataFrame({key: pdf[key], "tags": [[tags[t] for t in p] for p in paths], "emissions": [e[i, :k].tolist() for i, k in enumerate(n)]})

    kind = f"`{key}` {rows.schema[key].dataType.simpleString()}, tags array<string>, emissions array<array<double>>"
    return rows.select(key, "word_ids", "char_ids", "features").mapInPandas(run, kind)


def errors(gold: DataFrame, found: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """[SNK-13, SRT-10] At most `limit` sequences whose spans differ, by key."""
    side = lambda df, n: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("label", "first", "last"))).alias(n))
    both = side(gold, "true_spans").join(side(found, "pred_spans"), key, "full_outer")
    return both.where(~F.col("true_spans").eqNullSafe(F.col("pred_spans"))).orderBy(key).limit(limit)
