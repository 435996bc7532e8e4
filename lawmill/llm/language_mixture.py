"""Language identification by mixture inference.

Each language has smoothed probabilities of hashed byte n-grams of words (word edges marked), which give each word a
likelihood in each language. A document is a mixture: expectation-maximisation estimates the languages' proportions from
its words' likelihoods, and the set of languages is grown from the best one as long as another language raises the
log-likelihood by more than its penalty (half the logarithm of the words, for its share, and a word's worth of evidence).
The language of the document is the one with the largest proportion, and its proportion is the score.

Languages are learned from a seeded sample of about `sample` training documents for each language, chosen by hash of
the id alone; what is learned and broadcast has a fixed size for each language. A word's language is judged on its
letters only; digits and marks count for nothing. Everything else reads whole texts.

A null text, or one without a letter, gets `und` and score 0, as does every text when there is nothing to learn from.
Rows that repeat a doc_id each come back, and each trains if its hash is in the sample. Of languages equally likely the
first by code point is taken. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm.common import fold_mod, table

BITS = 16
ORDERS = (2, 3, 4)
SAMPLE = 4096
#: What a word's likelihoods are raised to: n-grams of a word overlap and are not independent.
_HEAT = 0.5
#: Expectation-maximisation ends when no proportion moves by more than _STILL in a step, or after _STEPS.
_STILL, _STEPS = 1e-5, 500
_MOST = 200_000
#: Most values of an array over n-grams or words and languages.
_CELLS = 40_000_000


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all words in order, index of the word of each)."""
    raw = np.frombuffer(("\n" + "\n".join(words) + "\n").encode(), np.uint8)
    edge = raw == 10
    word_of = np.cumsum(edge) - 1
    outs, owners = [], []
    for n in ORDERS:
        h = np.zeros(len(raw) - n + 1, np.uint64)
        inner = np.zeros(len(h), bool)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(257) + raw[k : len(raw) - n + 1 + k].astype(np.uint64) + np.uint64(1)
                if 0 < k < n - 1:
                    inner |= edge[k : len(raw) - n + 1 + k]
            h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        good = ~inner & ~(edge[: len(h)] & edge[n - 1 : len(raw)])
        outs.append((h[good] >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(word_of[: len(h)][good])
    out, owner = np.concatenate(outs), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return out[order], owner[order]


def letters(text: str | None) -> list[str]:
    """Runs of letters, lowered; a run of more than 64 goes on as the next word."""
    import regex

    global _RUNS
    _RUNS = _RUNS or regex.compile(r"\p{L}{1,64}")
    return _RUNS.findall(text.lower()) if text else []


_RUNS = None


#: Languages whose counts a task holds at once.
_HELD = 64


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n): the n-grams of a partition's texts, added up; whole texts go no further than this."""
    held: dict[str, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in held and len(held) == _HELD:
                yield from sent()
            n = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
            if words := letters(text.as_py()):
                n += np.bincount(grams(words)[0], minlength=1 << BITS)
    yield from sent()


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 5) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [n-gram, language]) from docs(doc_id, text, lang), null languages left out."""
    known = docs.where(F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return [], np.zeros((1 << BITS, 0), np.float32)
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 30, (sample << 30) // r["count"])) for r in sizes], "lang string, share long")
    part = known.join(F.broadcast(share), "lang").where(h < F.col("share")).select("lang", F.col("text").cast("string"))
    every = part.mapInArrow(count_grams, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a row a language, of as many entries as there are places at most
    rows = every.groupBy("lang").agg(F.collect_list("gram").alias("at"), F.collect_list("n").alias("n")).collect()
    langs = sorted(r["lang"] for r in sizes)
    counts = np.full((1 << BITS, len(langs)), np.float32(0.05))
    for r in rows:
        counts[np.array(r["at"], np.int64), langs.index(r["lang"])] += np.array(r["n"], np.float32)
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


class Words(dict):
    """word -> row of its log-likelihoods by language; emptied at `most` words."""

    def __init__(self, logp: np.ndarray, most: int = _MOST):
        super().__init__()
        self.logp, self.most = logp, min(most, _CELLS // max(1, logp.shape[1]))
        self.rows = np.zeros((0, logp.shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self) > self.most:
            self.clear()
            self.rows = self.rows[:0]
        new = list(words.difference(self))
        if not new:
            return
        g, owner = grams(new)
        starts = np.searchsorted(owner, np.arange(len(new)))
        step = max(1, _CELLS // max(1, self.logp.shape[1] * -(-len(g) // len(new))))
        parts = [self.rows]
        for i in range(0, len(new), step):
            part = g[starts[i] : starts[i + step] if i + step < len(new) else len(g)]
            parts.append(np.add.reduceat(self.logp[part], starts[i : i + step] - starts[i], axis=0) * _HEAT)
        self.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate(parts)


def mixture(ll: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions of the languages for words with log-likelihoods ll [word, language] and counts n."""
    p = np.exp(ll - ll.max(1, keepdims=True)).astype(np.float64)
    total = n.sum()

    def em(use: list[int]) -> tuple[np.ndarray, float]:
        q = p[:, use]
        share = np.full(len(use), 1 / len(use))
        for _ in range(_STEPS if len(use) > 1 else 0):
            turn = (n / (q @ share + 1e-300)) @ q / total
            share = share * turn
            if np.abs(share * (turn - 1)).max() < _STILL:
                break
        return share, float(n @ np.log(q @ share + 1e-300))

    # no set is likelier than all languages together, so where these do not pay for one more language none does
    most = em(list(range(p.shape[1])))[1] + _STILL * total
    single = n @ np.log(p + 1e-300)
    use = [int(np.argmax(single))]
    share, best = np.ones(1), float(single[use[0]])
    penalty = 0.5 * np.log(total) + 2.0
    while most - best > penalty and len(use) < p.shape[1]:
        tried = [(em([*use, k]), k) for k in range(p.shape[1]) if k not in use]
        (wider, value), k = max(tried, key=lambda t: t[0][1])
        if value - best <= penalty:
            break
        use, share, best = [*use, k], wider, value
    out = np.zeros(p.shape[1])
    out[use] = share
    return out


_GROUP = 2_000_000


def groups(texts: list[str | None], most: int = _GROUP) -> Iterator[list[list[str]]]:
    """The words of the texts, some at a time, so that new words are learned together."""
    group, size = [], 0
    for text in texts:
        group.append(letters(text))
        size += len(text or "")
        if size > most:
            yield group
            group, size = [], 0
    yield group


def predict_texts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = model.value
        known = Words(logp)
        for batch in batches:
            pred, score, sets = [], [], []
            for group in groups(batch.column(batch.num_columns - 1).to_pylist(), min(_GROUP, 5 * _CELLS // max(1, len(langs)))):
                if langs:
                    known.learn(set().union(*group))
                for words in group:
                    if not words or not langs:
                        pred.append("und")
                        score.append(0.0)
                        sets.append([])
                        continue
                    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    at.sort()
                    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    share = mixture(known.rows[at[first]], np.diff(first, append=len(at)).astype(float))
                    order = np.argsort(-share, kind="stable")
                    pred.append(langs[order[0]])
                    score.append(min(1.0, float(share[order[0]])))
                    sets.append([{"lang": langs[i], "share": float(share[i])} for i in order if share[i] > 0])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "lang_pred", "score", "languages"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) for docs(doc_id, held_out, text); languages has the chosen set."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string"))
    kind = "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    return rows.mapInArrow(predict_texts(shared), kind)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold_mod("doc_id", 3) == 1, F.lit(False)))
    return identify(docs, fit(docs.where(~F.col("held_out"))))
