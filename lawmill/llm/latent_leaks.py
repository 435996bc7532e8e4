"""Benchmark decontamination by latent semantic retrieval.

The passages of the benchmark, weighted by tf-idf with document frequencies over the whole corpus, are reduced by a
distributed randomised SVD (Halko, Martinsson and Tropp 2011). A document's passages are overlapping windows, folded
into the same latent space; a window is a candidate for an item if the cosine is high there and it carries enough of
the item's weight. A candidate's neighbourhood is then compared with the item by longest common subsequence of words, which
survives dropped, added and changed words, and the item's answer (what follows its last "answer" mark, else its last
sentence) must be found there too.

Only words of the benchmark have a place in the latent space. What a word can add to an item's weight is known for
every word; a window whose words, each at its best, cannot reach the share that any item requires is passed over by
this bound, without a product. Nothing else is skipped, every window of every text is judged. Windows are doubled until
the longest item of a block is covered, so an item of any length fits into the window it is sought with.

One latent space is fitted to all passages of the benchmark, and words have hashed places in it, so its size has a
bound and a cosine does not depend on what else is sought with an item. The benchmark is the query set: it goes to all
documents in blocks of about `block` items, so what is broadcast at once is bounded whatever its size. Documents are
read once for the frequencies and once for each block; nothing of them is shuffled but one row for each benchmark word
and task.

Null and empty texts, and items without words, match nothing. Rows that repeat a doc_id are judged one by one; a null
doc_id is returned as null. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lawmill.llm.common import free_name, materialize, table, union_all

RANK, OVERSAMPLE, TURNS = 192, 16, 2
STEP = 8
#: Doubled on until the longest item of a block is covered; from the last one here on the step grows with the width.
WINDOWS = (24, 48, 96, 192, 384)
#: Least cosine in the latent space and least share of an item's weight in a window.
COSINE, SHARE = 0.45, 0.45
#: Least share of the item's words, and of its answer's, in the common subsequence.
LCS, ANSWER = 0.6, 0.4
BLOCK = 4096
#: Places of words in the latent space, words of a passage, and benchmark words sought in one reading of the documents and at all.
BUCKETS, PASSAGE, SLICE, MOST_WORDS = 1 << 17, 384, 1 << 18, 1 << 21
_WORD = re.compile(r"[^\W_]+")
PAIRS = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def answer_start(text: str) -> int:
    """Number of the first word of an item's answer."""
    low = text.lower()
    marks = list(re.finditer(r"\banswer\b\s*[:=]?", low))
    if marks and words_of(low[marks[-1].end() :]):
        return len(words_of(low[: marks[-1].end()]))
    ends = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", low.rstrip())]
    n = len(words_of(low))
    starts = [k for e in ends if n - (k := len(words_of(low[:e]))) >= 4]
    return starts[-1] if starts else n - max(1, n // 3)


def bits_of(words: list[str]) -> dict[str, int]:
    """word -> its places as bits."""
    bits: dict[str, int] = {}
    for i, w in enumerate(words):
        bits[w] = bits.get(w, 0) | 1 << i
    return bits


def common(item: dict[str, int], n: int, region: list[str]) -> int:
    """Bits of the item's words in a longest common subsequence with region (bit-parallel); item has the places of words as bits."""
    full, v = (1 << n) - 1, (1 << n) - 1
    for w in region:
        if m := item.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full ^ v


def bucket(word: str) -> int:
    """The place of a word in the latent space, one of BUCKETS by hash: so its size has a bound, whatever the benchmark's."""
    return xxh64_intdigest(word.encode()) & (BUCKETS - 1)


def document_counts(vocabulary):
    """In how many documents of the task each bucket of vocabulary words is: rows (w, n), and the number of documents at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.value
        n, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                docs += 1
                n[[*{place[w] for w in place.keys() & set(words_of(raw))}]] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([docs, *n[at].tolist()], pa.int64())], ["w", "n"])

    return run


def vocabulary_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([*{w for raw in batch.column(0).to_pylist() for w in words_of(raw)}], pa.string())], ["word"])


def bucket_weights(texts: DataFrame, queries: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(word of the benchmark -> place, buckets by place, their inverse document frequencies in texts), from all rows of both.

    The vocabulary is sought in slices of about SLICE words, each in one reading of the texts: usually there is one. A
    benchmark of more than MOST_WORDS distinct words raises an error: its words are broadcast.
    """
    spark = texts.sparkSession
    words = queries.select("text").mapInArrow(vocabulary_words, "word string").distinct()
    if (n := words.count()) > MOST_WORDS:
        raise ValueError(f"the benchmark has {n} distinct words, more than {MOST_WORDS}: give it in parts")
    slices = max(1, -(-n // SLICE))
    total: dict[int, int] = {}
    docs, every = 0, {}
    for k in range(slices):
        found = words.where(F.pmod(F.xxhash64("word"), F.lit(slices)) == k).toArrow().column("word").to_pylist()
        place = {w: bucket(w) for w in found}
        every |= place
        seen = texts.select("raw").mapInArrow(document_counts(spark.sparkContext.broadcast(place)), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
        for w, n in zip(*seen.toArrow().to_pydict().values(), strict=True):
            if w < 0:
                docs = n
            else:
                total[w] = total.get(w, 0) + n
    at = np.array(sorted(set(every.values())), np.int64)
    to = {b: i for i, b in enumerate(at.tolist())}
    counts = np.minimum(docs, np.array([total.get(w, 0) for w in at.tolist()], np.float64))
    return {w: to[b] for w, b in every.items()}, at, np.log((docs + 1) / (counts + 1)) + 1e-3


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (text) to (at), the buckets of their words in passages of at most PASSAGE words."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            at = [bucket(w) for w in words_of(text)]
            out += [at[i : i + PASSAGE] for i in range(0, len(at), PASSAGE)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["at"])


def project(shared):
    """Passages (bucket list) to their part of A^T (A B): rows (w, values), a row for each bucket of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, idf, b = shared.value
        total = np.zeros_like(b)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                at, n = np.unique(used.searchsorted(np.array(at, np.int64)), return_counts=True)
                x = n * idf[at]
                x /= max(np.sqrt(x @ x), 1e-12)
                total[at] += np.outer(x, x @ b[at])
        found = np.flatnonzero(np.abs(total).any(1))
        for part in np.array_split(found, max(1, len(found) // 2000)):
            flat = pa.array(total[part].reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * b.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([pa.array(part), lists], ["w", "x"])

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w, x) sorted by w to one row for each w."""
    now, total = None, None
    for batch in batches:
        for w, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = x.values.to_numpy()
            if w != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total], pa.list_(pa.float64()))], ["w", "x"])
                now, total = w, np.zeros(len(x))
            total = total + x
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total], pa.list_(pa.float64()))], ["w", "x"])


def latent_axes(items: DataFrame, used: np.ndarray, idf: np.ndarray, rank: int = RANK, seed: int = 10) -> np.ndarray:
    """Right singular vectors [place in used, rank] of the tf-idf matrix of items(at): randomised range finder with power turns.

    Each turn is a distributed product with A^T A, summed on the executors; what comes back is one row for each bucket
    in use, of which there are at most BUCKETS.
    """
    spark, size = items.sparkSession, min(rank + OVERSAMPLE, len(idf))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), size)))[0]
    image = basis
    for turn in range(TURNS):
        shared = spark.sparkContext.broadcast((used, idf, basis))
        rows = items.select("at").mapInArrow(project(shared), "w long, x array<double>")
        got = rows.repartition("w").sortWithinPartitions("w").mapInArrow(summed, "w long, x array<double>").toArrow()
        image = np.zeros_like(basis)
        if got.num_rows:
            image[got.column("w").to_numpy()] = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, size)
        basis = np.linalg.qr(image)[0] if turn + 1 < TURNS else basis
    # Rayleigh-Ritz on the last basis: image = A^T A basis
    values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    keep = np.argsort(-values)[: min(rank, size)]
    return basis @ turn[:, keep][:, values[keep] > 1e-9]


class Items:
    """A block of benchmark items in the latent space."""

    def __init__(self, ids: list, texts: list[str], place: dict[str, int], idf: np.ndarray, axes: np.ndarray):
        self.ids, self.place, self.idf = ids, place, idf
        self.rows = (axes * idf[:, None]).astype(np.float32)
        self.words = [words_of(t) for t in texts]
        latent = np.stack([self.rows[[place[w] for w in ws]].sum(0) for ws in self.words]).astype(np.float64)
        self.norm = np.maximum(np.sqrt((latent * latent).sum(1)), 1e-12)
        self.unit = (latent / self.norm[:, None]).astype(np.float32)
        self.size = np.array([len(ws) for ws in self.words])
        self.least = SHARE * self.norm
        self.answer = [answer_start(t) for t in texts]
        self.widths = list(WINDOWS)
        while self.widths[-1] < self.size.max():
            self.widths.append(2 * self.widths[-1])
        # places of a long item's words take the square of its length and are made where it is a candidate
        self.bits = [bits_of(ws) if len(ws) <= WINDOWS[-1] else None for ws in self.words]
        # an item is sought with the least window that is as long as itself
        self.window = np.searchsorted(self.widths, self.size)
        # the most that one occurrence of each word adds to the share of any item of a window
        self.most = {}
        for k in np.unique(self.window).tolist():
            mine = np.flatnonzero(self.window == k)
            most = np.zeros(len(idf) + 1)
            for part in np.array_split(mine, -(-len(mine) // 256)):
                most[:-1] = np.maximum(most[:-1], (self.rows @ (self.unit[part] / self.norm[part, None]).T.astype(np.float32)).max(1))
            self.most[k] = mine, most

    def find(self, words: list[str]) -> Iterator[tuple]:
        """(item, cosine, lcs, answer, first word) of the items found in a text, the best place of each."""
        at = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, tuple] = {}
        long: dict[int, dict[str, int]] = {}
        for k, (mine, most) in self.most.items():
            width = self.widths[k]
            step = max(STEP, STEP * width // WINDOWS[-1])
            sums = np.concatenate([[0.0], np.cumsum(most[at])])
            starts = np.arange(0, max(1, len(words) - width + step), step)
            starts = starts[sums[np.minimum(starts + width, len(words))] - sums[starts] >= SHARE - 1e-4]
            for part in np.array_split(starts, max(1, len(starts) // 512)):
                if len(part):
                    self._judge(words, at, part, width, mine, best, long)
        for i, (_, row) in sorted(best.items()):
            yield i, *row

    def _judge(self, words, at, starts, width, mine, best, long) -> None:
        spans = [at[s : s + width] for s in starts]
        spans = [x[x >= 0] for x in spans]
        if width > WINDOWS[-1]:  # a row for each word, not for each of its places
            counted = [np.unique(p, return_counts=True) for p in spans]
            x = np.stack([n.astype(np.float32) @ self.rows[p] for p, n in counted])
        else:
            x = np.stack([self.rows[p].sum(0) for p in spans])
        norm = np.maximum(np.sqrt((x * x).sum(1)), 1e-12)
        dots = x @ self.unit[mine].T
        good = (dots >= COSINE * norm[:, None]) & (dots >= self.least[mine])
        for s, j in zip(*np.nonzero(good), strict=True):
            i = int(mine[j])
            cosine = float(dots[s, j] / norm[s])
            n = int(self.size[i])
            low = max(0, int(starts[s]) - n // 2)
            region = words[low : int(starts[s]) + width + n // 2]
            if i in best and best[i][0] >= 1.0:
                continue
            if (bits := self.bits[i] or long.get(i)) is None:
                bits = long[i] = bits_of(self.words[i])
            hit = common(bits, n, region)
            lcs = hit.bit_count() / n
            answer = (hit >> self.answer[i]).bit_count() / max(1, n - self.answer[i])
            if lcs >= LCS and answer >= ANSWER and (i not in best or lcs > best[i][0]):
                best[i] = lcs, (cosine, lcs, answer, int(starts[s]))


def find_items(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := words_of(raw):
                    rows += [(doc_id, items.ids[i], *rest) for i, *rest in items.find(words)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs", "answer", "first_word"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word) for each item of benchmark(item_id, text) in docs(doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("raw"))
    queries = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = max(1, -(-queries.count() // block))
    place, used, idf = bucket_weights(texts, queries)
    if not len(used):
        return spark.createDataFrame([], PAIRS)
    axes = latent_axes(materialize(queries.select("text").mapInArrow(passages, "at array<long>"), "leaks-passages"), used, idf)
    parts = []
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else queries
        got = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]
        got = [(i, t) for i, t in got if words_of(t)]
        if not got:
            continue
        model = Items([i for i, _ in got], [t for _, t in got], place, idf, axes)
        parts.append(texts.mapInArrow(find_items(spark.sparkContext.broadcast(model)), PAIRS))
    return union_all(parts) if parts else spark.createDataFrame([], PAIRS)


def op10_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in whose text no item is found, all columns kept; rows that share a doc_id are judged by their own texts."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = find_leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = found.select(F.col("doc_id").alias(free_name("leak", docs.columns))).distinct()
    return docs.join(leaks, key == F.col(leaks.columns[0]), "left_anti")
