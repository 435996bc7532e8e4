"""LM scoring with a probabilistic suffix tree (Ron, Singer and Tishby 1996; pruning as in Rissanen's context algorithm).

Symbols are words; each document ends with one end symbol, which also is the context of the next text's first word. A
context is one or two preceding symbols. Learning and scoring are four passes:

1. every symbol of the training documents is counted (a shuffle of block-wise counts, which grows with the corpus);
2. pairs of frequent symbols are counted, and then triples both of whose pairs are frequent;
3. a context stays in the tree if what follows it differs from what follows its suffix: its count times the
   Kullback-Leibler divergence must pay for the description of its distribution;
4. each document is scored with the longest retained suffix of each position's history.

Frequent means a count of at least min_count, whatever the size of the corpus. The counts and the tree are shared tables
and contexts are judged by joins of these. The logarithm of a symbol's probability is written as a sum of weights of
the n-grams that end there, so a document's score is a sum over a join of its n-grams with the weights. The heaviest part
of the tree is broadcast instead: at most `most` symbols, pairs and triples each, by counts that are checked first. All else stays on the executors and meets the documents in a join; bitmaps of a fixed size tell which
n-grams need not go there, and where they err an n-gram goes in vain. What a context has seen of rare symbols is mass for
its suffix, so every state's distribution sums to one over the vocabulary and one unseen symbol.

Nulls: a null text is empty (its end symbol is scored); a row with null doc_id is kept and trains. Empty tables give
no rows. Repeated doc_ids are scored each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm.common import fold_mod, materialize, mix, table, union_all

MIN_COUNT = 16
#: Most symbols, pairs and triples each that are broadcast, the most frequent ones; no result depends on it.
MOST = 1 << 20
#: What a context's suffix weighs against the context's own count.
PRIOR = 8.0
#: A symbol is the 63-bit hash of its word with the sign bit set, or its place among the frequent ones.
_SIGN = 1 << 63
END = np.int64(0x51ED270B27B4F3CF - _SIGN)
_SHIFT = 22
_MASK = (1 << _SHIFT) - 1
_FLUSH = 1_000_000
#: Size of the bitmaps.
_BITS = 25
#: What a key of a weight or bitmap stands for.
_CONTEXT1, _PAIR, _CONTEXT2, _TRIPLE = 1, 2, 3, 4
_WORDS: dict[int, tuple] = {}


class Codes(dict):
    """word -> place among the sorted frequent codes, else its code; emptied at `most` words."""

    def __init__(self, known: np.ndarray, most: int = 300_000):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.known, self.most, self.digest = known, most, xxh64_intdigest
        self.end = self.place(int(END))

    def place(self, code: int) -> int:
        i = int(self.known.searchsorted(code))
        return i if i < len(self.known) and self.known[i] == code else code

    def __missing__(self, word: bytes) -> int:
        code = (self.digest(word) | _SIGN) - (1 << 64)
        value = self.place(code) if len(self.known) else code
        if len(self) < self.most:
            self[word] = value
        return value

    def stream(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts with an end before the first and after each, place of each text's end)."""
        if len(self) >= self.most:
            self.clear()
        parts, ends, at = [np.array([self.end])], [], 0
        for raw in raws:
            words = raw.lower().split() if raw else []
            parts.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            parts.append(parts[0])
            at += len(words) + 1
            ends.append(at)
        return np.concatenate(parts), np.array(ends, np.int64)


def _codes(known: np.ndarray | None = None) -> Codes:
    """Kept by the worker for as long as the frequent symbols are the same object."""
    if known is None:
        known = _NONE
    if 0 not in _WORDS or _WORDS[0][0] is not known:
        _WORDS[0] = known, Codes(known)
    return _WORDS[0][1]


_NONE = np.empty(0, np.int64)


class Tally:
    """Counts of keys in sorted arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.raw: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting > _FLUSH:
            self.settle()

    def settle(self) -> None:
        if self.raw:
            self.parts.append(np.unique(np.concatenate(self.raw), return_counts=True))
            self.raw, self.waiting = [], 0
        if len(self.parts) > 1:
            keys, n = np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts])
            order = np.argsort(keys, kind="stable")  # runs that are sorted already merge fast
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[first], np.add.reduceat(n, first))]

    def size(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def take(self) -> pa.RecordBatch:
        self.settle()
        keys, n = self.parts[0] if self.parts else (_NONE, _NONE)
        self.parts = []
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["k", "n"])


class Finder:
    """Places of distinct keys in an open-addressing table: a lookup touches a few places, where a binary search takes twenty."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, 63 - max(2, int(len(keys)).bit_length())
        self.table = np.full(1 << (64 - self.shift), -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(rest):
            free = self.table[at] < 0
            self.table[at[free]] = rest[free]
            again = self.table[at] != rest
            rest, at = rest[again], (at[again] + 1) & (len(self.table) - 1)

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return (((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(self.shift)).view(np.int64)

    def __call__(self, x: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The place of each x among the keys where `where` holds and it is there, else -1."""
        out = np.full(len(x), -1, np.int64)
        if len(self.keys):
            left = np.flatnonzero(where)
            y = x[left]
            at = self._slots(y)
            while len(left):
                place = self.table[at]
                same = (place >= 0) & (self.keys[place] == y)
                out[left[same]] = place[same]
                go = np.flatnonzero((place >= 0) & ~same)
                left, y, at = left[go], y[go], (at[go] + 1) & (len(self.table) - 1)
        return out


def pair_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol but the first: key of the pair that ends there, and whether both its symbols are frequent."""
    return (s[:-1] << _SHIFT) | (s[1:] & _MASK), (s[:-1] >= 0) & (s[1:] >= 0)


def triple_keys(s: np.ndarray, pair: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol but the first: place of the preceding pair (-1: none in this text), key of the triple, whether it can be frequent."""
    before = np.concatenate([[-1], pair[:-1]])
    before[0] = -1
    before[ends[:-1]] = -1  # the first word of a text has only the end before it
    return before, (before << _SHIFT) | (s[1:] & _MASK), (before >= 0) & (pair >= 0)


def join_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys below 0 of the pairs of a and b."""
    return (mix(a.view(np.uint64), b.view(np.uint64)) | np.uint64(_SIGN)).view(np.int64)


def salted(keys: np.ndarray, kind: int) -> np.ndarray:
    return mix(keys.view(np.uint64), np.uint64(kind)).view(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray | None:
    """2^_BITS bits of which those of keys(k) are set; None if there is no key."""
    bit = F.expr("shiftleft(1L, cast(k & 63 as int))")
    place = F.shiftright(F.col("k").bitwiseAND(F.lit((1 << _BITS) - 1)), 6)
    got = keys.groupBy(place.cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    if not got.num_rows:
        return None
    out = np.zeros(1 << (_BITS - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out


def listed(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the bitmap."""
    if bits is None:
        return np.zeros(len(keys), bool)
    at = keys & ((1 << _BITS) - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 > 0


def pair_ids(s: np.ndarray, key: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """For each symbol but the first: key of the pair that ends there, whatever its symbols."""
    return np.where(ok, key, join_keys(s[:-1], s[1:]))


def preceding(x: np.ndarray, ends: np.ndarray, none) -> np.ndarray:
    """For each place what x is at the place before it in the same text, else none."""
    out = np.concatenate([np.full(1, none, x.dtype), x[:-1]])
    out[ends[:-1]] = none
    return out


def pieces(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time: the arrays over all symbols of a piece exist several times."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, tally = _codes(), Tally()
    for batch in pieces(batches):
        tally.add(codes.stream(batch.column(0).to_pylist())[0][1:])
        if tally.size() > 2 * _FLUSH:
            yield tally.take()
    yield tally.take()


COUNTED = "k long, n long, a long, b long"


def _rows(k, n, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), a, b], ["k", "n", "a", "b"])


def count_contexts(shared):
    """Counts of pairs of frequent symbols, or, once the frequent pairs are known, of triples of these.

    a and b are the symbols of a pair, or the keys of both pairs of a triple, where these are not in its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs, bits = shared.value
        codes, tally = _codes(known), Tally()

        def take() -> pa.RecordBatch:
            k, n = tally.take().columns
            return _rows(k, n, pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()))

        for batch in pieces(batches):
            s, ends = codes.stream(batch.column(0).to_pylist())
            key, ok = pair_keys(s)
            if pairs is None:
                a, b = s[:-1], s[1:]
                if bits is not None:
                    may = s >= 0
                    may[~may] = listed(bits, s[~may])
                    other = may[:-1] & may[1:] & ~ok
            else:
                pair = pairs(key, ok)
                if bits is not None:
                    b = pair_ids(s, key, ok)
                    a = preceding(b, ends, 0)
                    may = (pair >= 0) | listed(bits, salted(b, _PAIR))
                    other = may & preceding(may, ends, False)
                _, key, ok = triple_keys(s, pair, ends)
                if bits is not None:
                    other &= ~ok
            tally.add(key[ok])
            if bits is not None and other.any():
                yield _rows(join_keys(a[other], b[other]), np.ones(int(other.sum()), np.int64), pa.array(a[other]), pa.array(b[other]))
            if tally.size() > 2 * _FLUSH:
                yield take()
        yield take()

    return run


def placed(shared):
    """Symbols (k, n) to (k, n) with the place of those that are broadcast for their code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            k = batch.column(0).to_numpy()
            at = known(k, np.ones(len(k), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(at >= 0, at, k)), batch.column(1)], ["k", "n"])

    return run


def unpacked(shared):
    """Triples (k, n, a, b) to the same with both pairs' keys in a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        for batch in batches:
            k, a, b = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).copy() for c in (0, 2, 3))
            at = np.flatnonzero(k >= 0)
            a[at] = pairs[k[at] >> _SHIFT]
            b[at] = ((a[at] & _MASK) << _SHIFT) | (k[at] & _MASK)
            yield _rows(k, batch.column(1), pa.array(a), pa.array(b))

    return run


def salt_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, k, w) to (k, w) with salted keys."""
    for batch in batches:
        kind, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(salted(k, kind.astype(np.uint64))), batch.column(2)], ["k", "w"])


def follow(rows: DataFrame, prior: float) -> tuple[DataFrame, DataFrame]:
    """What follows contexts, from rows(k, n, context, n_context, below), below a symbol's log probability after the suffix.

    Returns the contexts with the log weight `back` of the suffix and whether they stay, and rows with log probability p.
    """
    by = rows.groupBy("context").agg(
        F.max("n_context").alias("n_context"), F.sum("n").alias("listed"), F.count(F.lit(1)).alias("kinds"),
        F.sum(F.exp("below")).alias("p_below"), F.sum(F.col("n") * (F.log("n") - F.col("below"))).alias("gain"),
    )
    by = by.withColumn("total", F.greatest("n_context", "listed").cast("double")).withColumn("rest", F.col("total") - F.col("listed"))
    p_rest = F.least(F.greatest(1 - F.col("p_below"), F.lit(1e-12)), F.lit(1.0))
    gain = F.col("gain") - F.col("listed") * F.log("total")
    gain += F.when(F.col("rest") > 0, F.col("rest") * (F.log(F.col("rest") / F.col("total")) - F.log(p_rest))).otherwise(0.0)
    weight = (F.col("rest") + prior) / (F.col("total") + prior)
    stays = gain > 0.5 * (F.col("kinds") + 1) * F.log(F.col("total") + 1)
    by = by.select("context", "n_context", "total", F.log(weight).alias("back"), stays.alias("stays"))
    both = rows.join(by.select("context", "total", "back", "stays"), "context")
    p = F.log(F.col("n") / (F.col("total") + prior) + F.exp(F.col("back") + F.col("below")))
    return by, both.withColumn("p", p).drop("total")


class Tree:
    """The part of the tree that is broadcast, and the bitmap of all other weights.

    known, n1: sorted codes and counts of symbols; pairs: sorted keys of pairs, which hold the places of their symbols;
    weights: (kind, k, w) of these symbols and pairs as contexts, of the pairs, and of triples, whose key holds the place
    of the first pair and the last symbol. A symbol's log probability is its base, and the weights of its pair and triple
    and of the contexts before it; what has no weight has 0.
    """

    def __init__(self, total: int, distinct: int, known, n1, pairs, weights, bits):
        kind, k, w = weights
        self.total, self.known, self.pairs, self.bits = total, known, pairs, bits
        self.space = float(np.log(total + distinct + 1))
        self.base = np.log(n1 + 1.0) - self.space
        self.back1, self.stays1 = np.zeros(len(known)), np.zeros(len(known), bool)
        self.back2, self.stays2, self.w2 = np.zeros(len(pairs)), np.zeros(len(pairs), bool), np.zeros(len(pairs))
        at = k[kind == _CONTEXT1]
        self.back1[at], self.stays1[at] = w[kind == _CONTEXT1], True
        self.w2[pairs.searchsorted(k[kind == _PAIR])] = w[kind == _PAIR]
        at = pairs.searchsorted(k[kind == _CONTEXT2])
        self.back2[at], self.stays2[at] = w[kind == _CONTEXT2], True
        order = np.argsort(k[kind == _TRIPLE])
        self.triples, self.w3 = k[kind == _TRIPLE][order], w[kind == _TRIPLE][order]
        self.find2, self.find3 = Finder(pairs), Finder(self.triples)

    def _places(self, s, ends):
        key, ok = pair_keys(s)
        pair = self.find2(key, ok)
        before, key3, ok3 = triple_keys(s, pair, ends)
        return key, ok, pair, before, key3, ok3, self.find3(key3, ok3)

    def score(self, s: np.ndarray, ends: np.ndarray, places=None) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms for each symbol but the first: (score, base), lacking log(count + 1) of rare symbols and the weights of `others`."""
        last = s[1:]
        frequent = last >= 0
        root = np.full(len(last), -self.space)
        root[frequent] = self.base[last[frequent]]
        _, _, pair, before, _, _, triple = places or self._places(s, ends)
        out = root.copy()
        for at, w, x in ((s[:-1], self.back1, s[:-1]), (pair, self.w2, pair), (before, self.back2, before), (triple, self.w3, triple)):
            at = np.flatnonzero(at >= 0)
            out[at] += w[x[at]]
        return out, root

    def others(self, s: np.ndarray, ends: np.ndarray, places) -> tuple[np.ndarray, np.ndarray]:
        """(place among all symbols but the first, salted key) of n-grams that may have a weight which is not broadcast."""
        if self.bits is None:
            return _NONE, _NONE
        key, ok, pair, before, key3, ok3, triple = places
        ids = pair_ids(s, key, ok)
        inside = preceding(np.ones(len(ids), bool), ends, False)
        first = preceding(ids, ends, 0)
        third = np.where(ok3, key3, join_keys(first, ids))
        spots, keys = [], []
        for where, k, kind in ((s[:-1] < 0, s[:-1], _CONTEXT1), (pair < 0, ids, _PAIR), (inside & (before < 0), first, _CONTEXT2), (inside & (triple < 0), third, _TRIPLE)):
            at = np.flatnonzero(where)
            k = salted(k[at], kind)
            hit = listed(self.bits, k)
            spots.append(at[hit])
            keys.append(k[hit])
        return np.concatenate(spots), np.concatenate(keys)


def score_texts(shared):
    names = ["row", "score", "base", "n", "known", "rare", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes = _codes(model.known)
        for batch in pieces(batches):
            s, ends = codes.stream(batch.column(1).to_pylist())
            if not len(ends):
                continue
            places = model._places(s, ends)
            score, base = model.score(s, ends, places)
            starts = np.concatenate([[0], ends[:-1]])
            rare = s[1:] < 0
            size = np.concatenate([[0], np.cumsum(rare)])
            lists = pa.ListArray.from_arrays(pa.array(size[np.concatenate([[0], ends])].astype(np.int32)), pa.array(s[1:][rare]))
            sums = [pa.array(np.add.reduceat(x, starts)) for x in (score, base)]
            n = ends - starts
            known = n - np.add.reduceat(rare.astype(np.int64), starts)
            spots, keys = model.others(s, ends, places)
            of = np.searchsorted(ends, spots, side="right")
            size = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ends)))])
            more = pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), pa.array(keys[np.argsort(of, kind="stable")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, pa.array(n), pa.array(known), lists, more], names)

    return run


def floor_of(counts: DataFrame, least: int, most: int) -> int:
    """The smallest of least, 2 * least, 4 * least ... such that at most `most` rows of counts(n) reach it."""
    step = F.floor(F.log2(F.col("n") / F.lit(float(least))) + 1e-9).cast("int")
    rows = counts.where(F.col("n") >= least).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()  # one row a power of two
    found, total = {r["step"]: r["rows"] for r in rows}, 0
    for k in sorted(found, reverse=True):
        total += found[k]
        if total > most:
            return least << (k + 1)
    return least


def _numpy(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of a table that has a proven bound."""
    got = df.toArrow()
    k, n = got.column("k").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(k)
    return k[order], n[order]


def fit(texts: DataFrame, min_count: int = MIN_COUNT, most: int = MOST, prior: float = PRIOR) -> tuple[Tree, DataFrame]:
    """The tree and the table of all symbol counts (k, n) of texts(raw)."""
    tree, counts, _ = learn(texts, min_count, most, prior)
    return tree, counts


def learn(texts: DataFrame, min_count: int, most: int, prior: float = PRIOR) -> tuple[Tree, DataFrame, DataFrame]:
    """The part of the tree that is broadcast, the symbol counts (k, n), and the weights (k, w) of the rest of the tree."""
    share = texts.sparkSession.sparkContext.broadcast
    counts = materialize(texts.mapInArrow(count_symbols, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "pst-symbols")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    often, f1 = F.col("n") >= min_count, floor_of(counts, min_count, min(most, _MASK))
    known, n1 = _numpy(counts.where(F.col("n") >= f1))
    symbols = counts.where(often).mapInArrow(placed(share(Finder(known))), "k long, n long")

    def counted(pairs, bits) -> DataFrame:
        rows = texts.mapInArrow(count_contexts(share((known, pairs, bits))), COUNTED)
        return rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("a").alias("a"), F.max("b").alias("b")).where(often)

    pairs = counted(None, bitmap(counts.where(often & (F.col("n") < f1)).select("k")))
    a, b = F.coalesce("a", F.shiftright("k", _SHIFT)), F.coalesce("b", F.col("k").bitwiseAND(F.lit(_MASK)))
    pairs = materialize(pairs.select("k", "n", a.alias("context"), b.alias("last")), "pst-pairs")
    space = float(np.log(total + distinct + 1))
    base = symbols.select(F.col("k").alias("last"), (F.log(F.col("n") + F.lit(1.0)) - space).alias("below"))
    rows = pairs.join(symbols.select(F.col("k").alias("context"), F.col("n").alias("n_context")), "context").join(base, "last")
    ones, twos = follow(rows, prior)
    ones, twos = materialize(ones, "pst-ones"), materialize(twos, "pst-twos")

    f2 = floor_of(pairs, f1, min(most, _MASK))
    heavies, _ = _numpy(pairs.where(F.col("n") >= f2))
    salt = pairs.where(F.col("n") < f2).select(F.lit(_PAIR).cast("long").alias("kind"), "k", F.lit(0.0).alias("w")).mapInArrow(salt_keys, "k long, w double")
    triples = counted(Finder(heavies), bitmap(salt.select("k"))).mapInArrow(unpacked(share(heavies)), COUNTED)
    triples = materialize(triples.select("k", "n", F.col("a").alias("context"), F.col("b").alias("suffix")), "pst-triples")
    rows = triples.join(pairs.select(F.col("k").alias("context"), F.col("n").alias("n_context")), "context")
    contexts, threes = follow(rows.join(twos.select(F.col("k").alias("suffix"), F.col("p").alias("below")), "suffix"), prior)
    contexts = materialize(contexts.where("stays"), "pst-contexts")

    # the suffix of a retained context stays too
    up = contexts.join(pairs.select(F.col("k").alias("context"), "last"), "context").select(F.col("last").alias("context")).distinct()
    stay = ones.where("stays").select("context").union(up).distinct()
    weight = lambda df, kind, k, n, w: df.select(F.lit(kind).cast("long").alias("kind"), F.col(k).alias("k"), F.col(n).alias("n"), w.alias("w"))
    more = F.col("p") - F.col("back") - F.col("below")
    weights = materialize(
        union_all([
            weight(ones.join(stay, "context"), _CONTEXT1, "context", "n_context", F.col("back")), weight(twos.join(stay, "context"), _PAIR, "k", "n", more),
            weight(contexts, _CONTEXT2, "context", "n_context", F.col("back")), weight(threes.where("stays"), _TRIPLE, "k", "n", more),
        ]), "pst-weights",
    )
    f3 = floor_of(triples, f2, most)
    heavy = F.col("n") >= F.when(F.col("kind") == _CONTEXT1, f1).when(F.col("kind") == _TRIPLE, f3).otherwise(f2)
    others = materialize(weights.where(~heavy).select("kind", "k", "w").mapInArrow(salt_keys, "k long, w double"), "pst-others")
    got = weights.where(heavy).select("kind", "k", "w").toArrow()
    return Tree(total, distinct, known, n1, heavies, [got.column(c).to_numpy() for c in range(3)], bitmap(others.select("k"))), counts, others


def score_documents(docs: DataFrame, held_out, min_count: int = MIN_COUNT, most: int = MOST) -> DataFrame:
    """Score docs(doc_id, text), learning from the rows where held_out is false."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("raw"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    tree, counts, others = learn(rows.where(~F.col("held_out")).select("raw"), min_count, most)
    shared = spark.sparkContext.broadcast(tree)
    kind = "row struct<doc_id: bigint, held_out: boolean, row: bigint>, score double, base double, n long, known long, rare array<long>, more array<long>"
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.monotonically_increasing_id().alias("row")).alias("row")
    scored = materialize(rows.select(row, "raw").mapInArrow(score_texts(shared), kind), "pst-scored")
    rare = scored.select("row.row", F.explode("rare").alias("k")).join(counts, "k").select("row", F.log(F.col("n") + F.lit(1.0)).alias("add"))
    by_row = rare.groupBy("row").agg(F.sum("add").alias("add"), F.count("add").alias("m")).withColumnRenamed("row", "id")
    joined = scored.select("row", "score", "base", "n", "known").withColumn("id", F.col("row.row")).join(by_row, "id", "left")
    if tree.bits is not None:
        found = scored.select("row.row", F.explode("more").alias("k")).join(others, "k")
        joined = joined.join(found.groupBy(F.col("row").alias("id")).agg(F.sum("w").alias("more")), "id", "left")
    else:
        joined = joined.withColumn("more", F.lit(0.0))
    ten = F.lit(float(np.log(10)))
    add = F.coalesce("add", F.lit(0.0))
    score = F.col("score") + add + F.coalesce("more", F.lit(0.0))
    return joined.select(
        "row.doc_id", "row.held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("m", F.lit(0))).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"), ((F.col("base") + add) / ten).alias("base_score"), (score / ten).alias("score"),
    )


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fold_mod("doc_id", 7) == 2)
