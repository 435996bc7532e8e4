"""The features of tagging.features for whole texts in Arrow batches: no row a token, so nothing is shuffled, joined or gathered.

Patterns over texts are found in the JVM, which gives tokens and spans. What a token says of itself (word classes, its key in the
gazetteer) is worked out once for each distinct token; neighbours, spans and phrases are places in flat arrays over a slice's texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators import tagging as B

#: Texts and tokens that are taken from a record batch at a time (one text at least), and distinct tokens whose classes a task keeps.
ROWS, TOKENS, KEPT = 1024, 262_144, 200_000
#: Two characters that each pattern may begin with; other places are passed over before it is tried.
_SPANS = {
    "cite": P.LEGAL_VI.quick_citation,
    "art": P.ahead(["cá", "đi", "kh"]) + f"(?:{P.ARTICLE_UNIT})",
    "law": P.ahead(["bl", "bộ", "lu", "ng", "th", "ph", "án"]) + f"(?:{P.LAW_NAME})",
}
_NUMBERISH, _YEAR, _MARK = regex.compile(r"\p{Nd}{1,4}[a-zA-ZđĐ]?"), regex.compile(r"(?:19|20)\p{Nd}{2}"), regex.compile(r"[^\p{L}\p{N}_\p{White_Space}]")
_PLAIN, _UNIT, _TYPO = regex.compile("[A-Za-z0-9_]+"), regex.compile(r"(?i)\b(điều|khoản|điểm)(?=\p{Nd})"), regex.compile(r"(?i)\bđê(?=\p{Nd})")
_YEAR_WORD, _OTHER = regex.compile(r"\bnăm\b"), regex.compile(r"[^\p{L}\p{N}_\p{White_Space}/-]")
#: A blank of the patterns is one of these alone, so all other characters stand in tokens.
_BLANKS = [9, 10, 11, 12, 13, 32]
#: Stands around matches; a text that has it takes a slower way.
_BETWEEN = "\uffff"


def token_key(token: str) -> str:
    """normalize_key of one token of a text in normal form."""
    if _PLAIN.fullmatch(token):
        return token.lower()
    x = _TYPO.sub("Điều ", _UNIT.sub(r"\1 ", token)).lower()
    return " ".join(_OTHER.sub(" ", _YEAR_WORD.sub(" ", x)).split())


class Phrases:
    """Phrases as a tree of their words, whose branches are sorted arrays."""

    def __init__(self, phrases: list[str]):
        self.words: dict[str, int] = {}
        edges: dict[tuple[int, int], int] = {}
        ends = [False]
        for phrase in phrases:
            at = 0
            for w in phrase.split(" "):
                at = edges.setdefault((at, self.words.setdefault(w, len(self.words))), len(ends))
                if at == len(ends):
                    ends.append(False)
            ends[at] = True
        keys = np.array([a * len(self.words) + w for a, w in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to, self.ends = keys[order], np.array(list(edges.values()), np.int64)[order], np.array(ends)

    def hits(self, words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[JON-5] (a phrase begins here, a phrase stands here) for word numbers (-1: in no phrase) and the end of each word's text."""
        begin, cover, depth = np.zeros(len(words), bool), np.zeros(len(words) + 1, np.int64), 0
        at = np.flatnonzero(words >= 0) if len(self.keys) else np.zeros(0, np.int64)
        node = np.zeros(len(at), np.int64)
        while len(at):
            inside = at + depth < last[at]
            at, node = at[inside], node[inside]
            word = words[at + depth]
            key = np.where(word >= 0, node * len(self.words) + word, -1)
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[spot] == key
            at, node, depth = at[on], self.to[spot[on]], depth + 1
            done = at[self.ends[node]]
            begin[done] = True
            cover[done] += 1
            cover[done + depth] -= 1
        return begin, np.cumsum(cover[:-1]) > 0


class Kinds:
    """What tokens say of themselves: nine features, near words (unit, law) and the word number in the phrases."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.known = phrases, {}

    def of(self, token: str) -> tuple:
        got = self.known.get(token)
        if got is None:
            low = token.lower()
            clean = low if token.isalnum() else token.strip(".,;:()[]{}“”\"'`").lower()
            got = (
                _NUMBERISH.fullmatch(clean) is not None, _YEAR.fullmatch(clean) is not None, clean == "điều", clean == "khoản", clean == "điểm",
                clean in B._LAW_WORDS or clean in B._CASE_WORDS, low in P.SHORT_NAMES, clean in B._LINKS, _MARK.fullmatch(token) is not None,
                clean in B._UNITS, clean in B._LAW_WORDS, self.phrases.words.get(token_key(token), -1),
            )
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[token] = got
        return got


def slices(batches: Iterator[pa.RecordBatch], items: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows and TOKENS items, or of one row."""
    for batch in batches:
        ends, at = np.cumsum(batch.column(items).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            most = TOKENS + (ends[at - 1] if at else 0)
            to = min(max(int(np.searchsorted(ends, most, "right")), at + 1), at + ROWS)
            yield batch.slice(at, to - at)
            at = to


def _near(flag: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """[JON-7, WIN-4]"""
    sums, at = np.concatenate([[0], np.cumsum(flag)]), np.arange(len(flag))
    return sums[np.minimum(at + window + 1, last)] > sums[np.maximum(at - window, first)]


def _within(starts: np.ndarray, ends: np.ndarray, parts: pa.ListArray) -> np.ndarray:
    """[JON-6] Tokens that overlap a span; parts: the lengths of gaps and spans of each text in turn, a gap first."""
    n = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    length = parts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    to = np.cumsum(length)
    hit = (np.arange(len(length)) - np.repeat(np.cumsum(n) - n, n)) % 2 == 1
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, np.searchsorted(ends, (to - length)[hit], "right"), 1)
    np.add.at(cover, np.searchsorted(starts, to[hit], "left"), -1)
    return np.cumsum(cover[:-1]) > 0


def described(batch: pa.RecordBatch, kinds: Kinds) -> np.ndarray:
    """[tokens, 16]: FEA-1 of all tokens of a batch's texts (text, tokens, lengths of gaps and spans)."""
    tokens = batch.column("tokens")
    n = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    said = coded.dictionary.to_pylist()
    table = np.array([kinds.of(t) for t in said], np.int64).reshape(-1, 12)[codes]
    last = np.repeat(np.cumsum(n), n)
    first = last - np.repeat(n, n)
    # the tokens of a text are all its characters but blanks, in order, so their lengths give their places
    texts = batch.column("text").to_pylist()
    solid = np.flatnonzero(~np.isin(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), _BLANKS))
    length = np.array([len(t) for t in said], np.int64)[codes]
    if length.sum() != len(solid):
        raise ValueError("tokens are not the characters of their texts")
    starts = solid[np.cumsum(length) - length]
    ends = starts + length
    begin, inside = kinds.phrases.hits(table[:, 11], last)
    spans = [_within(starts, ends, batch.column(k)) for k in _SPANS]
    near = [_near(table[:, k], first, last, w) for k, w in ((9, 3), (10, 4))]
    return np.column_stack([*table[:, :9].T, *spans, begin, inside, *near]).astype(np.int8)


def _parts(c: Column, pattern: str) -> Column:
    """Lengths of the gaps and matches of a text in turn, a gap first and last. The pattern runs once: its matches are put between marks."""
    found = T.match_spans(c, pattern)
    before = lambda s, i: s["start"] - F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
    slow = F.concat(F.flatten(F.transform(found, lambda s, i: F.array(before(s, i), s["end"] - s["start"]))), F.array(F.length(c) - F.coalesce(F.try_element_at(found, F.lit(-1))["end"], F.lit(0))))
    quick = F.transform(F.split(F.regexp_replace(c, pattern, f"{_BETWEEN}$0{_BETWEEN}"), _BETWEEN, -1), F.length)
    return F.when(F.contains(c, F.lit(_BETWEEN)), slow).otherwise(quick)


def beside(norm: DataFrame, phrases: list[str], key: str) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """norm(key, text) in the tagger's normal form as (rows, step): step makes (key, text, tokens, features) of the rows' record batches."""
    rows = norm.select(key, "text", T.tokens(F.col("text")).alias("tokens"), *(_parts(F.col("text"), p).alias(k) for k, p in _SPANS.items()))
    sent = norm.sparkSession.sparkContext.broadcast(Phrases(phrases))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, width = Kinds(sent.value), len(B.FEATURES)
        for batch in slices(batches, "tokens"):
            made, n = described(batch, kinds), batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, width), pa.int32()), pa.array(made.reshape(-1)))
            features = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("text"), batch.column("tokens"), features], [key, "text", "tokens", "features"])

    return rows, step
