"""Texts and the titles whose word sets they are most like: a set-similarity join, for the best match or above a threshold.

F1 of two word sets of sizes n and m with c words in common is 2c / (n + m). A title's words are ordered rarest first, by the number
of texts they occur in. A text and a title whose first common word, in that order, is the title's j-th have at most m - j words in
common, so a word at place j is of use only where 2 * min(n, m - j) / (n + m) can still reach what is asked for: the threshold, or the
best that the text has found already. Common words stand last in their titles, and that bound stops them.

The bound is applied before pairs exist: each word carries the few (m, j) it has in titles, a text keeps those that can still win, and
only these meet titles. Candidates of a text are gathered as sets, in slots of bounded size, beside the text's own words, and counted
there; no rows are dealt by (text, title).

A dictionary of few words needs none of that: its postings go to every task, and a batch of texts counts the words it shares with each
title in place, so nothing but the texts' own words moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions import text as T
from lawmill.sources import scratch

#: Titles are broadcast up to this many words in all, which are counted first; beyond it joins on words shuffle, and AQE splits hot words.
MOST_BROADCAST = 2_000_000
#: Titles of up to this many words in all are counted beside the texts.
MOST_COUNTED = 200_000
#: Counters of one pass over a batch of texts: texts times titles.
COUNTERS = 1 << 20
#: Titles of one slot, so a gathered set has at most as many.
SLOT = 4096
#: The share of a title's words, rarest first, that finds a first match.
FIRST = 1 / 3


def word_sets(titles: DataFrame, title: str) -> DataFrame:
    """(tw): the distinct word sets of titles, empty ones left out."""
    return titles.where(F.col(title).isNotNull()).select(F.array_sort(F.array_distinct(T.words(F.col(title)))).alias("tw")).where(F.size("tw") > 0).distinct()


def counted(texts: DataFrame, sets: list[list[str]]) -> DataFrame:
    """(k, f): the best F1 of each of texts(k, w) over all sets, by counts of common words."""
    vocabulary = {w: i for i, w in enumerate({w for tw in sets for w in tw})}
    posted: list[list[int]] = [[] for _ in vocabulary]
    for y, tw in enumerate(sets):
        for w in tw:
            posted[vocabulary[w]].append(y)
    n = np.array([len(x) for x in posted], np.int64)
    shared = texts.sparkSession.sparkContext.broadcast((list(vocabulary), n, np.cumsum(n) - n, np.array([y for x in posted for y in x], np.int64), np.array([len(tw) for tw in sets], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, first, posted, m = shared.value
        known, step = pa.array(words, pa.string()), max(1, COUNTERS // len(m))
        for batch in batches:
            best = [np.zeros(0)]
            for i in range(0, batch.num_rows, step):
                lists = batch.column("w").slice(i, step)
                size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                at = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy(zero_copy_only=False)
                row, at = np.repeat(np.arange(len(size)), size)[at >= 0], at[at >= 0]
                # every posting of every known word: a run of numbers from the word's first posting on
                many = n[at]
                spot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at], many)
                c = np.bincount(np.repeat(row, many) * len(m) + posted[spot], minlength=len(size) * len(m)).reshape(len(size), len(m))
                p, r = c / np.maximum(size, 1)[:, None], c / m
                best.append(np.where(c > 0, 2 * p * r / np.where(c > 0, p + r, 1.0), 0.0).max(1))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(np.concatenate(best), pa.float64())], ["k", "f"])

    return texts.select("k", "w").mapInArrow(run, f"k {texts.schema['k'].dataType.simpleString()}, f double")


class TitleIndex:
    """Distinct word sets of titles, their words rarest first, and the classes (m, j) of each word; written once."""

    def __init__(self, titles: DataFrame, texts: DataFrame, title: str):
        sets = scratch.written(word_sets(titles, title).select(F.monotonically_increasing_id().alias("y"), "tw"), "title-sets")
        n, words = sets.agg(F.count(F.lit(1)), F.sum(F.size("tw"))).first()
        self.slots, self.small = -(-n // SLOT) or 1, (words or 0) <= MOST_BROADCAST
        posted = sets.select("y", "tw", F.explode("tw").alias("word"))
        known = posted.select("word").distinct()
        seen = texts.select(F.explode("w").alias("word")).join(self.sent(known), "word").groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
        ranked = posted.join(seen, "word", "left").groupBy("y").agg(F.first("tw").alias("tw"), F.array_sort(F.collect_list(F.struct(F.coalesce("cnt", F.lit(0)).alias("cnt"), "word"))).alias("r"))
        rows = ranked.select("y", "tw", F.size("tw").alias("m"), F.posexplode("r").alias("j", "r")).select("y", "tw", "m", "j", "r.word")
        self.rows = scratch.written(rows, "title-words")
        self.classes = scratch.written(self.rows.select("word", "m", "j").distinct(), "title-classes")

    def sent(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def candidates(texts: DataFrame, index: TitleIndex, usable) -> DataFrame:
    """(x, y, tw): pairs that a usable class finds, for texts(x, n, w, low) and a condition on m, j, n and low that tells which can still win."""
    words = texts.select("x", "n", "low", F.explode("w").alias("has"))
    kept = words.join(index.sent(index.classes), (F.col("has") == F.col("word")) & usable).select("x", "word", "m", "j")
    return kept.join(index.sent(index.rows), ["word", "m", "j"]).select("x", "y", "tw")


def verified(texts: DataFrame, pairs: DataFrame, index: TitleIndex) -> DataFrame:
    """(x, f): the best F1 of each text's candidates, counted beside the text's words."""
    sets = pairs.groupBy("x", F.pmod(F.xxhash64("y"), F.lit(index.slots)).alias("slot")).agg(F.collect_set("tw").alias("tws"))
    score = lambda t: T.law_f1(F.size(F.array_intersect(t, "w")), F.col("n"), F.size(t))
    best = sets.join(texts.select("x", "n", "w"), "x").select("x", F.array_max(F.transform("tws", score)).alias("f"))
    return best.groupBy("x").agg(F.max("f").alias("f"))


def most() -> Column:
    """The largest F1 that a title of m words can have with a text of n words if its j-th word is the first in common."""
    return 2 * F.least(F.col("n"), F.col("m") - F.col("j")) / (F.col("n") + F.col("m"))


#: What rounding may take from a bound.
_SLACK = 1e-9


def best_title(laws: DataFrame, titles: DataFrame, key: str, law: str = "law", title: str = "title", least: float = 0.0) -> DataFrame:
    """[JON-1, AGG-15] (key, best_f1) for each row of laws: the largest word-set F1 of any title, 0.0 if no word is shared.

    With `least`, a best below it comes out as 0.0, and nothing that cannot reach it is looked at. Null texts and titles have no
    words; rows that share a key are scored each on its own; without titles all scores are 0.0.
    """
    words = F.array_distinct(T.words(T.safe_text(F.col(law))))
    made = laws.select(F.monotonically_increasing_id().alias("x"), F.col(key).alias("k"), words.alias("w"))
    sets = word_sets(titles, title)
    if 0 < (sets.agg(F.sum(F.size("tw"))).first()[0] or 0) <= min(MOST_COUNTED, MOST_BROADCAST):
        # dealt by row, so that a table of few files keeps all tasks busy
        dealt = laws.select(F.monotonically_increasing_id().alias("x"), F.col(key).alias("k"), F.col(law).alias("law")).repartition("x")
        found = counted(dealt.select("k", F.array_distinct(T.words(T.safe_text(F.col("law")))).alias("w")), [r["tw"] for r in sets.collect()])
        return found.select(F.col("k").alias(key), F.when(F.col("f") >= F.lit(least), F.col("f")).otherwise(0.0).alias("best_f1"))
    texts = scratch.written(made, "title-texts")
    index = TitleIndex(titles, texts, title)
    sized = texts.select("x", F.size("w").alias("n"), "w")
    low = F.col("low")
    if least > 0:
        best = verified(sized, candidates(sized.withColumn("low", F.lit(least)), index, most() >= low - _SLACK), index).where(F.col("f") >= least)
    else:
        # a first match by the rarest words; then only what can beat it, by the words after those
        rare = F.col("j") < F.ceil(F.col("m") * F.lit(FIRST))
        first = scratch.written(verified(sized, candidates(sized.withColumn("low", F.lit(0.0)), index, rare), index), "title-first")
        asked = sized.join(first, "x", "left").select("x", "n", "w", F.coalesce("f", F.lit(0.0)).alias("low"))
        more = candidates(asked, index, ~rare & (most() > low + _SLACK))
        best = first.unionByName(verified(sized, more, index)).groupBy("x").agg(F.max("f").alias("f"))
    return texts.select("x", F.col("k").alias(key)).join(best, "x", "left").select(key, F.coalesce("f", F.lit(0.0)).alias("best_f1"))
