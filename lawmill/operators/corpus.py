"""Vocabularies, counts, splits, ids, exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions import text as T
from lawmill.sources.scratch import written

PAD, UNKNOWN = 0, 1


def numbered(rows: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """rows with a long column name that counts them in order: range partitions, their sizes, then offsets; no single task.

    The sorted rows are written once, since a range partitioning that runs twice may cut elsewhere. What is gathered is one
    row a partition.
    """
    at, part, row = "__at", "__part", F.monotonically_increasing_id()
    placed = rows.orderBy(*order).withColumn(part, F.shiftright(row, 33)).withColumn(at, row.bitwiseAND(F.lit((1 << 33) - 1)))
    placed, before, starts = written(placed, "numbered"), first, []
    for r in placed.groupBy(part).count().orderBy(part).collect():
        starts += [F.lit(r[part]), F.lit(before)]
        before += r["count"]
    start = F.element_at(F.create_map(*starts), F.col(part)) if starts else F.lit(first)
    return placed.withColumn(name, (start + F.col(at)).cast("long")).drop(part, at)


def mini_batches(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """[SMP-4] rows with batch: numbers of shuffled mini-batches of `size`, in the order of a seeded hash of the key."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return numbered(rows.withColumn("__h", h), ["__h", key], "batch").withColumn("batch", F.floor(F.col("batch") / size)).drop("__h")


def per_file(samples: DataFrame, name: str = "file_name") -> DataFrame:
    """[AGG-18] (name, n): samples of each file; their rows stay where they are, a file of many is never gathered."""
    return samples.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def word_counts(docs: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """[AGG-3, FLT-17] (token, cnt): every token and its lower case count, so lower-case tokens count twice."""
    t = docs.select(F.explode(T.tokens(F.col(text))).alias("t"))
    both = t.groupBy("t").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array("t", F.lower("t"))).alias("token"), "n")
    return both.groupBy("token").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= least)


def char_counts(docs: DataFrame, text: str = "text", least: int = 1, lines_too: bool = False) -> DataFrame:
    """[AGG-4] (ch, cnt) over tokens, and with lines_too over whole lines once more, blanks included."""
    words = docs.select(F.explode(T.tokens(F.col(text))).alias("x"))
    if lines_too:
        words = words.unionByName(docs.select(F.explode(T.lines(F.col(text), False)).alias("x")))
    parts = words.groupBy("x").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.split("x", "")).alias("ch"), "n").where("ch <> ''")
    return parts.groupBy("ch").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= least)


def vocabulary(counts: DataFrame, key: str, first: str | None = None, most: int | None = None) -> DataFrame:
    """[SRT-5, FLT-17] (key, id): ids from 2 by falling count, ties by first place (or by the key itself)."""
    order = [F.desc("cnt"), F.col(first or key)]
    ranked = counts.orderBy(*order).limit(most) if most else counts
    return numbered(ranked, order, "id", 2).select(key, F.col("id").cast("int").alias("id"))


def encode(tokens: Column, ids: Column, lower: bool = True) -> Column:
    """[JON-8] Ids of tokens in a map; the lower case stands in (not in snippet inference), else UNKNOWN."""
    one = lambda t: F.coalesce(ids[t], ids[F.lower(t)], F.lit(UNKNOWN)) if lower else F.coalesce(ids[t], F.lit(UNKNOWN))
    return F.transform(tokens, one)


def pad(ids: Column, size: int) -> Column:
    """[SCL-30]"""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), size)), 1, size)


def exact_duplicates(files: DataFrame, path: str, content: str) -> DataFrame:
    """[AGG-12, SCL-29] (md5, n, first_path) of contents that occur more than once.

    A hot content is counted before the shuffle; its paths are not gathered, dedup_plan() names them row by row.
    """
    keyed = files.select(F.md5(F.col(content).cast("binary")).alias("md5"), path)
    return keyed.groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("first_path")).where("n > 1")


def dedup_plan(files: DataFrame, path: str, content: str) -> DataFrame:
    """[AGG-13, SNK-14] (path, md5, action): keep the first path of each content, delete the others. Nothing is deleted."""
    keyed = files.select(path, F.md5(F.col(content).cast("binary")).alias("md5"))
    firsts = keyed.groupBy("md5").agg(F.min(path).alias("__first"))
    action = F.when(F.col(path) == F.col("__first"), "keep").otherwise("delete")
    return keyed.join(firsts, "md5").select(path, "md5", action.alias("action"))


def bucket(key: Column, seed: int) -> Column:
    """0 to 99 by hash of a name."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100))


def split(docs: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """[SMP-2, SMP-3] docs with split: train, val and test at 80 / 10 / 10 by hash of the name, so a name never straddles."""
    b = bucket(F.col(key), seed)
    return docs.withColumn("split", F.when(b < 80, "train").when(b < 90, "val").otherwise("test"))


def split_exact(names: list[str], seed: int = 42, sections: bool = False) -> dict[str, str]:
    """[SMP-2, SMP-3] The split of few names by the standard generator's shuffle, in the given order.

    Citations: ends at int(.8 n) and int(.9 n), and an empty val or test takes the last of what precedes it. Sections: at least one
    name to train and one more to val.
    """
    import random

    order = list(names)
    random.Random(seed).shuffle(order)
    n = len(order)
    a, b = (max(1, int(n * 0.8)), int(n * 0.9)) if sections else (int(n * 0.8), int(n * 0.9))
    b = max(a + 1, b) if sections else b
    train, val, test = order[:a], order[a:b], order[b:]
    if not sections:
        if not val and train:
            val = [train.pop()]
        if not test and train:
            test = [train.pop()]
    return dict.fromkeys(train, "train") | dict.fromkeys(val, "val") | dict.fromkeys(test, "test")


def sample_counts(samples: DataFrame, tags: str = "tags") -> DataFrame:
    """[AGG-7] Numbers of samples with and without a tag."""
    has = F.exists(tags, lambda t: t != "O")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return samples.agg(n(has).alias("positive"), n(~has).alias("negative"))


def line_stats(rows: DataFrame, name: str = "file_name", tag: str = "tag") -> DataFrame:
    """[AGG-8] documents, lines, positive lines."""
    return rows.agg(F.countDistinct(name).alias("documents"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.when(F.col(tag) != "O", 1).otherwise(0)).cast("long").alias("positives"))
