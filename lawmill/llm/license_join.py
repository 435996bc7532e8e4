"""License scans by an exact set-similarity join, in DataFrame operations only.

A block is any run of consecutive words, whatever the line ends, a quarter longer than a template (`width`); it matches
the template if it contains at least `threshold` of the template's distinct words. The join that finds every such pair:
words of templates are ordered by the number of documents they occur in, rarest first, over the whole corpus; a block and
a template that share a (the least overlap) words must share one among the first |T| - a + 1 words of the template (prefix
filter), so only the blocks around places of such words are looked at; if these together have fewer than a template words,
none can match (length filter); and a first common word so late in either that less than a could follow is passed over
(positional filter). What is left is verified, block by block.

Templates are a fixed list, so their vocabulary, which alone is gathered and broadcast, does not grow with the data.
Base phrases are found as consecutive words in the same normalised text.

Nulls and empty texts have no words, no places and score 0; rows are told apart by position, so equal rows and null
ids stay; a place in every document has its word number counted from 0 in the whole text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm.common import ascii_lower, materialize, table

#: Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Own templates: label and notice.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "this work has been dedicated to the public domain under cc0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
]
THRESHOLD = 0.9
#: What separates words once A-Z are lowered.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalized(text: Column) -> Column:
    """Words joined by single blanks, or the empty string."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BREAK, " "))


def blanks(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def places(padded: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(number, first and last start) of a phrase's places in ' w1 w2 ... '."""
    key = f" {phrase} "
    found = padded.contains(key)
    n = F.when(found, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long")
    first = F.when(found, blanks(F.substring_index(padded, key, 1)))
    last = F.when(found, n_words - blanks(F.substring_index(padded, key, -1)) - len(phrase.split()))
    return n, first, last


def width(text: str) -> int:
    """Words of a block for a template."""
    n = len(text.split())
    return n + max(2, n // 4)


def word_ranks(norm: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents with each word, rarest first, ties by the word."""
    mine = F.array(*map(F.lit, vocabulary))
    hits = norm.select(F.explode(F.array_intersect(F.split("norm", " "), mine)).alias("w"))
    seen = {r["w"]: r["n"] for r in hits.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for docs(doc_id, text)."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(text.split())), width(text)) for label, text in templates]
    reach = max(w for _, _, w in sets) - 1
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranks = word_ranks(texts.select(normalized(F.col("text")).alias("norm")), sorted({w for _, s, _ in sets for w in s}))
    rank = {w: i for i, w in enumerate(ranks)}
    rows, prefix = [], set()
    for k, (label, words, size) in enumerate(sets):
        words = sorted(words, key=rank.__getitem__)
        least = math.ceil(threshold * len(words) - 1e-9)
        for i, w in enumerate(words[: len(words) - least + 1]):
            rows.append((rank[w], i, k, label, len(words), least, size, words))
            prefix.add(w)
    index = spark.createDataFrame(rows, "w int, i int, template int, label string, size int, least int, width int, words array<string>")
    some = "|".join(sorted(map(re.escape, prefix)))

    # one scan: counts and base places of every text, and the words around each that can begin a match
    found = texts.select("doc_id", normalized(F.col("text")).alias("norm"))
    n_words = F.when(F.col("norm") == "", F.lit(0)).otherwise(blanks(F.col("norm")) + 1).cast("long")
    found = found.select("doc_id", "norm", n_words.alias("n_words"), F.concat(F.lit(" "), "norm", F.lit(" ")).alias("padded"))
    words = F.split("norm", " ")
    spots = F.array_compact(F.transform(words, lambda x, i: F.when(x.isin(sorted(prefix)), i)))
    spots = F.when(F.col("padded").rlike(f" (?:{some}) "), spots)
    got = [places(F.col("padded"), F.col("n_words"), p) for p, _ in PHRASES]
    own = F.array(*(F.when(n > 0, F.lit(label)) for (n, _, _), (_, label) in zip(got, PHRASES, strict=True)))
    base = found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", sum((n for n, _, _ in got), F.lit(0).cast("long")).alias("n_base"),
        F.least(*(f for _, f, _ in got)).alias("first_word"), F.greatest(*(x for _, _, x in got)).alias("last_word"),
        F.array_sort(F.array_compact(own)).alias("base"), spots.alias("spots"), F.when(F.size(spots) > 0, words).alias("words"),
    )
    base = materialize(base, "license-base")

    # template words around each such place as ranks, rarest first; the join runs over the word at the place
    ranked = F.create_map(*[F.lit(x) for w in ranks for x in (w, rank[w])])
    known = F.array_intersect("near", F.array(*map(F.lit, ranks)))
    first = F.greatest(F.col("spot") - reach, F.lit(0))
    near = F.slice("words", first + 1, F.col("spot") - first + reach + 1)
    blocks = base.where(F.size("spots") > 0).select("row", "words", F.explode("spots").alias("spot"))
    blocks = blocks.select("row", (F.col("spot") - first + 1).alias("at"), near.alias("near"))
    blocks = blocks.withColumn("tokens", F.array_sort(F.transform(known, lambda w: F.element_at(ranked, w))))
    probes = blocks.withColumn("w", F.element_at(ranked, F.element_at("near", F.col("at"))))
    n, j = F.size("tokens"), F.array_position("tokens", F.col("w")) - 1
    probes = probes.select("row", "at", "near", "w", n.alias("n"), j.cast("int").alias("j"))
    pairs = probes.join(
        F.broadcast(index.withColumnRenamed("w", "v")),  # a row for each prefix word of each template
        (F.col("w") == F.col("v")) & (F.col("n") >= F.col("least")) & (F.least(F.col("size") - F.col("i"), F.col("n") - F.col("j")) >= F.col("least")),
    )
    pairs = pairs.where(F.size(F.array_intersect("near", "words")) >= F.col("least"))
    starts = F.sequence(F.greatest(F.col("at") - F.col("width") + 1, F.lit(1)), F.col("at"))
    overlap = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(F.slice("near", s, F.col("width")), "words"))))
    matched = pairs.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("least"))
    share = F.col("overlap") / F.col("size")
    labels = matched.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(share).alias("share"))  # as many labels as templates
    both = base.drop("spots", "words").join(labels, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), score.alias("score"),
    )


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
