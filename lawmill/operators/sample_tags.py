"""Tokens of texts tagged from what is known of them: law names where they stand, article numbers at their first unused place.

Names are found by an Aho-Corasick automaton, which reports every place of every name, overlapping ones too, in one pass over a text;
places are token positions. All choices after that (the longest place of a name, the counted range, the first place of an article that
no other has) are folds over arrays in the JVM. `samples` does it for short labelled snippets, each with names of its own;
`document_tags` for texts of any length and one dictionary, with a row a token, so nothing grows with the square of a text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lawmill.functions import patterns as P
from lawmill.functions import text as T

PLACES = ArrayType(StructType([StructField(c, IntegerType()) for c in ("name", "first", "last", "size")]))
_TOKENS = regex.compile(P.TOKEN)
#: Characters of names that one automaton holds.
NAME_CHARS = 4_000_000
# ---- fixed values: words that speak for a law in a counted range; the article keyword and how far before a number it may stand
LAW_WORDS = ["luật", "bộ", "nghị", "định", "quyết", "thông", "tư", "pháp", "lệnh", *P.SHORT_NAMES]
UNIT, REACH = "điều", 8


class Names:
    """An automaton over the lower-cased forms of numbered names."""

    def __init__(self, forms: list[tuple[int, str]]):
        import ahocorasick

        owners: dict[str, list[int]] = {}
        for name, form in forms:
            if form:
                owners.setdefault(form.lower(), []).append(name)
        self.automaton = ahocorasick.Automaton()
        for form, names in owners.items():
            self.automaton.add_word(form, (len(form), names))
        if owners:
            self.automaton.make_automaton()
        self.some = bool(owners)

    def places(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(name, first and last token, characters) of every place that touches a token, by start, then length."""
        if not self.some or not text:
            return []
        hits = list(self.automaton.iter(text.lower()))
        spans = [m.span() for m in _TOKENS.finditer(text)] if hits else []
        starts, ends, out = [a for a, _ in spans], [b for _, b in spans], []
        for end, (size, names) in hits:
            first, last = bisect_right(ends, end + 1 - size), bisect_left(starts, end + 1) - 1
            if first <= last:
                out += [(end + 1 - size, size, n, first, last) for n in names]
        return [(n, a, b, size) for _, size, n, a, b in sorted(out)]


@F.pandas_udf(PLACES)
def own_places(text: pd.Series, forms: pd.Series) -> pd.Series:
    """[JON-9] Places of each row's own names: forms is an array of the forms of each name."""
    return pd.Series([Names([(k, f) for k, fs in enumerate(some) for f in fs]).places(t) for t, some in zip(text, forms, strict=True)])


def dictionary_places(names: list[tuple[int, str]], spark) -> Column:
    """[JON-9, SEM-7] A function of a text column: the longest place of each name of a broadcast dictionary, the first of equals."""
    sent = spark.sparkContext.broadcast(names)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = Names(sent.value)
        for batch in texts:
            yield batch.map(lambda t: longest_places(found.places(t)))

    return F.pandas_udf(run, PLACES)


def longest_places(places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    best: dict = {}
    for p in places:
        if p[0] not in best or p[3] > best[p[0]][3]:
            best[p[0]] = p
    return list(best.values())


def longest(places: Column) -> Column:
    """[SEM-7] The longest place of an array in order of start, the first of equals; null for none."""
    best = F.array_max(F.transform(places, lambda p, k: F.struct(p["size"].alias("size"), (-k).alias("k"), p.alias("p"))))
    return best["p"]


def counted_range(tokens: Column, first: Column, last: Column) -> Column:
    """[SEM-6, SRT-7] Of the four readings of a counted range, that with most law words, then the longest, then the first; null for none."""
    readings = F.array(*(F.struct((first - a).alias("first"), (last - b).alias("last"), F.lit(-k).alias("k")) for k, (a, b) in enumerate([(0, 0), (1, 1), (0, 1), (1, 0)])))
    good = F.filter(readings, lambda r: (r["first"] >= 0) & (r["first"] <= r["last"]) & (r["last"] < F.size(tokens)))

    def scored(r: Column) -> Column:
        said = F.lower(F.array_join(F.slice(tokens, r["first"] + 1, r["last"] - r["first"] + 1), " "))
        hits = sum((F.when(F.contains(said, F.lit(w)), 1).otherwise(0) for w in LAW_WORDS), F.lit(0))
        return F.struct((2 * hits + 0.01 * (r["last"] - r["first"] + 1)).alias("score"), r["k"].alias("k"), r.alias("r"))

    return F.array_max(F.transform(good, scored))["r"]


def article_places(clean: Column, article: Column) -> Column:
    """[JON-10] Tokens equal to the article after the keyword, or with it among the eight before: an array of (first, last)."""
    spots = F.filter(F.transform(clean, lambda t, i: F.when(t == article, i)), lambda i: i.isNotNull() & F.array_contains(F.slice(clean, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))), UNIT))
    return F.transform(spots, lambda i: F.struct((i - F.when(F.get(clean, i - 1) == UNIT, 1).otherwise(0)).alias("first"), i.alias("last")))


def first_unused(places: Column) -> Column:
    """[SEM-5] For each array of places in turn the first that none before has taken: a fold; arrays without one give nothing."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def step(taken: Column, some: Column) -> Column:
        free = F.filter(some, lambda p: ~F.array_contains(taken, p))
        return F.when(F.size(free) > 0, F.concat(taken, F.slice(free, 1, 1))).otherwise(taken)

    return F.aggregate(places, none, step)


def marks(spans: Column, label: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.lit(label).alias("label")))


def bio(tokens: Column, marked: Column) -> Column:
    """[SEM-8] BIO tags: of the marks that cover a token the last one counts."""

    def tag(_, i: Column) -> Column:
        m = F.try_element_at(F.filter(marked, lambda m: (m["first"] <= i) & (m["last"] >= i)), F.lit(-1))
        return F.coalesce(F.concat(F.when(m["first"] == i, "B-").otherwise("I-"), m["label"]), F.lit("O"))

    return F.when(F.size(marked) > 0, F.transform(tokens, tag)).otherwise(F.transform(tokens, lambda t: F.lit("O")))


def article_spans(tokens: Column, articles: Column) -> Column:
    named = F.array_distinct(F.filter(F.transform(articles, T.strip), lambda a: a != ""))
    # the clean tokens are bound: written out in the lambdas, they would be made anew at every place of an article
    spots = lambda clean: F.transform(named, lambda a: T.let(T.clean_token(a), lambda x: article_places(clean, x)))
    return T.let(F.transform(tokens, T.clean_token), lambda clean: first_unused(spots(clean)))


def tagged(rows: DataFrame) -> DataFrame:
    """rows(text, tokens, norms, given, articles, first, last) with tags: each law at its longest place, in its normal form or else as
    given; the counted range only if no law was found; articles overwrite them."""
    both = lambda c: F.array_distinct(F.array(T.strip(c), F.regexp_replace(T.strip(c), "[.,;: ]+$", "")))
    n = F.size("norms")
    # names 0 to n - 1 are the normal forms, n to 2n - 1 the names as given
    forms = F.concat(F.transform("norms", both), F.transform("given", both))
    found = rows.withColumn("__at", own_places("text", forms))
    of = lambda k: longest(F.filter("__at", lambda p: p["name"] == k))
    laws = F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(of(k), of(k + n))), lambda p: p.isNotNull())
    found = found.withColumn("__laws", F.when(n > 0, laws).otherwise(F.array().cast(PLACES)))
    counted = counted_range(F.col("tokens"), F.col("first"), F.col("last"))
    spans = F.when(F.size("__laws") > 0, marks(F.col("__laws"), "LAW")).when(counted.isNotNull(), marks(F.array(counted), "LAW")).otherwise(F.array().cast("array<struct<first:int,last:int,label:string>>"))
    found = found.withColumn("__marks", F.concat(spans, marks(article_spans(F.col("tokens"), F.col("articles")), "ART")))
    return found.withColumn("tags", bio(F.col("tokens"), F.col("__marks"))).drop("__at", "__laws", "__marks")


def samples(entries: DataFrame, unicode_form: bool = True) -> DataFrame:
    """[SEM-8, FLT-15] (file_name, entry_index, law_index, text, tokens, tags) of entries(input, output_raw, citations, …).

    Empty and null inputs, and those without tokens, give no sample; null lists and names are empty.
    """
    from lawmill.operators.labels import parse_first

    cited = F.coalesce("citations", F.array().cast("array<struct<articles:array<string>,law:string>>"))
    arts = F.flatten(F.transform(cited, lambda c: F.coalesce(c["articles"], F.array().cast("array<string>"))))
    rows = entries.where(F.coalesce("input", F.lit("")) != "").select(
        "file_name", "entry_index", "law_index", T.normalize_legal(F.col("input"), "tagger", unicode_form).alias("text"),
        F.transform(cited, lambda c: T.safe_text(c["law"])).alias("given"), F.filter(arts, lambda a: a.isNotNull()).alias("arts"), parse_first(F.coalesce("output_raw", F.lit(""))).alias("p"),
    )
    # all names of a row are composed in one call, parted by a character that no text holds
    whole = F.split(T.nfc(F.array_join("given", "\x00")), "\x00") if unicode_form else F.col("given")
    rows = rows.withColumn("norms", F.transform(whole, lambda g: T.normalize_legal(g, "tagger", False)))
    rows = rows.withColumn("norms", F.when(F.size("given") > 0, F.col("norms")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({"tokens": T.tokens(F.col("text")), "articles": F.concat("arts", "p.articles"), "first": F.col("p.law.first"), "last": F.col("p.law.last")}).where(F.size("tokens") > 0)
    return tagged(rows).select("file_name", "entry_index", "law_index", "text", "tokens", "tags")


def document_tags(docs: DataFrame, names: DataFrame, key: str, text: str = "text", articles: str | None = None) -> DataFrame:
    """[JON-9, JON-10, SEM-5, SEM-7] (key, pos, token, tag) of the tagged tokens of docs, for names(name int, form string).

    Each name marks its longest place in a text; of names that overlap the last counts, articles before all. The dictionary goes out
    in parts of at most NAME_CHARS characters, each a pass of its own. Keys must be unique; null texts have no tokens.
    """
    parts, size = [[]], 0
    for r in names.where("form is not null").select("name", F.trim("form").alias("form")).orderBy("name").toLocalIterator():  # a dictionary, taken in parts
        # the forms of a name stay together, since each part gives its longest place
        if size > NAME_CHARS and parts[-1][-1][0] != r["name"]:
            parts.append([])
            size = 0
        parts[-1].append((r["name"], r["form"]))
        size += len(r["form"])
    found = docs.select(key, F.col(text).alias("__text"), *([F.col(articles).alias("__arts")] if articles else []), T.tokens(F.col(text)).alias("__tokens"))
    spark, none = docs.sparkSession, F.array().cast(PLACES)
    found = found.withColumn("__at", F.concat(*(F.coalesce(dictionary_places(p, spark)("__text"), none) for p in parts)))
    if not articles:
        found = found.withColumn("__arts", none_of("string"))
    given = F.coalesce("__arts", none_of("string"))

    def spread(tokens: Column, mark: Column, rank: Column, label: str) -> Column:
        tag = lambda i: F.concat(F.when(i == mark["first"], "B-").otherwise("I-"), F.lit(label))
        return F.transform(F.sequence(mark["first"], mark["last"]), lambda i: F.struct(i.alias("pos"), F.get(tokens, i).alias("token"), rank.cast("long").alias("rank"), tag(i).alias("tag")))

    def every(tokens: Column) -> Column:
        laws = F.transform("__at", lambda p: spread(tokens, p, p["name"], "LAW"))
        arts = F.transform(article_spans(tokens, given), lambda p, k: spread(tokens, p, k + F.lit(1 << 40), "ART"))
        return F.flatten(F.concat(laws, arts))

    # only tagged tokens leave their text; the array is bound, since lambdas look into it
    rows = found.select(key, F.explode(T.let(F.col("__tokens"), every)).alias("__s"))
    return rows.groupBy(key, F.col("__s.pos").alias("pos")).agg(F.first("__s.token").alias("token"), F.max_by("__s.tag", "__s.rank").alias("tag"))


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")
