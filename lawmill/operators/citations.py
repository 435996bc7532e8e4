"""Citation extraction, validation against titles, and triage of what stayed unlabelled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators.title_match import best_title

#: Characters of terms that one automaton holds.
TERM_CHARS = 4_000_000


def found(c: Column, pack: P.Pack) -> Column:
    """[SCL-16, SCL-22, FLT-1, FLT-2, AGG-1] Distinct citations of a normalised text, first occurrence first."""
    hits = F.transform(F.regexp_extract_all(c, F.lit(pack.quick_citation), F.lit(0)), T.collapse)
    kept = F.filter(hits, lambda m: (F.size(F.split(m, " ")) > 2) & ~F.contains(F.lower(m), F.lit(pack.unwanted)))
    return F.array_distinct(kept)


def extract(docs: DataFrame, name: str = "file_name", text: str = "text", pack: P.Pack = P.LEGAL_VI, unicode_form: bool = True) -> DataFrame:
    """[SEM-1, PRJ-1] (name, laws_cited, count); null texts cite nothing."""
    norm = T.normalize_legal(T.safe_text(F.col(text)), "extract", unicode_form)
    return docs.select(name, norm.alias("norm")).select(name, found(F.col("norm"), pack).alias("laws_cited")).withColumn("count", F.size("laws_cited"))


def snippets(c: Column) -> Column:
    """[SCL-18] The plainer spans of snippet inference, each to its full stop; they may run over line ends."""
    return F.regexp_extract_all(c, F.lit(P.SNIPPET), F.lit(0))


def total(cited: DataFrame) -> DataFrame:
    """[AGG-2]"""
    return cited.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total"))


def explode_laws(cited: DataFrame, entry: str = "entry_index") -> DataFrame:
    """[PRJ-4, WIN-9] One row a citation with entry and law index; entries are numbered by name."""
    from lawmill.operators.corpus import numbered

    return cited.join(numbered(cited.select("file_name").distinct(), ["file_name"], entry), "file_name").select("file_name", entry, F.posexplode("laws_cited").alias("law_index", "input"))


def split_valid(scored: DataFrame, threshold: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """[SEM-2, FLT-4, SET-5] (valid, invalid) halves."""
    ok = F.col("best_f1") >= F.lit(threshold)
    return scored.where(ok), scored.where(~ok)


def validate(cited: DataFrame, titles: DataFrame, threshold: float = 0.4) -> DataFrame:
    """[SEM-2] (file_name, valid, invalid): every file stays, empty lists included."""
    laws = cited.select("file_name", F.posexplode("laws_cited").alias("i", "law"))
    keyed = laws.withColumn("k", F.struct("file_name", "i"))
    scored = keyed.join(best_title(keyed, titles, "k", least=threshold), "k")
    pick = lambda good: F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("i", "law")))), lambda x: x["law"])
    ok = F.col("best_f1") >= F.lit(threshold)
    halves = scored.groupBy("file_name").agg(pick(ok).alias("valid"), pick(~ok).alias("invalid"))
    empty = F.array().cast("array<string>")
    return cited.select("file_name").join(halves, "file_name", "left").select("file_name", F.coalesce("valid", empty).alias("valid"), F.coalesce("invalid", empty).alias("invalid"))


def labelled(rows: DataFrame, citations: str = "citations") -> Column:
    """[FLT-5] Rows with at least one citation."""
    return F.coalesce(F.size(citations), F.lit(0)) > 0


def triage(unlabelled: DataFrame, titles: DataFrame, text: str = "input", title: str = "title", extra: list[str] = P.TRIAGE_WORDS) -> DataFrame:
    """[FLT-6, FLT-7, SET-4, SEM-15] Rows that contain a title or one of the extra words, whatever the case.

    Terms are matched literally, by one pass of an Aho-Corasick automaton over each text for all of them. The dictionary
    goes out in parts of at most TERM_CHARS characters, each a pass of its own, so what is broadcast has a bound. A frame
    without the column gives no rows; a row stays once, however many terms it has.
    """
    if text not in unlabelled.columns:
        return unlabelled.limit(0)
    terms = titles.select(F.lower(title).alias("term")).where(F.col("term").isNotNull())
    words = unlabelled.sparkSession.createDataFrame([(w.lower(),) for w in extra], "term string") if extra else terms.limit(0)
    every, parts, size = terms.unionByName(words).where("term <> ''").distinct(), [[]], 0
    for r in every.toLocalIterator():  # a dictionary of law titles, taken in parts
        if size > TERM_CHARS:
            parts.append([])
            size = 0
        parts[-1].append(r["term"])
        size += len(r["term"])
    low, hit = F.lower(F.col(text)), F.lit(False)
    for part in filter(None, parts):
        hit |= contains_any(unlabelled.sparkSession.sparkContext.broadcast(part))(low)
    return unlabelled.where(hit)


def contains_any(terms) -> Callable[[Column], Column]:
    """Whether a text contains any of the broadcast terms."""

    def match(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in terms.value:
            automaton.add_word(term, 1)
        automaton.make_automaton()
        for batch in texts:
            yield batch.map(lambda x: x is not None and next(automaton.iter(x), None) is not None).astype(bool)

    return F.pandas_udf(match, "boolean")
