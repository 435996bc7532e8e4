"""Column functions for text: normal forms, tokens, lines, letters, escapes. Ids in brackets are those of the survey."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lawmill.functions import patterns as P


#: Characters that are in NFC whatever stands beside them, with all precomposed Latin letters; a text of these alone is in NFC.
COMPOSED = r"\x00-\u02FF\u1E00-\u1EFF\u2010-\u2027\u20AB\u20AC\uFEFF"


def _odd(c: Column) -> Column:
    """The text if it holds any other character, else null, which costs a Python function nothing.

    ASCII is told first, since Java tests the wide class slowly.
    """
    return F.when((F.octet_length(c) > F.length(c)) & c.rlike(rf"[^\x00-\x7F](?<=[^{COMPOSED}])"), c)


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Unicode NFC; Spark has no such function. Only texts that may change go to Python."""
    return F.coalesce(_nfc(_odd(c)), c)


def _bare(x: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", bare).translate({0x111: "d", 0x110: "D"})


@F.pandas_udf(StringType())
def _strip_accents(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else _bare(x))


#: Letters with marks in the composed ranges and what is left of each; made from the character database.
_MARKED = [x for x in map(chr, [*range(0x00C0, 0x0300), *range(0x1E00, 0x1F00)]) if len(_bare(x)) == 1 and _bare(x) != x]


def strip_accents(c: Column) -> Column:
    """[SCL-8] Letters without marks; đ and Đ become d and D. Texts of composed letters stay in the JVM."""
    return F.coalesce(_strip_accents(_odd(c)), F.translate(c, "".join(_MARKED), "".join(map(_bare, _MARKED))))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(c: Column) -> Column:
    """[SCL-6, SCL-22] White space runs become one blank; ends stripped."""
    return F.trim(F.regexp_replace(c, P.NOT_ONE_BLANK, " "))


def safe_text(c: Column) -> Column:
    """[SCL-11]"""
    return F.coalesce(c, F.lit(""))


# ---- fixed values: the patterns of the normal forms below, whose results must be equal ------------------------------
def normalize_legal(c: Column, variant: str = "extract", unicode_form: bool = True) -> Column:
    """[SCL-1..3] variant: extract; highlight keeps line ends and collapses blanks last; tagger also knows case law."""
    x = nfc(c) if unicode_form else c
    if variant != "highlight":
        x = F.regexp_replace(x, P.SPACE, " ")
    # the letters come before the word's edge, which is slow to test at every place
    x = F.regexp_replace(x, P.ahead(["đi", "kh"]) + r"(?iuU)\b(điều|khoản|điểm)\s*(?=\p{Nd})", "$1 ")
    x = F.regexp_replace(x, P.ahead(["đê"]) + r"(?iuU)\bđê\s*(?=\p{Nd})", "Điều ")
    start = P.LAW_START_TAGGER if variant == "tagger" else P.LAW_START
    x = F.regexp_replace(x, rf"(?iuU);\s*((?:của|thuộc|theo)\s+(?={start}\b))", " $1")
    if variant == "highlight":
        x = F.regexp_replace(x, r"[ \t]+", " ")
    return strip(x)


def normalize_key(c: Column, unicode_form: bool = True) -> Column:
    """[SCL-4] Key of a law title: lower case, no quotes, no word "năm", no marks but - and /."""
    x = F.lower(normalize_legal(c, "tagger", unicode_form))
    x = F.regexp_replace(x, "[“”\"'`]", " ")
    x = F.regexp_replace(x, r"(?iuU)\bnăm\b", " ")
    return collapse(F.regexp_replace(x, r"(?U)[^\p{L}\p{N}_\s/-]", " "))


def normalize_line(c: Column, unicode_form: bool = True) -> Column:
    """[SCL-5] NFC, byte order marks to blanks, collapsed."""
    x = safe_text(nfc(c) if unicode_form else c)
    return collapse(F.replace(x, F.lit("﻿"), F.lit(" ")))


def lines(c: Column, unicode_form: bool = True) -> Column:
    """[SCL-7, FLT-3] The non-empty normalised lines of a text."""
    whole = nfc(c) if unicode_form else c
    # most texts have line feeds alone, which need no pattern
    raw = let(safe_text(whole), lambda x: F.when(x.rlike(P.OTHER_LINE_END), F.split(x, P.LINE_END)).otherwise(F.split(x, "\n")))
    return F.filter(F.transform(raw, lambda x: collapse(F.replace(x, F.lit("﻿"), F.lit(" ")))), lambda x: x != "")


def plain_line(c: Column) -> Column:
    """[SCL-9]"""
    return collapse(F.lower(strip_accents(c)))


def clean_token(c: Column) -> Column:
    """[SCL-10]"""
    return F.lower(F.btrim(c, F.lit(".,;:()[]{}“”\"'`")))


def tokens(c: Column) -> Column:
    """[SCL-13] Words and single marks."""
    return F.regexp_extract_all(c, F.lit(P.TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """[SCL-14] Words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(P.WORD), F.lit(0))


def white_tokens(c: Column) -> Column:
    return F.filter(F.split(c, P.SPACE), lambda x: x != "")


def indexed(c: Column) -> Column:
    """[SCL-12] "1#first 2#second"."""
    return F.array_join(F.transform(white_tokens(c), lambda t, i: F.concat((i + 1).cast("string"), F.lit("#"), t)), " ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that one fold of running sums goes over.
_RUN = 128


def running_sums(sizes: Column) -> Column:
    """Inclusive running sums of an array of ints: folds over runs, then over the runs' totals, so no long array is copied at each step."""
    none = F.array().cast("array<int>")
    fold = lambda a: F.aggregate(a, none, lambda out, x: F.concat(out, F.array(x + F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)))))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(_RUN)), lambda s: fold(F.slice(sizes, s + 1, _RUN)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0)))
        # what stands before each run: totals moved on by one
        return let(fold(F.concat(F.array(F.lit(0)), totals)), lambda before: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda v: v + F.get(before, k)))))

    return let(runs, joined)


def match_spans(c: Column, pattern: str) -> Column:
    """Half-open code point spans of all matches: array of (text, start, end).

    The gaps of split() and the matches of regexp_extract_all() alternate, so running sums of their lengths give every offset.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def spans(hits: Column) -> Column:
        gaps = F.transform(F.split(c, pattern, -1), F.length)
        ends = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.transform(hits, F.length), lambda g, n: g + n))
        return F.zip_with(hits, ends, lambda h, e: F.struct(h.alias("text"), (e - F.length(h)).alias("start"), e.alias("end")))

    return let(found, spans)


def escape_html(c: Column) -> Column:
    """[SCL-21]"""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def highlight(c: Column, pattern: str, color: str = "#ffcc99") -> Column:
    """[SCL-20] The text escaped, with each match in a <mark>."""
    gaps = F.transform(F.split(c, pattern, -1), escape_html)
    marks = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), escape_html)
    opening = f'<mark style="background-color: {color};">'
    pieces = F.zip_with(gaps, marks, lambda g, m: F.concat(g, F.when(m.isNotNull(), F.concat(F.lit(opening), m, F.lit("</mark>"))).otherwise("")))
    return F.array_join(pieces, "")


def page(body: Column, title: str = "Regex Candidate Highlight") -> Column:
    """[SNK-10] A page around highlighted text."""
    head = f'<html>\n<head><meta charset="utf-8"><title>{title}</title>\n<style>body{{font-family: sans-serif; font-size: 14px; line-height: 1.6;}} pre{{white-space: pre-wrap;}}</style>\n</head><body><pre>'
    return F.concat(F.lit(head), body, F.lit("</pre></body></html>"))


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def upper_count(c: Column) -> Column:
    """Letters that their upper case does not change; letters without case count."""
    return F.length(F.regexp_replace(c, r"[^\p{Lu}\p{Lo}\p{Lm}]+", ""))


#: Lines that measures() takes at a time, so that its arrays stay small.
_AT_ONCE = 1024
#: Of a character: letter; letter that its upper case does not change; decimal digit; of a word; ends a word and is no mark; neither mark nor blank nor of a word.
_LETTER, _CAPITAL, _DIGIT, _IN_WORD, _GAP, _QUIET = (1 << k for k in range(6))


@cache
def _kinds() -> np.ndarray:
    """What each code point is, as bits; blanks as Java's \\s has them, for words that of ASCII, for marks that of Unicode."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(len(out)):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LN":
            out[code] = (_LETTER if kind[0] == "L" else 0) | (_CAPITAL if kind in ("Lu", "Lo", "Lm") else 0) | (_DIGIT if kind == "Nd" else 0) | _IN_WORD | _QUIET
    out[ord("_")] |= _IN_WORD
    out[[*range(9, 14), 32]] |= _GAP
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] |= _QUIET
    return out


def _measured(lines: list[str]) -> np.ndarray:
    """[5, lines]: letters, capitals, digits, marks and tokens of each line."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(size)
    kind = _kinds()[np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)]
    word = (kind & _IN_WORD) > 0
    before = np.zeros_like(word)
    before[1:] = word[:-1]
    before[(ends - size)[size > 0]] = False
    flags = [(kind & _LETTER) > 0, (kind & _CAPITAL) > 0, (kind & _DIGIT) > 0, (kind & _QUIET) == 0, np.where(word, ~before, (kind & _GAP) == 0)]
    out = np.zeros((len(flags), len(lines)), np.int32)
    some = size > 0
    if some.any():
        for row, flag in zip(out, flags, strict=True):
            row[some] = np.add.reduceat(flag, (ends - size)[some], dtype=np.int32)
    return out


_MEASURES = ["letters", "capitals", "digits", "marks", "tokens"]


@F.arrow_udf(StructType([StructField(k, IntegerType()) for k in _MEASURES]))
def measures(c: pa.Array) -> pa.Array:
    """letter_count, upper_count, decimal digits, marks (no letter, number or white space) and the number of tokens() of a line, from one pass over its characters."""
    parts = [_measured(c.slice(k, _AT_ONCE).fill_null("").to_pylist()) for k in range(0, len(c), _AT_ONCE)] or [np.zeros((5, 0), np.int32)]
    return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, 1)], _MEASURES, mask=c.is_null())


def upper_ratio(c: Column) -> Column:
    """[SCL-26] 0 without letters."""
    return upper_count(c) / F.greatest(letter_count(c), F.lit(1))


def title_like(c: Column, short: int = 90, ratio: Column | None = None) -> Column:
    """[SCL-25] 1.0 for short, headed or capital lines. ratio: upper_ratio(c), worked out here if not given."""
    return F.when(c == "", 0.0).when((F.length(c) <= short) | c.startswith("#") | ((upper_ratio(c) if ratio is None else ratio) >= 0.55), 1.0).otherwise(0.0)


def looks_title_like(c: Column) -> Column:
    """[SCL-24]"""
    return (F.length(c) <= 100) | (upper_ratio(c) >= 0.55)


def law_f1(shared: Column, mine: Column, other: Column) -> Column:
    """[SCL-15] F1 of word sets from the sizes; precision and recall first, since the closed form differs at thresholds."""
    p, r = shared / mine, shared / other
    return F.when(shared > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
