"""Registered queries over every column of the line features, with accented lines before each document's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.operators import sections as S
from lawmill.plans.catalog import _F26, _FLAG, _LINES, _POS, _RATIO, _WS, _docs, query

#: Lines that the keyword columns speak of, put before each text; their numbers follow the document.
_HEAD = [
    "'NHÂN DANH ' || doc_id", "'Tòa án, ' || doc_id % 3 || ' bị cáo; kháng cáo: Đất đai'", "'Hội đồng xét xử NHẬN ĐỊNH' || repeat(' của luật sư', CAST(doc_id % 17 AS INT))",
    "'Viện kiểm sát (VKS) đề nghị' || repeat(' nguyên đơn', CAST(doc_id % 19 AS INT))", "'# QUYẾT ĐỊNH [1.2] căn cứ' || repeat(' theo luật', CAST(doc_id % 23 AS INT))",
    "'12) noi dung vu an @@ ++ =='", "'iv. x'", "'[3.1] y'",
]
_TEXT = " || chr(10) || ".join([*_HEAD, "coalesce(text, '')"])
_SOURCE = f"(SELECT doc_id, {_TEXT} AS text FROM documents)"
_MARKED = _LINES.replace("FROM documents", f"FROM {_SOURCE}")


def _marked(spark, sf_dir, around=0):
    docs = _docs(spark, sf_dir).select("doc_id", F.expr(_TEXT).alias("text"))
    return S.line_rows(docs, "doc_id", around=around)


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_ROW = rf"line AS x, lower(line) AS low, ' ' || trim(regexp_replace(lower(replace(replace(strip_accents(line), 'đ', 'd'), 'Đ', 'D')), '{_WS}', ' ', 'g')) AS z"
_KEYWORDS = {k: _FLAG.format(_has("low", words)) for k, words in S._KEYS.items()}
_ALL26 = _F26 | _KEYWORDS
_PLAIN = {m: _has("z", words) for m, words in S._PLAIN.items()}
_CUTS = [("00_05", None, 0.05), ("05_15", 0.05, 0.15), ("15_35", 0.15, 0.35), ("35_60", 0.35, 0.6), ("60_80", 0.6, 0.8), ("80_100", 0.8, None)]
_BASE = {k: _F26[k] for k in ("pos_ratio", "pos_from_end", "log_chars", "log_words", "upper_ratio", "digit_ratio", "punct_ratio")}
_BASE |= {f"pos_bucket_{n}": _FLAG.format(" AND ".join([*([f"{_POS} > {a}::DOUBLE"] if a else []), *([f"{_POS} <= {b}::DOUBLE"] if b else [])])) for n, a, b in _CUTS}
_BASE |= {"space_ratio": "(length(line) - length(replace(line, ' ', '')))::DOUBLE / greatest(1, length(line))"}
_BASE |= {f"has_{n}": _FLAG.format(f"contains(line, '{c}')") for n, c in (("colon", ":"), ("semicolon", ";"), ("period", "."), ("comma", ","))}
_BASE |= {"starts_hash": _F26["starts_hash"], "starts_number": _FLAG.format(r"regexp_matches(line, '^\s*\p{Nd}+[.)-]')")}
_BASE |= {"starts_roman": _FLAG.format(r"regexp_matches(line, '(?i)^\s*[IVX]+[.)-]')"), "starts_bracket_number": _FLAG.format(r"regexp_matches(line, '^\s*\[?\p{Nd}+(?:\.\p{Nd}+)*\]')")}
_BASE |= {f"is_short_{n}": _FLAG.format(f"length(line) <= {n}") for n in (40, 80, 120)}
_BASE |= {"title_like": _F26["title_like"], "all_caps": _F26["all_caps"], "mostly_lower": _FLAG.format(f"{_RATIO} <= 0.12::DOUBLE AND length(line) > 30")}
_BASE |= {f"regex_{m}": _F26[f"regex_{m}"] for m in P.MARKERS}
_BASE |= {"regex_any": "greatest(" + ", ".join(_F26[f"regex_{m}"] for m in P.MARKERS) + ")"}
_BASE |= {k: _FLAG.format(f"{_has('low', words)} OR {_PLAIN[m]}") for (k, words), m in zip(S._KEYS.items(), P.MARKERS, strict=True)}
_BASE |= {k: _FLAG.format(f"contains(low, '{a}') OR contains(z, '{b}')" + (" OR contains(z, ' luat')" if k == "kw_luat" else "")) for k, (a, b) in S._TOPICS.items()}
_BASE |= {k: _FLAG.format(f"(contains(low, '{a}') OR contains(z, '{b}')) AND length(line) > {n}") for k, (a, b, n) in S._LONG.items()}
_BASE |= {"line_is_empty_like": _FLAG.format("length(line) <= 2"), "has_markdown_table": _FLAG.format(r"regexp_matches(line, '\|.*\|')")}
_BASE |= {"has_ocr_noise": _FLAG.format(r"len(regexp_extract_all(line, '[^\p{L}\p{N}_\s.,;:()/-]')) >= 3"), "accentless_marker_hit": _FLAG.format(" OR ".join(_PLAIN.values()))}
_BASE |= {k: _F26[k] for k in ("near_top", "near_middle", "near_late")} | {"near_end": _FLAG.format(f"{_POS} >= 0.72::DOUBLE")}
_AROUND = {f"{side}_{what}": f"coalesce({move}({c}) OVER w, {end}::DOUBLE)" for side, move in (("prev", "lag"), ("next", "lead")) for what, c, end in (("regex_any", "regex_any", 0), ("title_like", "title_like", 0), ("blank_like", "0.0::DOUBLE", 1))}
_AROUND |= {f"window_regex_{m}": f"greatest(regex_{m}, 0.65::DOUBLE * coalesce(lag(regex_{m}) OVER w, 0), 0.65::DOUBLE * coalesce(lead(regex_{m}) OVER w, 0))" for m in P.MARKERS}


def _rounded(names) -> str:
    return ", ".join(f"round({k}, 9) AS {k}" for k in names)


@query(f"WITH {_MARKED}, r AS (SELECT *, {_ROW} FROM lines) SELECT doc_id, line_index::INT AS line_index, {', '.join(f'round({v}, 9) AS {k}' for k, v in _ALL26.items())} FROM r")
def line_features(spark, sf_dir):
    """FEA-2: all 26 columns"""
    made = S.features(_marked(spark, sf_dir), P.LICENSE_EN)
    return made.select("doc_id", "line_index", *(F.round(k, 9).alias(k) for k in _ALL26))


@query(f"WITH {_MARKED}, r AS (SELECT *, {_ROW} FROM lines), b AS (SELECT doc_id, line_index, {', '.join(f'{v} AS {k}' for k, v in _BASE.items())} FROM r), c AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _AROUND.items())} FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_index)) SELECT doc_id, line_index::INT AS line_index, {_rounded([*_BASE, *_AROUND])} FROM c")
def line_features_wide(spark, sf_dir):
    """FEA-3, WIN-3, SCL-8, SCL-9: all 59 columns of a line and 11 of its neighbours, accents stripped on the way"""
    made = S.wide_features(_marked(spark, sf_dir, 1), "doc_id", P.LICENSE_EN)
    return made.select("doc_id", "line_index", *(F.round(k, 9).alias(k) for k in [*_BASE, *_AROUND]))
