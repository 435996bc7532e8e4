"""The registered queries over the driver's tables, each with its SQL where SQL can express it.

Queries read whole tables. Documents take the place of Markdown files (doc_id names them) and licence notices that of
citations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators import citations as C
from lawmill.operators import corpus as V
from lawmill.operators import labels as L
from lawmill.operators import ledger as G
from lawmill.operators import links as K
from lawmill.operators import sections as S
from lawmill.operators import tagging as B

FLAGSHIP = "citation_extract"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "text")


def _lines(spark: SparkSession, sf_dir: str, around: int = 0) -> DataFrame:
    return S.line_rows(_docs(spark, sf_dir), "doc_id", around=around)


# ---- SQL fragments -------------------------------------------------------------------------------------------------
_WS = r"[\s\x0b\x1c-\x1f]+"
_LINES = rf"""
lines AS (
  SELECT doc_id, line, i - 1 AS line_index, n AS n_lines FROM (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS n FROM (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(nfc_normalize(coalesce(text, '')), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
        lambda x: trim(regexp_replace(replace(x, chr(65279), ' '), '{_WS}', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)))
"""
_CITED = rf"""
cited AS (
  SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(
    trim(regexp_replace(nfc_normalize(coalesce(text, '')), '{_WS}', ' ', 'g')), '{P.LICENSE_EN.citation}', 0),
    lambda m: trim(regexp_replace(m, '{_WS}', ' ', 'g'))), lambda m: len(string_split(m, ' ')) > 2 AND NOT contains(lower(m), '{P.LICENSE_EN.unwanted}')))) AS law
  FROM documents)
"""
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+', 0)"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_LETTERS = r"length(regexp_replace(line, '[^\p{L}]', '', 'g'))"
_UPPERS = r"length(regexp_replace(line, '[^\p{Lu}\p{Lo}\p{Lm}]', '', 'g'))"
_RATIO = f"(CASE WHEN {_LETTERS} = 0 THEN 0.0::DOUBLE ELSE {_UPPERS}::DOUBLE / {_LETTERS} END)"
_TITLE = f"(CASE WHEN line = '' THEN 0.0::DOUBLE WHEN length(line) <= 90 OR starts_with(line, '#') OR {_RATIO} >= 0.55::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_HEAD = r"regexp_matches(line, '(?i)^\s*(?:[IVX]+|\p{Nd}+)[.)-]')"
_FLAG = "(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_TABLE = r"regexp_matches(line, '\|.*\|')"
_POS = "(line_index::DOUBLE / greatest(1, n_lines - 1))"


def _re(marker: str) -> str:
    return f"regexp_matches(line, '{P.LICENSE_EN.markers[marker]}')"


# ---- citations -----------------------------------------------------------------------------------------------------
@query(f"WITH {_CITED} SELECT doc_id, law FROM cited")
def citation_extract(spark, sf_dir):
    """SEM-1 with FLT-1, FLT-2, AGG-1 over every document."""
    cited = C.extract(_docs(spark, sf_dir), "doc_id", pack=P.LICENSE_EN)
    return cited.select("doc_id", F.explode("laws_cited").alias("law"))


@query(f"WITH {_CITED}, c AS (SELECT doc_id, count(law) AS n FROM documents LEFT JOIN cited USING (doc_id) GROUP BY doc_id) SELECT doc_id, n::BIGINT AS n FROM c")
def citation_records(spark, sf_dir):
    """PRJ-1: a record for every document, empty ones too."""
    return C.extract(_docs(spark, sf_dir), "doc_id", pack=P.LICENSE_EN).select("doc_id", F.col("count").cast("long").alias("n"))


@query(f"WITH {_CITED} SELECT count(*)::BIGINT AS total FROM cited")
def citation_total(spark, sf_dir):
    """AGG-2"""
    return C.total(C.extract(_docs(spark, sf_dir), "doc_id", pack=P.LICENSE_EN))


_F1 = rf"""
laws AS (SELECT doc_id, list_distinct({_WORDS.format("coalesce(text, '')")}) AS w FROM documents),
titles AS (SELECT item_id, list_distinct({_WORDS.format("text")}) AS tw FROM benchmark),
pairs AS (SELECT doc_id, len(list_intersect(w, tw)) AS c, len(w) AS n, len(tw) AS m FROM laws, titles),
best AS (SELECT doc_id, max(CASE WHEN c > 0 THEN 2 * (c::DOUBLE / n) * (c::DOUBLE / m) / (c::DOUBLE / n + c::DOUBLE / m) ELSE 0.0::DOUBLE END) AS f FROM pairs GROUP BY doc_id)
"""


def _best(spark, sf_dir):
    return C.best_title(_docs(spark, sf_dir), _t(spark, sf_dir, "benchmark"), "doc_id", "text", "text")


@query(f"WITH {_F1} SELECT doc_id, round(f, 9) AS best_f1 FROM best")
def title_f1_best(spark, sf_dir):
    """JON-1, AGG-15: documents against all benchmark items."""
    return _best(spark, sf_dir).select("doc_id", F.round("best_f1", 9).alias("best_f1"))


@query(f"WITH {_F1} SELECT f >= 0.2::DOUBLE AS valid, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM best GROUP BY 1")
def valid_invalid_split(spark, sf_dir):
    """SEM-2, FLT-4, SET-5"""
    good, bad = C.split_valid(_best(spark, sf_dir), 0.2)
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return both.groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'all rights') OR contains(lower(text), 'mit license') OR EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(documents.text), lower(b.text)))")
def triage_semi(spark, sf_dir):
    """FLT-6, SET-4, SEM-15"""
    return C.triage(_docs(spark, sf_dir), _t(spark, sf_dir, "benchmark"), "text", "text", ["all rights", "MIT License"]).select("doc_id")


# ---- vocabularies, duplicates, splits ------------------------------------------------------------------------------
@query(rf"WITH t AS (SELECT unnest(regexp_extract_all(text, '{_TOKEN}', 0)) AS t FROM documents), b AS (SELECT t AS token FROM t UNION ALL SELECT lower(t) FROM t) SELECT token, count(*)::BIGINT AS cnt FROM b GROUP BY token HAVING count(*) >= 3")
def token_vocab(spark, sf_dir):
    """SCL-13, AGG-3, FLT-17"""
    return V.word_counts(_docs(spark, sf_dir), least=3)


@query(rf"WITH {_LINES}, x AS (SELECT unnest(regexp_extract_all(text, '{_TOKEN}', 0)) AS x FROM documents UNION ALL SELECT line FROM lines), c AS (SELECT unnest(string_split(x, '')) AS ch FROM x) SELECT ch, count(*)::BIGINT AS cnt FROM c WHERE ch <> '' GROUP BY ch")
def char_vocab(spark, sf_dir):
    """AGG-4 in the variant that counts lines once more."""
    return V.char_counts(_docs(spark, sf_dir), lines_too=True)


@query(rf"WITH t AS (SELECT unnest(regexp_extract_all(text, '{_TOKEN}', 0)) AS token FROM documents), c AS (SELECT token, count(*) AS cnt FROM t GROUP BY token ORDER BY cnt DESC, token LIMIT 500) SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 1)::INT AS id FROM c")
def vocab_ids(spark, sf_dir):
    """SRT-5, FLT-17: the 500 most frequent tokens, a top-k."""
    counts = _docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    return V.vocabulary(counts, "token", most=500)


@query("SELECT md5(text) AS md5, count(*)::BIGINT AS n, min(doc_id) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_exact_dups(spark, sf_dir):
    """AGG-12, SCL-29"""
    return V.exact_duplicates(_docs(spark, sf_dir), "doc_id", "text")


@query("SELECT doc_id, md5(text) AS md5, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY md5(text)) THEN 'keep' ELSE 'delete' END AS action FROM documents")
def dedup_plan(spark, sf_dir):
    """AGG-13, SNK-14"""
    return V.dedup_plan(_docs(spark, sf_dir), "doc_id", "text")


@query("WITH b AS (SELECT doc_id, ('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT % 100 AS b FROM documents) SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split FROM b")
def split_by_doc(spark, sf_dir):
    """SMP-2, SMP-3, JON-12 by hash"""
    return V.split(_docs(spark, sf_dir).select("doc_id"), "doc_id")


@query("WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) SELECT user_id, event_type, event_id FROM e WHERE r = 1")
def dedup_entries(spark, sf_dir):
    """AGG-6"""
    return L.first_of(_t(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


# ---- lines and sections --------------------------------------------------------------------------------------------
@query(f"WITH {_LINES} SELECT doc_id, line_index::INT AS line_index, lag(line, 2, '') OVER w AS previous_2, lag(line, 1, '') OVER w AS previous_1, lead(line, 1, '') OVER w AS next_1, lead(line, 2, '') OVER w AS next_2, round({_POS}, 9) AS position_ratio FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_index)")
def line_context(spark, sf_dir):
    """WIN-1, WIN-2, SCL-5, SCL-7, FLT-3"""
    return S.with_context(_lines(spark, sf_dir, 2), "doc_id").select("doc_id", "line_index", "previous_2", "previous_1", "next_1", "next_2", F.round("position_ratio", 9).alias("position_ratio"))


_SCORE = f"1.0::DOUBLE + {_FLAG.format('length(line) <= 100')} + 0.7::DOUBLE * {_FLAG.format('starts_with(line, chr(35)) OR ' + _HEAD)} + 0.7::DOUBLE * {_FLAG.format(f'{_UPPERS} >= greatest(3, trunc({_LETTERS} * 0.6::DOUBLE))')}"
_CANDS = f"""
hits AS ({" UNION ALL ".join(f"SELECT doc_id, line_index, n_lines, line, '{m}' AS m, 'regex' AS k, {_SCORE} AS s FROM lines WHERE {_re(m)}" for m in P.MARKERS)}),
hard AS (SELECT doc_id, line_index, n_lines, line, 'none' AS m, 'hard_negative' AS k, 0.2::DOUBLE AS s FROM lines l
  WHERE regexp_matches(line, '{P.LICENSE_EN.hard}') AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = l.doc_id AND h.line_index = l.line_index)),
free AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || line_index || ':42')) AS r FROM lines l
  WHERE NOT regexp_matches(line, '{P.LICENSE_EN.hard}') AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = l.doc_id AND h.line_index = l.line_index)),
every AS (SELECT * FROM hits UNION ALL SELECT * FROM hard UNION ALL SELECT doc_id, line_index, n_lines, line, 'none', 'random_negative', 0.0::DOUBLE FROM free WHERE r <= 16)
"""


def _candidates(spark, sf_dir):
    return S.candidates(_lines(spark, sf_dir, 2), "doc_id", P.LICENSE_EN)


@query(f"WITH {_LINES}, {_CANDS} SELECT doc_id || ':' || line_index || ':' || m || ':' || k AS candidate_id, line AS candidate_line, round(s, 9) AS regex_score, round({_POS}, 9) AS position_ratio FROM every")
def line_candidates(spark, sf_dir):
    """SEM-3, PRJ-2, SMP-1, SCL-19, SCL-27: matches, look-alikes and 16 sampled negatives a document."""
    return _candidates(spark, sf_dir).select("candidate_id", "candidate_line", F.round("regex_score", 9).alias("regex_score"), F.round("position_ratio", 9).alias("position_ratio"))


_F26 = {
    "pos_ratio": _POS, "pos_from_end": f"1.0 - {_POS}", "log_chars": "least(1.0::DOUBLE, ln(1 + length(line)) / 7.0)",
    "log_words": f"least(1.0::DOUBLE, ln(1 + len(regexp_extract_all(line, '{_TOKEN}', 0))) / 5.0)", "upper_ratio": _RATIO,
    "digit_ratio": r"length(regexp_replace(line, '[^\p{Nd}]', '', 'g'))::DOUBLE / greatest(1, length(line))",
    "punct_ratio": r"length(regexp_replace(line, '[\p{L}\p{N}\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g'))::DOUBLE / greatest(1, length(line))",
    "has_colon": _FLAG.format("contains(line, ':')"), "starts_hash": _FLAG.format("starts_with(line, '#')"), "starts_number": _FLAG.format(_HEAD),
    "is_short": _FLAG.format("length(line) <= 100"), "title_like": _TITLE, "all_caps": _FLAG.format(f"{_RATIO} >= 0.6::DOUBLE"),
} | {f"regex_{m}": _FLAG.format(_re(m)) for m in P.MARKERS} | {
    "near_top": _FLAG.format(f"{_POS} <= 0.2::DOUBLE"), "near_middle": _FLAG.format(f"{_POS} > 0.2::DOUBLE AND {_POS} < 0.78::DOUBLE"), "near_late": _FLAG.format(f"{_POS} >= 0.45::DOUBLE"),
}


@query(f"WITH {_LINES}, f AS (SELECT *, {', '.join(f'{_FLAG.format(_re(m))} AS r{i}' for i, m in enumerate(P.MARKERS))}, {_TITLE} AS tl FROM lines) SELECT doc_id, line_index::INT AS line_index, {', '.join(f'greatest(r{i}, 0.65::DOUBLE * lag(r{i}, 1, 0) OVER w, 0.65::DOUBLE * lead(r{i}, 1, 0) OVER w) AS window_regex_{m}' for i, m in enumerate(P.MARKERS))}, lag(greatest(r0, r1, r2, r3, r4), 1, 0) OVER w AS prev_regex_any, lead(tl, 1, 0) OVER w AS next_title_like, CASE WHEN lag(line) OVER w IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prev_blank_like FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_index)")
def window_regex_decay(spark, sf_dir):
    """WIN-3, FEA-3's context"""
    made = S.context_beside(_lines(spark, sf_dir, 1).withColumns(S.marker_flags(F.col("line"), P.LICENSE_EN)), P.LICENSE_EN)
    return made.select("doc_id", "line_index", *(f"window_regex_{m}" for m in P.MARKERS), "prev_regex_any", "next_title_like", "prev_blank_like")


_AT = ", ".join(f"min(CASE WHEN {_re(m)} THEN line_index END) AS f{i}" for i, m in enumerate(P.MARKERS))
_SLICES = f"""
m AS (SELECT doc_id, max(n_lines) AS n, list(line ORDER BY line_index) AS ls, {_AT} FROM lines GROUP BY doc_id),
a AS (SELECT *, coalesce(f0, 0) AS a0, coalesce(f1, greatest(coalesce(f0, 0) + 1, trunc(n * 0.15::DOUBLE))) AS a1 FROM m),
b AS (SELECT *, coalesce(f2, f3, greatest(a1, trunc(n * 0.48::DOUBLE))) AS a2 FROM a),
c AS (SELECT *, coalesce(f3, greatest(a2, trunc(n * 0.58::DOUBLE))) AS a3 FROM b),
d AS (SELECT *, coalesce(f4, greatest(a3 + 1, trunc(n * 0.78::DOUBLE))) AS a4 FROM c),
e AS (SELECT *, a0 <= a1 AND a1 <= a2 AND a2 <= a3 AND a3 <= a4 AND a4 <= n AS good FROM d),
g AS (SELECT doc_id, ls, n, good, CASE WHEN good THEN a0 ELSE 0 END AS s0, CASE WHEN good THEN a1 ELSE greatest(1, trunc(n * 0.15::DOUBLE)) END AS s1, a2, a3, a4 FROM e),
h AS (SELECT *, CASE WHEN good THEN a2 ELSE greatest(s1, trunc(n * 0.48::DOUBLE)) END AS s2 FROM g),
i AS (SELECT *, CASE WHEN good THEN a3 ELSE greatest(s2, trunc(n * 0.58::DOUBLE)) END AS s3 FROM h),
j AS (SELECT *, CASE WHEN good THEN a4 ELSE greatest(s3 + 1, trunc(n * 0.78::DOUBLE)) END AS s4 FROM i)
"""


@query("WITH " + _LINES + "," + _SLICES + " SELECT doc_id, NOT good AS reset, " + ", ".join(f"array_to_string(ls[s{k}::INT + 1:{f's{k + 1}::INT' if k < 4 else 'n'}], chr(10)) AS {m}" for k, m in enumerate(P.MARKERS)) + " FROM j")
def section_slices(spark, sf_dir):
    """SEM-11: markers are the first lines that match the licence pack."""
    rows = _lines(spark, sf_dir)
    first = rows.groupBy("doc_id").agg(*(F.min(F.when(F.col("line").rlike(P.LICENSE_EN.markers[m]), F.col("line_index"))).alias(m) for m in P.MARKERS))
    docs = _docs(spark, sf_dir).select("doc_id", T.lines(F.col("text")).alias("lines")).join(first, "doc_id")
    out = S.slice_sections(docs)
    return out.select("doc_id", F.array_contains("section_warnings", "invalid_order_ratio_fallback").alias("reset"), *(f"sections.{m}" for m in P.MARKERS))


# ---- labels --------------------------------------------------------------------------------------------------------
_LEVELED = "SELECT doc_id, quality, toxic, CASE WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence FROM labels"


def _leveled(spark, sf_dir):
    level = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    return _t(spark, sf_dir, "labels").withColumn("confidence", level)


@query(f"WITH l AS ({_LEVELED}), r AS (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, doc_id DESC) AS r FROM l) SELECT quality, toxic, doc_id, confidence FROM r WHERE r = 1")
def label_resolve(spark, sf_dir):
    """AGG-5: the most confident label of each group, the last among equals."""
    rows = _leveled(spark, sf_dir).withColumn("seq", F.col("doc_id"))
    return L.resolve(rows, ["quality", "toxic"], "doc_id", "confidence", "seq")


@query("SELECT d.doc_id, coalesce('q' || l.quality, 'O') AS tag FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_left_join(spark, sf_dir):
    """JON-3"""
    tags = _t(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("tag"))
    return L.attach(_docs(spark, sf_dir).select("doc_id"), tags, ["doc_id"])


@query("SELECT d.doc_id, 'q' || l.quality AS tag FROM documents d JOIN labels l USING (doc_id)")
def require_label(spark, sf_dir):
    """FLT-14, JON-4"""
    tags = _t(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("tag"))
    return L.attach(_docs(spark, sf_dir).select("doc_id"), tags, ["doc_id"], require=True)


@query("SELECT c.conv_id, c.turn, 'P1: ' || coalesce(lag(text) OVER w, '') || chr(10) || 'CAND: ' || text || chr(10) || 'N1: ' || coalesce(lead(text) OVER w, '') AS prompt FROM conversations c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prompt_render(spark, sf_dir):
    """PRJ-5, WIN-1"""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").withColumns({"p": F.lag("text").over(w), "n": F.lead("text").over(w)})
    return rows.select("conv_id", "turn", L.render("P1: {p}\nCAND: {text}\nN1: {n}", ["p", "text", "n"]).alias("prompt"))


@query(rf"SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> ''), lambda x, i: i || '#' || x), ' ') AS indexed FROM conversations")
def indexed_prompt(spark, sf_dir):
    """SCL-12"""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.indexed(F.col("text")).alias("indexed"))


# ---- tokens, tags, metrics -----------------------------------------------------------------------------------------
_POSED = rf"t AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}', 0) AS l FROM documents))"


@query(f"WITH {_POSED}, n AS (SELECT *, max(CASE WHEN lower(token) IN ('license', 'copyright', 'rights') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS flag FROM t) SELECT doc_id, pos::INT AS pos, token FROM n WHERE flag = 1")
def token_band(spark, sf_dir):
    """JON-7, WIN-4, SCL-10"""
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    return B.near(rows, "doc_id", ["license", "copyright", "rights"], 3, "flag").where("flag = 1").select("doc_id", "pos", "token")


@query(f"WITH {_POSED}, g AS (SELECT doc_id, pos, lower(token) AS a, lower(lead(token, 1) OVER w) AS b, lower(lead(token, 2) OVER w) AS c FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), h AS (SELECT doc_id, pos, 2 AS n FROM g WHERE a || ' ' || b IN ('mit license', 'apache license') UNION ALL SELECT doc_id, pos, 3 FROM g WHERE a || ' ' || b || ' ' || c IN ('all rights reserved', 'public license ,')), s AS (SELECT doc_id, pos + unnest(range(n)) AS pos, unnest(range(n)) AS i FROM h) SELECT doc_id, pos::INT AS pos, max(CASE WHEN i = 0 THEN 1 ELSE 0 END)::INT AS is_begin FROM s GROUP BY 1, 2")
def gazetteer_hits(spark, sf_dir):
    """JON-5 over every token"""
    phrases = spark.createDataFrame([("mit license", 2), ("apache license", 2), ("all rights reserved", 3), ("public license ,", 3)], "phrase string, n int")
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token")).withColumn("token", F.lower("token"))
    return B.phrase_hits(rows, phrases, "doc_id").select("doc_id", "pos", F.col("begin").alias("is_begin"))


@query(rf"WITH {_POSED}, m AS (SELECT doc_id, count(*) AS n, sum(length(token)) AS chars FROM t GROUP BY doc_id) SELECT doc_id, n::BIGINT AS n, chars::BIGINT AS chars, (length(text) - length(regexp_replace(text, '\s+$', '')))::BIGINT AS trailing FROM m JOIN documents USING (doc_id)")
def token_offsets(spark, sf_dir):
    """PAT-1, SCL-13: the last token's end leaves just the trailing white space."""
    rows = B.token_rows(_docs(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.max("end").alias("last"))
    return rows.join(_docs(spark, sf_dir), "doc_id").select("doc_id", "n", "chars", (F.length("text") - F.col("last")).cast("long").alias("trailing"))


# ---- pages, ledgers, layout ----------------------------------------------------------------------------------------
_HREF = r"""list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), lambda h: trim(h)), lambda h: NOT starts_with(h, 'javascript:') AND NOT contains(lower(h), 'tra-cu-ban-an'))))"""


@query(f"SELECT page_id, unnest({_HREF}) AS link FROM pages")
def page_links(spark, sf_dir):
    """PRS-7, FLT-10, SRT-3, native"""
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(K.plain_links(F.col("html"))).alias("link"))


@query(r"SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1], 'unknown_id') AS case_id FROM pages")
def url_case_id(spark, sf_dir):
    """PRS-9"""
    return _t(spark, sf_dir, "pages").select("page_id", K.case_id(F.col("url")).alias("case_id"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(substr(html, 1, length(html)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS escaped FROM pages""")
def escape_pages(spark, sf_dir):
    """SCL-21"""
    return _t(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("""SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), '(?i)(all rights reserved|under the [A-Z]+)', '<mark style="background-color: #ffcc99;">\\1</mark>', 'g') AS html FROM documents""")
def highlight_html(spark, sf_dir):
    """SCL-20, SNK-10"""
    return _docs(spark, sf_dir).select("doc_id", T.highlight(F.col("text"), "(?i)(?:all rights reserved|under the [A-Z]+)").alias("html"))


def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")


@query("WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE r = 1")
def ledger_upsert(spark, sf_dir):
    """SNK-5, STR-3, STR-5: odd events replace or join the ledger of the even ones."""
    e = _events(spark, sf_dir)
    old = G.latest(e.where("event_id % 2 = 0"), ["user_id"], "event_id")
    return G.upsert(old, e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("WITH r AS (SELECT user_id, event_id, event_type, value, event_id % 2 AS odd, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS r FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY odd) AS k FROM r WHERE r = 1) SELECT user_id, event_id, event_type, value FROM f WHERE k = 1")
def ledger_first_wins(spark, sf_dir):
    """SNK-4, JON-14: the first even event of a user stays; odd ones only fill in."""
    e = _events(spark, sf_dir)
    old = G.latest(e.where("event_id % 2 = 0"), ["user_id"], "event_id", last=False)
    return G.add_new(old, e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("WITH o AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id, max_by(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, event_id) FILTER (WHERE event_id % 3 <> 0) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, event_type, coalesce(v, value) AS value FROM o LEFT JOIN n USING (user_id)")
def ledger_update(spark, sf_dir):
    """SNK-6 with a null change keeping what is there"""
    e = _events(spark, sf_dir)
    old = G.latest(e.where("event_id % 2 = 0"), ["user_id"], "event_id").select("user_id", "event_type", "value")
    changes = e.where("event_id % 2 = 1").groupBy("user_id").agg(F.max_by("value", F.when(F.col("event_id") % 3 != 0, F.col("event_id"))).alias("value"))
    return G.update(old, changes, "user_id", ["value"])


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = e.event_type AND d.event_id % 10 = 0 AND d.value > 0)")
def resume_anti(spark, sf_dir):
    """JON-2, STR-2: done keys are composite, and only successful ones count."""
    e = _events(spark, sf_dir)
    return L.pending(e, e.where("event_id % 10 = 0"), ["user_id", "event_type"], F.col("value") > 0).select("event_id")


@query("SELECT count(DISTINCT d.doc_id)::BIGINT AS documents, count(*)::BIGINT AS n_lines, sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END)::BIGINT AS positives FROM documents d LEFT JOIN labels l USING (doc_id)")
def corpus_stats(spark, sf_dir):
    """AGG-8"""
    tags = _t(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("q1").alias("tag"))
    return V.line_stats(L.attach(_docs(spark, sf_dir).select("doc_id"), tags, ["doc_id"]), "doc_id")
