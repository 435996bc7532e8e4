"""Registered queries over tagged tokens of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.operators import sample_tags as A
from lawmill.operators import sections as S
from lawmill.operators import viterbi as V
from lawmill.plans.catalog import _F26, _LINES, _TOKEN, _docs, _lines, _t, query

_PREFIX = "'điều ' || doc_id % 50 || ', điều ' || doc_id % 50 || ', ' || doc_id % 7 || ' '"
_TEXT = f"{_PREFIX} || coalesce(text, '')"


@query(rf"""WITH d AS (SELECT doc_id, {_TEXT} AS x FROM documents),
f AS (SELECT item_id AS name, lower(trim(string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2])) AS form FROM benchmark),
h AS (SELECT doc_id, name, x, length(form) AS n, instr(lower(x), form) AS q FROM d, f WHERE contains(lower(x), form)),
s AS (SELECT doc_id, name, len(regexp_extract_all(substr(x, 1, q - 1), '{_TOKEN}')) - regexp_full_match(substr(x, q - 1, 2), '[\p{{L}}\p{{N}}_]{{2}}')::INT AS a, len(regexp_extract_all(substr(x, 1, q + n - 1), '{_TOKEN}')) - 1 AS b FROM h),
e AS (SELECT doc_id, name AS rank, unnest(range(a, b + 1)) AS pos, a, 'LAW' AS label FROM s
  UNION ALL SELECT doc_id, 1000000000 + i, pos, a, 'ART' FROM documents, (VALUES (0, 0, 0), (0, 1, 0), (1, 3, 3), (1, 4, 3), (2, 6, 6)) v(i, pos, a) WHERE i < 2 OR doc_id % 7 <> doc_id % 50),
t AS (SELECT doc_id, pos, max_by(CASE WHEN pos = a THEN 'B-' ELSE 'I-' END || label, rank) AS tag FROM e GROUP BY ALL),
k AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(x, '{_TOKEN}') AS l FROM d))
SELECT doc_id, pos::INT AS pos, token, tag FROM t JOIN k USING (doc_id, pos)""")
def document_tags(spark, sf_dir):
    """JON-9, JON-10, SEM-5, SEM-7, SRT-8: every document against the first words of every benchmark item, and article numbers at their first unused place"""
    docs = _docs(spark, sf_dir).select("doc_id", F.expr(_TEXT).alias("text"), F.expr("array(doc_id % 50 || '', doc_id % 50 || '.', doc_id % 7 || '')").alias("articles"))
    words = F.slice(F.split("text", " "), 1, 2)
    names = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("name"), F.array_join(words, " ").alias("form"))
    return A.document_tags(docs, names, "doc_id", articles="articles")


@query(rf"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' '), lambda x: length(x) > 3)[1:3] AS ws FROM conversations),
e AS (SELECT conv_id, turn, ws, 'theo điều 5, 7 ' || array_to_string(ws, ' ') || ' điều 5.' AS x FROM w)
SELECT conv_id, turn, array_to_string(['O', 'B-ART', 'I-ART', 'O', 'B-ART'], ',') || CASE WHEN len(ws) = 0 THEN '' ELSE ',' || array_to_string(list_transform(ws, lambda x, i: CASE WHEN i = 1 AND turn % 2 = 0 THEN 'B-LAW' ELSE 'I-LAW' END), ',') END || ',B-ART,I-ART,O' AS tags FROM e""")
def tag_samples(spark, sf_dir):
    """SEM-8, SEM-7, SEM-6, FLT-15, JON-9, JON-10: every turn as a labelled snippet; the name is found on even turns, on odd ones its counted range, one token longer, stands for it"""
    ws = F.slice(F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z]+", " "), " "), lambda x: F.length(x) > 3), 1, 3)
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", ws.alias("ws"))
    n, name = F.size("ws"), F.array_join("ws", " ")
    # tokens: theo điều 5 , 7 and then the name
    first = F.lit(5)
    raw = F.concat(F.lit("ART: 5 | LAW: "), first.cast("string"), F.lit("-"), (first + n - 1).cast("string"))
    cited = F.array(F.struct(F.array(F.lit("5"), F.lit("7"), F.lit("5.")).alias("articles"), F.when(F.col("turn") % 2 == 0, name).otherwise("no such name").alias("law")))
    entries = rows.select(
        F.col("conv_id").cast("string").alias("file_name"), F.col("turn").alias("entry_index"), F.lit(0).alias("law_index"),
        F.concat(F.lit("theo điều 5, 7 "), F.when(n > 0, F.concat(name, F.lit(" "))).otherwise(""), F.lit("điều 5.")).alias("input"), F.when((n > 0) & (F.col("turn") % 2 == 1), raw).otherwise("NL").alias("output_raw"), cited.alias("citations"),
    )
    made = A.samples(entries)
    return made.select(F.col("file_name").cast("long").alias("conv_id"), F.col("entry_index").alias("turn"), F.array_join("tags", ",").alias("tags"))


# ---- the best sequence of section markers: fixed weights, whose sums are exact ------------------------------------------
#: Weight of near_top, near_middle, near_late for each marker.
_PLACES = {"preamble": (0.5, 0.0, 0.0), "noi_dung_vu_an": (0.25, 0.25, 0.0), "dai_dien_vks": (0.0, 0.25, 0.0), "nhan_dinh": (0.0, 0.25, 0.25), "quyet_dinh": (0.0, 0.0, 0.5)}
_START, _END = [0.0, 0.5, 0.0, 0.0, 0.0, -0.5], [0.0, -0.5, 0.0, 0.0, 0.0, 0.25]
#: Tag 0 is none; from one marker to an earlier one costs 3, to itself 1, to a later one nothing.
_MOVE = [[0.25 if s == t == 0 else 0.0 if s == 0 or t == 0 else -3.0 if t < s else -1.0 if t == s else 0.0 for t in range(6)] for s in range(6)]
_EMIT = {m: f"2.0 * regex_{m} + 0.25 * title_like + {top} * near_top + {middle} * near_middle + {late} * near_late" for m, (top, middle, late) in _PLACES.items()}
_USED = ["title_like", "near_top", "near_middle", "near_late", *(f"regex_{m}" for m in P.MARKERS)]
_BEST = "list_transform(range(1, 7), lambda s: v.s[s] + m[s][t])"


@query(f"""WITH RECURSIVE {_LINES}, f AS (SELECT doc_id, line_index, {', '.join(f'({_F26[k]})::DOUBLE AS {k}' for k in _USED)} FROM lines),
e AS MATERIALIZED (SELECT doc_id, line_index, [1.0::DOUBLE, {', '.join(f'({x})::DOUBLE' for x in _EMIT.values())}] AS em, {_START}::DOUBLE[] AS st, {_MOVE}::DOUBLE[][] AS m FROM f),
v AS (SELECT doc_id, line_index, list_transform(em, lambda x, k: x + st[k]) AS s, list_transform(range(6), lambda t: t::VARCHAR) AS p FROM e WHERE line_index = 0
  UNION ALL SELECT e.doc_id, e.line_index, list_transform(range(1, 7), lambda t: em[t] + list_max({_BEST})), list_transform(range(1, 7), lambda t: v.p[list_position({_BEST}, list_max({_BEST}))] || (t - 1)) FROM v JOIN e ON e.doc_id = v.doc_id AND e.line_index = v.line_index + 1),
z AS (SELECT doc_id, p, list_transform(s, lambda x, k: x + {_END}::DOUBLE[][k]) AS s FROM v WHERE (doc_id, line_index) IN (SELECT (doc_id, max(line_index)) FROM lines GROUP BY doc_id))
SELECT doc_id, md5(p[list_position(s, list_max(s))]) AS path, length(p[1])::INT AS n FROM z""".replace(f"{_END}::DOUBLE[][k]", f"({_END}::DOUBLE[])[k]"))
def viterbi_lines(spark, sf_dir):
    """MDL-2, WIN-10: the best marker sequence over every line of every document, its line features as scores"""
    rows = S.features(_lines(spark, sf_dir), P.LICENSE_EN).select("doc_id", "line_index", *_USED)
    scores = F.array(F.lit(1.0), *(F.expr(x.replace(".0 ", ".0D ").replace("0.25 ", "0.25D ").replace("0.5 ", "0.5D ")) for x in _EMIT.values()))
    made = V.decode_rows(rows, "doc_id", "line_index", scores, _START, _END, _MOVE)
    return made.select("doc_id", F.md5(F.array_join(F.col("path").cast("array<string>"), "").cast("binary")).alias("path"), F.size("path").alias("n"))
