"""Registered queries over page layout: spans with boxes made of every page's tags, written as a table and laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmill.operators import layout as Y
from lawmill.plans.catalog import _t, query
from lawmill.sources import scratch

# Paragraphs are blocks, line breaks part lines, what stands between angle brackets are spans. Boxes follow the places, so that the
# reading order differs from the native one, with ties; five pages make a document; every ninth block is an image.
_BOXES = {
    "block_type": "CASE WHEN block_idx % 9 = 8 THEN 1 ELSE 0 END", "block_y0": "(block_idx * 37) % 11 * 10.5", "line_x0": "line_idx % 3 * 6.5", "line_y0": "(block_idx * 37) % 11 * 10.5 + (line_idx * 7) % 5",
    "x0": "(span_idx * 53) % 97 * 2.5", "y0": "(line_idx * 7) % 5 * 1.0", "x1": "(span_idx * 53) % 97 * 2.5 + length(text) * 4.5", "y1": "(line_idx * 7) % 5 + 9.5",
    "font": "CASE WHEN span_idx % 4 = 0 THEN 'F&' WHEN span_idx % 4 < 3 THEN 'G' END", "size": "CASE WHEN span_idx % 5 > 0 THEN 8.5 + span_idx % 5 END",
}


def _spans(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "pages").select(F.expr("page_id div 5").cast("string").alias("doc"), F.expr("int(page_id % 5 + 1)").alias("page"), F.posexplode(F.split("html", "</p>", -1)).alias("block_idx", "b"))
    rows = rows.select("doc", "page", "block_idx", F.posexplode(F.split("b", "<br>", -1)).alias("line_idx", "l"))
    rows = rows.select("doc", "page", "block_idx", "line_idx", F.posexplode(F.split("l", "[<>]", -1)).alias("span_idx", "text"))
    kinds = dict(x.split() for x in Y.SPAN.split(", "))
    made = rows.withColumns({k: F.expr(v).cast(kinds[k]) for k, v in _BOXES.items()})
    return scratch.written(made.select(*(F.col(c).cast(t) for c, t in kinds.items())), "spans")


_SPANS = f"""
b AS (SELECT (page_id // 5)::VARCHAR AS doc, (page_id % 5 + 1)::INT AS page, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS block_idx FROM (SELECT page_id, string_split(html, '</p>') AS l FROM pages)),
l AS (SELECT doc, page, block_idx, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS line_idx FROM (SELECT *, string_split(b, '<br>') AS l FROM b)),
p AS (SELECT doc, page, block_idx, line_idx, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS span_idx FROM (SELECT *, string_split(replace(l, '>', '<'), '<') AS x FROM l)),
s AS (SELECT *, {', '.join(f'({v})' + ('::DOUBLE' if k not in ('block_type', 'font') else '') + f' AS {k}' for k, v in _BOXES.items())} FROM p),
t AS (SELECT * FROM s WHERE block_type = 0 AND regexp_matches(text, '[^\\s]'))
"""
_ORDER = "block_y0, block_idx, line_y0, line_idx"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH {_SPANS}, g AS (SELECT *, lag(x1) OVER (PARTITION BY doc, page, block_idx, line_idx ORDER BY x0, span_idx) AS last FROM t),
n AS (SELECT doc, page, {_ORDER}, string_agg(repeat(' ', (CASE WHEN last IS NULL THEN trunc(x0 / 6.0) ELSE greatest(0, trunc((x0 - last) / 6.0)) END)::BIGINT) || text, '' ORDER BY x0, span_idx) AS line FROM g GROUP BY ALL),
a AS (SELECT doc, page, 0 AS k, NULL::DOUBLE AS block_y0, NULL AS block_idx, NULL::DOUBLE AS line_y0, NULL AS line_idx, '' AS line FROM s GROUP BY ALL UNION ALL SELECT doc, page, 1, block_y0, block_idx, line_y0, line_idx, line FROM n)
SELECT doc, md5(string_agg(line, chr(10) ORDER BY page, k, {_ORDER})) AS text, count(*) FILTER (WHERE k = 1)::BIGINT AS n_lines FROM a GROUP BY doc""")
def layout_markdown(spark, sf_dir):
    """SEM-13, WIN-5, AGG-16, FLT-12, SRT-2: every page's spans to text that keeps its columns"""
    spans = _spans(spark, sf_dir)
    counts = Y.lines(spans).groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"))
    return Y.markdown(spans).join(counts, "doc", "left").select("doc", F.md5(F.col("text").cast("binary")).alias("text"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query(f"SELECT * FROM (WITH {_SPANS} SELECT doc, page, (row_number() OVER (PARTITION BY doc, page ORDER BY {_ORDER}, x0, span_idx))::INT AS i, {_STRIP.format('text')} AS text, x0, x1, font, size FROM t)")
def layout_elements(spark, sf_dir):
    """PRJ-6, SRT-2: every element of every page in reading order"""
    made = Y.elements(_spans(spark, sf_dir)).select("doc", "page", F.posexplode("elements").alias("i", "e"))
    at = lambda k: F.get("e.bbox", F.lit(k))
    return made.select("doc", "page", (F.col("i") + 1).alias("i"), "e.text", at(0).alias("x0"), at(2).alias("x1"), "e.font", "e.size")


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query(f"""WITH {_SPANS}, n AS (SELECT doc, page, block_idx, line_idx, line_x0, line_y0, string_agg(text, '' ORDER BY span_idx) AS text, arg_max(font, span_idx) FILTER (WHERE font IS NOT NULL) AS f0,
  list(font ORDER BY span_idx DESC)[1] AS font, list(size ORDER BY span_idx DESC)[1] AS size FROM s WHERE block_type = 0 GROUP BY ALL),
d AS (SELECT doc, page, block_idx, line_idx, printf('<div class=''text-line'' style=''left:%.1fpx;top:%.1fpx;font-size:%.1fpx;font-family:', line_x0, line_y0, coalesce(size, 11.0)) || {_ESCAPED.format("coalesce(font, 'Times New Roman')")} || ';''>' || {_ESCAPED.format('text')} || '</div>' AS div FROM n WHERE regexp_matches(text, '[^\\s]')),
e AS (SELECT doc, page, string_agg(div, chr(10) ORDER BY block_idx, line_idx) AS body FROM d GROUP BY ALL)
SELECT q.doc, q.page, md5('<div class=''page'' style=''width:595.0px;height:842.0px;'' data-page=''' || q.page || '''>' || coalesce(chr(10) || body, '') || chr(10) || '</div>') AS html FROM (SELECT DISTINCT doc, page FROM s) q LEFT JOIN e ON e.doc = q.doc AND e.page = q.page""")
def layout_html(spark, sf_dir):
    """SEM-14, AGG-17, SNK-9: every page as positioned lines"""
    spans = _spans(spark, sf_dir)
    sizes = spans.select("doc", "page").distinct().select("doc", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return Y.html(spans, sizes).select("doc", "page", F.md5(F.col("html").cast("binary")).alias("html"))
