"""Registered queries over pages: all that a crawl takes from them, as typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawmill.operators import links as K
from lawmill.plans.catalog import _t, query

#: A form, a select, a result zone on every third page and a document link, made of each page's own columns and put before its end.
_ZONED = "CASE WHEN page_id % 3 = 0 THEN '<div id=\"List_group_pub\"><a href=\"/case/' || page_id || '?a=1&amp;b=2\">x</a><br><a href=\"javascript:go()\">y</a></div>' ELSE '' END"
_FORM = (
    "'<form id=\"aspnetForm\" action=\"/search/' || page_id || '\"><input type=\"hidden\" name=\"state\" value=\"s' || page_id || '\"><input type=\"checkbox\" name=\"box\" checked>"
    "<input type=\"submit\" name=\"go\" value=\"Go\"><select name=\"court\" id=\"courts\"><option value=\"\">all</option><option value=\"c1\">one</option>"
    "<option value=\"c' || page_id || '\" selected> court ' || page_id || ' </option></select></form><a href=\"/files/no ' || page_id || '.PDF\">pdf</a>'"
)
_HTML = f"html || {_ZONED} || {_FORM}"


def _pages(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.expr(_HTML).alias("html"), F.lit("https://h.example/a/b").alias("url"))


_HREFS = r"""list_transform(regexp_extract_all(h, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), lambda x: replace(trim(x), '&amp;', '&'))"""
#: The tables' links are absolute, or start with "/" or "#".
_WHOLE = "CASE WHEN regexp_matches(x, '^[a-z]+://') THEN x WHEN starts_with(x, '/') THEN 'https://h.example' || x WHEN x = '' THEN 'https://h.example/a/b' WHEN starts_with(x, '#') THEN 'https://h.example/a/b' || x WHEN starts_with(x, 'mailto:') THEN x ELSE 'https://h.example/a/' || x END"


@query(f"""WITH p AS (SELECT page_id, {_HTML} AS h FROM pages),
z AS (SELECT page_id, page_id % 3 = 0 AS zone, CASE WHEN page_id % 3 = 0 THEN ['/case/' || page_id || '?a=1&b=2'] ELSE {_HREFS} END AS l FROM p),
l AS (SELECT page_id, zone, list_sort(list_distinct(list_transform(list_filter(l, lambda x: NOT starts_with(x, 'javascript:') AND NOT contains(lower(x), 'tra-cu-ban-an')), lambda x: {_WHOLE}))) AS l FROM z)
SELECT page_id, 'link' AS kind, NULL AS name, unnest(l) AS value, NULL AS text, (generate_subscripts(l, 1) - 1)::INT AS place, zone AS in_zone FROM l
UNION ALL SELECT page_id, 'pdf', NULL, 'https://h.example/files/no%20' || page_id || '.PDF', NULL, 0, NULL FROM pages
UNION ALL SELECT page_id, 'action', NULL, 'https://h.example/search/' || page_id, NULL, 0, NULL FROM pages
UNION ALL SELECT page_id, 'field', f.name, replace(f.value, '#', page_id::VARCHAR), NULL, f.place, NULL FROM pages, (VALUES ('__EVENTTARGET', '', 0), ('__EVENTARGUMENT', '', 1), ('state', 's#', 2), ('box', 'on', 3), ('court', 'c#', 4)) f(name, value, place)
UNION ALL SELECT page_id, 'option', 'courts', replace(o.value, '#', page_id::VARCHAR), replace(o.text, '#', page_id::VARCHAR), o.place, NULL FROM pages, (VALUES ('c1', 'one', 0), ('c#', 'court #', 1)) o(value, text, place)""")
def page_items(spark, sf_dir):
    """UDTF-1, PRS-6, PRS-7, PRS-8, PRS-10, PRS-11, FLT-9, FLT-10, SRT-3: one parse a page, joined laterally"""
    return K.page_items(_pages(spark, sf_dir)).select("page_id", "kind", "name", "value", "text", "place", "in_zone")
