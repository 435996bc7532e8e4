"""Page items by the lateral join against the plain functions."""

from test_reference import HTML

from lawmill.operators import links as K


def test_items_of_a_page(spark):
    pages = spark.createDataFrame([(1, HTML, "https://h/x/"), (2, None, None), (3, "", "https://h/"), (4, "<a href='http://[x'>b</a><a href=y.pdf>", "https://h/")], "page_id long, html string, url string")
    rows = [tuple(r) for r in K.page_items(pages).select("page_id", "kind", "name", "value", "text", "place", "in_zone").collect()]
    of = lambda page, kind: [r[2:5] for r in sorted((r for r in rows if r[:2] == (page, kind)), key=lambda r: r[5])]
    assert [v for _, v, _ in of(1, "link")] == K.page_links(HTML, "https://h/x/")
    assert of(1, "pdf") == [(None, K.pdf_link(HTML, "https://h/x/"), None)]
    fields, action = K.form_fields(HTML, "https://h/x/")
    assert {n: v for n, v, _ in of(1, "field")} == fields and of(1, "action") == [(None, action, None)]
    assert of(1, "option") == [("sel", "2", "two")]
    assert of(2, "field") == of(3, "field") == [("__EVENTTARGET", "", None), ("__EVENTARGUMENT", "", None)]
    assert of(3, "action") == [(None, "https://h/", None)] and of(2, "link") == []
    assert of(4, "link") == [(None, "http://[x", None), (None, "https://h/y.pdf", None)] and of(4, "pdf")[0][1] == "https://h/y.pdf"


def test_empty_table(spark):
    assert K.page_items(spark.createDataFrame([], "html string, url string")).count() == 0
