"""Links, forms and names found in pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlparse, urlunparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the listing site.
ZONE, SEARCH_PAGE = "List_group_pub", "tra-cu-ban-an"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_PRESSED = {"submit", "button", "file", "image"}


class Page(HTMLParser):
    """What the crawl needs of a page: links and whether they are in the zone, form fields, options of selects."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.links, self.forms, self.selects, self.open, self.in_zone, self.has_zone = [], [], {}, [], 0, False
        self.form = self.select = None
        self.feed(text)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag not in _VOID:
            self.open.append((tag, a.get("id") == ZONE))
            self.in_zone += self.open[-1][1]
            self.has_zone |= self.open[-1][1]
        if tag == "a" and "href" in a:
            self.links.append((a["href"].strip(), "download" in a, self.in_zone > 0))
        elif tag == "form":
            self.form = {"id": a.get("id", ""), "action": a.get("action", ""), "fields": {}, "chosen": {}}
            self.forms.append(self.form)
        elif tag == "input" and self.form is not None and a.get("name"):
            kind = (a.get("type") or "text").lower()
            if kind in ("checkbox", "radio"):
                if "checked" in a:
                    self.form["fields"][a["name"]] = a.get("value", "on")
            elif kind not in _PRESSED:
                self.form["fields"][a["name"]] = a.get("value", "")
        elif tag == "select":
            self.select = {"id": a.get("id", ""), "name": a.get("name", ""), "options": []}
            self.selects[self.select["id"] or self.select["name"]] = self.select
            if self.form is not None and self.select["name"]:
                self.form["chosen"][self.select["name"]] = self.select
        elif tag == "option" and self.select is not None:
            self.select["options"].append({"value": a.get("value", ""), "selected": "selected" in a, "text": ""})

    def handle_endtag(self, tag: str) -> None:
        if tag in ("form", "select"):
            setattr(self, tag, None)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.in_zone -= sum(zone for _, zone in self.open[i:])
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.select is not None and self.select["options"]:
            self.select["options"][-1]["text"] += data


def joined(base: str, href: str) -> str:
    """The absolute address; what is no address stays as it is."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def page_links(text: str | Page | None, base: str) -> list[str]:
    """[PRS-7, FLT-10, SRT-3] Absolute links of the result zone, else of the page, sorted and distinct."""
    page = parsed(text)
    links = [href for href, _, zone in page.links if zone or not page.has_zone]
    return sorted({joined(base, h) for h in links if not h.startswith("javascript:") and SEARCH_PAGE not in h.lower()})


def parsed(text: str | Page | None) -> Page:
    return text if isinstance(text, Page) else Page(text or "")


def pdf_link(text: str | Page | None, url: str, encode: bool = True) -> str | None:
    """[PRS-8, PRS-11] The first link to a .pdf or with a download mark, its path percent-encoded."""
    for href, download, _ in parsed(text).links:
        if href.lower().endswith(".pdf") or download:
            try:
                p = urlparse(href)
            except ValueError:
                return href
            return joined(url, urlunparse(p._replace(path=quote(p.path, safe="/"))) if encode else href)
    return None


def form_fields(text: str | Page | None, url: str, form_id: str = "aspnetForm") -> tuple[dict[str, str], str]:
    """[PRS-6] (fields, action) of the named form, else of the first: values, checked boxes, chosen or first options."""
    forms = parsed(text).forms
    form = next((f for f in forms if f["id"] == form_id), forms[0] if forms else {"action": "", "fields": {}, "chosen": {}})
    fields = dict(form["fields"])
    for name, select in form["chosen"].items():
        options = select["options"]
        fields[name] = next((o for o in options if o["selected"]), options[0])["value"] if options else ""
    return {"__EVENTTARGET": "", "__EVENTARGUMENT": ""} | fields, joined(url, form["action"] or url)


def options(text: str | Page | None, select: str, exclude: set[str] = frozenset()) -> list[tuple[str, str]]:
    """[PRS-10, FLT-9] (value, text) of a select's options, without empty and excluded ones."""
    found = parsed(text).selects.get(select, {"options": []})["options"]
    pairs = [(o["value"].strip(), o["text"].strip()) for o in found]
    return [(v, t) for v, t in pairs if v and t and v not in exclude]


#: kind: "link" (value: absolute address), "pdf", "action", "field" (name, value), "option" (name of the select, value, text); place counts from 0 within a kind.
ITEM = "kind string, name string, value string, text string, place int, in_zone boolean"


@F.udtf(returnType=ITEM)
class PageItems:
    """[UDTF-1, PRS-6, PRS-7, PRS-8, PRS-10, PRS-11, FLT-9, FLT-10, SRT-3] What a crawl needs of a page, by one parse, as typed rows.

    A null page is an empty one and a null address "": it has the two event fields and an action. A link that is no address stays as
    it is. Long pages cost their length once.
    """

    def eval(self, html: str, url: str):
        page, base = Page(html or ""), url or ""
        for k, link in enumerate(page_links(page, base)):
            yield "link", None, link, None, k, page.has_zone
        if (pdf := pdf_link(page, base)) is not None:
            yield "pdf", None, pdf, None, 0, None
        fields, action = form_fields(page, base)
        yield "action", None, action, None, 0, None
        for k, (name, value) in enumerate(fields.items()):
            yield "field", name, value, None, k, None
        for select in page.selects:
            for k, (value, text) in enumerate(options(page, select)):
                yield "option", select, value, text, k, None


def page_items(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Each row of pages beside its items, by a lateral join."""
    return pages.lateralJoin(PageItems(F.col(html).outer(), F.col(url).outer()))


def plain_links(html: Column) -> Column:
    """[PRS-7] Link targets by pattern, for pages without a zone: native, sorted, distinct, filtered."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1)), lambda h: F.trim(h))
    return F.array_sort(F.array_distinct(F.filter(hrefs, lambda h: ~h.startswith("javascript:") & ~F.contains(F.lower(h), F.lit(SEARCH_PAGE)))))


def case_id(url: Column) -> Column:
    """[PRS-9] The first part of a URL's path."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(0)), F.lit("unknown_id"))


def too_short(text: Column, least: int = 200) -> Column:
    """[FLT-11, SRC-13] A page image without text."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least
