"""Page layout: spans to elements, to text that keeps its columns, and to positioned HTML."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType
from pyspark.sql.window import Window

from lawmill.functions import text as T

#: Fixed value: points that a blank takes.
BLANK = 6.0
SPAN = (
    "doc string, page int, block_idx int, block_type int, block_y0 double, line_idx int, line_x0 double, line_y0 double, "
    "span_idx int, x0 double, y0 double, x1 double, y1 double, text string, font string, size double"
)
_LINE = ["doc", "page", "block_idx", "block_y0", "line_idx", "line_y0"]


@F.pandas_udf(DoubleType())
def round1(x: pd.Series) -> pd.Series:
    """One decimal as the standard float rounding has it (0.25 gives 0.2)."""
    return x.map(lambda v: None if pd.isna(v) else round(v, 1))


@F.pandas_udf(StringType())
def fixed1(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")


def text_spans(spans: DataFrame) -> DataFrame:
    """[FLT-12] Spans of text blocks that aren't blank."""
    return spans.where((F.col("block_type") == 0) & (T.strip(F.col("text")) != ""))


def elements(spans: DataFrame) -> DataFrame:
    """[PRJ-6, SRT-2] (doc, page, elements) in reading order; text stripped, box and size to one decimal."""
    box = F.array(*(round1(c) for c in ("x0", "y0", "x1", "y1")))
    rows = text_spans(spans).select(*_LINE, "x0", "span_idx", F.struct(T.strip(F.col("text")).alias("text"), box.alias("bbox"), "font", round1("size").alias("size")).alias("e"))
    order = F.struct("block_y0", "block_idx", "line_y0", "line_idx", "x0", "span_idx", "e")
    made = rows.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["e"]).alias("elements"))
    pages = spans.select("doc", "page").distinct()
    return pages.join(made, ["doc", "page"], "left")


def lines(spans: DataFrame) -> DataFrame:
    """[AGG-16, WIN-5] One row a line with its text: each span preceded by the blanks that fit before it."""
    w = Window.partitionBy(*_LINE).orderBy("x0", "span_idx")
    last = F.lag("x1").over(w)
    gap = F.when(last.isNull(), (F.col("x0") / BLANK).cast("int")).otherwise(F.greatest(F.lit(0), ((F.col("x0") - last) / BLANK).cast("int")))
    rows = text_spans(spans).withColumn("piece", F.concat(F.repeat(F.lit(" "), gap), F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "span_idx", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy(*_LINE).agg(joined.alias("line"))


def markdown(spans: DataFrame) -> DataFrame:
    """[SEM-13] (doc, text): lines in reading order, each page after an empty line."""
    order = F.struct("block_y0", "block_idx", "line_y0", "line_idx", "line")
    pages = lines(spans).groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]).alias("l"))
    every = spans.select("doc", "page").distinct().join(pages, ["doc", "page"], "left")
    body = F.concat(F.array(F.lit("")), F.coalesce("l", F.array().cast("array<string>")))
    docs = every.select("doc", F.struct("page", body.alias("l")).alias("p")).groupBy("doc").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return docs.select("doc", F.array_join(F.flatten(F.transform("ps", lambda p: p["l"])), "\n").alias("text"))


def html(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """[SEM-14, AGG-17, SNK-9] (doc, page, html): a positioned element a line, in native order, styled by its last span.

    sizes(doc, page, width, height) names the pages; one without text has no lines.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "text"))), lambda x: x["text"]), "")
    rows = spans.where("block_type = 0").groupBy("doc", "page", "block_idx", "line_idx", "line_x0", "line_y0")
    rows = rows.agg(text.alias("text"), F.max_by("font", "span_idx").alias("font"), F.max_by("size", "span_idx").alias("size")).where(T.strip(F.col("text")) != "")
    font, size = F.coalesce("font", F.lit("Times New Roman")), F.coalesce("size", F.lit(11.0))
    div = F.concat(F.lit("<div class='text-line' style='left:"), fixed1("line_x0"), F.lit("px;top:"), fixed1("line_y0"), F.lit("px;font-size:"), fixed1(size), F.lit("px;font-family:"), T.escape_html(font), F.lit(";'>"), T.escape_html(F.col("text")), F.lit("</div>"))
    made = rows.withColumn("div", div).groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "line_idx", "div"))), lambda x: x["div"]).alias("d"))
    opening = F.concat(F.lit("<div class='page' style='width:"), F.col("width").cast("string"), F.lit("px;height:"), F.col("height").cast("string"), F.lit("px;' data-page='"), F.col("page").cast("string"), F.lit("'>"))
    parts = F.concat(F.array(opening), F.coalesce("d", F.array().cast("array<string>")), F.array(F.lit("</div>")))
    return sizes.join(made, ["doc", "page"], "left").select("doc", "page", F.array_join(parts, "\n").alias("html"))
