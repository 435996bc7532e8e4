"""Readers and writers of the pipeline's files and tables. Ids in brackets are those of the survey."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.functions import text as T


def markdown(spark: SparkSession, folder: str, pattern: str = "*.md", lenient: bool = False) -> DataFrame:
    """[SRC-1, SRC-2] (file_name, text), a file a row. lenient drops bytes that aren't UTF-8; order is by explicit sort only."""
    if not lenient:
        files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
        return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    decode = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("utf-8", "ignore")), "string")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), decode("content").alias("text"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[SRC-3] A file with an array of objects, or with one."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, bad: str = "count") -> DataFrame:
    """[SRC-4, SRC-5, SRC-6, SET-3] bad: "drop" malformed lines, or "count" them as rows with _corrupt set."""
    if bad == "drop":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(paths)


def titles(spark: SparkSession, path: str, column: str = "title") -> DataFrame:
    """[SRC-7, SRC-9] Titles of a CSV with a header, stripped, without empty ones; repeats stay."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(T.strip(F.col(column).cast("string")).alias("title")).where("title <> ''")


def titles_by_place(spark: SparkSession, path: str) -> DataFrame:
    """[SRC-8] The first column, a first row "title" left out, quotes stripped, each title once in order of place."""
    rows = spark.read.option("escape", '"').csv(path).select(F.monotonically_increasing_id().alias("place"), F.col("_c0").alias("t"))
    first = rows.agg(F.min("place")).first()[0]
    kept = rows.where(~((F.col("place") == F.lit(first)) & (F.lower(F.trim("t")) == "title"))).where(F.trim("t") != "")
    title = F.btrim(F.trim("t"), F.lit('"'))
    return kept.groupBy(title.alias("title")).agg(F.min("place").alias("place")).orderBy("place")


def snippets(spark: SparkSession, path: str) -> DataFrame:
    """[SRC-11] (text) of each line that isn't blank."""
    return spark.read.text(path).select(T.strip(F.col("value")).alias("text")).where("text <> ''")


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """[SRC-10] (pdf_path, ocr_text)."""
    return spark.read.parquet(path).select("pdf_path", "ocr_text")


def table(spark: SparkSession, url: str, name: str) -> DataFrame:
    """[SRC-14] A ledger in any JDBC database; parquet ledgers need no reader of their own."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).load()


def pdf_spans(spark: SparkSession, folder: str, reader: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """[SRC-12] Layout spans of PDF files. reader takes a file's bytes and returns span rows without doc; PyMuPDF if installed."""
    from lawmill.operators.layout import SPAN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader or _pymupdf
        for pdf in batches:
            rows = [{"doc": path} | row for path, content in zip(pdf["path"], pdf["content"], strict=True) for row in read(bytes(content))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPAN.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", "content").mapInPandas(run, SPAN)


def _pymupdf(content: bytes) -> list[dict]:
    import fitz

    rows = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            for i, block in enumerate(page.get_text("dict")["blocks"]):
                for j, line in enumerate(block.get("lines", [])):
                    for k, span in enumerate(line["spans"]):
                        box = dict(zip(("x0", "y0", "x1", "y1"), map(float, span["bbox"]), strict=True))
                        place = {"page": number, "block_idx": i, "block_type": block["type"], "block_y0": float(block["bbox"][1]), "line_idx": j, "line_x0": float(line["bbox"][0]), "line_y0": float(line["bbox"][1])}
                        rows.append(place | box | {"span_idx": k, "text": span["text"], "font": span["font"], "size": float(span["size"])})
    return rows


def fetch(urls: DataFrame, fetcher: Callable[[str], tuple[str | None, bytes | None]]) -> DataFrame:
    """[SRC-15, SRC-16, STR-1, STR-9] (url, html, content) by an injected fetcher; as many at once as partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [fetcher(u) for u in pdf["url"]]
            yield pd.DataFrame({"url": pdf["url"], "html": [g[0] for g in got], "content": [g[1] for g in got]})

    return urls.select("url").mapInPandas(run, "url string, html string, content binary")


def write_json_array(df: DataFrame, folder: str, order: list[str]) -> None:
    """[SNK-1] A pretty UTF-8 array as ordered parts, written by the tasks and committed at once; json_array.read reads it."""
    from lawmill.sources.json_array import JsonArray

    df.sparkSession.dataSource.register(JsonArray)
    df.orderBy(*order).write.format("json_array").mode("overwrite").save(folder)


def write_triage(labelled: DataFrame, unlabelled: DataFrame, filtered: DataFrame, folder: str) -> None:
    """[SNK-3]"""
    for name, df in (("labeled", labelled), ("unlabeled", unlabelled), ("unlabeled_filtered", filtered)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_texts(df: DataFrame, folder: str, text: str = "text") -> None:
    """[SNK-8, SNK-9, SNK-10] Markdown, HTML or JSON strings as text files, by Spark's own committer."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(folder)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """[SNK-11] Each row's bytes as a file of its own in a shared folder (any that Arrow opens); returns (name, size).

    A file is written under a task's own name and then renamed, so a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root)
        task = TaskContext.get().taskAttemptId()
        for pdf in batches:
            for n, data in zip(pdf["name"], pdf["content"], strict=True):
                inner, _, own = f"{root}/{n}".rpartition("/")
                store.create_dir(inner)
                with store.open_output_stream(f"{inner}/.{own}.{task}") as f:
                    f.write(bytes(data))
                store.move(f"{inner}/.{own}.{task}", f"{inner}/{own}")
            yield pd.DataFrame({"name": pdf["name"], "size": [len(x) for x in pdf["content"]]})

    rows = df.select(F.col(name).alias("name"), F.col(content).alias("content")).where("content is not null")
    return rows.mapInPandas(run, "name string, size long")
