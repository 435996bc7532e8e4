"""Labelling as a stream: an injected labeller, resumable by key, and a ledger that each micro-batch upserts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lawmill.operators import labels as L
from lawmill.streaming.ledger_table import LedgerTable

Labeller = Callable[[str], str]


def with_retry(call: Labeller, attempts: int = 3, wait: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> Labeller:
    """[STR-7] Linear waits between attempts; what still fails is an "ERROR: …" answer, which stays pending."""

    def run(prompt: str) -> str:
        for k in range(attempts):
            try:
                return call(prompt)
            except Exception as e:  # any client's failure counts as an attempt
                last = e
                if k + 1 < attempts:
                    sleep(wait * (k + 1))
        return f"ERROR: {last}"

    return run


def ask(rows: DataFrame, labeller: Labeller, prompt: str = "prompt", out: str = "raw_response") -> DataFrame:
    """[SRC-17] rows with the labeller's answers; partitions are the concurrency."""
    schema = rows.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [labeller(p) for p in pdf[prompt]]})

    return rows.mapInPandas(run, schema)


def offline(rows: DataFrame) -> DataFrame:
    """The stand-in without a network: the rule's label as three digits."""
    rule = L.rule_label(F.col("candidate_line"), F.col("expected_marker_type"), F.col("candidate_kind"))
    kinds = F.array(*map(F.lit, ["none", *L.P.MARKERS]))
    marker = F.array_position(kinds, F.coalesce(rule["marker_type"], F.lit("none"))) - 1
    digits = F.concat(F.coalesce(rule["label"], F.lit(0)).cast("string"), marker.cast("string"), F.greatest(F.lit(1), L.confidence_rank(rule["confidence"])).cast("string"))
    return rows.withColumn("raw_response", digits)


def answered(rows: DataFrame) -> DataFrame:
    """[PRS-3, PRS-5] Labels from the answers, beside those of the rules."""
    rule = L.rule_label(F.col("candidate_line"), F.col("expected_marker_type"), F.col("candidate_kind"))
    got = L.parse_marker(F.col("raw_response"))
    return rows.withColumn("__g", got).select(*rows.columns, "__g.*", *(rule[c].alias(f"rule_{c}") for c in ("label", "marker_type", "confidence", "reason")))


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, label: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 64):
    """[STR-2, STR-3, SNK-2, SNK-5] Start a query that labels what the ledger lacks and upserts it, bucket by bucket.

    Rows answered before are not asked again, unless the answer was an error. `Ticks` on the session's listeners shows the progress.
    """
    table = LedgerTable(stream.sparkSession, path, keys, order, buckets)

    def step(rows: DataFrame, old: DataFrame | None) -> DataFrame:
        if old is not None:
            rows = L.pending(rows, old, keys, ~F.coalesce(F.col("raw_response"), F.lit("")).startswith("ERROR:") if "raw_response" in old.columns else None)
        return label(rows)

    counted = stream.observe(Ticks.METRIC, F.count(F.lit(1)).alias("rows"))
    return counted.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number, step)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger as of its last version, or None."""
    return LedgerTable(spark, path, [], "").read()


class Ticks(StreamingQueryListener):
    """[STR-6, SNK-15] tick(rows so far) after each `every_rows` rows or `every_seconds` seconds, by what the batches were observed to read."""

    METRIC = "ledger_rows"

    def __init__(self, tick: Callable[[int], None], every_rows: int = 50, every_seconds: float = 180.0, clock: Callable[[], float] = time.monotonic):
        self.tick, self.every_rows, self.every_seconds, self.clock = tick, every_rows, every_seconds, clock
        self.rows = self.told = 0
        self.at = clock()

    def onQueryStarted(self, event) -> None:
        self.at = self.clock()

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.METRIC)
        self.add(seen["rows"] if seen else 0)

    def add(self, rows: int) -> None:
        self.rows += rows
        if self.rows // self.every_rows > self.told // self.every_rows or self.clock() - self.at >= self.every_seconds:
            self.told, self.at = self.rows, self.clock()
            self.tick(self.rows)

    def onQueryIdle(self, event) -> None:
        self.add(0)

    def onQueryTerminated(self, event) -> None:
        if self.rows > self.told:
            self.told = self.rows
            self.tick(self.rows)
