"""Keyed state: first writer wins, last writer wins, updates of what is there, and the crawl's states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, DOWNLOADED, SCANNED, FAILED = "pending", "downloaded", "skipped_scanned", "failed"
LEDGER = "url string, case_id string, pdf_url string, status string, text_length int, pdf_filename string, court_value string, court_name string, created_at timestamp, updated_at timestamp"


def add_new(ledger: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """[SNK-4, JON-14] The ledger and those rows whose key it lacks; of several, the first in order."""
    fresh = latest(rows, keys, order, last=False) if order else rows.dropDuplicates(keys)
    return ledger.unionByName(fresh.join(ledger, keys, "left_anti"), allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """[SNK-5, STR-5] One row a key: the last in order (or the first). Rows are reduced before they are shuffled."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns))


def upsert(ledger: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """[SNK-5, SNK-7] Later rows replace earlier ones of the same key; columns only one side has are kept as nulls."""
    return latest(ledger.unionByName(rows, allowMissingColumns=True), keys, order)


def update(ledger: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """[SNK-6] Columns of known keys; a null change keeps what is there, an unknown key is ignored."""
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = ledger.join(new, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in ledger.columns))


def settled(status: Column) -> Column:
    """[FLT-8] Done for good; failed is tried again."""
    return status.isin(DOWNLOADED, SCANNED)


def outcome(pdf_url: Column, text: Column) -> Column:
    """[STR-5, FLT-11] The state after a download."""
    from lawmill.operators.links import too_short

    return F.when(pdf_url.isNull() | text.isNull(), FAILED).when(too_short(text), SCANNED).otherwise(DOWNLOADED)


def waiting(ledger: DataFrame) -> DataFrame:
    """[AGG-14]"""
    return ledger.agg(F.sum(F.when(F.col("status") == PENDING, 1).otherwise(0)).cast("long").alias("pending"))
