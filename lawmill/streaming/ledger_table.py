"""A keyed table in hash buckets, of which a batch rewrites only those it touches.

    <path>/data/batch=<number>-<id>/bucket=<b>/…   Parquet files, never changed once written
    <path>/manifest/version=<n>/…                  one file: for each bucket the folder that holds it, and the last batch

A version comes into sight with its one manifest file, so readers see all of a batch or nothing; what a failed attempt has left in
`data` is in no manifest and harmless. A batch that was applied before is passed over, so a stream that restarts may send it again.
One writer at a time. Bytes written follow the batch: at most as many buckets as it has keys; choose `buckets` so that one is quickly
rewritten. Null keys are keys; an empty batch adds a version and writes no data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.operators import ledger as G
from lawmill.sources import scratch

MANIFEST = "batch long, bucket int, folder string"


class LedgerTable:
    """[SNK-4..7, STR-3] keys: the key columns; order: of rows with one key the last in it stays."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def manifest(self) -> tuple[int, int, dict[int, str]]:
        """(version, last batch, folder of each bucket); the rows are as many as buckets."""
        try:
            rows = self.spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.path}/manifest")
            last = rows.agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        if last is None:
            return -1, -1, {}
        found = rows.where(F.col("version") == last).collect()
        return last, max(r["batch"] for r in found), {r["bucket"]: r["folder"] for r in found if r["folder"]}

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """The ledger, or some buckets of it; None where nothing has been written."""
        folders = [f for b, f in sorted(self.manifest()[2].items()) if only is None or b in only]
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def apply(self, rows: DataFrame, number: int, step: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None) -> bool:
        """Upsert rows as batch `number`; False if it was applied before.

        step(rows, old) may turn the rows of the batch, one a key, into those that are written, knowing the touched buckets.
        """
        version, done, folders = self.manifest()
        if number <= done:
            return False
        fresh = scratch.written(G.latest(rows, self.keys, self.order), "ledger-batch")
        touched = {r[0] for r in fresh.select(self.bucket()).distinct().collect()}
        if touched:
            old = self.read(touched)
            made = step(fresh, old) if step else fresh
            full = made if old is None else G.upsert(old, made, self.keys, self.order)
            folder = f"data/batch={number:09d}-{uuid.uuid4().hex[:8]}"
            full.withColumn("bucket", self.bucket()).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            folders = folders | {b: f"{folder}/bucket={b}" for b in touched}
        lines = [(number, b, f) for b, f in sorted(folders.items())] or [(number, -1, "")]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version + 1}")
        return True
