"""Substring dedup over a log-structured index of window fingerprints.

Which of a text's 50-word windows also start in a document with a smaller doc_id? Every window has an anchor: the least
of the hashes of the 25-word sequences in it. Equal windows have equal anchors, and a text has about one anchor for thirteen words,
so anchors alone are indexed: each batch's (anchor, document) pairs become a sorted immutable run, cut into buckets of
anchors. A new batch is merge-joined with the runs before it bucket by bucket: the batch's distinct anchors are dealt
into the buckets, the runs are read where they lie and never shuffled. An anchor of many documents lies in several
buckets, by a salt that the run's small table of such anchors gives. Only documents that share an anchor are candidates,
their windows under shared anchors are verified by 96 bits of hashes of all fifty words, and runs are compacted into one
when there are more than `most_runs` of them. Batches are taken in ascending doc_id order, so what a batch meets in the
index is what precedes it; a store that is kept (`Index`) dedups further batches without reading the old texts that
share nothing. `dedup` takes its table in several batches and verifies the candidates of all of them at once, so each
text is fetched once at most.

Texts that are equal as a whole are one unit, represented by its smallest doc_id; the others lose every word if they
have a window at all.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm.common import HashedWords, fresh_path, materialize, table, union_all

WINDOW = 50
BATCHES = 4
MOST_RUNS = 2
#: Rows of one anchor in a bucket of a run: an anchor of more has several salts.
_HOT = 1 << 16
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORDS: list[HashedWords] = []


def _hashes(words: list[bytes]) -> np.ndarray:
    if not _WORDS:
        _WORDS.append(HashedWords())
    return _WORDS[0].array(words)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(2 * n, 1 << 12)
            with np.errstate(over="ignore"):
                up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n - 1, b, np.uint64)]), dtype=np.uint64) for b in (self.base, pow(self.base, -1, 1 << 64)))
            self.kept = up, down
        return self.kept[0][:n], self.kept[1][:n]


_POWERS = [Powers(b) for b in _BASES]


def sequences(h: np.ndarray, length: int, which: int) -> np.ndarray:
    """Polynomial hashes of all runs of `length` words, finished so that each bit depends on all."""
    up, down = _POWERS[which].upto(len(h))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
        x = (sums[length:] - sums[:-length]) * down[: len(h) - length + 1]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return x


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: the least hash of the sequences of half a window in it."""
    half = max(1, window // 2)
    low, want, have = sequences(h, half, 0), window - half + 1, 1
    while 2 * have <= want:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    return np.minimum(low[: len(low) - (want - have)], low[want - have :]) if want > have else low


def scan(window: int):
    """(doc_id, key, raw) to (doc_id, key, n_words, sha, anchors): what a text is without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, marks = [], [], []
            for raw in batch.column(2).to_pylist():
                words = raw.split() if raw else []
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                marks.append(np.unique(anchors(_hashes(words), window)).view(np.int64) if len(words) >= window else np.empty(0, np.int64))
            size = np.cumsum([0, *map(len, marks)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([np.empty(0, np.int64), *marks])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha), lists], ["doc_id", "key", "n_words", "sha", "anchors"])

    return run


def windows(window: int):
    """(unit, doc, new, shared, raw) to the windows under shared anchors: (w, x, unit, doc, new, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                unit, doc, new, shared, raw = (batch.column(c)[i] for c in range(5))
                h = _hashes(raw.as_py().split())
                at = np.flatnonzero(np.isin(anchors(h, window), shared.values.to_numpy().view(np.uint64)))
                for part in np.array_split(at, max(1, len(at) // 200_000)):
                    w, x = (sequences(h, window, k)[part] for k in (0, 1))
                    fill = lambda v, t: pa.array(np.full(len(part), v.as_py()), t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w.view(np.int64)), pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32)), fill(unit, pa.int64()), fill(doc, pa.int64()), fill(new, pa.bool_()), pa.array(part.astype(np.int32))],
                        ["w", "x", "unit", "doc", "new", "at"],
                    )

    return run


def cut(window: int):
    """(unit, starts, raw) to (unit, n_removed, sha) with the words of the windows at starts removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha = [], []
            for starts, raw in zip(batch.column(1), batch.column(2), strict=True):
                words = raw.as_py().split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = starts.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(sha)], ["unit", "n_removed", "sha"])

    return run


class Index:
    """Immutable runs (anchor, salt, unit, doc) in the shared folder, each in buckets of (anchor, salt) and sorted in them.

    hot[i] has the anchors of runs[i] with more than one salt: (anchor, top), their greatest.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, most_runs: int = MOST_RUNS):
        self.spark, self.path, self.window, self.most_runs, self.runs, self.hot, self.turn = spark, path, window, most_runs, [], [], 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        self.turn += 1
        many = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _HOT)
        hot = materialize(many.select("anchor", F.floor(F.col("n") / _HOT).cast("int").alias("top")), "runs-hot")
        salt = F.when(F.col("top").isNull(), 0).otherwise(F.pmod(F.xxhash64("unit"), F.col("top") + 1)).cast("int")
        salted = rows.join(hot, "anchor", "left").select("anchor", salt.alias("salt"), "unit", "doc")
        # dealt like the buckets, so that a bucket is one file
        return self._keep(salted.repartition(self.buckets, "anchor", "salt")), hot

    def _keep(self, rows: DataFrame) -> DataFrame:
        """rows(anchor, salt, unit, doc) as the next run."""
        name, at = f"lawmill_run_{uuid.uuid4().hex}", f"{self.path}/run-{self.turn:05d}"
        rows.write.bucketBy(self.buckets, "anchor", "salt").sortBy("anchor", "salt").option("path", at).saveAsTable(name)
        return self.spark.table(name)

    def append(self, rows: DataFrame) -> DataFrame:
        """Add a batch as a run of its own."""
        run, hot = self._write(rows.select("anchor", "unit", "doc"))
        self.runs.append(run)
        self.hot.append(hot)
        return run

    def compact(self) -> None:
        """Merge all runs into one if there are more than most_runs; old runs stay readable for those who read them.

        Runs share their buckets, so a bucket of the new run is made of the same bucket of each: rows keep their salts and
        are not shuffled, but for those of anchors that came to over 2 * _HOT rows under one salt, which are salted anew.
        """
        if len(self.runs) <= self.most_runs:
            return
        self.turn += 1
        rows, hot = union_all(self.runs), union_all(self.hot).groupBy("anchor").agg(F.max("top").alias("top"))
        full = rows.groupBy("anchor", "salt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * _HOT)
        full = materialize(full.select("anchor").distinct(), "runs-full")
        if full.limit(1).count():
            moved = materialize(union_all([self.under(*b, full) for b in zip(self.runs, self.hot, strict=True)]), "runs-moved")
            tops = materialize(moved.groupBy("anchor").agg(F.floor(F.count(F.lit(1)) / _HOT).cast("int").alias("top")), "runs-tops")
            salt = F.pmod(F.xxhash64("unit"), F.col("top") + 1).cast("int").alias("salt")
            anew = moved.join(tops, "anchor").select("anchor", salt, "unit", "doc").repartition(self.buckets, "anchor", "salt")
            salts = F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))).alias("salt")
            gone = full.join(hot, "anchor", "left").select("anchor", salts)
            rows = rows.hint("merge").join(gone, ["anchor", "salt"], "left_anti").select("anchor", "salt", "unit", "doc").unionByName(anew)
            hot = hot.join(full, "anchor", "left_anti").unionByName(tops)
        self.runs, self.hot = [self._keep(rows)], [materialize(hot, "runs-hot")]

    @staticmethod
    def under(run: DataFrame, hot: DataFrame, wanted: DataFrame) -> DataFrame:
        """A run's rows under wanted(anchor), by a merge-join that reads the run in its buckets."""
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))).alias("salt")
        probe = wanted.join(hot, "anchor", "left").select("anchor", salts)
        return run.hint("merge").join(probe, ["anchor", "salt"], "left_semi").select("anchor", "unit", "doc")

    def meet(self, batch: DataFrame) -> DataFrame:
        """Add batch(anchor, unit, doc) as a run and return (anchor, unit, doc, new): all rows under anchors that it shares."""
        before = list(zip(self.runs, self.hot, strict=True))
        run = self.append(batch)
        mine = materialize(run.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "runs-mine")
        shared, old = mine.where("n > 1").select("anchor"), None
        if before:
            old = materialize(union_all([self.under(*b, mine.select("anchor")) for b in before]), "runs-old")
            shared = shared.union(old.select("anchor")).distinct()
        new = self.under(run, self.hot[-1], shared).withColumn("new", F.lit(True))
        out = materialize(new if old is None else new.unionByName(old.withColumn("new", F.lit(False))), "runs-met")
        self.compact()
        return out

    def remove(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """Add batch(anchor, unit, doc) and return (unit, n_removed, sha) of its units that lose words.

        texts(unit, raw) has the text of each unit, old and new, once or more.
        """
        return verify(self.meet(batch), lambda units: units.join(texts, "unit").dropDuplicates(["unit"]), self.window)


def verify(met: DataFrame, fetch: Callable[[DataFrame], DataFrame], window: int = WINDOW) -> DataFrame:
    """(unit, n_removed, sha) of the new units of met(anchor, unit, doc, new) that lose words.

    A unit is new where any of its rows is. fetch adds raw, the text, to rows (unit, doc, new, shared).
    """
    units = met.groupBy("unit", "doc").agg(F.max("new").alias("new"), F.collect_set("anchor").alias("shared"))  # at most a text's anchors
    cands = materialize(fetch(materialize(units, "runs-units")).select("unit", "doc", "new", "shared", "raw"), "runs-texts")
    rows = materialize(cands.mapInArrow(windows(window), "w long, x int, unit long, doc long, new boolean, at int"), "runs-windows")
    least = rows.groupBy("w", "x").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    least = materialize(least.select("w", "x", "least"), "runs-least")
    late = rows.where("new").join(least, ["w", "x"]).where("doc > least")
    starts = late.groupBy("unit").agg(F.collect_list("at").alias("starts"))  # at most a text's windows
    kept = cands.where("new").select("unit", "raw").join(starts, "unit").select("unit", "starts", "raw")
    return materialize(kept.mapInArrow(cut(window), "unit long, n_removed long, sha string"), "runs-cut")


def dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of docs(doc_id, text).

    A null text has no words; a row with null doc_id neither takes words from others nor loses any; rows with the same
    doc_id take nothing from each other. Every row comes back once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.col("text").cast("string").cast("binary").alias("raw"))
    meta = materialize(raw.mapInArrow(scan(window), "doc_id long, key binary, n_words long, sha string, anchors array<long>"), "runs-meta")
    firsts = meta.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("key").agg(F.min("doc_id").alias("doc"))
    units = materialize(firsts.withColumn("unit", F.monotonically_increasing_id()), "runs-firsts")
    marks = meta.select("doc_id", "key", F.explode("anchors").alias("anchor")).join(units, "key").where("doc_id = doc")
    marks = materialize(marks.select("anchor", "unit", "doc").distinct(), "runs-anchors")

    def fetch(cands: DataFrame) -> DataFrame:
        """One row of each unit's first document; the texts meet the candidates by id, and no others move on."""
        wanted = cands.join(units.select("unit", "key"), "unit").withColumn("doc_id", F.col("doc"))
        return wanted.join(raw, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])

    cuts = units.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    index, parts = Index(spark, fresh_path(spark, "runs"), window), []
    for low, high in zip(bounds, bounds[1:], strict=False):
        inside = F.lit(True)
        if low is not None:
            inside &= F.col("doc") > low
        if high is not None:
            inside &= F.col("doc") <= high
        parts.append(index.meet(marks.where(inside)))
    lost = verify(union_all(parts), fetch, window)
    named = units.join(lost, "unit", "left").select("key", "doc", "n_removed", "sha")
    named = materialize(named.withColumnRenamed("sha", "cut_sha"), "runs-named")
    out = meta.drop("anchors").join(named, "key", "left")
    copy = F.col("doc") < F.col("doc_id")
    own = (F.col("doc") == F.col("doc_id")) & F.col("n_removed").isNotNull()
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, none).when(own, F.col("cut_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def op4_substring_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
