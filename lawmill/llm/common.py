"""What the corpus operators share: shared-storage tables, words, hashes and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where a session names none and runs in one process (tests) a temporary folder of this machine takes its place; on a
    cluster executors would write to their own disks, so there it must be set.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.environ.setdefault("LAWMILL_SHARED_DIR", "") or tempfile.mkdtemp(prefix="lawmill-")
        os.environ["LAWMILL_SHARED_DIR"] = root
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lawmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever the letters' case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def fold_mod(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids give null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class HashedWords(dict):
    """bytes -> xxh64 as int; emptied when it holds `most` words, so its size does not follow the data."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.seed, self.most, self.digest = seed, most, xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.digest(word, self.seed)
        if len(self) < self.most:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x = (x + b) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph with edges (a[i], b[i]): (node, smallest node of its component), roots left out."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while np.any((jump := new[new]) != new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges(a, b): one row (node, root) for each node with an edge; root is the smallest node.

    Large-star and small-star rounds (Kiveris et al. 2014): each round is two shuffles of the edges, the number of rounds
    is logarithmic in practice, and every round is written to the shared folder, so nothing is gathered on the driver
    but one count. Both stars take min() with map-side combination and join it back, and joins of a hot node are split
    by AQE; no neighbour list is ever collected. Null ends and self loops are dropped; no edges give no rows.
    """
    both = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct()
    cur = materialize(both.select("a", "b"), f"{name}-cc0")
    spark = edges.sparkSession
    turn = 0
    while True:
        turn += 1
        # large star: each larger neighbour of a node goes to the smallest of the node's closed neighbourhood
        two = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-low{turn}")
        big = two.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        big = materialize(big.distinct(), f"{name}-big{turn}")
        # small star: each node and its smaller neighbours go to the smallest of them
        low = materialize(big.groupBy("a").agg(F.min("b").alias("m")), f"{name}-small{turn}")
        small = big.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-cc{turn}")
        parents = new.groupBy("b").agg(F.lit(1).alias("x")).join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        stars = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0
        if stars and parents.limit(1).count() == 0:
            break
        cur = new
    roots = new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return materialize(new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), f"{name}-roots")
