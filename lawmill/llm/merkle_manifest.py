"""Merkle manifest of a dataset: a digest tree for each group of rows, one tree over the groups, proofs for every row.

A row's leaf is H of its columns, each `-` if null, else its UTF-8 byte count, `:` and its value; H is the lowercase hex
SHA-256 of its inputs laid end to end, digests as hex text. Leaves of a group ascend; while several nodes remain, every
`FANOUT` consecutive ones (the last run may be shorter, even one) become their H. The groups' roots, ordered by group, form a
tree of the same kind.

Leaves are hashed in the JVM and written once, as narrow rows. A range partitioning by (group, order, leaf) numbers them, so
a group of any size is spread over many tasks. Every `BLOCK` leaves, aligned, become one row that holds their digests; in
Python such a row is a contiguous matrix of 64-byte lines, a level is hashed by reshaping it to runs, and the siblings of all
leaves are found by index arithmetic. Block roots are the leaves of the next stage, so a stage shrinks by `BLOCK` and a tree of
10^11 rows has four. On the way down each block gets the siblings above it, once for all its leaves.

Defined results: null ids come first in their group and are never tampered with; a null group is a group of its own, the
first; rows that are equal in all hashed columns keep one leaf each (their digests are equal, so their order does not matter);
rows that share only an id are ordered by leaf; very long texts cost their length once or twice in the JVM and never reach
Python; an empty table gives no rows; columns that are not hashed are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawmill.llm.common import fold_mod, materialize, table

FANOUT, HEIGHT = 3, 5
#: Leaves of a block: a power of the fanout, so that blocks align with whole subtrees.
BLOCK = FANOUT**HEIGHT
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
HEX = 64
PATH = "array<string>"


# ---- digests of a block ---------------------------------------------------------------------------------------------
def hashed_runs(nodes: np.ndarray) -> np.ndarray:
    """The next level: H of each run of FANOUT lines of a contiguous (n, 64) matrix."""
    whole = len(nodes) // FANOUT
    runs = [sha256(run).hexdigest() for run in nodes[: whole * FANOUT].reshape(whole, FANOUT * HEX)]
    if whole * FANOUT < len(nodes):
        runs.append(sha256(nodes[whole * FANOUT :].reshape(-1)).hexdigest())
    return np.frombuffer("".join(runs).encode(), np.uint8).reshape(-1, HEX)


def height_of(nodes: int) -> int:
    """Levels that a block of a tree of so many nodes has above its own: all of them, or HEIGHT where more blocks follow."""
    height, reach = 0, 1
    while reach < nodes and height < HEIGHT:
        height, reach = height + 1, reach * FANOUT
    return height


def levels(leaves: np.ndarray, nodes: int) -> list[np.ndarray]:
    """Matrices of a block from its leaves to its root."""
    out = [leaves]
    for _ in range(height_of(nodes)):
        out.append(hashed_runs(out[-1]))
    return out


def siblings(level: np.ndarray) -> tuple[list[str], list[str]]:
    """What stands left and right of each node in its run, as text, by index arithmetic."""
    text, at = level.tobytes().decode("ascii"), np.arange(len(level))
    first, place = at - at % FANOUT, at
    last = np.minimum(first + FANOUT, len(level))
    left = [text[a:b] for a, b in zip((first * HEX).tolist(), (place * HEX).tolist(), strict=True)]
    right = [text[a:b] for a, b in zip(((place + 1) * HEX).tolist(), (last * HEX).tolist(), strict=True)]
    return left, right


def folded(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(lefts, rights, strict=True):
        leaf = sha256(f"{a}{leaf}{b}".encode()).hexdigest()
    return leaf


def _matrices(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The digests of each row of a list column, as views of one contiguous matrix."""
    flat, ends = column.flatten(), np.cumsum([0, *(x.as_py() for x in column.value_lengths())])
    raw = np.frombuffer(flat.buffers()[2], np.uint8, len(flat) * HEX, flat.offset * HEX) if len(flat) else np.empty(0, np.uint8)
    matrix = raw.reshape(-1, HEX)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield matrix[a:b]


def block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, nodes, block, digests) to (tree, nodes, i, digest): each block's root as a node of the next stage."""
    for batch in batches:
        tree, nodes, block, digests = batch.columns
        roots = [levels(m, n)[-1].tobytes().decode("ascii") for m, n in zip(_matrices(digests), nodes.to_pylist(), strict=True)]
        above = [-(-n // BLOCK) for n in nodes.to_pylist()]
        yield pa.RecordBatch.from_arrays([tree, pa.array(above, pa.int64()), block, pa.array(roots, pa.string())], ["tree", "nodes", "i", "digest"])


def node_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, nodes, block, digests, lefts, rights, root, top) to a row (tree, block, lefts, rights, root, top) for each node: its siblings up to the top."""
    names = ["tree", "block", "lefts", "rights", "root", "top"]
    for batch in batches:
        _, nodes, block, digests, lefts, rights, root, top = batch.columns
        for k, m in enumerate(_matrices(digests)):
            sides = [siblings(x) for x in levels(m, nodes[k].as_py())[:-1]]
            own = [[[s[side][j // FANOUT**h] for h, s in enumerate(sides)] for j in range(len(m))] for side in (0, 1)]
            up = [lefts[k].as_py(), rights[k].as_py()]
            paths = [pa.array([x + up[side] for x in own[side]], pa.list_(pa.string())) for side in (0, 1)]
            first = block[k].as_py() * BLOCK
            same = [pa.array([c[k].as_py()] * len(m), pa.string()) for c in (batch.column(0), root, top)]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(range(first, first + len(m)), pa.int64()), *paths, *same[1:]], names)


PROOFS = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, changed, nodes, digests, lefts, rights, root, top) to a row of PROOFS for each leaf."""
    names = [x.split()[0] for x in PROOFS.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    for batch in batches:
        keys, changed, nodes, digests, lefts, rights, root, top = batch.columns
        for k, m in enumerate(_matrices(digests)):
            sides = [siblings(x) for x in levels(m, nodes[k].as_py())[:-1]]
            up = lefts[k].as_py(), rights[k].as_py()
            above = "".join(a + b for a, b in zip(*up, strict=True))
            final, rows = top[k].as_py(), []
            for j, (key, leaf, other) in enumerate(zip(keys[k].as_py(), digests[k].as_py(), changed[k].as_py(), strict=True)):
                left, right = ([s[side][j // FANOUT**h] for h, s in enumerate(sides)] for side in (0, 1))
                proof = sha256(("".join(a + b for a, b in zip(left, right, strict=True)) + above).encode()).hexdigest()
                got = folded(other if other is not None else leaf, left + up[0], right + up[1])
                rows.append((key, leaf, root[k].as_py(), final, proof, got, got == final))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


# ---- trees as tables ------------------------------------------------------------------------------------------------
def encoded(c: Column) -> Column:
    """`-` if null, else byte count, `:` and value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows(tree, …) with their place `i` in their tree and its number of `nodes`, written.

    A range partitioning by (tree, order) spreads a large tree over tasks; only the counts of (task, tree) are summed in
    order, and they come back by a join on both, so no join key holds more than a task's rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order)
    placed = materialize(dealt.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")), f"{name}-placed")
    counts = placed.groupBy("task", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("task", "tree", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("nodes"))
    return placed.join(counts, ["task", "tree"]).withColumn("i", F.col("at") + F.col("shift")).drop("task", "at", "shift")


def blocked(nodes: DataFrame, more: list[str], name: str) -> DataFrame:
    """(tree, nodes, block, digests, …): every BLOCK nodes as one row, in order; written. A row's arrays have BLOCK entries at most."""
    item = F.sort_array(F.collect_list(F.struct("i", "digest", *more)))
    rows = nodes.groupBy("tree", "nodes", F.floor(F.col("i") / BLOCK).alias("block")).agg(item.alias("x"))
    return materialize(rows.select("tree", "nodes", "block", F.col("x.digest").alias("digests"), *(F.col(f"x.{c}").alias(f"{c}s") for c in more)), name)


def grown(leaves: DataFrame, more: list[str], name: str) -> list[DataFrame]:
    """The stages of all trees over leaves(tree, nodes, i, digest, …), from their leaves' blocks to one block a tree."""
    stages = [blocked(leaves, more, f"{name}-0")]
    while (stages[-1].agg(F.max("nodes")).first()[0] or 0) > BLOCK:
        roots = stages[-1].select("tree", "nodes", "block", "digests").mapInArrow(block_roots, "tree string, nodes long, i long, digest string")
        stages.append(blocked(roots, [], f"{name}-{len(stages)}"))
    return stages


def roots(stages: list[DataFrame]) -> DataFrame:
    """(tree, digest): the root of each tree."""
    last = stages[-1].select("tree", "nodes", "block", "digests").mapInArrow(block_roots, "tree string, nodes long, i long, digest string")
    return last.select("tree", "digest")


def handed_down(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first stage with the siblings above each block; tops(tree, lefts, rights, root, top) holds what is above the trees."""
    kind = "tree string, block long, lefts array<string>, rights array<string>, root string, top string"
    above = stages[-1].join(tops, "tree")
    for lower in stages[-2::-1]:
        inner = above.select("tree", "nodes", "block", "digests", "lefts", "rights", "root", "top")
        above = lower.join(inner.mapInArrow(node_paths, kind), ["tree", "block"])
    return above


class Manifest:
    """The written stages of a dataset's trees: `groups` over the rows of each group, `over` over the groups' roots."""

    def __init__(self, groups: list[DataFrame], over: list[DataFrame], subroots: DataFrame):
        self.groups, self.over, self.subroots = groups, over, subroots

    def root(self) -> DataFrame:
        """(digest) of the whole dataset; no row for an empty one."""
        return roots(self.over).select("digest")

    def proofs(self) -> DataFrame:
        """A row of PROOFS for each row: its proof's digest, and the root that its changed (else its own) leaf folds to."""
        none = F.array().cast(PATH)
        tops = roots(self.over).select("tree", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("root"), F.col("digest").alias("top"))
        last = handed_down(self.over, tops).select("tree", "nodes", "block", "digests", "lefts", "rights", "root", "top")
        kind = "tree string, block long, lefts array<string>, rights array<string>, root string, top string"
        paths = last.mapInArrow(node_paths, kind)
        tops = self.subroots.join(paths.withColumnRenamed("block", "i").drop("tree", "root"), "i").select("group", "lefts", "rights", F.col("digest").alias("root"), "top")
        rows = handed_down(self.groups, tops.withColumnRenamed("group", "tree"))
        return rows.select("keys", "changeds", "nodes", "digests", "lefts", "rights", "root", "top").mapInArrow(leaf_proofs, PROOFS)


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of rows(tree, key, digest, changed): tree sorts as the groups do, key as the rows of a group."""
    rows = materialize(rows, "merkle-leaves")
    groups = grown(numbered(rows, ["key", "digest"], "merkle"), ["key", "changed"], "merkle-rows")
    own = roots(groups).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    subroots = materialize(numbered(own, ["group"], "merkle-groups"), "merkle-subroots")
    return Manifest(groups, grown(subroots.drop("group"), [], "merkle-over"), subroots)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, key, digest, changed) of documents; changed: the leaf of the text without line ends, where crc32(doc_id) is even."""
    cols = [F.col(c) for c in COLUMNS]
    stripped = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    changed = F.when(fold_mod("doc_id", 2) == 0, leaf([*cols[:-1], stripped]))
    # a null source sorts before every other, the empty one included
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), "source"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("key"), leaf(cols).alias("digest"), changed.alias("changed"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    return manifest(document_leaves(docs)).proofs().withColumnRenamed("key", "doc_id")
