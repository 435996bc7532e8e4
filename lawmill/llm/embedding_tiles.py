"""Embedding near-duplicates by tiled comparison in the order of principal components.

Vectors are scaled to length one and rotated to the principal axes of all of them (one distributed sum of outer
products). Products then gather most of their value in the leading dimensions: a tile pair is computed for a few
dimensions at a time, and what the others can still add is bounded by the product of the two suffix norms, so pairs
drop out as soon as their cosine cannot reach the threshold. Before that whole tiles drop out: tiles are runs of one
label in the order of the first axes, and two tiles are compared only if their bounding boxes come near enough.

The rotation only rules pairs out, with a margin far above rounding; what stays is decided on the vectors as given, in
double precision.

Equal vectors of a label are one class, compared once; classes are told apart by 128 bits of a digest and numbered once. A tile pair returns counts of direct links and the edges
of a spanning forest, never the pairs, and hot labels are cut into tiles by range partitioning, so no task holds a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm.common import components, forest, materialize, table

THRESHOLD = 0.98
TILE = 512
#: Axes of a tile's bounding box, and dimensions of one step of the products.
BOX, STEP = 6, 8
_MARGIN = 1e-7


def usable(v: str):
    """Vectors that can link: not null, not empty, all components finite, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("label").isNotNull() & F.col(v).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0.0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of outer products of unit vectors for each width, as rows (width, i, values)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for width, rows in by_width(batch.column(0)):
            u = unit(rows)
            total[width] = total.get(width, 0) + u.T @ u
    for width, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([width] * width), pa.array(range(width)), pa.array(m.tolist(), pa.list_(pa.float64()))], ["width", "i", "m"])


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(x) for x in column])
    for width in np.unique(sizes):
        yield int(width), matrix(column.filter(pa.array(sizes == width)), int(width))


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each width, strongest first; what is gathered is one square matrix a width."""
    parts = classes.select("v").mapInArrow(moments, "width long, i long, m array<double>")
    sums = parts.select("width", "i", F.posexplode("m").alias("j", "x")).groupBy("width", "i", "j").agg(F.sum("x").alias("x"))
    got = sums.toArrow().to_pydict()
    out = {}
    w = np.array(got["width"], np.int64)
    for width in np.unique(w).tolist():
        at = np.flatnonzero(w == width)
        m = np.zeros((width, width))
        m[np.array(got["i"])[at], np.array(got["j"])[at]] = np.array(got["x"])[at]
        out[width] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def rotate(shared):
    """(id, label, v, size) with the width and the coordinates on the first axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("v")], np.int64)
            lead = np.zeros((batch.num_rows, 2))
            for width in np.unique(sizes):
                at = np.flatnonzero(sizes == width)
                u = unit(matrix(batch.column("v").take(pa.array(at)), int(width))) @ turn[int(width)][:, :2]
                lead[at, : u.shape[1]] = u
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(lead[:, 0]), pa.array(lead[:, 1])], [*batch.schema.names, "width", "p1", "p2"])

    return run


def cut_tiles(shared, tile: int, reach: float):
    """Sorted rows of a partition to tiles of one label and width: ids, sizes, vectors, bounding box, buckets of the first axis."""

    def made(rows: list[pa.RecordBatch], part: int, number: int) -> dict:
        t = pa.Table.from_batches(rows)
        width = t.column("width")[0].as_py()
        x = matrix(t.column("v"), width)
        u = unit(x) @ shared.value[width]
        low, high = u[:, :BOX].min(0), u[:, :BOX].max(0)
        lowest, highest = int(np.floor((low[0] - _MARGIN) / reach)), int(np.floor((high[0] + _MARGIN) / reach))
        return {
            "label": t.column("label")[0].as_py(), "width": width, "tile": (part << 32) + number, "low": low.tolist(), "high": high.tolist(),
            "first": lowest, "last": highest, "ids": t.column("id").to_numpy().astype("<i8").tobytes(),
            "sizes": t.column("size").to_numpy().astype("<i8").tobytes(), "x": x.tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, n, key = TaskContext.get().partitionId(), 0, [], 0, None
        for batch in batches:
            label, width = batch.column("label").to_numpy(zero_copy_only=False), batch.column("width").to_numpy()
            i = 0
            while i < batch.num_rows:
                if held and ((label[i], width[i]) != key or n >= tile):
                    yield pa.RecordBatch.from_pylist([made(held, part, number)], TILES_ARROW)
                    held, n, number = [], 0, number + 1
                key = (label[i], width[i])
                j = i
                while j < batch.num_rows and j - i < tile - n and (label[j], width[j]) == key:
                    j += 1
                held.append(batch.slice(i, j - i))
                n += j - i
                i = j
        if held:
            yield pa.RecordBatch.from_pylist([made(held, part, number)], TILES_ARROW)

    return run


TILES = "label long, width long, tile long, low array<double>, high array<double>, first int, last int, ids binary, sizes binary, x binary"
TILES_ARROW = pa.schema([("label", pa.int64()), ("width", pa.int64()), ("tile", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("first", pa.int32()), ("last", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("x", pa.binary())])


def near(u: np.ndarray, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rotated unit vectors whose cosine may reach the threshold, some dimensions at a time."""
    rest_u = np.sqrt(np.maximum(0, 1 - np.cumsum(u * u, 1)))
    rest_v = np.sqrt(np.maximum(0, 1 - np.cumsum(v * v, 1)))
    d = u.shape[1]
    end = min(STEP, d)
    dots = u[:, :end] @ v[:, :end].T
    least = threshold - _MARGIN
    i, j = np.nonzero(dots + np.outer(rest_u[:, end - 1], rest_v[:, end - 1]) >= least)
    dots = dots[i, j]
    while end < d and len(i):
        start, end = end, min(end + STEP, d)
        dots = dots + np.einsum("ij,ij->i", u[i, start:end], v[j, start:end])
        stay = dots + rest_u[i, end - 1] * rest_v[j, end - 1] >= least
        i, j, dots = i[stay], j[stay], dots[stay]
    return i, j


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows as given, in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, which rounds nothing and keeps squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def compare(shared, threshold: float):
    """Tile pairs to rows (id, n, other): links of id counted by vectors, or a forest edge to other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                turn, same = shared.value[r["width"]], r["tile"] == r["tile2"]
                ids, ids2 = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["ids2"], "<i8")
                sizes, sizes2 = np.frombuffer(r["sizes"], "<i8"), np.frombuffer(r["sizes2"], "<i8")
                x, y = (scaled(np.frombuffer(r[c], "<f8").reshape(-1, r["width"])) for c in ("x", "x2"))
                i, j = near(unit(x) @ turn, unit(y) @ turn, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                good = cosines(x[i], y[j]) >= threshold if len(i) else np.zeros(0, bool)
                i, j = i[good], j[good]
                if not len(i):
                    continue
                n = np.bincount(i, sizes2[j], len(ids)).astype(np.int64), np.bincount(j, sizes[i], len(ids2)).astype(np.int64)
                a, b = forest(ids[i], ids2[j])
                at, at2 = np.flatnonzero(n[0]), np.flatnonzero(n[1])
                out = np.concatenate([ids[at], ids2[at2], a])
                count = np.concatenate([n[0][at], n[1][at2], np.zeros(len(a), np.int64)])
                other = pa.array([None] * (len(at) + len(at2)) + b.tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(count), other], ["id", "n", "other"])

    return run


def tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """Pairs of tiles of a label and width whose boxes are within reach, each pair once.

    They meet in buckets of the first axis as wide as the reach, the second of them in its neighbouring buckets too, and
    only their boxes do; a pair that meets more than once counts in the first bucket.
    """
    box = tiles.select("label", "width", "tile", "low", "high", "first", "last")
    a = box.select(*box.columns, F.explode(F.sequence("first", "last")).alias("bucket"))
    b = box.select(*(F.col(c).alias(f"{c}2") for c in box.columns), F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("bucket2"))
    gap = F.zip_with(F.zip_with("low", "high2", lambda p, q: p - q), F.zip_with("low2", "high", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    far = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    met = (F.col("label") == F.col("label2")) & (F.col("width") == F.col("width2")) & (F.col("bucket") == F.col("bucket2")) & (F.col("tile") <= F.col("tile2"))
    first = F.col("bucket") == F.greatest("first", F.col("first2") - 1)
    return a.join(b, met & first & (far <= reach * reach + _MARGIN)).select("tile", "tile2")


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding, label).

    Vectors that are null, empty, zero or hold null or non-finite components, and those with null label, link with
    nothing and are kept; vectors of different widths do not link. Rows that repeat a vec_id each come back and count
    as vectors of their own; a null vec_id links as others do and names no component unless all ids are null. Ties and
    equal vectors link. An empty table gives no rows. Any type of number in the embedding will do.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable("v"), F.lit(False))).withColumn("key", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",")), 256))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.substring("key", 1, 32)))
    rows = materialize(rows, "tiles-rows")
    good = rows.where("ok").groupBy("key").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(good.withColumn("id", F.monotonically_increasing_id()), "tiles-classes")
    turn = spark.sparkContext.broadcast(axes(classes))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    kept = classes.select("id", "label", "v", "size")
    lead = kept.mapInArrow(rotate(turn), "id long, label long, v array<double>, size long, width long, p1 double, p2 double")
    cell = F.floor(F.col("p1") / reach)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lead.withColumn("cell", cell).repartitionByRange(parts, "label", "width", "cell", "p2", "id").sortWithinPartitions("label", "width", "cell", "p2", "id")
    tiles = materialize(dealt.select("id", "label", "v", "size", "width").mapInArrow(cut_tiles(turn, tile, reach), TILES), "tiles")
    pairs = materialize(tile_pairs(tiles, reach), "tiles-pairs")
    left = tiles.select("tile", "width", "ids", "sizes", "x")
    right = tiles.select(F.col("tile").alias("tile2"), *(F.col(c).alias(f"{c}2") for c in ("ids", "sizes", "x")))
    both = pairs.join(left, "tile").join(right, "tile2")
    found = materialize(both.mapInArrow(compare(turn, threshold), "id long, n long, other long"), "tiles-links")
    links = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), "tiles")
    named = classes.select("key", "id", "first", "size").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = materialize(named.select("key", "first", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "tiles-named")
    groups = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "tiles-groups")
    members = materialize(named.join(groups, "root").select("key", "n_links", "component_id"), "tiles-members")
    linked = rows.where("ok").join(members, "key").select("vec_id", "n_links", "component_id")
    lone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
