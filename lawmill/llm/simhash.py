"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy's exclusive-or and bit counts. Two fingerprints within
`radius` bits differ by at most that in the number of set bits; the same holds for the sum of the differences over any
cut of the 64 bits. So a fingerprint's tile is the four population counts of its 16-bit quarters, and a pair of tiles
is skipped when these differ by more than the radius in sum; nothing else is left out. There are at most 17^4 tiles, and
each is sent to those within the radius only (half of them, the relation being symmetric), which bounds what moves by a
constant for each fingerprint. The fingerprints of all tiles are counted first: a tile of many is cut into blocks of its
own and of its visitors' fingerprints by hash, and each pair of blocks is a task's work of its own, so that no task
compares more than about `_LARGE` times `_LARGE` fingerprints, however full the tiles in the middle are.

Only distinct fingerprints are compared, each with the smallest doc_id that has it. A tile returns the edges of a spanning
forest of its links, not the links, so a large group of near copies gives no more rows than it has members.
Components of those edges come from distributed star contraction.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm.common import components, forest, free_name, materialize, table

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Rows and columns of one exclusive-or.
_BLOCK = 1024
#: Fingerprints in one row of a tile: a tile of many is several such rows.
_PACK = 4096
#: Fingerprints in a block of a tile, its own or its visitors'.
_LARGE = 1 << 17
#: About the bytes of a record batch of packs, and those of a row beside its pack.
_BATCH_BYTES = 4 << 20
_ROW_BYTES = 24


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of whole text: bit b is set if over half of the shingle hashes have it; no words give 0."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split() if raw else []
    if not words:
        return 0
    parts = [words[k : len(words) - shingle + 1 + k] for k in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    counts, n = np.zeros(64, np.int64), 0
    shingles = map(b" ".join, zip(*parts, strict=True))
    while chunk := list(itertools.islice(shingles, 65536)):
        h = np.fromiter((xxh64_intdigest(s, SEED) for s in chunk), np.uint64, len(chunk))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(chunk)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, shingle) for x in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with a column fp (signed 64-bit) in place of text; null and empty texts have fingerprint 0."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(*rest, F.col("text").cast("string").cast("binary").alias(free_name("raw", rest)))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "fp long"])
    return rows.mapInArrow(fingerprint_rows(shingle), kinds)


def _near(radius: int) -> np.ndarray:
    """Steps to tiles within the radius: zero first, then one of each opposite pair."""
    r = range(-radius, radius + 1)
    steps = [s for s in itertools.product(r, repeat=4) if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]
    return np.array(sorted(steps, key=lambda s: (sum(map(abs, s)), s)), np.int64)


def tile_of(fp: np.ndarray) -> np.ndarray:
    quarters = fp.view(np.uint16).reshape(-1, 4)
    return np.bitwise_count(quarters).astype(np.int64)


_PLACES = np.array([17**3, 17**2, 17, 1])


def blocks_of(counts: np.ndarray, radius: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """How many blocks the own fingerprints of each tile and its visitors are cut into; counts: fingerprints by tile."""
    own, visitors = counts.reshape((17,) * 4), np.zeros((17,) * 4, np.int64)
    for step in _near(radius):
        to = tuple(slice(max(0, s), 17 + min(0, s)) for s in step)
        at = tuple(slice(max(0, -s), 17 + min(0, -s)) for s in step)
        visitors[to] += own[at]
    return np.maximum(1, -(-counts // large)), np.maximum(1, -(-visitors.reshape(-1) // large))


def tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) to (tile, n) of the task."""
    n = np.zeros(17**4, np.int64)
    for batch in batches:
        n += np.bincount(tile_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) @ _PLACES, minlength=17**4)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["tile", "n"])


def spread(radius: int, shared):
    """(fp) to rows (tile, block, own, packed fingerprints): each tile's fingerprints for itself and for the tiles within the radius."""
    steps = _near(radius)

    def packs(fp: np.ndarray, blocks: int, turn: int) -> Iterator[tuple[int, bytes]]:
        """Each block's fingerprints, in packs."""
        with np.errstate(over="ignore"):
            of = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(turn)) % np.uint64(blocks) if blocks > 1 else np.zeros(len(fp), np.uint64)
        for k in np.unique(of).tolist():
            mine = fp[of == k]
            for i in range(0, len(mine), _PACK):
                yield k, mine[i : i + _PACK].tobytes()

    def dealt(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bytes]]:
        """Packs and where they go: (tiles, blocks, own, pack)."""
        owns, visits = shared.value
        quarters = tile_of(fp)
        tile = quarters @ _PLACES
        order = np.argsort(tile, kind="stable")
        fp, quarters, tile = fp[order], quarters[order], tile[order]
        edges = np.flatnonzero(np.diff(tile, prepend=-1, append=-1)).tolist()
        for low, high in zip(edges, edges[1:], strict=False):
            mine, own = fp[low:high], int(tile[low])
            m = int(visits[own])
            for k, blob in packs(mine, int(owns[own]), 40):
                yield np.full(m, own), k * m + np.arange(m), True, blob
            to = quarters[low] + steps
            to = to[((to >= 0) & (to <= 16)).all(1)] @ _PLACES
            for m in np.unique(visits[to]).tolist():
                there = to[visits[to] == m]
                n = owns[there]
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for v, blob in packs(mine, m, 20):
                    yield np.repeat(there, n), block * m + v, False, blob

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Record batches of about _BATCH_BYTES each, however many tiles and blocks a pack goes to."""
        parts, size = [], 0
        for tiles, blocks, own, blob in dealt(np.concatenate(held)):
            most = max(1, _BATCH_BYTES // (len(blob) + _ROW_BYTES))
            for i in range(0, len(tiles), most):
                parts.append((tiles[i : i + most], blocks[i : i + most], own, blob))
                size += len(parts[-1][0]) * (len(blob) + _ROW_BYTES)
                if size >= _BATCH_BYTES:
                    yield batch_of(parts)
                    parts, size = [], 0
        if parts:
            yield batch_of(parts)

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        tiles, blocks, marks, blobs = zip(*parts, strict=True)
        n = [len(t) for t in tiles]
        pack = pa.array(blobs, pa.binary()).take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles)), pa.array(np.concatenate(blocks)), pa.array(np.repeat(marks, n)), pack], ["tile", "block", "own", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= 1 << 16:
                yield from rows(held)
                held, n = [], 0
        if n:
            yield from rows(held)

    return run


def links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different fingerprints of a and b within the radius, as the edges of a forest.

    Pairs of a block become a forest before the next block, so what is held stays near the number of members.
    """
    left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for i in range(0, len(a), _BLOCK):
        for j in range(0, len(b), _BLOCK):
            x, y = a[i : i + _BLOCK], b[j : j + _BLOCK]
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y) <= radius)
            if len(p):
                other = x[p] != y[q]
                left.append(x[p[other]])
                right.append(y[q[other]])
        if sum(map(len, left)) > 4 * _BLOCK:
            u, v = forest(np.concatenate(left), np.concatenate(right))
            left, right = [u], [v]
    return forest(np.concatenate(left), np.concatenate(right))


def compare(radius: int):
    """Rows (tile, block, own, pack) sorted by tile and block to forest edges (a, b)."""

    def edges(packs: list[tuple[bool, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        mine, other = (np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(p, np.uint64) for own, p in packs if own == side)]) for side in (True, False))
        return links(mine, other, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs = None, []

        def out() -> pa.RecordBatch:
            a, b = edges(packs)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = (batch.column(c).to_pylist() for c in ("tile", "block", "own"))
            for tile, block, own, pack in zip(*keys, (x.as_py() for x in batch.column("pack")), strict=True):
                if (tile, block) != now:
                    if packs:
                        yield out()
                    now, packs = (tile, block), []
                packs.append((own, pack))
        if packs:
            yield out()

    return run


def near_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) of the fingerprints in distinct(fp) that have a neighbour; root names their component."""
    got = distinct.select("fp").mapInArrow(tile_rows, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n")).toArrow()  # at most 17^4 rows
    counts = np.zeros(17**4, np.int64)
    counts[got.column("tile").to_numpy()] = got.column("n").to_numpy()
    shared = distinct.sparkSession.sparkContext.broadcast(blocks_of(counts, radius, _LARGE))
    dealt = distinct.select("fp").mapInArrow(spread(radius, shared), "tile long, block long, own boolean, pack binary")
    tiles = dealt.repartition("tile", "block").sortWithinPartitions("tile", "block")
    edges = materialize(tiles.mapInArrow(compare(radius), "a long, b long"), "simhash-edges")
    return components(edges, "simhash").select(F.col("node").alias("fp"), "root")


def group_documents(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without text, with fp and component_id, the smallest doc_id of the group.

    Every row comes back once, whether its text is null, empty or repeated; null doc_ids group too but name no group,
    unless nothing else does, and then component_id is null. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle), "simhash-rows")
    classes = materialize(rows.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("first")), "simhash-classes")
    roots = near_fingerprints(classes, radius)
    named = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-named")
    groups = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-groups")
    by_fp = materialize(named.join(groups, "root").select("fp", "component_id"), "simhash-members")
    return rows.join(by_fp, "fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = group_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id, all columns kept.

    Rows that repeat this doc_id are the same document and all stay; so do rows without doc_id, which no id can single out.
    """
    name = free_name("id", docs.columns)
    kept = group_documents(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    # one plan at every size: both sides meet by id, no matter how few ids there are
    once = docs.where("doc_id is not null").join(materialize(kept, "simhash-kept").hint("merge"), F.col("doc_id") == F.col(name), "left_semi")
    return once.unionByName(docs.where("doc_id is null"))
