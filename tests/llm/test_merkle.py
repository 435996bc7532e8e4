"""The Merkle manifest against a tree of plain lists."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

from lawmill.llm import merkle_manifest as M


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes, at, cur):
    """(root, siblings of nodes[at] level by level, what cur in its place folds to)."""
    path = []
    while len(nodes) > 1:
        run = nodes[at - at % 3 : at - at % 3 + 3]
        path += [x for k, x in enumerate(run) if k != at % 3]
        cur = digest(*(cur if k == at % 3 else x for k, x in enumerate(run)))
        nodes, at = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], at // 3
    return nodes[0], path, cur


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    low = lambda v: (v is not None, v or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((low(r[0]), plain_leaf(r, r[4]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: [x[1] for x in sorted(groups[g], key=lambda x: x[:2])] for g in names}
    subroots = [climb(leaves[g], 0, "")[0] for g in names]
    out = []
    for k, g in enumerate(names):
        for at, (_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            changed = plain_leaf(r, r[4].replace("\n", "") if even and r[4] is not None else r[4])
            sub, low_path, cur = climb(leaves[g], at, changed)
            root, high_path, cur = climb(subroots, k, cur)
            out.append((r[0], leaf, sub, root, digest(*low_path, *high_path), cur, cur == root))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = M.manifest(M.document_leaves(docs)).proofs()
    assert got.columns == ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4, 1, 9, 10), (700, 28, 1)])
def test_trees_of_every_shape(spark, sizes):
    rows = [(100 * k + i if n < 100 else 7 * i, f"s{k}", "en", i, f"text {i}\nmore") for k, n in enumerate(sizes) for i in range(n)]
    check(spark, rows)


def test_levels_of_a_block():
    leaves = [digest(str(i)) for i in range(90)]
    matrix = np.frombuffer("".join(leaves).encode(), np.uint8).reshape(-1, 64)
    assert M.hashed_runs(matrix).tobytes().decode() == "".join(digest(*leaves[k : k + 3]) for k in range(0, 90, 3))
    assert [M.height_of(n) for n in (1, 2, 3, 4, 9, 10, 243, 244, 10**9)] == [0, 1, 1, 2, 2, 3, 5, 5, 5]


def test_three_stages(spark):
    """Over BLOCK * BLOCK rows of one group."""
    n = M.BLOCK * M.BLOCK + 2
    docs = spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "concat('t', id) AS text")
    made = M.manifest(M.document_leaves(docs))
    assert len(made.groups) == 3
    leaves = [plain_leaf((i, "s", "en", i), f"t{i}") for i in range(n)]
    root, path, _ = climb(leaves, 12345, "")
    got = made.proofs().where("key = 12345").first()
    assert (got["subroot"], got["root"], got["proof_sha256"], got["verified"]) == (root, root, digest(*path), True)
    assert made.root().first()[0] == root


def test_messy_rows(spark, messy):
    rows = [tuple(r) for r in messy.select(*M.COLUMNS).collect()]
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    got = M.manifest(M.document_leaves(messy)).proofs()
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    made = M.manifest(M.document_leaves(docs))
    assert made.proofs().count() == 0 and made.root().count() == 0


def test_a_changed_row_is_found_and_no_other(spark):
    rows = [(i, "s", "en", 1, "a\nb" if i == 5 else "ab") for i in range(300)]
    bad = [r["key"] for r in M.manifest(M.document_leaves(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))).proofs().where("not verified").collect()]
    assert bad == ([5] if zlib.crc32(b"5") % 2 == 0 else [])
