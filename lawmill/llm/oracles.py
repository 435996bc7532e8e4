"""DuckDB SQL of the corpus queries that SQL can express, independent of how the operators work."""

from __future__ import annotations

from itertools import permutations

from lawmill.llm import license_join as L

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"
_NAME = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS m FROM h GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM h JOIN f USING (h) WHERE doc_id > m),
u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS k FROM w),
s AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM u ANTI JOIN g ON g.doc_id = u.doc_id AND g.k = u.k GROUP BY u.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _starts(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(words))
    return f"list_filter(range(len(ws) - {len(words) - 1}), lambda i: {same})"


def licenses() -> str:
    spots = ", ".join(f"{_starts(p)} AS p{k}" for k, (p, _) in enumerate(L.PHRASES))
    every = "list_concat(" * (len(L.PHRASES) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(L.PHRASES)))
    named = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(L.PHRASES))
    rows = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in L.TEMPLATES)
    return rf"""
WITH t AS (SELECT label, list_distinct(ws) AS tw FROM (VALUES {rows}) AS v(label, ws)),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS x FROM documents),
w AS (SELECT doc_id, regexp_extract_all(x, '{_NAME}') AS ws FROM d),
s AS (SELECT doc_id, len(ws) AS n_words, {spots} FROM w),
b AS (SELECT doc_id, n_words, {every} AS hits, list_filter([{named}], lambda x: x IS NOT NULL) AS base FROM s),
l AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(x, chr(10))), '{_NAME}')) AS lw FROM d),
m AS (SELECT doc_id, label, len(list_intersect(lw, tw))::DOUBLE / len(tw) AS share FROM l JOIN t ON len(list_intersect(lw, tw)) >= ceil({L.THRESHOLD}::DOUBLE * len(tw) - 1e-9)),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, len(hits)::BIGINT AS n_base, list_min(hits)::BIGINT AS first_word, list_max(hits)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(hits) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN g USING (doc_id)
"""


def _tree(name: str, deep: int) -> str:
    """Levels of trees name_0(s, i, d), each run of three hashed, while a tree has several nodes; the last level holds the roots."""
    step = "SELECT s, i // 3 AS i, CASE WHEN any_value(m) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM (SELECT *, count(*) OVER (PARTITION BY s) AS m FROM {0}_{1}) GROUP BY s, i // 3"
    return ", ".join(f"{name}_{k + 1} AS MATERIALIZED ({step.format(name, k)})" for k in range(deep))


def _paths(name: str, rows: str, deep: int) -> str:
    """rows_0(rid, s, i, cur, proof) carried up the trees of name: siblings added to the proof, the leaf folded."""
    step = """SELECT rid, p.s, p.i // 3 AS i, CASE WHEN any_value(m) = 1 THEN any_value(cur) ELSE sha256(string_agg(CASE WHEN n.i = p.i THEN cur ELSE d END, '' ORDER BY n.i)) END AS cur,
      any_value(proof) || coalesce(string_agg(CASE WHEN n.i <> p.i THEN d END, '' ORDER BY n.i), '') AS proof
      FROM {0}_{2} p JOIN (SELECT *, count(*) OVER (PARTITION BY s) AS m FROM {1}_{2}) n ON n.s = p.s AND n.i // 3 = p.i // 3 GROUP BY rid, p.s, p.i"""
    return ", ".join(f"{rows}_{k + 1} AS MATERIALIZED ({step.format(rows, name, k)})" for k in range(deep))


def merkle(rows_deep: int = 14, groups_deep: int = 8) -> str:
    """Trees of up to 3^14 rows and 3^8 groups, level by level; crc32 bit by bit."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS s, {leaf("text")} AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS other FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t_0 AS MATERIALIZED (SELECT s, i, leaf AS d FROM o), {_tree("t", rows_deep)},
g AS MATERIALIZED (SELECT s AS source, d, row_number() OVER (ORDER BY s) - 1 AS i FROM t_{rows_deep}),
u_0 AS MATERIALIZED (SELECT '' AS s, i, d FROM g), {_tree("u", groups_deep)},
p_0 AS MATERIALIZED (SELECT rid, s, i, coalesce(other, leaf) AS cur, '' AS proof FROM o), {_paths("t", "p", rows_deep)},
q_0 AS MATERIALIZED (SELECT rid, '' AS s, g.i, cur, proof FROM p_{rows_deep} p JOIN g ON g.source = p.s), {_paths("u", "q", groups_deep)}
SELECT doc_id, leaf, g.d AS subroot, u.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.d AS verified
FROM d JOIN g ON g.source = d.s JOIN q_{groups_deep} q USING (rid), u_{groups_deep} u
"""


def filters() -> str:
    """Every order and step as a row, figures counted from the documents' flags directly."""
    rows = []
    for order in permutations("ABCDE"):
        for k, f in enumerate(order):
            rows.append(f"('{''.join(order)}', {k + 1}, '{f}', '{''.join(order[:k])}')")
    fails = lambda f: f"(CASE {f} " + " ".join(f"WHEN '{x}' THEN {x}" for x in "ABCDE") + " END)"
    past = "NOT (" + " OR ".join(f"({x} AND contains(done, '{x}'))" for x in "ABCDE") + ")"
    others = " + ".join(f"{x}::INT" for x in "ABCDE")
    total = lambda c, what: f"coalesce(sum({what}) FILTER (WHERE {c}), 0)::BIGINT"
    mine = fails("f")
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
b AS (SELECT doc_id, part, len(ws) < 100 AS A, 100 * len(list_distinct(ws)) < 80 * len(ws) AS B, 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) AS C,
  regexp_matches(x, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS E FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, A, B, C, D, E, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT * FROM (VALUES {", ".join(rows)}) v(filter_order, step, f, done)),
r AS MATERIALIZED (SELECT part, filter_order, step, f, {total(f"{past} AND NOT {mine}", "n")} AS kept, {total(f"{past} AND {mine}", "n")} AS removed,
  {total(f"{mine} AND NOT {past}", "n")} AS redundant, {total(f"{mine} AND {others} = 1", "n")} AS unique_fails,
  {total(f"{past} AND {mine}", "good")} AS good_lost, {total(f"{past} AND {mine}", "toxic")} AS toxic_lost FROM c, o GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""


ORACLES = {
    "op3_embedding_tiles": EMBEDDINGS,
    "op4_substring_runs": SUBSTRINGS,
    "op9_license_join": licenses(),
    "op11_merkle_manifest": merkle(),
    "op12_filter_audit": filters(),
}
