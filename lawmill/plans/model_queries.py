"""Registered queries of the model path: whole documents through a network to tags, metrics, sections and citations.

The networks copy: their weights are set so that each tag follows from one feature or word, which SQL can say too. So the
query checks everything around the weights (normal form, tokens, ids, features, padding, packing, decoding, repair).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators import inference as I
from lawmill.operators import models as M
from lawmill.operators import tagging as B
from lawmill.plans.catalog import _LINES, _TOKEN, _docs, query
from lawmill.plans.whole_tables import _FEATURE_TEXT, _SNIPPET_TEXT, _TOKEN_BITS, _S, _normal


def copying(tags: list[str], by_feature: dict[str, str], by_word: dict[str, str], features: list[str], widths=(3,), **sizes) -> tuple[dict, dict]:
    """A model whose tag is that of the feature that is set or of the word; else the first after padding."""
    words = {w: i + 2 for i, w in enumerate(by_word)}
    signs, k = [*by_feature.items(), *by_word.items()], len(by_feature)
    b = M.new_bundle(2 + len(words), 2, len(features), len(tags), len(words) or 1, 1, 1, max(k, 1), len(signs), widths=widths)
    b = {n: {m: x * 0 for m, x in w.items()} if isinstance(w, dict) else w * 0 for n, w in b.items()}
    h, start = len(signs), len(words) or 1
    for i in range(len(words)):
        b["word"][i + 2, i] = 1
    for j, (f, _) in enumerate(by_feature.items()):
        b["feat"][j, features.index(f)] = 1
    for part in ("forward", "backward"):
        w = b[part]
        w["bih"][:h], w["bih"][h : 2 * h], w["bih"][2 * h : 3 * h], w["bih"][3 * h :] = 20, -20, -20, 20
        for j in range(h):
            w["ih"][2 * h + j, start + len(widths) + j if j < k else j - k] = 40
    for j, (_, t) in enumerate(signs):
        b["out"][tags.index(t), [j, h + j]] = 5
        b["out_bias"][tags.index(t)] = 0
    # h is 0.76 where a sign is set and -0.76 elsewhere: several signs of one tag add up, so the bias makes up for the rest
    for t in set(t for _, t in signs):
        n = sum(x == t for _, x in signs)
        b["out_bias"][tags.index(t)] = 10 * np.tanh(1) * (n - 1)
    b["out_bias"][0] = M.NEVER
    config = {"words": words, "chars": {}, "tags": tags, "features": features} | ({"max_line_words": 8, "max_line_chars": 8} if len(widths) > 1 else {"max_word_len": 4}) | sizes
    return b, config


def _token_model() -> tuple[dict, dict]:
    return copying(B.TAGS, {"is_punct": "B-ART", "is_numberish": "I-ART", "is_connector": "B-LAW"}, {"the": "I-LAW"}, B.FEATURES)


_RAW = f"CASE WHEN {_TOKEN_BITS['is_punct']} THEN 'B-ART' WHEN {_TOKEN_BITS['is_numberish']} THEN 'I-ART' WHEN {_TOKEN_BITS['is_connector']} THEN 'B-LAW' WHEN lower(t) = 'the' THEN 'I-LAW' ELSE 'O' END"
_TAGGED = (
    rf"n AS (SELECT doc_id, {_normal('luật|án lệ')} AS text FROM (SELECT doc_id, {_FEATURE_TEXT} AS text FROM documents)), "
    rf"t AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}', 0) AS l FROM n)), r AS (SELECT doc_id, i, {_RAW} AS raw FROM t), "
    "x AS (SELECT doc_id, i, raw, CASE WHEN raw LIKE 'I-%' AND coalesce(lag(raw) OVER w, 'O') NOT LIKE '%' || substr(raw, 2) THEN 'B' || substr(raw, 2) ELSE raw END AS tag FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i))"
)


def _texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("theo khoản 2 điều "), F.col("doc_id").cast("string"), F.lit(" của BLHS năm 2013; "), T.safe_text(F.col("text"))).alias("text"))


def _titles(spark):
    return spark.range(0, 1, 1, 1).select(F.lit("Luật Đất đai").alias("title"))


@query(f"WITH {_TAGGED} SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(tag, ' ' ORDER BY i)) AS tags FROM x GROUP BY doc_id")
def model_tags(spark, sf_dir):
    """SEM-16, MDL-3, MDL-9, JON-8: every document's text to repaired tags"""
    got = I.tag_texts(_texts(spark, sf_dir), _titles(spark), "doc_id", _token_model())
    return got.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tags", " ").cast("binary")).alias("tags"))


_ENTITIES = "e AS (SELECT doc_id, i, tag, sum((tag LIKE 'B-%')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM x WHERE tag <> 'O')"


@query(f"WITH {_TAGGED}, {_ENTITIES}, s AS (SELECT doc_id, g, substr(max(tag), 3) AS label FROM e GROUP BY doc_id, g), c AS (SELECT label, count(*)::BIGINT AS tp FROM s GROUP BY label) SELECT label, tp, 1.0::DOUBLE AS f1 FROM c UNION ALL SELECT 'micro', sum(tp)::BIGINT, 1.0::DOUBLE FROM c UNION ALL SELECT 'avg', 0::BIGINT, 1.0::DOUBLE")
def model_metrics(spark, sf_dir):
    """MDL-10, AGG-9, AGG-10, AGG-11: the tagger's own tags as the truth; the loss is that of a sure model"""
    model = _token_model()
    rows, told = I.told_samples(_texts(spark, sf_dir), _titles(spark), "doc_id", model)
    _, metrics = I.evaluate(rows, "doc_id", model, before=told)
    return metrics.select("label", "tp", "f1")


_MARKS = [m for m in P.MARKERS if P.LICENSE_EN.markers[m]]


def _line_model() -> tuple[dict, dict]:
    names = ["pos_ratio", *(f"regex_{m}" for m in P.MARKERS)]
    return copying(["<PAD>", "O", *P.MARKERS], {f"regex_{m}": m for m in _MARKS}, {}, names, widths=(3, 5))


# a line of two markers scores both alike, and the first is taken
_MARK = "CASE " + " ".join(f"WHEN regexp_matches(line, '{P.LICENSE_EN.markers[m]}') THEN '{m}'" for m in _MARKS) + " END"


@query(f"WITH {_LINES}, m AS (SELECT doc_id, line_index + 1 AS spot, coalesce({_MARK}, 'O') AS m FROM lines) SELECT doc_id, count(*)::BIGINT AS n, {', '.join(f"sum((m = '{m}')::INT * spot)::BIGINT AS {m}" for m in _MARKS)} FROM m GROUP BY doc_id")
def model_line_tags(spark, sf_dir):
    """SEM-12, MDL-5, FEA-2, SCL-30: every line's marker by the line model, as sums of places"""
    rows = I.tag_lines(_docs(spark, sf_dir), _line_model(), "doc_id", pack=P.LICENSE_EN)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.when(F.col("tag") == m, F.col("line_index") + 1).otherwise(0)).cast("long").alias(m) for m in _MARKS))


@query()
def model_sections(spark, sf_dir):
    """SEM-10, SEM-11, SEM-12: every document to sections; tests compare with a plain version"""
    got = I.predict_sections(_docs(spark, sf_dir), _line_model(), "doc_id", P.LICENSE_EN)
    return got.select("doc_id", "warnings", *(F.col(f"sections.{m}").alias(m) for m in P.MARKERS))


@query(rf"WITH s AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS s FROM (SELECT doc_id, regexp_extract_all({_SNIPPET_TEXT}, '(?i)(?:các{_S}+)?(?:Điều|khoản|điểm){_S}+(?:\p{{Nd}}|,|{_S})+(?:và{_S}+(?:\p{{Nd}}|,|{_S})+)?[^.]*\.', 0) AS l FROM documents)), t AS (SELECT doc_id, n, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM (SELECT doc_id, n, regexp_extract_all(s, '{_TOKEN}', 0) AS l FROM s)), g AS (SELECT *, sum((t = 'the')::INT) OVER (PARTITION BY doc_id, n ORDER BY i) AS law FROM t) SELECT doc_id::VARCHAR AS pdf_path, sum((t = 'of')::INT)::BIGINT AS articles, count(DISTINCT CASE WHEN t = 'of' THEN n || ':' || law END)::BIGINT AS laws FROM g WHERE law > 0 GROUP BY doc_id HAVING sum((t = 'of')::INT) > 0")
def model_citations(spark, sf_dir):
    """FLT-16, MDL-4: scanned texts to snippets, tags and laws with articles; "the" stands for a law and "of" for an article"""
    b, config = copying(B.TAGS, {}, {"the": "B-LAW", "of": "I-ART"}, [])
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("pdf_path"), F.concat(F.lit("Theo Điều "), F.col("doc_id").cast("string"), F.lit(" và các khoản 2 "), "text").alias("ocr_text"))
    got = I.snippet_citations(docs, (b, config))
    return got.select("pdf_path", F.aggregate("citations", F.lit(0).cast("long"), lambda a, c: a + F.size(c["articles"])).alias("articles"), F.size("citations").cast("long").alias("laws"))
