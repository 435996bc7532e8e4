"""More registered queries: normal forms with NFC, token features, readers and writers by round trip, ids and counts, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators import citations as C
from lawmill.operators import corpus as V
from lawmill.operators import labels as L
from lawmill.operators import ledger as G
from lawmill.operators import sections as S
from lawmill.operators import tagging as B
from lawmill.plans.catalog import _CANDS, _CITED, _LINES, _TOKEN, _WS, _candidates, _docs, _lines, _t, query
from lawmill.sources import json_array as J
from lawmill.sources import readers as R
from lawmill.sources import scratch

#: A phrase in the legal pack's language put before each text, so that its rules have something to do.
_HEAD = "Theo ĐIỀU5; của luật và “khoản  7” năm 2013"
_LEGAL = f"(SELECT doc_id, '{_HEAD} ' || text AS text FROM documents)"


def _legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit(_HEAD + " "), "text").alias("text"))


def _normal(law: str, keep_lines: bool = False) -> str:
    """SQL of the normal form of text; law: alternatives after which a ';' is dropped."""
    x = "nfc_normalize(text)"
    if not keep_lines:
        x = f"regexp_replace({x}, '{_WS}', ' ', 'g')"
    x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])(điều|khoản|điểm|ĐIỀU|KHOẢN|ĐIỂM)[\s\x0b]*(\p{{Nd}})', '\1\2 \3', 'g')"
    x = rf"regexp_replace({x}, ';[\s\x0b]*((?:của|thuộc|theo)[\s\x0b]+(?:{law})([^\p{{L}}\p{{N}}_]|$))', ' \1', 'g')"
    if keep_lines:
        x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return rf"regexp_replace({x}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"


@query(f"SELECT doc_id, md5({_normal('luật')}) AS extract, md5({_normal('luật', True)}) AS highlight, md5({_normal('luật|án lệ')}) AS tagger FROM {_LEGAL}")
def normal_forms(spark, sf_dir):
    """SCL-1, SCL-2, SCL-3 with NFC, over every document"""
    form = lambda v: F.md5(T.normalize_legal(F.col("text"), v).cast("binary")).alias(v)
    return _legal(spark, sf_dir).select("doc_id", form("extract"), form("highlight"), form("tagger"))


def _key(text: str) -> str:
    x = f"regexp_replace(lower({text}), '[“”\"''`]', ' ', 'g')"
    x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])năm([^\p{{L}}\p{{N}}_]|$)', '\1 \2', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s\x0b/-]', ' ', 'g'), '{_WS}', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_key(_normal('luật|án lệ'))}) AS k FROM {_LEGAL}")
def title_keys(spark, sf_dir):
    """SCL-4 with NFC"""
    return _legal(spark, sf_dir).select("doc_id", F.md5(T.normalize_key(F.col("text")).cast("binary")).alias("k"))


@query(f"WITH {_LINES} SELECT doc_id, line_index::INT AS line_index, trim(regexp_replace(translate(strip_accents(lower(line)), 'đĐ', 'dD'), '{_WS}', ' ', 'g')) AS plain FROM lines")
def plain_lines(spark, sf_dir):
    """SCL-8, SCL-9: every line without accents"""
    return _lines(spark, sf_dir).select("doc_id", "line_index", T.plain_line(F.lower("line")).alias("plain"))


@query(f"WITH {_LINES} SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(line, chr(10) ORDER BY line_index)) AS digest FROM lines GROUP BY doc_id")
def composed_lines(spark, sf_dir):
    """SCL-5, SCL-7, FLT-3 with NFC on"""
    rows = _docs(spark, sf_dir).select("doc_id", T.lines(F.col("text")).alias("l")).where(F.size("l") > 0)
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "\n").cast("binary")).alias("digest"))


_S = r"[\s\x0b\x85\p{Z}]"
_SNIPPET_TEXT = "'Theo Điều ' || doc_id || ' và các khoản 2 ' || text"


@query(rf"SELECT doc_id::VARCHAR AS pdf_path, unnest(regexp_extract_all({_SNIPPET_TEXT}, '(?i)(?:các{_S}+)?(?:Điều|khoản|điểm){_S}+(?:\p{{Nd}}|,|{_S})+(?:và{_S}+(?:\p{{Nd}}|,|{_S})+)?[^.]*\.', 0)) AS snippet FROM documents")
def snippet_inference(spark, sf_dir):
    """SRC-10, SCL-18: scanned texts in Parquet to snippets, which may run over line ends"""
    made = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("pdf_path"), F.concat(F.lit("Theo Điều "), F.col("doc_id").cast("string"), F.lit(" và các khoản 2 "), "text").alias("ocr_text"))
    path = scratch.folder(spark, "scanned")
    made.write.parquet(path)
    return R.scanned(spark, path).select("pdf_path", F.explode(C.snippets(F.col("ocr_text"))).alias("snippet"))


# ---- readers and writers by round trip ---------------------------------------------------------------------------------
@query("SELECT item_id::VARCHAR || '.md' AS file_name, text, true AS same FROM benchmark")
def markdown_files(spark, sf_dir):
    """SRC-1, SRC-2, SNK-11: each benchmark item a file of its own, read strictly and leniently"""
    path = scratch.folder(spark, "markdown")
    rows = _t(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".md")).alias("name"), F.col("text").cast("binary").alias("content"))
    R.write_files(rows, path.removeprefix("file://").replace("file:/", "/"), "name", "content").count()
    loose = R.markdown(spark, path, lenient=True).withColumnRenamed("text", "loose")
    return R.markdown(spark, path).join(loose, "file_name").select("file_name", "text", (F.col("text") == F.col("loose")).alias("same"))


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS good, (SELECT count(*) FROM labels)::BIGINT AS bad, (SELECT sum(doc_id) FROM documents)::BIGINT AS ids, (SELECT count(*) FROM documents)::BIGINT AS after_drop")
def json_lines_with_bad_ones(spark, sf_dir):
    """SRC-4, SRC-5, SRC-6, SNK-8: documents as JSON lines, with a broken line for each label"""
    path = scratch.folder(spark, "jsonl")
    good = _docs(spark, sf_dir).select(F.to_json(F.struct("doc_id", "text")).alias("text"))
    bad = _t(spark, sf_dir, "labels").select(F.concat(F.lit('{"doc_id": oops '), F.col("doc_id").cast("string")).alias("text"))
    R.write_texts(good.unionByName(bad), path)
    kind = "doc_id long, text string"
    counted = R.json_lines(spark, path, kind).select("doc_id", "_corrupt").agg(F.count_if(F.col("_corrupt").isNull()).alias("good"), F.count_if(F.col("_corrupt").isNotNull()).alias("bad"), F.sum("doc_id").alias("ids"))
    return counted.crossJoin(R.json_lines(spark, path, kind, "drop").select("doc_id", "text").agg(F.count("doc_id").alias("after_drop")))  # one row each


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_document(spark, sf_dir):
    """SRC-3, SNK-1: every document in a pretty array, written in parts and read"""
    path = scratch.folder(spark, "array")
    R.write_json_array(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path, ["doc_id"])
    return J.read(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


def _csv(spark: SparkSession, sf_dir: str) -> str:
    path = scratch.folder(spark, "csv")
    _t(spark, sf_dir, "benchmark").select(F.concat(F.lit(" "), "text", F.lit("  ")).alias("title"), "item_id").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(r"SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS title FROM benchmark")
def csv_titles(spark, sf_dir):
    """SRC-7, SRC-9"""
    return R.titles(spark, _csv(spark, sf_dir))


@query("SELECT DISTINCT trim(t) AS title FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM benchmark) WHERE trim(t) <> ''")
def csv_first_column(spark, sf_dir):
    """SRC-8: a header named title is no title"""
    path = scratch.folder(spark, "csv")
    lines = _t(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("title")).where(F.trim("title") != "")
    lines.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return R.titles_by_place(spark, path).select("title")


@query(r"SELECT regexp_replace(t, '^\s+|\s+$', '', 'g') AS text, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents) WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1")
def snippet_lines(spark, sf_dir):
    """SRC-11: documents as plain text, a snippet a line"""
    path = scratch.folder(spark, "lines")
    R.write_texts(_docs(spark, sf_dir), path)
    return R.snippets(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CITED}, h AS (SELECT d.doc_id, count(law) AS n FROM documents d LEFT JOIN cited USING (doc_id) GROUP BY 1) SELECT CASE WHEN n > 0 THEN 'labeled' ELSE 'unlabeled' END AS part, count(*)::BIGINT AS n FROM h GROUP BY 1 UNION ALL SELECT 'unlabeled_filtered', count(*)::BIGINT FROM documents JOIN h USING (doc_id) WHERE n = 0 AND contains(lower(text), 'license')")
def triage_tables(spark, sf_dir):
    """SNK-3, FLT-5, FLT-6: labelled, unlabelled and filtered rows as three tables, read again"""
    docs = _docs(spark, sf_dir)
    cited = scratch.written(C.extract(docs, "doc_id", pack=P.LICENSE_EN), "cited")  # read thrice
    good, rest = cited.where(C.labelled(cited, "laws_cited")), cited.where(~C.labelled(cited, "laws_cited"))
    titles = spark.createDataFrame([], "title string")
    path = scratch.folder(spark, "triage")
    R.write_triage(good, rest, C.triage(rest.select("doc_id").join(docs, "doc_id"), titles, "text", extra=["license"]), path)
    parts = [spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n in ("labeled", "unlabeled", "unlabeled_filtered")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id FROM events WHERE false")
def triage_without_column(spark, sf_dir):
    """FLT-7: a frame that lacks the column gives no rows"""
    return C.triage(_t(spark, sf_dir, "events").select("event_id"), spark.createDataFrame([("x",)], "title string"))


# ---- labels, ids, batches -------------------------------------------------------------------------------------------
@query(f"WITH {_CITED}, e AS (SELECT doc_id::VARCHAR AS file_name, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS entry_index FROM documents) SELECT e.file_name, entry_index::BIGINT AS entry_index, count(*)::BIGINT AS n, max(i)::INT AS last FROM e JOIN (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) - 1 AS i FROM cited) c ON c.doc_id::VARCHAR = e.file_name GROUP BY ALL")
def law_entries(spark, sf_dir):
    """PRJ-4, WIN-9, AGG-18: citations numbered by entry and place, counted by file"""
    cited = C.extract(_docs(spark, sf_dir).withColumn("file_name", F.col("doc_id").cast("string")), "file_name", pack=P.LICENSE_EN)
    rows = scratch.written(C.explode_laws(cited), "law-rows")  # read twice
    last = rows.groupBy("file_name", "entry_index").agg(F.max("law_index").alias("last"))
    return V.per_file(rows).join(last, "file_name").select("file_name", "entry_index", "n", "last")


@query(f"WITH {_LINES}, {_CANDS}, c AS (SELECT doc_id || ':' || line_index || ':' || m || ':' || k AS candidate_id, * FROM every), w AS (SELECT doc_id, line_index, lag(line, 1, '') OVER x AS p, lead(line, 1, '') OVER x AS q FROM lines WINDOW x AS (PARTITION BY doc_id ORDER BY line_index)) SELECT c.candidate_id, c.doc_id::VARCHAR AS file_name, c.line AS candidate_line, p AS previous_1, q AS next_1, (row_number() OVER (ORDER BY c.doc_id::VARCHAR, c.line_index, candidate_id) - 1)::BIGINT AS place FROM c JOIN w USING (doc_id, line_index)")
def ordered_candidates(spark, sf_dir):
    """SRT-1, SRT-9, PRJ-7: candidates as JSON objects in order"""
    rows = _candidates(spark, sf_dir).withColumn("file_name", F.col("doc_id").cast("string"))
    rows = V.numbered(rows, ["file_name", "line_index", "candidate_id"], "place")
    got = L.ordered_outputs(rows).select("place", F.from_json(L.input_json(rows), "file_name string, candidate_id string, candidate_line string, previous_1 string, next_1 string").alias("j"))
    return got.select("j.candidate_id", "j.file_name", "j.candidate_line", "j.previous_1", "j.next_1", "place")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) - 1) // 32)::BIGINT AS batch FROM documents")
def mini_batches(spark, sf_dir):
    """SMP-4: seeded batches of 32"""
    return V.mini_batches(_docs(spark, sf_dir).select("doc_id"), "doc_id", 32)


@query(f"WITH {_LINES} SELECT count(DISTINCT doc_id)::BIGINT AS documents, count(*)::BIGINT AS n_lines, sum(regexp_matches(line, '{P.LICENSE_EN.markers['quyet_dinh']}')::INT)::BIGINT AS positives FROM lines")
def line_counts(spark, sf_dir):
    """AGG-8 over lines"""
    tag = F.when(F.col("line").rlike(P.LICENSE_EN.markers["quyet_dinh"]), "quyet_dinh").otherwise("O")
    return V.line_stats(_lines(spark, sf_dir).withColumn("tag", tag), "doc_id")


@query("SELECT sum((quality = 1)::INT)::BIGINT AS positive, sum((quality <> 1 OR quality IS NULL)::INT)::BIGINT AS negative FROM labels")
def sample_counts(spark, sf_dir):
    """AGG-7: a sample is positive if any of its tags is not O"""
    tags = F.array(F.lit("O"), F.when(F.col("quality") == 1, "B-LAW").otherwise("O"))
    return V.sample_counts(_t(spark, sf_dir, "labels").select(tags.alias("tags")))


@query(rf"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}', 0) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_slice(list_concat(list_transform(t, lambda x: CASE WHEN x = 'The' THEN 5 WHEN lower(x) = 'the' THEN 2 WHEN lower(x) = 'and' THEN 3 WHEN lower(x) = 'of' THEN 4 ELSE 1 END), list_transform(range(24), lambda x: 0)), 1, 24), ',') AS ids FROM t")
def encoded_words(spark, sf_dir):
    """JON-8, SCL-30: ids with the lower case standing in, cut or padded to 24"""
    ids = F.create_map(*(F.lit(x) for x in ("the", 2, "and", 3, "of", 4, "The", 5)))
    coded = V.pad(V.encode(T.tokens(F.col("text")), ids), 24)
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.array_join(F.transform(coded, lambda x: x.cast("string")), ",").alias("ids"))


@query(rf"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}', 0)) AS t FROM documents) SELECT doc_id, sum(contains(lower(t), 'license')::INT)::BIGINT AS inside, count(*)::BIGINT AS n FROM t GROUP BY doc_id")
def tokens_in_spans(spark, sf_dir):
    """JON-6: tokens that overlap a match"""
    docs = _docs(spark, sf_dir)
    rows = B.token_rows(docs, "doc_id").join(docs.select("doc_id", T.match_spans(F.col("text"), "(?i)license").alias("spans")), "doc_id")
    hit = B.inside_spans(F.col("start"), F.col("end"), F.col("spans"))
    return rows.groupBy("doc_id").agg(F.sum(hit).alias("inside"), F.count(F.lit(1)).alias("n"))


_SHORT = ", ".join(f"('{x}')" for kv in P.SHORT_NAMES.items() for x in kv)


@query(rf"WITH k AS (SELECT {_key(_normal('luật|án lệ'))} AS k FROM benchmark), w AS (SELECT regexp_extract_all(k, '[\p{{L}}\p{{N}}_]+', 0) AS w FROM k UNION SELECT string_split(x, ' ') FROM (VALUES {_SHORT}) v(x)) SELECT DISTINCT array_to_string(w, ' ') AS phrase, len(w)::INT AS n FROM w WHERE len(w) >= 2 OR array_to_string(w, ' ') IN (SELECT x FROM (VALUES {_SHORT}) v(x))")
def gazetteer_phrases(spark, sf_dir):
    """SEM-4, SET-6"""
    return B.gazetteer(_t(spark, sf_dir, "benchmark"), "text")


_CLEAN = "lower(trim(t, '.,;:()[]{}“”\"''`'))"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_TOKEN_BITS = {
    "is_numberish": rf"regexp_full_match({_CLEAN}, '\p{{Nd}}{{1,4}}[a-zA-ZđĐ]?')", "is_year": rf"regexp_full_match({_CLEAN}, '(?:19|20)\p{{Nd}}{{2}}')",
    "is_article_keyword": f"{_CLEAN} = 'điều'", "is_clause_keyword": f"{_CLEAN} = 'khoản'", "is_point_keyword": f"{_CLEAN} = 'điểm'",
    "is_law_kind": f"{_CLEAN} IN {_IN(B._LAW_WORDS + B._CASE_WORDS)}", "is_law_abbr": f"lower(t) IN {_IN(P.SHORT_NAMES)}", "is_connector": f"{_CLEAN} IN {_IN(B._LINKS)}",
    "is_punct": r"regexp_full_match(t, '[^\p{L}\p{N}_\s]')",
}
_NEAR = {"near_article_keyword": (B._UNITS, 3), "near_law_keyword": (B._LAW_WORDS, 4)}
_FEATURE_TEXT = "'theo khoản 2 điều ' || doc_id || ' của BLHS năm 2013; ' || coalesce(text, '')"


@query(rf"WITH t AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM (SELECT doc_id, regexp_extract_all({_FEATURE_TEXT}, '{_TOKEN}', 0) AS l FROM documents)), f AS (SELECT doc_id, t, i, {', '.join(f'({v})::INT AS {k}' for k, v in _TOKEN_BITS.items())}, {', '.join(f'max(({_CLEAN} IN {_IN(w)})::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING) AS {k}' for k, (w, n) in _NEAR.items())} FROM t) SELECT doc_id, count(*)::BIGINT AS n, {', '.join(f'sum({k} * i)::BIGINT AS {k}' for k in [*_TOKEN_BITS, *_NEAR])}, 1::BIGINT AS gazetteer_law_begin FROM f GROUP BY doc_id")
def token_features(spark, sf_dir):
    """FEA-1, SCL-10, JON-7 over every token: a document's sums of places with each feature"""
    made = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("theo khoản 2 điều "), F.col("doc_id").cast("string"), F.lit(" của BLHS năm 2013; "), T.safe_text(F.col("text"))).alias("text"))
    phrases = B.gazetteer(spark.createDataFrame([("Luật Đất đai",)], "title string"))
    rows = B.features(made, phrases, "doc_id")
    at = F.col("pos") + 1
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(k) * at).cast("long").alias(k) for k in [*_TOKEN_BITS, *_NEAR]), F.sum("gazetteer_law_begin").cast("long").alias("gazetteer_law_begin"))


# ---- ledgers --------------------------------------------------------------------------------------------------------
_STATUS = "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'downloaded' WHEN 2 THEN 'skipped_scanned' ELSE 'failed' END"


@query(f"WITH e AS (SELECT event_id, {_STATUS} AS status FROM events) SELECT event_id, (SELECT count(*) FROM e WHERE status = 'pending')::BIGINT AS pending FROM e WHERE status NOT IN ('downloaded', 'skipped_scanned')")
def ledger_open(spark, sf_dir):
    """FLT-8, AGG-14: what is not settled, and how many wait"""
    e = _t(spark, sf_dir, "events").select("event_id", F.expr(_STATUS).alias("status"))
    return e.where(~G.settled(F.col("status"))).select("event_id").crossJoin(F.broadcast(G.waiting(e)))  # one row


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR text IS NULL THEN 'failed' WHEN length(trim(text)) < 200 THEN 'skipped_scanned' ELSE 'downloaded' END AS status FROM documents")
def download_outcome(spark, sf_dir):
    """FLT-11, STR-5"""
    url = F.when(F.col("doc_id") % 7 != 0, F.lit("u"))
    return _docs(spark, sf_dir).select("doc_id", G.outcome(url, F.col("text")).alias("status"))


@query("SELECT event_id, event_type, value, CASE WHEN event_id % 2 = 1 THEN event_id * 2 END AS extra FROM events")
def ledger_evolves(spark, sf_dir):
    """SNK-7: rows with a column that the ledger lacks"""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return G.upsert(e.where("event_id % 2 = 0").withColumn("turn", F.lit(0)), e.where("event_id % 2 = 1").withColumns({"turn": F.lit(1), "extra": F.col("event_id") * 2}), ["event_id"], "turn").drop("turn")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE doc_id END AS got FROM documents")
def lenient_json(spark, sf_dir):
    """PRS-4: an answer that is JSON, that holds JSON, or neither"""
    i = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"id": '), i, F.lit("}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('Sure:\n{"id": '), i, F.lit("}\nDone."))).otherwise(F.lit("no { braces"))
    return _docs(spark, sf_dir).select("doc_id", F.try_variant_get(L.lenient_json(raw), "$.id", "bigint").alias("got"))
