"""Operators on hand-made cases and against plain versions."""

import json
import random
import re
import unicodedata

import numpy as np
import plain_tags
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators import citations as C
from lawmill.operators import corpus as V
from lawmill.operators import labels as L
from lawmill.operators import ledger as G
from lawmill.operators import links as K
from lawmill.operators import models as M
from lawmill.operators import sections as S
from lawmill.operators import tagging as B
from lawmill.sources import readers as R
from lawmill.streaming import runner as U


def values(spark, rows, kind, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, kind).select(*columns).collect()]


# ---- text -----------------------------------------------------------------------------------------------------------
def test_normal_forms(spark):
    got = values(spark, [("Điều 5  ; của  luật\nkhoản5 đê 7",), (unicodedata.normalize("NFD", "điều5"),), (None,)], "t string", T.normalize_legal(F.col("t")))
    assert got == [("Điều 5  của luật khoản 5 Điều 7",), ("điều 5",), (None,)]
    assert values(spark, [("a \n\n b ; của án lệ",)], "t string", T.normalize_legal(F.col("t"), "highlight"), T.normalize_legal(F.col("t"), "tagger")) == [("a \n\n b ; của án lệ", "a b  của án lệ")]
    assert values(spark, [('Luật "Đất đai" năm 2013 (số 45/2013)',)], "t string", T.normalize_key(F.col("t"))) == [("luật đất đai 2013 số 45/2013",)]
    assert values(spark, [("Đường  Ắc",)], "t string", T.plain_line(F.col("t")), T.strip_accents(F.col("t"))) == [("duong ac", "Duong  Ac")]


def test_lines_are_those_of_splitlines(spark):
    rng = random.Random(4)
    ends = ["\n", "\r\n", "\r", "\u000b", "\u000c", "\u001c", "\u001d", "\u001e", "\u0085", " ", " ", " ", "﻿", "a", "b é"]
    texts = ["".join(rng.choice(ends) for _ in range(40)) for _ in range(60)] + ["", None]
    want = [[y for x in (t or "").splitlines() if (y := re.sub(r"\s+", " ", x.replace("﻿", " ")).strip())] for t in texts]
    got = values(spark, list(enumerate(texts)), "i int, t string", "i", T.lines(F.col("t")))
    assert [list(x) for _, x in sorted(got)] == want


def test_tokens_and_escapes(spark):
    x = "Điều 5, Bộ-luật <a & 'b'>"
    got = values(spark, [(x,)], "t string", T.tokens(F.col("t")), T.indexed(F.col("t")), T.escape_html(F.col("t")), T.clean_token(F.lit("(ĐIỀU).")))[0]
    assert list(got[0]) == re.findall(r"\w+|[^\w\s]", x) and got[1].startswith("1#Điều 2#5, 3#Bộ-luật") and got[2].endswith("&lt;a &amp; &#x27;b&#x27;&gt;") and got[3] == "điều"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["Điều 5", " và ", "khoản 2", " BLHS", "x", "😀", " Luật A; ", "điểm a, b "]), max_size=12))
def test_spans_are_those_of_the_standard_engine(spark, parts):
    text = "".join(parts)
    got = values(spark, [(text,)], "t string", T.match_spans(F.col("t"), P.ARTICLE_UNIT))[0][0]
    assert all(text[s["start"] : s["end"]] == s["text"] for s in got)
    assert [s["start"] for s in got] == sorted({s["start"] for s in got})


def test_long_lists_of_articles_do_not_overflow(spark):
    text = "Điều " + ", ".join(map(str, range(1, 2500))) + " Bộ luật Hình sự"
    got = values(spark, [(text,)], "t string", C.found(F.col("t"), P.LEGAL_VI))[0][0]
    assert list(got) == [text]


def test_upper_ratio(spark):
    got = values(spark, [("ABc1",), ("123",), ("ß文A",)], "t string", T.upper_ratio(F.col("t")))
    assert [x for (x,) in got] == [2 / 3, 0.0, 2 / 3]


# ---- citations ------------------------------------------------------------------------------------------------------
def test_f1_keeps_its_order_of_evaluation(spark):
    laws = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "zz"), (3, None)], "k int, law string")
    titles = spark.createDataFrame([("a b c x",), ("q",), (None,)], "title string")
    got = dict(C.best_title(laws, titles, "k").collect())
    p, r = 3 / 11, 3 / 4
    assert got == {1: 2 * p * r / (p + r), 2: 0.0, 3: 0.0}


def test_validation_keeps_every_file(spark):
    cited = spark.createDataFrame([("a", ["Bộ luật Dân sự", "gì đó khác"]), ("b", [])], "file_name string, laws_cited array<string>")
    titles = spark.createDataFrame([("Bộ luật Dân sự",)], "title string")
    got = {r[0]: (list(r[1]), list(r[2])) for r in C.validate(cited, titles).collect()}
    assert got == {"a": (["Bộ luật Dân sự"], ["gì đó khác"]), "b": ([], [])}


def test_triage(spark):
    rows = spark.createDataFrame([(1, "theo BLHS"), (2, "a.c"), (3, "abc"), (4, None)], "i int, input string")
    assert sorted(r[0] for r in C.triage(rows, spark.createDataFrame([("A.C",)], "title string")).collect()) == [1, 2]
    assert C.triage(rows.drop("input"), spark.createDataFrame([("x",)], "title string")).count() == 0


def test_explode_numbers_files_by_name(spark):
    cited = spark.createDataFrame([("b", ["x"]), ("a", ["y", "z"])], "file_name string, laws_cited array<string>")
    assert sorted(tuple(r) for r in C.explode_laws(cited).collect()) == [("a", 0, 0, "y"), ("a", 0, 1, "z"), ("b", 1, 0, "x")]


# ---- labels ---------------------------------------------------------------------------------------------------------
@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["1", "22", "x", "3a"]), max_size=3), st.integers(0, 9), st.integers(0, 9)), max_size=4))
def test_parse_citations(spark, lines):
    words = "a b c d e f".split()
    raw = "\n".join(f"ART: {', '.join(a)} | LAW: {x}-{y}" for a, x, y in lines) + "\nnoise"
    want = [([n for n in a if n.isdigit()], " ".join(words[x - 1 : y]) if 1 <= x <= y <= 6 else "[INVALID_RANGE]") for a, x, y in lines]
    got = values(spark, [(raw, words)], "r string, w array<string>", L.parse_citations(F.col("r"), F.col("w")))[0][0]
    assert [(list(c["articles"]), c["law"]) for c in got] == want


def test_resolution_and_joins(spark):
    rows = spark.createDataFrame([("f", 1, "quyet_dinh", "medium", 0), ("f", 1, "O", "high", 1), ("f", 1, "nhan_dinh", "high", 2), (None, 1, "x", "high", 3)], "file string, line int, tag string, conf string, seq int")
    best = L.resolve(rows, ["file", "line"], "tag", "conf", "seq")
    assert [tuple(r) for r in best.collect()] == [("f", 1, "nhan_dinh", "high")]
    lines = spark.createDataFrame([("f", 0), ("f", 1), ("g", 0)], "file string, line int")
    assert sorted(tuple(r) for r in L.attach(lines, best, ["file", "line"], require=True).collect()) == [("f", 0, "O"), ("f", 1, "nhan_dinh")]
    done = spark.createDataFrame([("f", 0, "ERROR: x"), ("g", 0, "113")], "file string, line int, raw string")
    left = L.pending(lines, done, ["file", "line"], ~F.col("raw").startswith("ERROR:"))
    assert sorted(tuple(r) for r in left.collect()) == [("f", 0), ("f", 1)]


def test_lenient_json_and_flatten(spark):
    got = values(spark, [('{"a":1}',), ('x {"a":2} y',), ("no",)], "t string", L.lenient_json(F.col("t")).cast("string"))
    assert [x[0] for x in got] == ['{"a":1}', '{"a":2}', None]
    docs = spark.createDataFrame([("f", "p", [(None, "one"), ("g", "two")])], "file_name string, path string, candidates array<struct<file_name:string,line:string>>")
    assert [tuple(r) for r in L.flatten_candidates(docs).collect()] == [("f", "p", "one"), ("g", "p", "two")]


# ---- sections -------------------------------------------------------------------------------------------------------
DOC = ["TÒA ÁN", "NHÂN DANH NƯỚC CỘNG HÒA", "x", "NỘI DUNG VỤ ÁN:", "nội dung", "theo quyết định gì", "NHẬN ĐỊNH CỦA TÒA ÁN", "QUYẾT ĐỊNH:", "| a | b |", "hết"]


def test_candidates(spark):
    docs = spark.createDataFrame([("f.md", "\n\n".join(DOC))], "file_name string, text string")
    rows = S.line_rows(docs)
    got = {r["candidate_id"]: r for r in S.candidates(rows, negatives=1, exact_seed=True).collect()}
    kinds = sorted((r["line_index"], r["expected_marker_type"], r["candidate_kind"]) for r in got.values())
    free = [0, 2, 8, 9]
    order = list(free)
    random.Random(42 + sum(map(ord, "f.md"))).shuffle(order)
    want = [(1, "preamble", "regex"), (3, "noi_dung_vu_an", "regex"), (4, "none", "hard_negative"), (5, "none", "hard_negative"), (6, "nhan_dinh", "regex"), (7, "quyet_dinh", "regex"), (order[0], "none", "random_negative")]
    assert kinds == sorted(want)
    r = got["f.md:7:quyet_dinh:regex"]
    assert (r["previous_2"], r["next_2"], r["position_ratio"]) == (DOC[5], "hết", 7 / 9) and r["regex_score"] == pytest.approx(3.7)
    assert len([k for k in S.candidates(rows, negatives=3).collect() if k["candidate_kind"] == "random_negative"]) == 3


def test_features(spark):
    rows = S.line_rows(spark.createDataFrame([("f", "\n".join(DOC))], "file_name string, text string"))
    f = {r["line_index"]: r for r in S.features(rows).collect()}
    assert len([c for c in f[0].asDict() if c not in rows.columns]) == 26
    assert f[7]["regex_quyet_dinh"] == f[7]["kw_quyet_dinh"] == f[7]["has_colon"] == f[7]["all_caps"] == 1.0 and f[0]["near_top"] == 1.0 and f[9]["pos_ratio"] == 1.0
    w = {r["line_index"]: r for r in S.wide_features(rows).collect()}
    assert len([c for c in w[0].asDict() if c not in rows.columns]) == 70
    assert w[6]["window_regex_quyet_dinh"] == pytest.approx(0.65) and w[8]["has_markdown_table"] == 1.0 and w[0]["prev_blank_like"] == 1.0 and w[1]["prev_blank_like"] == 0.0
    assert w[0]["kw_toa_an"] == 1.0 and w[7]["accentless_marker_hit"] == 1.0 and w[3]["kw_noi_dung"] == 1.0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.none() | st.integers(0, 20), min_size=5, max_size=5), st.integers(1, 21))
def test_slices_follow_the_order_and_cover_the_rest(spark, at, n):
    at = [None if x is None or x >= n else x for x in at]
    docs = spark.createDataFrame([([f"l{i}" for i in range(n)], *at)], "lines array<string>, " + ", ".join(f"{m} int" for m in P.MARKERS))
    out = S.slice_sections(docs).first()
    said = [x for m in P.MARKERS for x in out["sections"][m].split("\n") if x]
    assert said == [f"l{i}" for i in range(n)][n - len(said) :]


def test_fallback_starts(spark):
    docs = spark.createDataFrame([([f"l{i}" for i in range(100)], *[None] * 5)], "lines array<string>, " + ", ".join(f"{m} int" for m in P.MARKERS))
    out = S.slice_sections(docs).first()
    assert [out["sections"][m].split("\n")[0] for m in P.MARKERS] == ["l0", "l15", "l48", "l57", "l78"]
    assert len(out["section_warnings"]) == 5


def test_prediction(spark):
    docs = spark.createDataFrame([("f", "\n".join(DOC)), ("e", " \n ")], "file_name string, text string")
    rows = S.line_rows(docs).withColumn("tag", F.lit("O")).withColumns({f"prob_{m}": F.lit(0.0) for m in P.MARKERS})
    got = {r["file_name"]: r for r in S.predict(docs, rows).collect()}
    assert list(got["e"]["warnings"]) == ["empty_file"] and got["e"]["sections"]["preamble"] == ""
    assert {k: v["line_index"] for k, v in got["f"]["selected_markers"].items()} == {"preamble": 1, "noi_dung_vu_an": 3, "nhan_dinh": 6, "quyet_dinh": 7}
    assert got["f"]["sections"]["quyet_dinh"] == "QUYẾT ĐỊNH:\n| a | b |\nhết" and "missing_marker:dai_dien_vks" in got["f"]["warnings"]


# ---- tags -----------------------------------------------------------------------------------------------------------
def test_tagging():
    assert plain_tags.tag("Điều 5, 7 Luật Đất đai", [("Luật Đất đai", "Luật Đất đai")], ["5", "7", "5"], None) == ["B-ART", "I-ART", "O", "B-ART", "B-LAW", "I-LAW", "I-LAW"]
    assert plain_tags.tag("a Luật b", [], [], (2, 3)) == ["O", "B-LAW", "I-LAW"]
    assert plain_tags.law_range(["x", "luật", "y"], 2, 2) == (1, 2) and plain_tags.law_range(["x"], 5, 9) is None


def test_token_features(spark):
    phrases = B.gazetteer(spark.createDataFrame([("Luật Đất đai",)], "title string"))
    docs = spark.createDataFrame([("a", "Điều 5 của Luật Đất đai năm 2013.")], "k string, text string")
    got = {r["token"]: r for r in B.features(docs, phrases, "k").collect()}
    assert got["5"]["is_numberish"] == 1 and got["2013"]["is_year"] == 1 and got["."]["is_punct"] == 1 and got["của"]["is_connector"] == 1
    assert [got[w]["gazetteer_law_begin"] for w in ("Luật", "Đất")] == [1, 0] and got["đai"]["gazetteer_law_inside"] == 1
    assert got["Điều"]["inside_article_regex"] == got["Luật"]["inside_law_regex"] == got["5"]["inside_citation_regex"] == 1 and got["5"]["near_article_keyword"] == 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["O", "B-LAW", "I-LAW", "B-ART", "I-ART"]), min_size=1, max_size=10))
def test_bio(spark, tags):
    fixed, before = [], "O"
    for t in tags:
        before = "B-" + t[2:] if t[0] == "I" and before[2:] != t[2:] else t
        fixed.append(before)
    rows = spark.createDataFrame([("k", i, str(i), t) for i, t in enumerate(tags)], "k string, pos int, token string, tag string")
    once = B.repair(rows, "k")
    assert [r["tag"] for r in once.orderBy("pos").collect()] == fixed
    assert [r["tag"] for r in B.repair(once, "k").orderBy("pos").collect()] == fixed
    spans = sorted((r["first"], r["last"], r["label"]) for r in B.spans(rows, "k").collect())
    want, i = [], 0
    while i < len(fixed):
        j = i + 1
        if fixed[i] != "O":
            while j < len(fixed) and fixed[j] == "I-" + fixed[i][2:]:
                j += 1
            want.append((i, j - 1, fixed[i][2:]))
        i = j
    assert spans == want


def test_following_attachment(spark):
    tags = ["B-ART", "I-ART", "B-LAW", "I-LAW", "O", "I-LAW"]
    rows = spark.createDataFrame([("k", i, w, t) for i, (w, t) in enumerate(zip("Điều 5 Luật A và B".split(), tags, strict=True))], "k string, pos int, token string, tag string")
    assert [tuple(r)[2:] for r in B.law_articles(rows, "k", "following").collect()] == [("Luật A", ["5"])]
    assert [tuple(r)[2:] for r in B.law_articles(rows, "k").collect()] == [("Luật A", [])]


# ---- corpus ---------------------------------------------------------------------------------------------------------
def test_vocabulary_and_ids(spark):
    counts = V.word_counts(spark.createDataFrame([("A a b",)], "text string"))
    assert {r["token"]: r["cnt"] for r in counts.collect()} == {"A": 1, "a": 3, "b": 2}
    ids = {r["token"]: r["id"] for r in V.vocabulary(counts, "token").collect()}
    assert ids == {"a": 2, "b": 3, "A": 4}
    m = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    assert [list(x) for (x,) in values(spark, [(["B", "zz"],)], "t array<string>", V.pad(V.encode(F.col("t"), m), 3))] == [[3, 1, 0]]


def test_splits():
    names = [f"n{i}" for i in range(10)]
    got = list(V.split_exact(names).values())
    assert (got.count("train"), got.count("val"), got.count("test")) == (8, 1, 1)
    assert sorted(V.split_exact(["a", "b", "c"]).values()) == ["test", "train", "val"]
    assert sorted(V.split_exact(["a", "b"], sections=True).values()) == ["train", "val"]


def test_duplicates(spark):
    files = spark.createDataFrame([("b c", "x"), ("a", "x"), ("d", "y")], "path string, content string")
    assert [r["first_path"] for r in V.exact_duplicates(files, "path", "content").collect()] == ["a"]
    assert {r["path"]: r["action"] for r in V.dedup_plan(files, "path", "content").collect()} == {"a": "keep", "b c": "delete", "d": "keep"}


# ---- pages ----------------------------------------------------------------------------------------------------------
HTML = """<form id='aspnetForm' action='go.aspx'><input name='a' value='1'><input type='checkbox' name='c'><input type='radio' name='r' checked>
<input type='submit' name='s'><select name='x' id='sel'><option value=''>-</option><option value='2' selected>two</option></select></form>
<a href='/out'>o</a><div id='List_group_pub'><a href=' /b '>b</a><br><a href='javascript:x'>j</a><a href='/TRA-CU-BAN-AN/q'>t</a><a href='a b.PDF'>p</a></div><a href='/z' download>z</a>"""


def test_pages():
    assert K.page_links(HTML, "https://h/x/") == ["https://h/b", "https://h/x/a b.PDF"]
    assert K.page_links("<a href='/q'>", "https://h/") == ["https://h/q"] and K.page_links(None, "https://h/") == []
    assert K.pdf_link(HTML, "https://h/x/") == "https://h/x/a%20b.PDF" and K.pdf_link("<a href=x>", "https://h") is None
    fields, action = K.form_fields(HTML, "https://h/f/")
    assert fields == {"__EVENTTARGET": "", "__EVENTARGUMENT": "", "a": "1", "r": "on", "x": "2"} and action == "https://h/f/go.aspx"
    assert K.options(HTML, "sel") == [("2", "two")] and K.options(HTML, "sel", {"2"}) == []


def test_case_id(spark):
    assert [x for (x,) in values(spark, [("https://h/12/x",), ("https://h",), ("https://h/?q=/9",)], "u string", K.case_id(F.col("u")))] == ["12", "unknown_id", "unknown_id"]


# ---- ledgers, streams, files ----------------------------------------------------------------------------------------
def test_ledger(spark):
    old = spark.createDataFrame([("a", 1, "x", "keep"), ("b", 1, "x", None)], "k string, seq int, v string, w string")
    new = spark.createDataFrame([("a", 2, "y"), ("c", 1, "z"), ("c", 2, "zz")], "k string, seq int, v string")
    assert sorted((r["k"], r["v"], r["w"]) for r in G.upsert(old, new, ["k"], "seq").collect()) == [("a", "y", None), ("b", "x", None), ("c", "zz", None)]
    assert sorted((r["k"], r["v"]) for r in G.add_new(old, new, ["k"], "seq").collect()) == [("a", "x"), ("b", "x"), ("c", "z")]
    assert sorted((r["k"], r["v"]) for r in G.update(old, spark.createDataFrame([("a", None), ("q", "n")], "k string, v string"), "k", ["v"]).collect()) == [("a", "x"), ("b", "x")]
    states = values(spark, [("u", "x" * 300), ("u", "short"), (None, "x" * 300)], "p string, t string", G.outcome(F.col("p"), F.col("t")))
    assert [s for (s,) in states] == ["downloaded", "skipped_scanned", "failed"]


def test_stream_resumes(spark, tmp_path):
    kind = "file_name string, candidate_id string, candidate_line string, expected_marker_type string, candidate_kind string, seq long"
    asked = tmp_path / "in"
    rows = [("f", f"f:{i}", "QUYẾT ĐỊNH" if i % 2 else "x", "quyet_dinh", "regex", i) for i in range(4)]

    def turn(part, number):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").json(str(asked))
        stream = spark.readStream.schema(kind).json(str(asked))
        q = U.upsert_batches(stream, str(tmp_path / "ledger"), ["file_name", "candidate_id"], "seq", str(tmp_path / "cp"), lambda df: U.answered(U.offline(df)))
        q.awaitTermination()
        return {r["candidate_id"]: (r["label"], r["marker_type"], r["rule_reason"]) for r in U.read_ledger(spark, str(tmp_path / "ledger")).collect()}

    first = turn(rows[:2], 0)
    assert first == {"f:0": (0, "none", None), "f:1": (1, "quyet_dinh", "rule_strong_marker")}
    assert len(turn(rows[1:], 1)) == 4


def test_retry_and_ask(spark):
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise ValueError("no")
        return "113"

    assert U.with_retry(flaky, sleep=waits.append)("p") == "113" and waits == [1.5, 3.0]
    assert U.with_retry(lambda p: 1 / 0, 2, sleep=waits.append)("p").startswith("ERROR:")
    rows = spark.createDataFrame([("a",)], "prompt string")
    assert U.ask(rows, lambda p: p + "!").first()["raw_response"] == "a!"


def test_files(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_bytes("điều\n".encode() + b"\xff5")
    (tmp_path / "md" / "b.txt").write_text("x")
    assert [tuple(r) for r in R.markdown(spark, str(tmp_path / "md"), lenient=True).collect()] == [("a.md", "điều\n5")]
    assert R.markdown(spark, str(tmp_path / "md")).count() == 1
    for name, data in (("one", {"a": 1}), ("many", [{"a": 1}, {"a": 2}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1))
    assert [R.json_documents(spark, str(tmp_path / f"{n}.json"), "a int").count() for n in ("one", "many")] == [1, 2]
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\nbad\n{"a":2}\n')
    rows = R.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").cache()
    assert rows.where("_corrupt is not null").count() == 1 and R.json_lines(spark, str(tmp_path / "l.jsonl"), "a int", "drop").count() == 2
    (tmp_path / "t.csv").write_text('title\n"Luật, A"\n\nLuật B\nLuật B\n')
    assert [r[0] for r in R.titles(spark, str(tmp_path / "t.csv")).collect()] == ["Luật, A", "Luật B", "Luật B"]
    assert [r[0] for r in R.titles_by_place(spark, str(tmp_path / "t.csv")).collect()] == ["Luật, A", "Luật B"]
    R.write_json_array(spark.createDataFrame([(2, "é"), (1, "a")], "i int, t string"), str(tmp_path / "o"), ["i"])
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))) == [{"i": 1, "t": "a"}, {"i": 2, "t": "é"}]


def test_pdf_and_fetch(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    span = {"page": 1, "block_idx": 0, "block_type": 0, "block_y0": 0.0, "line_idx": 0, "line_x0": 0.0, "line_y0": 0.0, "span_idx": 0, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "text": "t", "font": "F", "size": 9.0}
    assert R.pdf_spans(spark, str(tmp_path), lambda b: [span]).first()["text"] == "t"
    assert R.fetch(spark.createDataFrame([("u",)], "url string"), lambda u: ("<p>", None)).first()["html"] == "<p>"


def test_files_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([("a.pdf", b"xy"), ("b.pdf", None)], "n string, c binary")
    assert [tuple(r) for r in R.write_files(df, str(tmp_path / "out"), "n", "c").collect()] == [("a.pdf", 2)]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.pdf"]


# ---- models ---------------------------------------------------------------------------------------------------------
def test_crf_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    crf, e = M.Crf(rng.normal(size=3), rng.normal(size=3), rng.normal(size=(3, 3)), pad=None), rng.normal(size=(5, 3))
    paths = list(itertools.product(range(3), repeat=5))
    scores = np.array([crf.path_score(e, list(p)) for p in paths])
    assert crf.decode(e) == list(paths[int(scores.argmax())]) and crf.log_partition(e) == pytest.approx(np.log(np.exp(scores).sum()))
    p, pairs = crf.marginals(e)
    assert p.sum(1) == pytest.approx(np.ones(5)) and pairs.sum() == pytest.approx(4) and crf.loss(e, [0] * 5) > 0


def test_sizes_of_models():
    v, c = 50, 40
    assert M.parameters(M.new_bundle(v, c, 16, 6)) == 210_558 + 96 * v + 32 * c
    assert M.parameters(M.new_bundle(v, c, 26, 7, feat_dim=32, filters=32, widths=(3, 5), word_dim=96)) == 233_254 + 96 * v + 32 * c


def test_padding_does_not_change_scores(tmp_path):
    rng = np.random.default_rng(1)
    b = M.new_bundle(20, 15, 16, 6, hidden=8)
    words, chars, feats = rng.integers(1, 20, (2, 4)), rng.integers(1, 15, (2, 4, 6)), rng.normal(size=(2, 4, 16))
    both = M.token_emissions(b, words, chars, feats, np.array([4, 2]))
    alone = M.token_emissions(b, words[1:, :2], chars[1:, :2], feats[1:, :2], np.array([2]))
    assert both[1, :2] == pytest.approx(alone[0])
    M.save_bundle(b, {"x": 1}, str(tmp_path))
    again, config = M.load_bundle(str(tmp_path))
    assert config == {"x": 1} and M.token_emissions(again, words, chars, feats, np.array([4, 2])) == pytest.approx(both)
    g = M.new_bundle(20, 15, 70, 7, word_dim=40, char_dim=12, filters=24, feat_dim=16, hidden=40, widths=(3, 5), gates=3)
    assert M.line_emissions(g, rng.integers(0, 20, (1, 3, 5)), rng.integers(0, 15, (1, 3, 9)), rng.normal(size=(1, 3, 70)), np.array([3])).shape == (1, 3, 7)


def test_model_in_batches(spark):
    b = M.new_bundle(20, 15, 16, 6, hidden=8)
    rows = [("a", [3, 4], [[1] * 24] * 2, [[0.0] * 16] * 2), ("e", [], [], [])]
    df = spark.createDataFrame(rows, "k string, word_ids array<int>, char_ids array<array<int>>, features array<array<double>>")
    got = {r["k"]: r for r in M.label_tokens(df, "k", b, B.TAGS).collect()}
    assert len(got["a"]["tags"]) == 2 and got["e"]["tags"] == []


def test_errors_and_counts(spark):
    span = "k int, label string, first int, last int"
    gold, found = spark.createDataFrame([(1, "LAW", 0, 1), (2, "LAW", 0, 0)], span), spark.createDataFrame([(1, "LAW", 0, 1), (3, "ART", 1, 1)], span)
    assert [r["k"] for r in M.errors(gold, found, "k").collect()] == [2, 3]
    assert V.sample_counts(spark.createDataFrame([(["O"],), (["O", "B-LAW"],)], "tags array<string>")).first() == (1, 1)
