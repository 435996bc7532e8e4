"""Hand-made cases of citations, answers, labels, spans and sections."""

from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators import citations as C
from lawmill.operators import labels as L
from lawmill.operators import sections as S
from lawmill.operators import tagging as B

_VI = [
    ("a", "khoản 4 Điều 174 Bộ luật Hình sự.", ["khoản 4 Điều 174 Bộ luật Hình sự"]),
    ("b", "khoản 4 Điều 174 , điểm b, s, v khoản 1, khoản 2 Điều 51, Điều 65 của Bộ luật Hình sự.", ["khoản 4 Điều 174 , điểm b, s, v khoản 1, khoản 2 Điều 51, Điều 65 của Bộ luật Hình sự"]),
    ("c", "Điều 48 BLHS.", ["Điều 48 BLHS"]),
    ("d", "khoản 2 Điều 468 của BLDS (2015) tương ứng với số tiền", ["khoản 2 Điều 468 của BLDS (2015)"]),
    ("e", "Luật sư bào chữa cho bị cáo. Căn cứ Điều 2 Luật Thi hành án dân sự; theo quy định tại các điều 6, 7 và 9 Luật Thi hành án dân sự", ["Căn cứ Điều 2 Luật Thi hành án dân sự", "theo quy định tại các điều 6, 7 và 9 Luật Thi hành án dân sự"]),
    ("f", "khoản tiền nợ do thế chấp ngôi nhà số H T cho Ngân hàng (cả gốc và lãi khoảng hơn 5.", []),
    ("g", "Điều 48 BLHS (sửa đổi, bổ sung năm 2017) và Điều 5.", ["Điều 48 BLHS"]),
]


def test_citations(spark):
    docs = spark.createDataFrame([(n, t) for n, t, _ in _VI], "file_name string, text string")
    assert {r["file_name"]: list(r["laws_cited"]) for r in C.extract(docs).collect()} == {n: ms for n, _, ms in _VI}


_PICK = [(f"Dòng {i}", "O") for i in range(10)]
_PICK[0], _PICK[2], _PICK[4], _PICK[6], _PICK[8] = ("NHÂN DANH", "O"), ("NỘI DUNG VỤ ÁN:", "O"), ("Đại diện Viện kiểm sát", "O"), ("NHẬN ĐỊNH CỦA TÒA ÁN", "nhan_dinh"), ("QUYẾT ĐỊNH:", "quyet_dinh")


def test_section_select(spark):
    rows = spark.createDataFrame([("d", i, len(_PICK), x, t) for i, (x, t) in enumerate(_PICK)], "file_name string, line_index int, n_lines int, line string, tag string")
    rows = rows.withColumns({f"prob_{m}": F.lit(0.1) for m in P.MARKERS})
    got = S.choose_markers(rows).select(F.explode("selected_markers").alias("marker", "v")).select("marker", "v.line_index").collect()
    assert dict(map(tuple, got)) == {"preamble": 0, "noi_dung_vu_an": 2, "dai_dien_vks": 4, "nhan_dinh": 6, "quyet_dinh": 8}


_LLM = [
    ("1", "khoản 4 Điều 174 Bộ luật Hình sự.", "ART: 174 | LAW: 5-8", [("174", "Bộ luật Hình sự.")]),
    ("2", "các Điều 271, Điều 272 và Điều 273 Bộ luật tố tụng Dân sự.", "ART: 271,272,273 | LAW: 9-14", [("271,272,273", "Bộ luật tố tụng Dân sự.")]),
    ("3", "Luật Đất đai", "ART: | LAW: 1-3", [("", "Luật Đất đai")]),
    ("4", "không có", "NL", []),
    ("5", "a b c d e f g h", "ART: 10a,5 | LAW: 5-99\nART: 7 | LAW: 1-2", [("5", "[INVALID_RANGE]"), ("7", "a b")]),
]


def test_parse_citations(spark):
    df = spark.createDataFrame([(k, t, o) for k, t, o, _ in _LLM], "k string, input string, raw string")
    got = df.select("k", L.parse_citations(F.col("raw"), T.white_tokens(F.col("input"))).alias("c")).collect()
    assert {r["k"]: [(",".join(c["articles"]), c["law"]) for c in r["c"]] for r in got} == {k: rows for k, _, _, rows in _LLM}


_DIGITS = [("113", 1, "preamble", "high"), ("003", 0, "none", "high"), ("x 152 y", 1, "quyet_dinh", "medium"), ("nothing", 0, "none", "low"), ("043", 0, "none", "high"), ("", 0, "none", "low")]


def test_parse_marker(spark):
    df = spark.createDataFrame([(r[0],) for r in _DIGITS], "raw string")
    assert [tuple(r) for r in df.select("raw", L.parse_marker(F.col("raw")).alias("m")).select("raw", "m.*").collect()] == _DIGITS


_FIRST = [("ART: 1, 2 | LAW: 3-5\nART: 9 | LAW: 1-1", "1,2", 3, 5), ("ART: 10a | LAW: 5-2", "10a", None, None), ("NL", "", None, None)]


def test_parse_first(spark):
    df = spark.createDataFrame([(r[0],) for r in _FIRST], "raw string").withColumn("p", L.parse_first(F.col("raw")))
    assert [tuple(r) for r in df.select("raw", F.array_join("p.articles", ",").alias("articles"), "p.law.first", "p.law.last").collect()] == _FIRST


_RULED = [
    ("NHÂN DANH NƯỚC", "preamble", "regex", "rule_strong_marker"), ("VÌ CÁC LẼ TRÊN", "quyet_dinh", "regex", "rule_decision_transition"),
    ("gì đó", "none", "random_negative", "rule_random_negative"), ("QUYẾT ĐỊNH", "preamble", "regex", None),
]


def test_rule_labels(spark):
    df = spark.createDataFrame([r[:3] for r in _RULED], "line string, expected string, kind string")
    assert [r[0] for r in df.select(L.rule_label(F.col("line"), F.col("expected"), F.col("kind"))["reason"]).collect()] == [r[3] for r in _RULED]


_GOLD = ["B-LAW", "I-LAW", "O", "B-ART", "I-ART", "O"]
_PRED = ["O", "I-LAW", "I-LAW", "B-ART", "I-ART", "I-LAW"]
_SPANS = [("gold", "LAW", 0, 1, "a b"), ("gold", "ART", 3, 4, "d e"), ("pred", "LAW", 1, 2, "b c"), ("pred", "ART", 3, 4, "d e"), ("pred", "LAW", 5, 5, "f")]


def _tagged(spark):
    return spark.createDataFrame([(k, i, "abcdef"[i], t) for k, tags in (("gold", _GOLD), ("pred", _PRED)) for i, t in enumerate(tags)], "doc string, pos int, token string, tag string")


def test_spans_and_metrics(spark):
    found = B.spans(_tagged(spark), "doc")
    assert sorted(tuple(r) for r in found.select("doc", "label", "first", "last", "text").collect()) == sorted(_SPANS)
    side = lambda d: found.where(F.col("doc") == d).select("label", "first", "last")
    got = B.metrics(side("gold"), side("pred"), ["first", "last"]).select("label", "tp", "fp", "fn", F.round("f1", 9)).collect()
    assert sorted(map(tuple, got)) == [("ART", 1, 0, 0, 1.0), ("LAW", 0, 2, 1, 0.0), ("avg", 0, 0, 0, 0.5), ("micro", 1, 2, 1, 0.4)]


_SNIP = list(zip("Điều 5 Bộ luật Dân sự Điều 7 Luật A".split(), ["B-ART", "I-ART", "B-LAW", "I-LAW", "I-LAW", "I-LAW", "B-ART", "I-ART", "B-LAW", "I-LAW"], strict=True))


def test_law_articles(spark):
    rows = spark.createDataFrame([("x", i, w, t) for i, (w, t) in enumerate(_SNIP)], "doc string, pos int, token string, tag string")
    got = B.law_articles(rows, "doc").select("law_name", F.array_join("articles", ",")).collect()
    assert sorted(map(tuple, got)) == [("Bộ luật Dân sự", "7"), ("Luật A", "")]
