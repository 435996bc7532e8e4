"""The lookaheads before slow patterns leave out nothing, whatever the case; citations are found once."""

from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T

_TEXTS = [
    "Căn cứ điều 5 luật đất đai; ÁP DỤNG khoản 2 ĐIỀU 7, điểm a Khoản 3 điều 9 BLHS năm 2015", "theo quy định tại Điều 3; QUY ĐỊNH TẠI điều 4; Phù hợp với quy định tại điều 1",
    "VI PHẠM quy định tại Điều 8; vı phạm quy định tại Điều 8; vİ PHẠM quy định tại Điều 8; ĐƯỢC quy định tại điều 2; TẠI điều 6; CÁC điều 1, 2; cá điều 3", "Khoản 2 điều 5 KHOẢN 7",
    "BỘ LUẬT số 1 abc. Luật số 2; NGHỊ QUYẾT 3. nghị định 4. Thông tư 5. pháp lệnh 6. ÁN LỆ 7. luật x", "khoản5 điểm 7 ĐIỀU9 đê5 Đê 7 abcđiều5",
    "Licensed under MIT. THIS WORK IS LICENSED under a b; released under c d. All rights reserved, re al th li", "", None,
]


def test_lookaheads_leave_out_nothing(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(_TEXTS)], "k int, t string")
    for pack, least in ((P.LEGAL_VI, 15), (P.LICENSE_EN, 4)):
        whole, quick = (F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (pack.citation, pack.quick_citation))
        got = docs.select("k", whole.alias("whole"), quick.alias("quick")).collect()
        assert all(r["whole"] == r["quick"] for r in got) and sum(len(r["whole"] or []) for r in got) >= least
    plain = F.regexp_replace(F.regexp_replace("t", r"(?iuU)\b(điều|khoản|điểm)\s*(?=\p{Nd})", "$1 "), r"(?iuU)\bđê\s*(?=\p{Nd})", "Điều ")
    rest = F.regexp_replace(plain, rf"(?iuU);\s*((?:của|thuộc|theo)\s+(?={P.LAW_START}\b))", " $1")
    got = docs.select(T.strip(rest).alias("a"), T.normalize_legal(F.regexp_replace("t", P.SPACE, " "), unicode_form=False).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_citations_are_numbered_from_one_pass(spark):
    from lawmill.plans.whole_tables import law_entries

    plan = law_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
