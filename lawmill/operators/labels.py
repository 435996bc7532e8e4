"""Labels: model output parsing, rule labels, resolution, resuming, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawmill.functions import patterns as P
from lawmill.functions import text as T

CITATION = "array<struct<articles:array<string>,law:string>>"
INVALID = "[INVALID_RANGE]"
CONFIDENCE = ["low", "medium", "high"]


def parse_citations(raw: Column, tokens: Column) -> Column:
    """[PRS-1] All lines "ART: 1,2 | LAW: a-b" as (articles, law); a-b counts tokens from 1 and includes both ends."""
    form = r"^ART:\s*(.*?)\s*\|\s*LAW:\s*(\p{Nd}+)-(\p{Nd}+)\s*$"
    rows = F.filter(F.split(T.strip(T.safe_text(raw)), P.LINE_END), lambda x: x.rlike(form))

    def one(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, form, k)
        low, high = F.try_to_number(part(2), F.lit("9999999999")), F.try_to_number(part(3), F.lit("9999999999"))
        numbers = F.filter(F.transform(F.split(part(1), ","), lambda a: F.trim(a)), lambda a: a.rlike(r"^\p{Nd}+$"))
        inside = (low >= 1) & (low <= high) & (high <= F.size(tokens))
        start, size = F.when(inside, low).otherwise(1).cast("int"), F.when(inside, high - low + 1).otherwise(0).cast("int")
        law = F.when(inside, F.array_join(F.slice(tokens, start, size), " ")).otherwise(F.lit(INVALID))
        return F.struct(numbers.alias("articles"), law.alias("law"))

    return F.transform(rows, one)


def parse_first(raw: Column) -> Column:
    """[PRS-2] The first ART list, unchecked, and the first LAW range with a <= b, else null."""
    arts = T.strip(F.regexp_extract(T.safe_text(raw), r"(?i)ART:\s*([^|]+)", 1))
    articles = F.filter(F.split(arts, r"[,\s]+"), lambda x: x != "")
    low, high = (F.regexp_extract(T.safe_text(raw), r"(?i)LAW:\s*([0-9]+)\s*-\s*([0-9]+)", k) for k in (1, 2))
    a, b = F.when(low != "", low).cast("int"), F.when(high != "", high).cast("int")
    return F.struct(articles.alias("articles"), F.when(a <= b, F.struct(a.alias("first"), b.alias("last"))).alias("law"))


def parse_marker(raw: Column) -> Column:
    """[PRS-3] Three digits anywhere: label, marker, confidence; 0, none, low without them; label 0 has no marker."""
    form = "([0-1])([0-5])([1-3])"
    digit = lambda k: F.regexp_extract(T.safe_text(raw), form, k)
    hit = digit(1) != ""
    label = F.when(hit, digit(1).cast("int")).otherwise(0)
    kinds = F.array(*map(F.lit, ["none", *P.MARKERS]))
    levels = F.array(*map(F.lit, CONFIDENCE))
    marker = F.when(label == 1, F.get(kinds, digit(2).cast("int"))).otherwise(F.lit("none"))
    level = F.when(hit, F.get(levels, digit(3).cast("int") - 1)).otherwise(F.lit("low"))
    return F.struct(label.alias("label"), marker.alias("marker_type"), level.alias("confidence"))


def lenient_json(raw: Column) -> Column:
    """[PRS-4] A VARIANT from the text, else from what its outermost braces hold, else null."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))


def confidence_rank(c: Column) -> Column:
    """[AGG-5] high 3, medium 2, low 1, else 0."""
    x = F.lower(c)
    return F.when(x == "high", 3).when(x == "medium", 2).when(x == "low", 1).otherwise(0)


# ---- fixed values: phrases that settle a label --------------------------------------------------------------------
_STRONG = {
    "preamble": ["NHÂN DANH", "NHAN DANH", "NƯỚC CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"],
    "noi_dung_vu_an": ["NỘI DUNG VỤ ÁN", "NOI DUNG VU AN", "NỘI DUNG BẢN ÁN", "NOI DUNG BAN AN"],
    "dai_dien_vks": ["ĐẠI DIỆN VIỆN KIỂM SÁT", "DAI DIEN VIEN KIEM SAT", "ĐẠI DIỆN VKS"],
    "nhan_dinh": ["NHẬN ĐỊNH CỦA TÒA ÁN", "NHAN DINH CUA TOA AN", "NHẬN ĐỊNH CỦA HỘI ĐỒNG XÉT XỬ", "HĐXX NHẬN ĐỊNH"],
    "quyet_dinh": ["QUYẾT ĐỊNH", "QUYET DINH"],
}
_TURNS = ["VÌ CÁC LẼ TRÊN", "VI CAC LE TREN"]


def rule_label(line: Column, expected: Column, kind: Column) -> Column:
    """[PRS-5] (label, marker_type, confidence, reason) or null where no rule decides."""
    x = T.collapse(T.safe_text(line))
    up = F.upper(x)
    has = lambda words: F.array_contains(F.array(*(F.contains(up, F.lit(w)) for w in words)), True)
    strong = F.lit(False)
    for marker, phrases in _STRONG.items():
        strong |= (expected == marker) & has(phrases)
    turn = (expected == "quyet_dinh") & (has(_TURNS) | up.rlike(r"(?iuU)^\s*TUY[ÊE]N\s+XỬ"))
    make = lambda label, marker, level, reason: F.struct(F.lit(label).alias("label"), marker.alias("marker_type"), F.lit(level).alias("confidence"), F.lit(reason).alias("reason"))
    return (
        F.when(strong & T.looks_title_like(x), make(1, expected, "high", "rule_strong_marker"))
        .when(turn, make(1, expected, "medium", "rule_decision_transition"))
        .when(kind == "random_negative", make(0, F.lit("none"), "high", "rule_random_negative"))
    )


def flatten_candidates(docs: DataFrame) -> DataFrame:
    """[PRJ-3] One row a candidate; file_name and path of the document where the candidate has none."""
    c = docs.select("file_name", "path", F.explode("candidates").alias("c"))
    names = [f.name for f in c.schema["c"].dataType.fields]
    rest = [F.col(f"c.{n}") for n in names if n not in ("file_name", "path")]
    own = lambda n: F.coalesce(F.col(f"c.{n}"), F.col(n)).alias(n) if n in names else F.col(n)
    return c.select(own("file_name"), own("path"), *rest)


def resolve(labels: DataFrame, keys: list[str], value: str, confidence: str, order: str) -> DataFrame:
    """[AGG-5, FLT-13] One value a key: the most confident, the last in order among equals."""
    rows = labels
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rank = F.struct(confidence_rank(F.coalesce(F.col(confidence), F.lit(""))), F.col(order))
    return rows.groupBy(*keys).agg(F.max_by(value, rank).alias(value), F.max_by(confidence, rank).alias(confidence))


def first_of(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """[AGG-6] The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return entries.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def attach(lines: DataFrame, resolved: DataFrame, keys: list[str], tag: str = "tag", require: bool = False) -> DataFrame:
    """[JON-3, JON-4, FLT-14] Lines with their tag, "O" without; require keeps documents that have a labelled line."""
    if require:
        lines = lines.join(lines.join(resolved, keys, "left_semi").select(keys[0]).distinct(), keys[0], "left_semi")
    return lines.join(resolved.select(*keys, tag), keys, "left").withColumn(tag, F.coalesce(tag, F.lit("O")))


def pending(candidates: DataFrame, done: DataFrame, keys: list[str], ok: Column | None = None) -> DataFrame:
    """[JON-2, STR-2] Candidates not yet done; a row that only failed before is pending again."""
    finished = done if ok is None else done.where(ok)
    return candidates.join(finished.select(*keys).distinct(), keys, "left_anti")


def render(template: str, fields: list[str]) -> Column:
    """[PRJ-5] The template with {field} replaced by columns; nulls are empty."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        if name not in fields:
            raise KeyError(name)
        parts += [F.lit(before), T.safe_text(F.col(name).cast("string"))]
    return F.concat(*parts, F.lit(rest))


#: ---- fixed values: what is kept of a candidate beside its label
INPUT_KEYS = ["file_name", "candidate_id", "line_index", "candidate_line", "previous_1", "next_1"]


def input_json(rows: DataFrame) -> Column:
    """[PRJ-7] The candidate's own columns as a JSON object; columns it lacks are null."""
    return F.to_json(F.struct(*(F.col(k) if k in rows.columns else F.lit(None).cast("string").alias(k) for k in INPUT_KEYS)), {"ignoreNullFields": "false"})


def ordered_outputs(rows: DataFrame) -> DataFrame:
    """[SRT-9] Results by file, line and candidate."""
    return rows.orderBy("file_name", "line_index", "candidate_id")
