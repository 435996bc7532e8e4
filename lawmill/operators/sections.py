"""Section markers: lines, context, candidates, line features, ordered selection, slicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawmill.functions import patterns as P
from lawmill.functions import text as T

#: Share of the lines at which a section starts when its marker is missing.
STARTS = {"noi_dung_vu_an": 0.15, "dai_dien_vks": 0.48, "nhan_dinh": 0.58, "quyet_dinh": 0.78}


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def line_rows(docs: DataFrame, name: str = "file_name", text: str = "text", unicode_form: bool = True, around: int = 0) -> DataFrame:
    """[SCL-5, SCL-7, FLT-3] (name, line_index, line, n_lines): non-empty lines counted from 0.

    around also gives so many lines before and after, previous_<k> and next_<k>, null beyond the ends; they come from the document's own
    array, so what looks at neighbours needs no window.
    """
    made = docs.select(name, T.lines(F.col(text), unicode_form).alias("line"))
    n = F.size("line")
    gap = lambda k: F.array_repeat(F.lit(None).cast("string"), F.least(n, F.lit(k)))
    kept = lambda k: F.greatest(n - k, F.lit(0))
    moved = {f"previous_{k}": F.concat(gap(k), F.slice("line", F.lit(1), kept(k))) for k in range(around, 0, -1)}
    moved |= {f"next_{k}": F.concat(F.slice("line", F.lit(k + 1), kept(k)), gap(k)) for k in range(1, around + 1)}
    # a bare array would be tested for emptiness below the step that makes it, which makes it twice; zipped it is not. The number of
    # lines is taken before, so that no row carries its document's whole array along
    each = made.withColumns(moved | {"n_lines": n}).select(name, "n_lines", F.posexplode(F.arrays_zip("line", *moved)).alias("line_index", "z"))
    return each.select(name, "n_lines", "line_index", "z.line", *(f"z.{c}" for c in moved))


def position(index: Column, total: Column) -> Column:
    """[WIN-2]"""
    return index / F.greatest(F.lit(1), total - 1)


def with_context(rows: DataFrame, name: str = "file_name") -> DataFrame:
    """[WIN-1, WIN-2] Two lines before and after, "" at the ends, and the position. Rows of line_rows(around=2) need no window."""
    sides = ["previous_2", "previous_1", "next_1", "next_2"]
    if set(sides) <= set(rows.columns):
        return rows.withColumns({c: T.safe_text(F.col(c)) for c in sides} | {"position_ratio": position(F.col("line_index"), F.col("n_lines"))})
    w = Window.partitionBy(name).orderBy("line_index")
    near = {"previous_2": F.lag("line", 2, "").over(w), "previous_1": F.lag("line", 1, "").over(w), "next_1": F.lead("line", 1, "").over(w), "next_2": F.lead("line", 2, "").over(w)}
    return rows.withColumns(near | {"position_ratio": position(F.col("line_index"), F.col("n_lines"))})


def strength(line: Column, marker: str) -> Column:
    """[SCL-27]"""
    up = F.upper(line)
    caps = T.upper_count(line) >= F.greatest(F.lit(3), F.floor(T.letter_count(line) * F.lit(0.6)))
    names = {"preamble": ("NHÂN DANH", "NHAN DANH"), "quyet_dinh": ("QUYẾT ĐỊNH", "QUYET DINH")}.get(marker, ())
    score = F.lit(1.0) + flag(F.length(line) <= 100) + F.lit(0.7) * flag(line.startswith("#") | line.rlike(P.HEADING_NUMBER)) + F.lit(0.7) * flag(caps)
    named = F.lit(False)
    for x in names:
        named |= F.contains(up, F.lit(x))
    return score + flag(named)


def candidates(rows: DataFrame, name: str = "file_name", pack: P.Pack = P.LEGAL_VI, negatives: int = 16, seed: int = 42, exact_seed: bool = False) -> DataFrame:
    """[SEM-3, PRJ-2, SRT-1] Marker candidates of lines: matches, look-alikes, and some lines that are neither.

    Negatives are the `negatives` lines of a document with the smallest hash of (name, index, seed), or with exact_seed
    the ones that a seeded shuffle of the standard generator picks. Only lines that are neither are ranked.
    """
    line = F.col("line")
    hits = F.array_compact(F.array(*(F.when(line.rlike(pack.markers[m]), F.struct(F.lit(m).alias("m"), F.lit("regex").alias("k"), strength(line, m).alias("s"))) for m in P.MARKERS)))
    hard = F.array(F.struct(F.lit("none").alias("m"), F.lit("hard_negative").alias("k"), F.lit(0.2).alias("s")))
    marked = with_context(rows, name).withColumn("c", hits)
    marked = marked.withColumn("c", F.when(F.size("c") > 0, F.col("c")).when(line.rlike(pack.hard), hard).otherwise(F.col("c")))
    plain = F.array(F.struct(F.lit("none").alias("m"), F.lit("random_negative").alias("k"), F.lit(0.0).alias("s")))
    if exact_seed:
        free = shuffled(marked.where(F.size("c") == 0), name, negatives, seed).withColumn("c", plain)
        kept = marked.where(F.size("c") > 0).unionByName(free)
    else:
        # one pass: lines that are neither are ranked among themselves, in a window that matched lines pass through
        w = Window.partitionBy(name, "__free").orderBy(F.when(F.col("__free"), draw(F.col(name), F.col("line_index"), seed)))
        ranked = marked.withColumn("__free", F.size("c") == 0).withColumn("__r", F.row_number().over(w))
        kept = ranked.where(~F.col("__free") | (F.col("__r") <= negatives)).withColumn("c", F.when(F.col("__free"), plain).otherwise(F.col("c")))
    every = kept.withColumn("c", F.explode("c"))
    ident = F.concat_ws(":", F.col(name).cast("string"), "line_index", "c.m", "c.k")
    return every.select(
        name, ident.alias("candidate_id"), "line_index", F.col("c.m").alias("expected_marker_type"), F.col("c.k").alias("candidate_kind"),
        F.col("line").alias("candidate_line"), "previous_2", "previous_1", "next_1", "next_2", "position_ratio", F.col("c.s").alias("regex_score"),
    )


def draw(name: Column, index: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", name.cast("string"), index.cast("string"), F.lit(str(seed))).cast("binary"))


def shuffled(rows: DataFrame, name: str, k: int, seed: int) -> DataFrame:
    """[SMP-1] k rows of each name by the standard generator, seeded with seed plus the code points of the name."""
    import random

    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(pdf["line_index"].tolist())
        random.Random(seed + sum(map(ord, str(pdf[name].iloc[0])))).shuffle(order)
        return pdf[["line_index", name]][pdf["line_index"].isin(order[: max(0, k)])]

    kind = f"line_index {rows.schema['line_index'].dataType.simpleString()}, `{name}` {rows.schema[name].dataType.simpleString()}"
    return rows.join(rows.select("line_index", name).groupBy(name).applyInPandas(pick, kind), [name, "line_index"], "left_semi")


# ---- fixed values: words of the keyword features ------------------------------------------------------------------
_KEYS = {
    "kw_preamble": ["nhân danh", "nhan danh"],
    "kw_noi_dung": ["nội dung", "noi dung", "theo các tài liệu"],
    "kw_vks": ["viện kiểm sát", "vks", "kiểm sát viên"],
    "kw_nhan_dinh": ["nhận định", "nhan dinh", "hđxx"],
    "kw_quyet_dinh": ["quyết định", "quyet dinh", "tuyên xử", "vì các lẽ trên"],
}
#: accented, plain
_TOPICS = {
    "kw_toa_an": ("tòa án", "toa an"), "kw_hdxx": ("hđxx", "hoi dong xet xu"), "kw_bi_cao": ("bị cáo", "bi cao"),
    "kw_nguyen_don": ("nguyên đơn", "nguyen don"), "kw_khang_cao": ("kháng cáo", "khang cao"), "kw_xet_xu": ("xét xử", "xet xu"),
    "kw_can_cu": ("căn cứ", "can cu"), "kw_luat": ("luật", "bo luat"), "negative_luat_su": ("luật sư", "luat su"),
}
_LONG = {"negative_quyet_dinh_in_sentence": ("quyết định", "quyet dinh", 120), "negative_nhan_dinh_in_sentence": ("nhận định", "nhan dinh", 120), "negative_vks_in_sentence": ("viện kiểm sát", "vien kiem sat", 160)}
_PLAIN = {
    "preamble": ["nhan danh", "nuoc cong hoa xa hoi chu nghia viet nam"],
    "noi_dung_vu_an": ["noi dung vu an", "noi dung ban an", "theo cac tai lieu", "qua trinh dieu tra"],
    "dai_dien_vks": ["dai dien vien kiem sat", "kiem sat vien", "vien kiem sat", " vks"],
    "nhan_dinh": ["nhan dinh cua toa an", "nhan dinh cua hoi dong xet xu", "hdxx nhan dinh"],
    "quyet_dinh": ["quyet dinh", "vi cac le tren", "tuyen xu"],
}
_BUCKETS = [(0.05, "00_05"), (0.15, "05_15"), (0.35, "15_35"), (0.60, "35_60"), (0.80, "60_80")]


def _has(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(c, F.lit(w))
    return out


def _shares(x: Column, pos: Column, ratio: Column, m: Column) -> dict[str, Column]:
    """m: T.measures(x)."""
    n = F.length(x)
    return {
        "pos_ratio": pos, "pos_from_end": 1.0 - pos,
        "log_chars": F.least(F.lit(1.0), F.log1p(n) / 7.0), "log_words": F.least(F.lit(1.0), F.log1p(m["tokens"]) / 5.0),
        "upper_ratio": ratio, "digit_ratio": m["digits"] / F.greatest(F.lit(1), n),
        "punct_ratio": m["marks"] / F.greatest(F.lit(1), n),
    }


def _ratio(m: Column) -> Column:
    """T.upper_ratio of a line from its measures."""
    return m["capitals"] / F.greatest(m["letters"], F.lit(1))


def _near(pos: Column) -> dict[str, Column]:
    return {"near_top": flag(pos <= F.lit(0.2)), "near_middle": flag((pos > F.lit(0.2)) & (pos < F.lit(0.78))), "near_late": flag(pos >= F.lit(0.45))}


def marker_flags(x: Column, pack: P.Pack) -> dict[str, Column]:
    """[SCL-28]"""
    return {f"regex_{m}": flag(x.rlike(pack.markers[m])) for m in P.MARKERS}


def features(rows: DataFrame, pack: P.Pack = P.LEGAL_VI) -> DataFrame:
    """[FEA-2] Rows (…, line, line_index, n_lines) with the 26 line features as columns."""
    x, pos = F.col("line"), position(F.col("line_index"), F.col("n_lines"))
    # what several features share is worked out in a step of its own
    low, m, ratio = F.col("__low"), F.col("__m"), _ratio(F.col("__m"))
    return rows.withColumns({"__low": F.lower(x), "__m": T.measures(x)}).withColumns(
        _shares(x, pos, ratio, m)
        | {"has_colon": flag(F.contains(x, F.lit(":"))), "starts_hash": flag(x.startswith("#")), "starts_number": flag(x.rlike(P.HEADING_NUMBER))}
        | {"is_short": flag(F.length(x) <= 100), "title_like": T.title_like(x, ratio=ratio), "all_caps": flag(ratio >= F.lit(0.6))}
        | marker_flags(x, pack)
        | {k: flag(_has(low, words)) for k, words in _KEYS.items()}
        | _near(pos)
    ).drop("__low", "__m")


def wide_features(rows: DataFrame, name: str = "file_name", pack: P.Pack = P.LEGAL_VI, plain: Column | None = None) -> DataFrame:
    """[FEA-3, WIN-3] The 59 base and 11 context features. plain: the line without accents, made here if not given.

    Rows of line_rows(around=1) have their neighbours beside them, and nothing is shuffled.
    """
    x, pos, n = F.col("line"), position(F.col("line_index"), F.col("n_lines")), F.length(F.col("line"))
    rows = rows.withColumns({"__z": F.concat(F.lit(" "), T.plain_line(x) if plain is None else plain), "__low": F.lower(x), "__m": T.measures(x)})
    low, z, m, ratio = F.col("__low"), F.col("__z"), F.col("__m"), _ratio(F.col("__m"))
    plain_flags = {m: _has(z, words) for m, words in _PLAIN.items()}
    any_plain = F.lit(False)
    for c in plain_flags.values():
        any_plain |= c
    cuts = [(None, _BUCKETS[0][0]), *((a[0], b[0]) for a, b in zip(_BUCKETS, _BUCKETS[1:], strict=False)), (_BUCKETS[-1][0], None)]
    inside = lambda a, b: (F.lit(True) if a is None else pos > F.lit(a)) & (F.lit(True) if b is None else pos <= F.lit(b))
    buckets = {f"pos_bucket_{label}": flag(inside(a, b)) for (a, b), label in zip(cuts, [*(b[1] for b in _BUCKETS), "80_100"], strict=True)}
    marks = {"has_colon": ":", "has_semicolon": ";", "has_period": ".", "has_comma": ","}
    starts = {"starts_number": r"^\s*\p{Nd}+[.)-]", "starts_roman": r"(?i)^\s*[IVX]+[.)-]", "starts_bracket_number": r"^\s*\[?\p{Nd}+(?:\.\p{Nd}+)*\]"}
    keyed = zip(_KEYS.items(), P.MARKERS, strict=True)
    out = rows.withColumns(
        _shares(x, pos, ratio, m) | buckets
        | {"space_ratio": F.length(F.regexp_replace(x, r"(?U)\S+", "")) / F.greatest(F.lit(1), n)}
        | {k: flag(F.contains(x, F.lit(m))) for k, m in marks.items()}
        | {"starts_hash": flag(x.startswith("#"))} | {k: flag(x.rlike(p)) for k, p in starts.items()}
        | {f"is_short_{k}": flag(n <= k) for k in (40, 80, 120)}
        | {"title_like": T.title_like(x, ratio=ratio), "all_caps": flag(ratio >= F.lit(0.6)), "mostly_lower": flag((ratio <= F.lit(0.12)) & (n > 30))}
        | marker_flags(x, pack)
    )
    any_regex = F.greatest(*(F.col(f"regex_{m}") for m in P.MARKERS))
    out = out.withColumns(
        {"regex_any": any_regex}
        | {k: flag(_has(low, words) | plain_flags[m]) for (k, words), m in keyed}
        | {k: flag(F.contains(low, F.lit(a)) | F.contains(z, F.lit(b)) | (F.contains(z, F.lit(" luat")) if k == "kw_luat" else F.lit(False))) for k, (a, b) in _TOPICS.items()}
        | {k: flag((F.contains(low, F.lit(a)) | F.contains(z, F.lit(b))) & (n > size)) for k, (a, b, size) in _LONG.items()}
        | {"line_is_empty_like": flag(n <= 2), "has_markdown_table": flag(x.rlike(r"\|.*\|")), "has_ocr_noise": flag(F.regexp_count(x, F.lit(r"(?U)[^\p{L}\p{N}_\s.,;:()/-]")) >= 3)}
        | {"accentless_marker_hit": flag(any_plain)} | _near(pos) | {"near_end": flag(pos >= F.lit(0.72))}
    )
    out = out.drop("__z", "__low", "__m")
    return context_beside(out, pack) if {"previous_1", "next_1"} <= set(out.columns) else context_features(out, name)


def context_beside(rows: DataFrame, pack: P.Pack = P.LEGAL_VI) -> DataFrame:
    """[WIN-3] The same as context_features for rows of line_rows(around=1), from the neighbouring lines themselves."""
    sides = [("prev", F.col("previous_1")), ("next", F.col("next_1"))]
    flags = {f"__{side}_{k}": f for side, x in sides for k, f in marker_flags(x, pack).items()}
    near = {}
    for side, x in sides:
        near[f"{side}_regex_any"] = F.greatest(*(F.col(f"__{side}_regex_{m}") for m in P.MARKERS))
        near[f"{side}_title_like"] = T.title_like(x)
        near[f"{side}_blank_like"] = F.when(x.isNull(), 1.0).otherwise(flag(x == ""))
    wide = {f"window_regex_{m}": F.greatest(F.col(f"regex_{m}"), *(F.col(f"__{side}_regex_{m}") * F.lit(0.65) for side, _ in sides)) for m in P.MARKERS}
    return rows.withColumns(flags).withColumns(near | wide).drop(*flags)


def context_features(rows: DataFrame, name: str = "file_name") -> DataFrame:
    """[WIN-3] Neighbours' flags and the decayed maximum over three lines; blank-like is 1 beyond the ends."""
    w = Window.partitionBy(name).orderBy("line_index")
    any_regex = F.greatest(*(F.col(f"regex_{m}") for m in P.MARKERS))
    blank = flag(F.col("line") == "")
    near = {f"{side}_{what}": f(c, 1, end).over(w) for side, f in (("prev", F.lag), ("next", F.lead)) for what, c, end in (("regex_any", any_regex, 0.0), ("title_like", F.col("title_like"), 0.0), ("blank_like", blank, 1.0))}
    wide = {f"window_regex_{m}": F.greatest(F.col(f"regex_{m}"), F.lag(f"regex_{m}", 1, 0.0).over(w) * F.lit(0.65), F.lead(f"regex_{m}", 1, 0.0).over(w) * F.lit(0.65)) for m in P.MARKERS}
    return rows.withColumns(near | wide)


# ---- fixed values: prior of a marker inside and outside a range of positions --------------------------------------
_PRIORS = {"preamble": (None, 0.2, 0.45, -0.3), "noi_dung_vu_an": (0.02, 0.45, 0.25, -0.1), "dai_dien_vks": (0.15, 0.75, 0.15, -0.05), "nhan_dinh": (0.25, 0.88, 0.25, -0.15), "quyet_dinh": (0.45, None, 0.45, -0.3)}


def position_prior(marker: str, pos: Column) -> Column:
    """[SCL-32]"""
    low, high, inside, outside = _PRIORS[marker]
    ok = F.lit(True)
    if low is not None:
        ok &= pos >= F.lit(low)
    if high is not None:
        ok &= pos <= F.lit(high)
    return F.when(ok, F.lit(inside)).otherwise(F.lit(outside))


def choose_markers(rows: DataFrame, name: str = "file_name", pack: P.Pack = P.LEGAL_VI, threshold: float = 0.45) -> DataFrame:
    """[SEM-10, FLT-18, WIN-8, SRT-6] (name, n_lines, selected, warnings) from rows with line, tag and prob_<marker>.

    Five chained choices on the document's candidates: the best score after the marker before, near ones first. The
    opening is sought in the first 18 % (or 30 lines) and the decision from 45 % on, where there is any.
    """
    line, pos = F.col("line"), position(F.col("line_index"), F.col("n_lines"))
    scored = rows
    for m in P.MARKERS:
        hit, mine = line.rlike(pack.markers[m]), F.col("tag") == m
        score = F.col(f"prob_{m}") + F.lit(0.75) * flag(mine) + F.lit(0.55) * flag(hit) + position_prior(m, pos)
        item = F.struct("line_index", F.lit(m).alias("marker_type"), "line", score.alias("score"), F.lit("model_regex").alias("source"))
        scored = scored.withColumn(f"__{m}", F.when((score >= F.lit(threshold)) | hit | mine, item))
    docs = scored.groupBy(name).agg(F.first("n_lines").alias("n_lines"), *(F.collect_list(f"__{m}").alias(f"__{m}") for m in P.MARKERS))
    n = F.col("n_lines")
    edges = {"preamble": (F.lit(0), F.greatest(F.lit(30), F.floor(n * F.lit(0.18)))), "quyet_dinh": (F.floor(n * F.lit(0.45)), n)}
    turns = [F.struct(*(e.cast("int").alias(k) for k, e in zip(("low", "high"), edges.get(m, (F.lit(0), n)), strict=True)), F.col(f"__{m}").alias("items")) for m in P.MARKERS]

    def choose(state: Column, turn: Column) -> Column:
        """The turn's best item after the last pick, near the edge where there is any."""
        viable = F.filter(turn["items"], lambda c: c["line_index"] > state["last"])
        near = lambda v: F.filter(v, lambda c: (c["line_index"] >= turn["low"]) & (c["line_index"] <= turn["high"]))
        kept = T.let(viable, lambda v: T.let(near(v), lambda part: F.when(F.size(part) > 0, part).otherwise(v)))
        ranked = F.transform(kept, lambda c: F.struct(c["score"].alias("s"), (state["last"] - c["line_index"]).alias("d"), (-c["line_index"]).alias("i"), c.alias("c")))
        return T.let(F.array_max(ranked)["c"], lambda best: F.struct(F.coalesce(best["line_index"], state["last"]).alias("last"), F.concat(state["picks"], F.array(best)).alias("picks")))

    item = docs.schema[f"__{P.MARKERS[0]}"].dataType.simpleString()
    zero = F.struct(F.lit(-1).alias("last"), F.array().cast(item).alias("picks"))
    docs = docs.withColumn("__picks", F.aggregate(F.array(*turns), zero, choose, lambda s: s["picks"]))
    picks = F.filter("__picks", lambda c: c.isNotNull())
    warned = F.array_compact(F.array(*(F.when(F.get("__picks", F.lit(k)).isNull(), F.lit(f"missing_marker:{m}")) for k, m in enumerate(P.MARKERS))))
    return docs.select(name, "n_lines", F.map_from_entries(F.transform(picks, lambda c: F.struct(c["marker_type"], c))).alias("selected_markers"), warned.alias("warnings"))


def starts(n: Column, found: dict[str, Column]) -> tuple[Column, Column]:
    """[SEM-11] (line index of each section's start as a struct, warnings); found: indices or null."""
    at = lambda m: F.floor(n * F.lit(STARTS[m])).cast("int")
    pre = F.coalesce(found["preamble"], F.lit(0))
    body = F.coalesce(found["noi_dung_vu_an"], F.greatest(pre + 1, at("noi_dung_vu_an")))
    vks = F.coalesce(found["dai_dien_vks"], found["nhan_dinh"], F.greatest(body, at("dai_dien_vks")))
    view = F.coalesce(found["nhan_dinh"], F.greatest(vks, at("nhan_dinh")))
    end = F.coalesce(found["quyet_dinh"], F.greatest(view + 1, at("quyet_dinh")))
    good = (pre <= body) & (body <= vks) & (vks <= view) & (view <= end) & (end <= n)
    body2 = F.greatest(F.lit(1), at("noi_dung_vu_an"))
    vks2 = F.greatest(body2, at("dai_dien_vks"))
    view2 = F.greatest(vks2, at("nhan_dinh"))
    other = [F.lit(0), body2, vks2, view2, F.greatest(view2 + 1, at("quyet_dinh"))]
    idx = F.struct(*(F.when(good, a).otherwise(b).cast("int").alias(m) for m, a, b in zip(P.MARKERS, [pre, body, vks, view, end], other, strict=True)))
    names = ["fallback_start:preamble", "fallback_boundary:noi_dung_vu_an", "empty_or_missing:dai_dien_vks", "fallback_boundary:nhan_dinh", "fallback_boundary:quyet_dinh"]
    warned = [F.when(found[m].isNull(), F.lit(w)) for m, w in zip(P.MARKERS, names, strict=True)]
    return idx, F.array_compact(F.array(*warned, F.when(~good, F.lit("invalid_order_ratio_fallback"))))


def slice_sections(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """[SEM-11] docs(…, lines, <marker> index or null each) with sections and section_warnings."""
    n = F.size(lines)
    idx, warned = starts(n, {m: F.col(m) for m in P.MARKERS})
    out = docs.withColumn("__idx", idx).withColumn("section_warnings", warned)
    edges = [F.col(f"__idx.{m}") for m in P.MARKERS] + [n]
    cut = lambda a, b: T.strip(F.array_join(F.slice(lines, F.least(a, n) + 1, F.greatest(F.lit(0), F.least(b, n) - F.least(a, n))), "\n"))
    out = out.withColumn("sections", F.struct(*(cut(a, b).alias(m) for m, a, b in zip(P.MARKERS, edges, edges[1:], strict=False))))
    empty = F.array_compact(F.array(*(F.when(F.col(f"sections.{m}") == "", F.lit(f"empty_section:{m}")) for m in P.MARKERS)))
    return out.withColumn("section_warnings", F.concat("section_warnings", empty)).drop("__idx")


def predict(docs: DataFrame, rows: DataFrame, name: str = "file_name", pack: P.Pack = P.LEGAL_VI, threshold: float = 0.45, unicode_form: bool = True) -> DataFrame:
    """[SEM-12] (name, selected_markers, warnings, sections) of docs(name, text); rows has the lines' tags and scores.

    A document without lines has empty sections and the warning "empty_file".
    """
    picked = choose_markers(rows, name, pack, threshold)
    made = docs.select(name, T.lines(F.col("text"), unicode_form).alias("lines")).join(picked.drop("n_lines"), name, "left")
    for m in P.MARKERS:
        made = made.withColumn(m, F.element_at("selected_markers", m)["line_index"])
    out = slice_sections(made)
    none = F.array(F.lit("empty_file"))
    warned = F.when(F.size("lines") == 0, none).otherwise(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), "section_warnings"))
    return out.select(name, "selected_markers", warned.alias("warnings"), "sections")
