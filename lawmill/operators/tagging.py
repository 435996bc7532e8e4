"""Token tags and features: law names, articles, BIO spans, metrics, law to articles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.sources.scratch import written

TAGS = ["<PAD>", "O", "B-LAW", "I-LAW", "B-ART", "I-ART"]
# ---- fixed values: word classes of the token features -------------------------------------------------------------
_LAW_WORDS = ["luật", "bộ", "nghị", "định", "quyết", "thông", "tư", "pháp", "lệnh"]
_CASE_WORDS = ["án", "lệ"]
_LINKS = ["của", "theo", "thuộc", "và", "hoặc", "căn", "cứ", "áp", "dụng", "tại"]
_UNITS = ["điều", "khoản", "điểm"]
FEATURES = [
    "is_numberish", "is_year", "is_article_keyword", "is_clause_keyword", "is_point_keyword", "is_law_kind", "is_law_abbr", "is_connector",
    "is_punct", "inside_citation_regex", "inside_article_regex", "inside_law_regex", "gazetteer_law_begin", "gazetteer_law_inside",
    "near_article_keyword", "near_law_keyword",
]


def gazetteer(titles: DataFrame, title: str = "title", unicode_form: bool = True) -> DataFrame:
    """[SEM-4, SET-6] (phrase, n): titles of two or more words, their short forms, and the short and long names."""
    key = T.normalize_key(F.col(title), unicode_form)
    forms = [key] + [F.when(F.contains(key, F.lit(full)), F.replace(key, F.lit(full), F.lit(short))) for short, full in P.SHORT_NAMES.items()]
    made = titles.where(F.col(title).isNotNull()).select(F.explode(F.array_compact(F.array(*forms))).alias("k"))
    made = made.select(F.regexp_extract_all("k", F.lit(P.WORD), F.lit(0)).alias("w")).where(F.size("w") >= 2)
    names = F.array(*(F.split(F.lit(x), " ") for s, full in P.SHORT_NAMES.items() for x in (s, full)))
    own = titles.sparkSession.range(0, 1, 1, 1).select(F.explode(names).alias("w"))
    every = made.unionByName(own).select(F.array_join("w", " ").alias("phrase"), F.size("w").alias("n"))
    return every.dropDuplicates(["phrase"])


def token_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """[SCL-13, UDTF-1] (key, pos, token, start, end) of a normalised text, half-open code point offsets.

    Offsets are a running sum over the alternating gaps and tokens of a text, so long texts cost no more than short.
    """
    c = F.col(text)
    made = docs.select(key, T.tokens(c).alias("t"), F.transform(F.split(c, P.TOKEN, -1), F.length).alias("g"))
    rows = made.select(key, F.posexplode(F.arrays_zip(F.col("t"), F.slice("g", F.lit(1), F.size("t")).alias("g"))).alias("pos", "z"))
    rows = rows.select(key, "pos", F.col("z.t").alias("token"), F.col("z.g").alias("gap"))
    w = Window.partitionBy(key).orderBy("pos")
    end = F.sum(F.col("gap") + F.length("token")).over(w)
    return rows.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("token")).cast("int")).select(key, "pos", "token", "start", "end")


def near(rows: DataFrame, key: str, words: list[str], window: int, out: str, token: Column | None = None) -> DataFrame:
    """[JON-7, WIN-4] 1 where a keyword stands within `window` tokens."""
    c = T.clean_token(F.col("token")) if token is None else token
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(-window, window)
    return rows.withColumn(out, F.max(F.when(c.isin(words), 1).otherwise(0)).over(w))


def phrase_hits(rows: DataFrame, phrases: DataFrame, key: str, token: str = "token") -> DataFrame:
    """[JON-5] (key, pos, begin, inside): contiguous matches of phrases(phrase, n), by an equi-join on n-grams.

    N-grams are built for the lengths that occur in the dictionary only, and phrases are broadcast behind their count.
    """
    counts = {r["n"]: r["count"] for r in phrases.groupBy("n").count().collect()}
    sizes = sorted(counts)
    w = Window.partitionBy(key).orderBy("pos")
    longest = max(sizes, default=1)
    ahead = rows.select(key, "pos", F.col(token).alias("__0"), *(F.lead(token, i).over(w).alias(f"__{i}") for i in range(1, longest)))
    grams = [F.when(F.col(f"__{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *(f"__{i}" for i in range(n))).alias("phrase"))) for n in sizes]
    wide = ahead.select(key, "pos", F.explode(F.array(*grams)).alias("g")).where("g is not null") if grams else ahead.select(key, "pos", F.lit(None).cast("struct<n:int,phrase:string>").alias("g")).limit(0)
    small = F.broadcast(phrases) if sum(counts.values()) <= 200_000 else phrases
    hits = wide.select(key, "pos", "g.n", "g.phrase").join(small, ["n", "phrase"], "left_semi")
    spots = hits.select(key, F.posexplode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("i", "pos"))
    return spots.groupBy(key, "pos").agg(F.max(F.when(F.col("i") == 0, 1).otherwise(0)).alias("begin"), F.lit(1).alias("inside"))


#: Phrases are sent to the tokens up to this number.
MOST_PHRASES = 200_000


def with_phrases(rows: DataFrame, phrases: DataFrame, key: str, token: str = "token") -> DataFrame:
    """[JON-5] rows with begin and inside, null or 0 where no phrase stands: n-grams meet broadcast phrases beside their token, so rows stay
    where the window on key and pos has put them. More phrases than MOST_PHRASES take the join of phrase_hits."""
    counts = {r["n"]: r["count"] for r in phrases.groupBy("n").count().collect()}
    if sum(counts.values()) > MOST_PHRASES:
        return rows.join(phrase_hits(rows, phrases, key, token), [key, "pos"], "left")
    w, found = Window.partitionBy(key).orderBy("pos"), {}
    for n in sorted(counts):
        words = [F.col(token), *(F.lead(token, i).over(w) for i in range(1, n))]
        rows = rows.withColumn("__gram", F.when(words[-1].isNotNull(), F.concat_ws(" ", *words)))
        known = phrases.where(F.col("n") == n).select(F.col("phrase").alias("__gram"), F.lit(1).alias(f"__hit{n}")).distinct()
        rows = rows.join(F.broadcast(known), "__gram", "left").drop("__gram")
        found[n] = F.col(f"__hit{n}")
    if not found:
        return rows.withColumns({"begin": F.lit(0), "inside": F.lit(0)})
    begin = F.coalesce(*found.values())
    inside = F.coalesce(*(F.max(h).over(w.rowsBetween(1 - n, 0)) for n, h in found.items()))
    return rows.withColumns({"begin": begin, "inside": inside}).drop(*(f"__hit{n}" for n in found))


def inside_spans(start: Column, end: Column, spans: Column) -> Column:
    """[JON-6] 1 if a token overlaps a span."""
    return F.when(F.exists(spans, lambda s: (end > s["start"]) & (start < s["end"])), 1).otherwise(0)


def features(docs: DataFrame, phrases: DataFrame, key: str, text: str = "text", unicode_form: bool = True) -> DataFrame:
    """[FEA-1] (key, pos, token, start, end, the 16 features) of docs whose text is a normalised snippet."""
    spans = {name: T.match_spans(F.col(text), p) for name, p in (("cite", P.CITATION), ("art", P.ARTICLE_UNIT), ("law", P.LAW_NAME))}
    marks = docs.select(key, *(c.alias(n) for n, c in spans.items()))
    c = T.clean_token(F.col("token"))
    bit = lambda x: F.when(x, 1).otherwise(0)
    rows = token_rows(docs, key, text).withColumn("clean", c)
    rows = near(rows, key, _UNITS, 3, "near_article_keyword", F.col("clean"))
    rows = near(rows, key, _LAW_WORDS, 4, "near_law_keyword", F.col("clean"))
    # the text is in normal form already, so its tokens need no second composition
    # and a token of ASCII letters and digits is its own key
    norm = F.when(F.col("token").rlike("^[A-Za-z0-9_]+$"), F.lower("token")).otherwise(T.normalize_key(F.col("token"), False))
    rows = with_phrases(rows.withColumn("norm", norm), phrases, key, "norm").join(marks, key)
    clean = F.col("clean")
    return rows.select(
        key, "pos", "token", "start", "end",
        bit(clean.rlike(r"^\p{Nd}{1,4}[a-zA-ZđĐ]?$")).alias("is_numberish"), bit(clean.rlike(r"^(19|20)\p{Nd}{2}$")).alias("is_year"),
        bit(clean == "điều").alias("is_article_keyword"), bit(clean == "khoản").alias("is_clause_keyword"), bit(clean == "điểm").alias("is_point_keyword"),
        bit(clean.isin(_LAW_WORDS + _CASE_WORDS)).alias("is_law_kind"), bit(F.lower("token").isin(list(P.SHORT_NAMES))).alias("is_law_abbr"),
        bit(clean.isin(_LINKS)).alias("is_connector"), bit(F.col("token").rlike(r"(?U)^[^\p{L}\p{N}_\s]$")).alias("is_punct"),
        inside_spans(F.col("start"), F.col("end"), F.col("cite")).alias("inside_citation_regex"),
        inside_spans(F.col("start"), F.col("end"), F.col("art")).alias("inside_article_regex"),
        inside_spans(F.col("start"), F.col("end"), F.col("law")).alias("inside_law_regex"),
        F.coalesce("begin", F.lit(0)).alias("gazetteer_law_begin"), F.coalesce("inside", F.lit(0)).alias("gazetteer_law_inside"),
        "near_article_keyword", "near_law_keyword",
    )


# ---- BIO sequences ------------------------------------------------------------------------------------------------
def repair(rows: DataFrame, key: str, tag: str = "tag") -> DataFrame:
    """[WIN-7] I-x after anything but B-x or I-x becomes B-x. Repair never changes a label, so the raw tag before will do."""
    before = F.lag(tag, 1, "O").over(Window.partitionBy(key).orderBy("pos"))
    label = lambda c: F.when(c.startswith("B-") | c.startswith("I-"), F.substring(c, 3, 64))
    broken = F.col(tag).startswith("I-") & ~label(before).eqNullSafe(label(F.col(tag)))
    return rows.withColumn(tag, F.when(broken, F.concat(F.lit("B-"), label(F.col(tag)))).otherwise(F.col(tag)))


def spans(rows: DataFrame, key: str, tag: str = "tag") -> DataFrame:
    """[WIN-6] (key, label, first, last, text) of the entities in repaired tags; last is inclusive."""
    fixed = repair(rows, key, tag).where(F.col(tag).startswith("B-") | F.col(tag).startswith("I-"))
    island = F.sum(F.when(F.col(tag).startswith("B-"), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("pos"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    made = fixed.withColumn("n", island).groupBy(key, "n", F.substring(tag, 3, 64).alias("label"))
    return made.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), said.alias("text")).drop("n")


def entities(tags: Column, tokens: Column | None = None) -> Column:
    """[WIN-6, WIN-7] The same as spans for a text's tags in one array: array of (label, first, last and, with tokens, text) by first.

    A tag goes on with the one before if it is I-x after B-x or I-x. Entities begin where an inside tag does not go on and end where the
    next does not, so the two lists of places pair off, and nothing is shuffled or sorted.
    """
    inside = lambda t: t.startswith("B-") | t.startswith("I-")
    label = lambda t: F.when(inside(t), F.substring(t, 3, 64))

    def paired(t: Column, on: Column, tokens: Column | None) -> Column:
        first = F.array_compact(F.transform(t, lambda x, i: F.when(inside(x) & ~F.get(on, i), i)))
        last = F.array_compact(F.transform(t, lambda x, i: F.when(inside(x) & ~F.coalesce(F.get(on, i + 1), F.lit(False)), i)))
        said = lambda a, b: [] if tokens is None else [F.array_join(F.slice(tokens, a + 1, b - a + 1), " ").alias("text")]
        return F.zip_with(first, last, lambda a, b: F.struct(label(F.get(t, a)).alias("label"), a.alias("first"), b.alias("last"), *said(a, b)))

    goes_on = lambda t: F.transform(t, lambda x, i: x.startswith("I-") & label(F.get(t, i - 1)).eqNullSafe(F.substring(x, 3, 64)))
    # what lambdas look into is bound, since an optimizer that puts its definition there would work it out at each element
    of = lambda k: T.let(tags, lambda t: T.let(goes_on(t), lambda on: paired(t, on, k)))
    return of(None) if tokens is None else T.let(tokens, of)


def _marked(tags: pa.ListArray, labels: dict) -> tuple[np.ndarray, np.ndarray]:
    """(label of the entity that begins at each place of the flattened tags or -1, its last place); labels numbers the labels met so far."""
    codes, n = tags.flatten().dictionary_encode(), tags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    known = [t or "" for t in codes.dictionary.to_pylist()] + [""]
    own = np.array([labels.setdefault(t[2:66], len(labels)) if t[:2] in ("B-", "I-") else -1 for t in known])
    at = codes.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)
    label, within = own[at], np.array([t[:2] == "I-" for t in known])[at]
    before = np.concatenate([[-1], label])[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = -1
    on = within & (before == label)
    begins = (label >= 0) & ~on
    last = np.full(len(label), -1)
    last[begins] = np.flatnonzero((label >= 0) & ~np.concatenate([on[1:], [False]])[: len(on)])
    return np.where(begins, label, -1), last


def metrics_beside(docs: DataFrame, gold: str, found: str, label: str = "label") -> DataFrame:
    """[AGG-9, AGG-10, JON-13, SET-2] The same as metrics for docs with both sides' tags as arrays, a row a text: the sides are compared
    place by place in their batch, and only counts of labels are shuffled. Null tags count as none; sides of different length are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, sums = {}, np.zeros((3, 0), np.int64)
        for batch in batches:
            (g, g_last), (p, p_last) = _marked(batch.column(0), labels), _marked(batch.column(1), labels)
            sums = np.pad(sums, ((0, 0), (0, len(labels) - sums.shape[1])))
            for k, x in enumerate((g[(g == p) & (g_last == p_last)], p, g)):
                sums[k] += np.bincount(x[x >= 0], minlength=len(labels))
        tp, fp, fn = sums[0], sums[1] - sums[0], sums[2] - sums[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(labels), pa.string()), *(pa.array(x, pa.int64()) for x in (tp, fp, fn))], [label, "tp", "fp", "fn"])

    same = F.coalesce(F.size(gold) == F.size(found), F.lit(False)) | (F.col(gold).isNull() & F.col(found).isNull())
    checked = F.when(same, F.col(gold)).otherwise(F.raise_error(F.lit("gold and found tags differ in number")).cast("array<string>"))
    made = docs.select(checked.alias("gold"), F.col(found).alias("found")).mapInArrow(run, f"`{label}` string, tp long, fp long, fn long")
    counts = made.groupBy(label).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).where("tp + fp + fn > 0")
    return rates(counts, label)


def metrics(gold: DataFrame, found: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """[AGG-9, AGG-10, JON-13, SET-2] Precision, recall and F1 of each label, of all ("micro") and their mean F1 ("avg")."""
    a = gold.select(label, *keys).distinct().withColumn("g", F.lit(1))
    b = found.select(label, *keys).distinct().withColumn("p", F.lit(1))
    both = a.join(b, [label, *keys], "full_outer")
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    return rates(both.groupBy(label).agg(hit(g & p).alias("tp"), hit(p & ~g).alias("fp"), hit(g & ~p).alias("fn")), label)


def rates(counts: DataFrame, label: str = "label") -> DataFrame:
    """[AGG-9, AGG-10] Precision, recall and F1 of counts(label, tp, fp, fn), with the rows "micro" and "avg".

    The counts, a row a label, are written first: they are read for each kind of row, and a plan that repeats them would tag all texts thrice.
    """
    counts = written(counts, "label-counts")
    micro = counts.agg(F.lit("micro").alias(label), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    made = counts.unionByName(micro).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    pr = F.col("precision") + F.col("recall")
    made = made.withColumn("f1", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(F.lit(0.0)))
    zero = F.lit(0).cast("long")
    mean = made.where(F.col(label) != "micro").agg(F.lit("avg").alias(label), zero.alias("tp"), zero.alias("fp"), zero.alias("fn"), F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"))
    return made.unionByName(mean)


def law_articles(rows: DataFrame, key: str, attach: str = "preceding") -> DataFrame:
    """[SEM-9, JON-11, FLT-16] (key, first, law_name, articles): article numbers go to the law before them.

    attach="preceding" takes inside-article tokens only and drops those before the first law; "following" takes all
    article tokens and gives them to the next law, as citations are written. Laws without articles stay; filter on
    size(articles) for output.
    """
    w = Window.partitionBy(key).orderBy("pos")
    t = F.col("tag")
    begun = rows.withColumn("law", F.when(t == "B-LAW", F.col("pos")))
    # an inside tag goes on with a law only if nothing else came between
    broken = F.sum(F.when(~t.isin("B-LAW", "I-LAW"), 1).otherwise(0)).over(w)
    begun = begun.withColumn("run", broken).withColumn("last_law", F.last("law", True).over(w))
    begun = begun.withColumn("run_law", F.max("law").over(Window.partitionBy(key, "run").orderBy("pos")))
    if attach == "following":
        ahead = F.first("law", True).over(w.rowsBetween(0, Window.unboundedFollowing))
        begun = begun.withColumn("goes", ahead)
        article = t.isin("B-ART", "I-ART") & F.col("token").rlike(r"\p{Nd}")
    else:
        begun = begun.withColumn("goes", F.col("last_law"))
        article = t == "I-ART"
    name = F.collect_list(F.when((t == "B-LAW") | ((t == "I-LAW") & (F.col("run_law") == F.col("last_law"))), F.struct("pos", "token")))
    owner = F.when(article, F.col("goes")).otherwise(F.when(t.isin("B-LAW", "I-LAW"), F.col("last_law")))
    words = lambda c: F.transform(F.array_sort(c), lambda x: x["token"])
    made = begun.withColumn("first", owner).where("first is not null").groupBy(key, "first")
    return made.agg(F.array_join(words(name), " ").alias("law_name"), words(F.collect_list(F.when(article, F.struct("pos", "token")))).alias("articles"))
