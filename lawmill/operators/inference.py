"""From texts to tags, sections, citations and losses with a model: a bundle of weights and its configuration.

A configuration holds words and chars (symbol to id, 0 padding, 1 unknown), tags (with the padding tag first), and either
max_word_len (token models) or max_line_words and max_line_chars (line models). Both go to the executors once, as a
broadcast; their size is that of the training vocabulary, not of the texts. Sequences of one Arrow batch are packed by
length into padded numpy batches of bounded size, and vectors of equal words are computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions import patterns as P
from lawmill.functions import text as T
from lawmill.operators import citations as C
from lawmill.operators import corpus as V
from lawmill.operators import models as M
from lawmill.operators import sections as S
from lawmill.operators import tagging as B
from lawmill.operators import token_features as K
from lawmill.sources.scratch import written

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_FEATURES = "array<array<tinyint>>"
#: Padded places of one numpy batch; a longer sequence is a batch of its own.
PLACES = 32_768
#: Sequences of a pack from which on the best paths are sought side by side.
BESIDE = 4
#: Weight of the tag losses beside the path's, and of the marker tags in it.
AUX, MARKER_WEIGHT = 0.15, 8.0


def packs(lengths: np.ndarray, most: int = PLACES) -> Iterator[np.ndarray]:
    """Row numbers of the padded batches, longest first; empty sequences are in none."""
    order = np.argsort(-lengths, kind="stable")[: int((lengths > 0).sum())]
    while len(order):
        n = max(1, most // int(lengths[order[0]]))
        yield order[:n]
        order = order[n:]


def word_id(words: dict, token: str, lower: bool = True) -> int:
    """[JON-8]"""
    return words.get(token, words.get(token.lower(), V.UNKNOWN) if lower else V.UNKNOWN)


def _fixed(ids: list[int], size: int) -> list[int]:
    return ids[:size] + [V.PAD] * (size - len(ids))


def encode_tokens(config: dict, tokens, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """[MDL-9] Word ids [n] and character ids [n, max_word_len]."""
    chars, size = config["chars"], config["max_word_len"]
    words = np.array([word_id(config["words"], t, lower) for t in tokens], np.int64)
    cut = [t[:size] for t in tokens]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    kinds, back = np.unique(np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    out = np.full((len(cut), size), V.PAD, np.int64)
    out[np.arange(size) < n[:, None]] = np.array([chars.get(chr(k), V.UNKNOWN) for k in kinds], np.int64)[back]
    return words, out


def encode_lines(config: dict, lines) -> tuple[np.ndarray, np.ndarray]:
    """[SCL-30, MDL-9] Word ids [n, max_line_words] and character ids [n, max_line_chars]."""
    import regex

    token, chars = regex.compile(P.TOKEN), config["chars"]
    words = [_fixed([word_id(config["words"], w) for w in token.findall(x)[: config["max_line_words"]]], config["max_line_words"]) for x in lines]
    return np.array(words, np.int64), np.array([_fixed([chars.get(c, V.UNKNOWN) for c in x[: config["max_line_chars"]]], config["max_line_chars"]) for x in lines], np.int64)


def emissions(b: dict, config: dict, sequences: list, feats: list | None, lower: bool = True) -> list[np.ndarray]:
    """Tag scores of each sequence of tokens, or of lines if the configuration has max_line_words."""
    lengths = np.array([len(x) for x in sequences], np.int64)
    out = [np.zeros((0, len(config["tags"]))) for _ in sequences]
    of = _line_scores if "max_line_words" in config else _token_scores
    for rows in packs(lengths):
        n, most = lengths[rows], int(lengths[rows[0]])
        f = None
        if feats is not None:
            f = np.zeros((len(rows), most, b["feat"].shape[1]))
            for i, r in enumerate(rows):
                f[i, : n[i]] = feats[r]
        e = of(b, config, [sequences[r] for r in rows], n, f, lower)
        for i, r in enumerate(rows):
            out[r] = e[i, : n[i]]
    return out


def _line_scores(b: dict, config: dict, pack: list, n: np.ndarray, feats: np.ndarray, lower: bool) -> np.ndarray:
    parts = [encode_lines(config, x) for x in pack]
    words, chars = (np.stack([np.pad(p[k], [(0, int(n[0]) - len(p[k]))] + [(0, 0)] * (p[k].ndim - 1)) for p in parts]) for k in (0, 1))
    return M.line_emissions(b, words, chars, feats, n)


def _token_scores(b: dict, config: dict, pack: list, n: np.ndarray, feats: np.ndarray | None, lower: bool) -> np.ndarray:
    """Distinct tokens of the pack are encoded once; padded places repeat one of them, which nothing reads."""
    at: dict = {}
    codes = np.zeros((len(pack), int(n[0])), np.int64)
    for i, x in enumerate(pack):
        codes[i, : n[i]] = [at.setdefault(t, len(at)) for t in x]
    return M.token_emissions(b, *encode_tokens(config, at, lower), feats, n, codes)


def best_paths(chain: M.Crf, es: list[np.ndarray]) -> list[list[int]]:
    """[WIN-10] The best path of each of es, many of like length side by side."""
    from lawmill.operators.crf_training import best

    n, out = np.array([len(e) for e in es], np.int64), [[] for _ in es]
    for rows in packs(n):
        if len(rows) < BESIDE:
            for r in rows:
                out[r] = chain.decode(es[r])
            continue
        e = np.zeros((len(rows), int(n[rows[0]]), es[rows[0]].shape[1]))
        for i, r in enumerate(rows):
            e[i, : n[r]] = es[r]
        for i, path in enumerate(best(chain, e, n[rows])):
            out[rows[i]] = path[: n[rows[i]]].tolist()
    return out


def nested(column: pa.ListArray, width: int) -> list[np.ndarray]:
    """[length, width] of each row of an array<array<number>>, without a Python object for each place; null rows are empty."""
    n = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.split(flat, np.cumsum(n)[:-1])


def log_partitions(chain: M.Crf, es: list[np.ndarray]) -> np.ndarray:
    """[MDL-2] The log partition of each of es, many of like length side by side; 0 for an empty one."""
    n, out = np.array([len(e) for e in es], np.int64), np.zeros(len(es))
    for rows in packs(n):
        e = np.zeros((int(n[rows[0]]), len(rows), es[rows[0]].shape[1]))
        for i, r in enumerate(rows):
            e[: n[r], i] = es[r]
        a = chain.start + e[0]
        # longest first, so those that go on are the first ones
        for i, k in enumerate(np.searchsorted(-n[rows], -np.arange(1, len(e))), 1):
            every = a[:k, :, None] + chain.move
            most = every.max(1)
            every -= most[:, None]
            a[:k] = most + np.log(np.exp(every, every).sum(1)) + e[i, :k]
        out[rows] = M.logsumexp(a + chain.end, 1)
    return out


def sequence_losses(crf: M.Crf, es: list[np.ndarray], gold: list[list[int]], aux: float = 0.0) -> list[tuple[float, float, float]]:
    """[MDL-7] (path loss, weighted cross-entropy, weight) of each: a batch's loss is the mean of the first and aux times second / third."""
    out = []
    for e, z, said in zip(es, log_partitions(crf, es), gold, strict=True):
        if not len(e):
            out.append((0.0, 0.0, 0.0))
            continue
        if len(said) != len(e):
            raise ValueError("gold tags differ in number from the sequence")
        g = np.array(said)
        score = crf.start[g[0]] + crf.end[g[-1]] + e[np.arange(len(g)), g].sum() + crf.move[g[:-1], g[1:]].sum()
        w = np.where(np.arange(e.shape[1]) >= 2, MARKER_WEIGHT, 1.0)[g] * (g != V.PAD)
        ce = -(np.log(M.softmax(e)[np.arange(len(g)), g] + 1e-300) * w).sum() if aux else 0.0
        out.append((float(z - score), float(ce), float(w.sum())))
    return out


def sequence_loss(crf: M.Crf, e: np.ndarray, gold: list[int], aux: float = 0.0) -> tuple[float, float, float]:
    """That of one sequence."""
    return sequence_losses(crf, [e], [gold], aux)[0]


def tagging(spark, key: str, model: tuple[dict, dict], items: str = "tokens", feats: str | None = "features", crf: bool = True, lower: bool = True, gold: str | None = None, aux: float = 0.0, probs: bool = True, keep: tuple = (), repair: bool = False, tags: str = "tags") -> Step:
    """The pass of tag_sequences over record batches. keep: further columns that go along. tags: the name of the tags."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, conf = shared.value
        chain, at = M.Crf(b["start"], b["end"], b["move"]), {t: i for i, t in enumerate(conf["tags"])}
        texts, numbers = pa.list_(pa.string()), pa.list_(pa.float64())
        mended, known = _mending(conf["tags"])
        labels = pa.array(known, pa.string())
        for batch in K.slices(batches, items):
            seqs = [x or [] for x in batch.column(items).to_pylist()]
            es = emissions(b, conf, seqs, None if feats is None else nested(batch.column(feats), b["feat"].shape[1]), lower)
            paths = best_paths(chain, es) if crf else [e.argmax(-1).tolist() for e in es]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
            codes = np.concatenate([[], *paths]).astype(np.int64)
            tagged = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), labels.take(pa.array(mended(codes, ends[:-1]) if repair else codes)))
            given = batch.column(items)
            out = {key: batch.column(key), items: pa.array(seqs, texts) if given.null_count else given, tags: tagged}
            if probs:
                out["probs"] = pa.array([M.softmax(e).tolist() if len(e) else [] for e in es], pa.list_(numbers))
            if gold:
                said = [x or [] for x in batch.column(gold).to_pylist()]
                loss = sequence_losses(chain, es, [[at[t] for t in g] for g in said], aux)
                out |= {gold: pa.array(said, texts)} | {k: pa.array([x[i] for x in loss], pa.float64()) for i, k in enumerate(("path_loss", "ce", "weight"))}
            out |= {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def tag_sequences(rows: DataFrame, key: str, model: tuple[dict, dict], items: str = "tokens", feats: str | None = "features", crf: bool = True, lower: bool = True, gold: str | None = None, aux: float = 0.0, probs: bool = True, before: Step | None = None, repair: bool = False) -> DataFrame:
    """[SEM-16, MDL-9] (key, items, tags, probs) of rows(key, items array<string>, feats array<array<number>>).

    A few sequences at a time are taken from a record batch, so memory follows these. probs=False leaves the scores out. crf=False takes the best score of each place. With gold (array of tags) there are also gold, path_loss, ce and weight,
    all 0 for an empty sequence. A null sequence is an empty one. before makes the columns of rows' record batches in the same pass.
    repair mends the tags, as repaired() does.
    """
    run = tagging(rows.sparkSession, key, model, items, feats, crf, lower, gold, aux, probs, repair=repair)
    taken = rows.columns if before else [c for c in (key, items, feats, gold) if c]
    kind = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{items}` array<string>, tags array<string>" + (", probs array<array<double>>" if probs else "")
    kind += f", `{gold}` array<string>, path_loss double, ce double, weight double" if gold else ""
    return rows.select(*taken).mapInArrow((lambda batches: run(before(batches))) if before else run, kind)


def _mending(tags: list[str]) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], list[str]]:
    """[WIN-7] repaired() on numbers of tags, all sequences in one array (the places where they begin beside it), and the tags it may give."""
    known = list(dict.fromkeys([*tags, *(f"B-{t[2:]}" for t in tags if t.startswith("I-"))]))
    names: dict = {}
    label = np.array([names.setdefault(t[2:], len(names)) if t[:2] in ("B-", "I-") else -1 for t in known])
    within = np.array([t.startswith("I-") for t in known])
    begins = np.array([known.index(f"B-{t[2:]}") if t.startswith("I-") else k for k, t in enumerate(known)])

    def mended(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        before = np.concatenate([[-1], label[codes]])[:-1]
        before[starts[starts < len(codes)]] = -1
        return np.where(within[codes] & (before != label[codes]), begins[codes], codes)

    return mended, known


def repaired(tags: Column) -> Column:
    """[WIN-7] On arrays: I-x after anything but x becomes B-x."""
    label = lambda t: F.when(t.startswith("B-") | t.startswith("I-"), F.substring(t, 3, 64))
    before = lambda i: F.when(i > 0, F.get(tags, i - 1))
    return F.transform(tags, lambda t, i: F.when(t.startswith("I-") & ~label(before(i)).eqNullSafe(label(t)), F.concat(F.lit("B-"), label(t))).otherwise(t))


def dealt(docs: DataFrame, key: str) -> DataFrame:
    """docs by key over all tasks, in a number of parts that small shuffles do not lessen: a model's work is many times what is moved."""
    spark = docs.sparkSession
    return docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def token_samples(docs: DataFrame, titles: DataFrame, key: str, text: str = "text", unicode_form: bool = True) -> DataFrame:
    """(key, text, tokens, features) of texts in the tagger's normal form, with FEA-1; a text without tokens has empty arrays.

    The gazetteer is built once from titles(title). key must be unique.
    """
    rows, step = _samples(docs, titles, key, text, unicode_form)
    return rows.mapInArrow(step, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string, tokens array<string>, features {_FEATURES}") if step else rows


def _samples(docs: DataFrame, titles: DataFrame, key: str, text: str, unicode_form: bool) -> tuple[DataFrame, Step | None]:
    """Samples as rows and the step that makes them of these; without one the rows are samples, as for a gazetteer too large to send."""
    norm = dealt(docs.select(key, text), key).select(key, T.normalize_legal(T.safe_text(F.col(text)), "tagger", unicode_form).alias("text"))
    phrases = B.gazetteer(titles, unicode_form=unicode_form)
    if phrases.count() <= B.MOST_PHRASES:
        return K.beside(norm, [r["phrase"] for r in phrases.select("phrase").collect()], key)
    rows = B.features(norm, phrases, key, "text", unicode_form)
    every = F.array_sort(F.collect_list(F.struct("pos", "token", F.array(*(F.col(f).cast("byte") for f in B.FEATURES)).alias("f"))))
    made = rows.groupBy(key).agg(every.alias("__t"))
    some = norm.join(made, key, "left").withColumn("__t", F.coalesce("__t", F.array().cast(made.schema["__t"].dataType)))
    return some.select(key, "text", F.col("__t.token").alias("tokens"), F.col("__t.f").alias("features")), None


def told_samples(docs: DataFrame, titles: DataFrame, key: str, model: tuple[dict, dict], text: str = "text", unicode_form: bool = True) -> tuple[DataFrame, Step]:
    """Rows and the step that makes (key, tokens, features, gold) of them, gold being the model's own tags, for evaluate(before=step)."""
    rows, step = _samples(docs, titles, key, text, unicode_form)
    tell = tagging(docs.sparkSession, key, model, probs=False, keep=("features",), tags="gold")
    return rows, (lambda batches: tell(step(batches))) if step else tell


def tag_texts(docs: DataFrame, titles: DataFrame, key: str, model: tuple[dict, dict], text: str = "text", unicode_form: bool = True) -> DataFrame:
    """[SEM-16, MDL-3] (key, tokens, tags) of whole texts, tags repaired; entity_rows() gives the entities."""
    rows, step = _samples(docs, titles, key, text, unicode_form)
    return tag_sequences(rows, key, model, probs=False, before=step, repair=True)


def tag_rows(tagged: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, token, tag) of (keys, tokens, tags)."""
    return tagged.select(*keys, F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "z")).select(*keys, "pos", F.col("z.tokens").alias("token"), F.col("z.tags").alias("tag"))


def entity_rows(tagged: DataFrame, key: str) -> DataFrame:
    """[WIN-6] (key, label, first, last, text)."""
    return B.spans(tag_rows(tagged, key), key)


def snippet_citations(docs: DataFrame, model: tuple[dict, dict], name: str = "pdf_path", text: str = "ocr_text") -> DataFrame:
    """[FLT-16, SCL-18, MDL-4] (name, citations array<struct<law_name, articles>>): scanned texts to laws with articles.

    Each snippet is tagged by itself, by the plain model: exact words only, best score of each place. Laws come in the
    order of the text; those without articles, and names without laws, are left out. Names must be unique.
    """
    found = docs.select(name, F.posexplode(C.snippets(F.col(text))).alias("n", "s"))
    rows = found.select(F.struct(name, "n").alias("k"), T.tokens(F.col("s")).alias("tokens"))
    tagged = tag_sequences(rows, "k", model, feats=None, crf=False, lower=False, probs=False)
    laws = B.law_articles(tag_rows(tagged, "k"), "k").where(F.size("articles") > 0)
    made = laws.select(F.col(f"k.{name}").alias(name), F.struct(F.col("k.n").alias("n"), "first", "law_name", "articles").alias("c"))
    ordered = F.array_sort(F.collect_list("c"))
    return made.groupBy(name).agg(F.transform(ordered, lambda c: F.struct(c["law_name"].alias("law_name"), c["articles"].alias("articles"))).alias("citations"))


def tag_lines(docs: DataFrame, model: tuple[dict, dict], name: str = "file_name", text: str = "text", pack: P.Pack = P.LEGAL_VI, wide: bool = False, unicode_form: bool = True) -> DataFrame:
    """[SEM-12, MDL-5, MDL-6] (name, n_lines, line_index, line, tag, prob_<marker>) of every non-empty line.

    wide takes the 70 features in place of the 26. The features used are those named in the configuration, in its order.
    """
    bundle, config = model
    lines = S.line_rows(dealt(docs.select(name, text), name), name, text, unicode_form, 1 if wide else 0)
    made = S.wide_features(lines, name, pack) if wide else S.features(lines, pack)
    every = F.array_sort(F.collect_list(F.struct("line_index", "line", F.array(*(F.col(f).cast("float") for f in config["features"])).alias("f"))))
    rows = made.groupBy(name).agg(every.alias("t")).select(name, F.col("t.line").alias("lines"), F.col("t.f").alias("features"))
    got = tag_sequences(rows, name, model, "lines")
    flat = got.select(name, F.size("lines").alias("n_lines"), F.posexplode(F.arrays_zip("lines", "tags", "probs")).alias("line_index", "z"))
    at = {t: i for i, t in enumerate(config["tags"])}
    return flat.select(name, "n_lines", "line_index", F.col("z.lines").alias("line"), F.col("z.tags").alias("tag"), *(F.get("z.probs", F.lit(at[m])).alias(f"prob_{m}") for m in P.MARKERS))


def line_predictions(rows: DataFrame, name: str = "file_name") -> DataFrame:
    """[PRJ-8] (name, line_predictions array<struct<line_index, line, tag, scores map>>) of tag_lines' rows."""
    scores = F.create_map(*(x for m in P.MARKERS for x in (F.lit(m), F.col(f"prob_{m}"))))
    return rows.select(name, F.struct("line_index", "line", "tag", scores.alias("scores")).alias("p")).groupBy(name).agg(F.sort_array(F.collect_list(F.struct(F.col("p.line_index").alias("i"), F.to_json("p").alias("p")))).alias("x")).select(
        name, F.transform("x", lambda x: F.from_json(x["p"], "line_index int, line string, tag string, scores map<string,double>")).alias("line_predictions")
    )


def predict_sections(docs: DataFrame, model: tuple[dict, dict], name: str = "file_name", pack: P.Pack = P.LEGAL_VI, threshold: float = 0.45, wide: bool = False, unicode_form: bool = True) -> DataFrame:
    """[SEM-12] (name, selected_markers, warnings, sections) of docs(name, text); an empty document warns "empty_file"."""
    return S.predict(docs, tag_lines(docs, model, name, "text", pack, wide, unicode_form), name, pack, threshold, unicode_form)


def evaluate(samples: DataFrame, key: str, model: tuple[dict, dict], items: str = "tokens", gold: str = "gold", batch: int = 32, aux: float = 0.0, before: Step | None = None) -> tuple[DataFrame, DataFrame]:
    """[MDL-10, AGG-11] (one row: loss, the unweighted mean of batch losses; metrics of the entities found) of (key, items, features, gold).

    Batches are the samples in key order, `batch` a piece. An empty table has a null loss and zero metrics. before makes the samples of
    samples' record batches in the same pass.
    """
    # the model runs once; only losses are put in order, and both sides' entities are compared beside their text
    got = tag_sequences(samples, key, model, items, gold=gold, aux=aux, probs=False, before=before)
    got = written(got.select(key, gold, "tags", "path_loss", "ce", "weight"), "evaluated")
    losses = V.numbered(got.select(key, "path_loss", "ce", "weight"), [key], "__n")
    each = losses.groupBy(F.floor(F.col("__n") / batch).alias("b")).agg((F.avg("path_loss") + F.lit(aux) * F.coalesce(F.try_divide(F.sum("ce"), F.sum("weight")), F.lit(0.0))).alias("loss"))
    return each.agg(F.avg("loss").alias("loss")), B.metrics_beside(got, gold, "tags")
