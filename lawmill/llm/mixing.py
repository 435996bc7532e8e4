"""Mixing sources to target weights by fitting exact token budgets.

Targets: the sources in code point order (null last) weigh 5, 2, 1, repeating, and share `share` of all words; no target
exceeds twice its source's size, and the excess is shared again by weight until none does.

Taking: documents are counted by exact length, source and one of 256 seeded slots. A source whose target reaches its
size takes each document once and then fits the rest as second copies. The rest is fitted in two steps, whatever the
source's size: quotas run through the lengths from the longest, so that of each length its share is taken; what then is missing, with four
documents each of the shortest lengths given back, is filled by dynamic programming over the counts of documents (a
bounded knapsack whose reachable sums are the bits of one integer), at most four more of a length than its quota. Which
documents of a length are taken is decided by seeded hash: whole slots first, then the lowest hashes of one slot, so no
group of equal lengths is ever ranked in one task.

What is gathered for a source is its histogram of lengths, whose size follows the longest document, not their number.
The targets come from sums over the sources, a table of its own; sources are not gathered.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawmill.llm.common import free_name, materialize, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240
SLOTS = 256
WORD = r"[^\x20\x09-\x0D]+"
#: The knapsack exchanges documents of so many of the shortest lengths, of so many words together, which bounds its bit rows.
_LENGTHS, _SPAN = 64, 1 << 19
#: Documents of such a length that are given back at most, and that are taken above its quota.
_TRADE = 4


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, most: float = MOST) -> list[float]:
    """The target of each source; sizes in any order."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0] is None, sizes[i][0] or ""))
    weight = {i: WEIGHTS[k % len(WEIGHTS)] for k, i in enumerate(order)}
    out, free, left = [0.0] * len(sizes), set(order), share * sum(n for _, n in sizes)
    while free:
        unit = left / sum(weight[i] for i in free)
        over = [i for i in order if i in free and unit * weight[i] > most * sizes[i][1]]
        for i in over or free:
            out[i] = float(most * sizes[i][1]) if over else unit * weight[i]
        if not over:
            break
        left -= sum(most * sizes[i][1] for i in over)
        free -= set(over)
    return out


def fill(budget: int, lengths: list[int], counts: list[int]) -> list[int]:
    """How many of each length sum closest to budget from below: bounded knapsack over the bits of integers.

    Counts are split into powers of two; bit b of a row says that b is reachable with the items so far.
    """
    take = [0] * len(lengths)
    items = []
    for i, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        part = 1
        c = min(c, budget // n) if n else 0
        while c > 0:
            items.append((i, min(part, c)))
            c -= part
            part *= 2
    mask, rows = (1 << (budget + 1)) - 1, [1]
    for i, k in items:
        rows.append((rows[-1] | rows[-1] << lengths[i] * k) & mask)
        if rows[-1] >> budget & 1:
            break
    at = rows[-1].bit_length() - 1
    for (i, k), row in zip(reversed(items[: len(rows) - 1]), reversed(rows[:-1]), strict=True):
        if not row >> at & 1:
            take[i] += k
            at -= lengths[i] * k
    return take


def quotas(target: float, lengths: np.ndarray, counts: np.ndarray, seed: int = SEED) -> tuple[int, np.ndarray]:
    """(copies of every document, further documents of each length) whose words come nearest to target."""
    take = np.zeros(len(lengths), np.int64)
    size = int((lengths * counts).sum())
    whole = min(int(target // size), MOST) if size else 0
    rest = round(target - whole * size)
    if whole == MOST or rest <= 0 or not size:
        return whole, take
    # each length in proportion, what it owes passing on to the next shorter one
    part, owed = rest / size, 0.0
    down = [int(i) for i in np.argsort(-lengths, kind="stable") if lengths[i]]
    for i in down:
        owed += part * int(lengths[i]) * int(counts[i])
        take[i] = min(int(counts[i]), int(owed // int(lengths[i]) + 1e-9))
        owed -= int(take[i]) * int(lengths[i])
    # the knapsack gets what is missing, and some documents of each of the shortest lengths back to exchange
    room = [i for i, n in zip(down[::-1], np.cumsum(lengths[down[::-1]]), strict=True) if n <= _SPAN][:_LENGTHS]
    take[room] -= (back := np.minimum(take[room], _TRADE))
    budget = min(rest - int((take * lengths).sum()), 8 * _SPAN)
    usable = np.random.default_rng(seed).permutation([i for i in room if lengths[i] <= budget and counts[i] > take[i]]).astype(int)
    spare = dict(zip(room, (back + _TRADE).tolist(), strict=True))
    for i, k in zip(usable, fill(budget, [int(lengths[i]) for i in usable], [min(spare[i], int(counts[i] - take[i])) for i in usable]), strict=True):
        take[i] += k
    short = rest - int((take * lengths).sum())
    for i in down:  # where short documents have run out
        k = min(int(counts[i] - take[i]), max(0, short) // int(lengths[i]))
        take[i] += k
        short -= k * int(lengths[i])
    left = [i for i in down if counts[i] > take[i]]
    if left and lengths[left[-1]] < 2 * short:
        take[left[-1]] += 1  # one more goes over by less than what is missing
    return whole, take


def source_targets(sources: DataFrame, share: float, most: float = MOST) -> DataFrame:
    """sources(source, source_size) with target: what `targets` gives, by one pass of sums for each round of capping."""
    order = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(order).sortWithinPartitions(order)
    row = F.monotonically_increasing_id()
    placed = materialize(dealt.withColumn("part", F.shiftright(row, 33)).withColumn("at", row.bitwiseAND(F.lit((1 << 33) - 1))), "mix-sources")
    before, first = 0, {}
    for r in placed.groupBy("part").count().orderBy("part").collect():  # one row a partition
        first[r["part"]] = before % len(WEIGHTS)
        before += r["count"]
    start = F.element_at(F.create_map(*(F.lit(x) for kv in first.items() for x in kv)), F.col("part")) if first else F.lit(0)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("at") + start, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = materialize(placed.select("source", "source_size", weight.alias("weight")), "mix-weights")
    cap, free, bound, unit = most * F.col("source_size"), F.lit(True), [], 0.0
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left = share * total
    while True:
        n = weighed.where(free).agg(F.sum("weight")).first()[0]
        if not n:
            break
        unit = left / n
        over = free & (F.lit(unit) * F.col("weight") > cap)
        capped = weighed.where(over).agg(F.sum("source_size")).first()[0]
        if capped is None:
            break
        left -= most * capped
        bound.append(unit)
        free = F.lit(max(bound)) * F.col("weight") <= cap  # a source once capped stays so: units only rise
    return weighed.select("source", "source_size", F.when(free, F.lit(unit) * F.col("weight")).otherwise(cap).cast("double").alias("target"))


def plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """The histogram of one source (source, target, size, n) to what is taken of each length."""
    pdf = pdf.sort_values("size")
    whole, more = quotas(float(pdf["target"].iloc[0]), pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
    return pdf[["source", "size"]].assign(whole=whole, more=more)


def row_hash(seed: int) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(seed))


def choose(docs: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with source, doc_id, size, h and copies, sources with source_size and target)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rank = row_hash(seed)
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), rank.alias("h"))
    sized = materialize(sized.withColumn("slot", F.pmod("h", F.lit(SLOTS)).cast("int")), "mix-sizes")
    slots = materialize(sized.groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("n")), "mix-slots")
    by_size = slots.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))

    aims = materialize(source_targets(sources, share), "mix-aims")
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    plans = by_size.join(aims, same(by_size, aims, "source")).select(by_size["source"], "target", "size", "n")
    plan = materialize(plans.groupBy("source").applyInPandas(plan_source, "source string, size long, whole int, more long"), "mix-plan")
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slot")) - F.col("n")
    cut = slots.withColumn("before", before).alias("s").join(plan.alias("p"), [F.col("s.source").eqNullSafe(F.col("p.source")), F.col("s.size") == F.col("p.size")])
    inside = F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("before")))
    cut = materialize(cut.select("s.source", "s.size", "s.slot", "whole", inside.alias("k"), "n"), "mix-cuts")
    # documents of slots that are taken in part are ranked; a slot has 1/256 of a length's documents
    keys = [F.col("d.source").eqNullSafe(F.col("c.source")), F.col("d.size") == F.col("c.size"), F.col("d.slot") == F.col("c.slot")]
    dealt = sized.alias("d").join(cut.alias("c"), keys).select("d.*", "c.whole", "c.k", "c.n")
    w = Window.partitionBy("source", "size", "slot").orderBy("h", "doc_id")
    partly = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    ranked = dealt.where(partly).withColumn("r", F.row_number().over(w)).withColumn("extra", (F.col("r") <= F.col("k")).cast("int")).drop("r")
    plain = dealt.where(~partly).withColumn("extra", (F.col("k") > 0).cast("int"))
    taken = plain.unionByName(ranked).withColumn("copies", F.col("whole") + F.col("extra"))
    return taken.select("source", "doc_id", "size", "h", "copies"), aims


def mix_sources(docs: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for docs(doc_id, text, source).

    taken is 0, 1 or 2 times size, so no word is taken more than twice. Null texts have size 0 and are never taken; a
    null source is a source of its own, the last; rows that share doc_id and everything else are ranked by their text's
    hash and, where that ties, arbitrarily but with the same total. Empty tables give no rows; other columns are not read.
    """
    taken, aims = choose(docs, share, seed)
    taken = taken.alias("t")
    out = taken.join(F.broadcast(aims).alias("a") if aims.count() <= 100_000 else aims.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source")))
    return out.select("t.doc_id", "t.size", "a.source_size", "a.target", (F.col("t.size") * F.col("copies")).alias("taken"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, all columns kept; rows alike in id, text and source share their copies."""
    taken, _ = choose(docs, SHARE, SEED)
    h, i, source, copies, alike, key, n, copy = (free_name(f"mix_{k}", docs.columns) for k in ("h", "id", "source", "copies", "alike", "key", "n", "copy"))
    taken = taken.groupBy(F.col("h").alias(h), F.col("doc_id").alias(i), F.col("source").alias(source))
    plan = materialize(taken.agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(alike)).where(F.col(copies) > 0), "mix-copies")
    keyed = docs.withColumn(key, row_hash(SEED))
    same = (F.col(key) == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(i)) & keyed["source"].eqNullSafe(F.col(source))
    joined = keyed.join(plan, same)
    each = F.floor(F.col(copies) / F.col(alike)).cast("long")
    even = joined.where(F.col(copies) % F.col(alike) == 0).withColumn(n, each.cast("int"))  # also each row that has no like
    turn = F.row_number().over(Window.partitionBy(key, "doc_id", "source").orderBy(F.lit(0)))
    odd = joined.where(F.col(copies) % F.col(alike) != 0)
    odd = odd.withColumn(n, (each + (turn <= F.col(copies) % F.col(alike)).cast("long")).cast("int"))
    counted = even.unionByName(odd).where(F.col(n) > 0)
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)
