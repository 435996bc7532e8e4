"""The best tag sequence of a linear chain, by dynamic programming over arrays in the JVM.

A fold over a sequence's scores keeps, for each tag, the best score of a path that ends in it, and for each place which tag such a path
came from; a second fold follows these back pointers from the best end. Both go in runs of places, so what a fold has gathered is copied
once a run and not at every place, and long sequences cost little more than short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that one inner fold goes over.
RUN = 128
_BACK = "array<array<int>>"


def _numbers(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _runs(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(RUN)), lambda s: F.slice(items, s + 1, RUN))


def best(scores: Column) -> Column:
    """(score, tag) of the largest, the first of equals."""
    top = F.array_max(F.transform(scores, lambda v, k: F.struct(v.alias("v"), (-k).alias("k"))))
    return F.struct(top["v"].alias("v"), (-top["k"]).alias("k"))


def path(emissions: Column, start: list[float], end: list[float], move: list[list[float]]) -> Column:
    """[MDL-2, WIN-10] The tags (ints) of the likeliest path for emissions[place][tag]; of equal paths that with the first tag, from the end.

    move[s][t]: from s to t. An empty sequence has an empty path, a null one null; scores must not be null.
    """
    into = F.array(*(_numbers([row[t] for row in move]) for t in range(len(start))))
    first = F.transform(F.get(emissions, F.lit(0)), lambda e, t: e + F.get(_numbers(start), t))

    def step(state: Column, e: Column) -> Column:
        tops = F.transform(into, lambda row: best(F.zip_with(state["score"], row, lambda a, b: a + b)))
        return F.struct(F.zip_with(tops["v"], e, lambda a, b: a + b).alias("score"), F.concat(state["back"], F.array(tops["k"])).alias("back"))

    def run(state: Column, es: Column) -> Column:
        inner = F.aggregate(es, F.struct(state["score"].alias("score"), F.array().cast(_BACK).alias("back")), step)
        return F.transform(F.array(inner), lambda i: F.struct(i["score"].alias("score"), F.concat(state["runs"], F.array(i["back"])).alias("runs")))[0]

    rest = F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0)))
    zero = F.struct(first.alias("score"), F.array().cast(f"array<{_BACK}>").alias("runs"))
    last = F.aggregate(_runs(rest), zero, run, lambda s: F.struct(best(F.zip_with(s["score"], _numbers(end), lambda a, b: a + b))["k"].alias("tag"), F.reverse(F.flatten(s["runs"])).alias("back")))

    def back(state: Column, row: Column) -> Column:
        return F.transform(F.array(F.get(row, state["tag"])), lambda t: F.struct(t.alias("tag"), F.concat(state["path"], F.array(t)).alias("path")))[0]

    def back_run(state: Column, rows: Column) -> Column:
        inner = F.aggregate(rows, F.struct(state["tag"].alias("tag"), F.array().cast("array<int>").alias("path")), back)
        return F.transform(F.array(inner), lambda i: F.struct(i["tag"].alias("tag"), F.concat(state["runs"], F.array(i["path"])).alias("runs")))[0]

    def followed(found: Column) -> Column:
        begun = F.struct(found["tag"].alias("tag"), F.array(F.array(found["tag"])).alias("runs"))
        return F.aggregate(_runs(found["back"]), begun, back_run, lambda s: F.reverse(F.flatten(s["runs"])))

    whole = F.transform(F.array(last), followed)[0]
    return F.when(F.size(emissions) > 0, whole).when(emissions.isNotNull(), F.array().cast("array<int>"))


def decode_rows(rows: DataFrame, key: str, place: str, scores: Column, start: list[float], end: list[float], move: list[list[float]]) -> DataFrame:
    """(key, path) of rows with a place in their sequence and an array of scores; a sequence's scores come together in one row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("i"), scores.alias("e")))), lambda x: x["e"])
    return rows.groupBy(key).agg(ordered.alias("__e")).select(key, path(F.col("__e"), start, end, move).alias("path"))
