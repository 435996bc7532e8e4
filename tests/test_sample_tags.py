"""Tags of samples and documents against the plain version."""

import random

import plain_tags

from lawmill.functions import text as T
from lawmill.operators import sample_tags as A

KIND = "file_name string, entry_index int, law_index int, input string, output_raw string, citations array<struct<articles:array<string>,law:string>>"
WORDS = ["điều", "Điều", "5", "7", "5.", "luật", "Luật", "đất", "đai", "Bộ", "abc", ",", "và", "BLHS", "(x)"]


def test_samples_against_the_plain_version(spark):
    rng = random.Random(9)
    entries, want = [], {}
    for i in range(150):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 25))]
        a = rng.randrange(len(words))
        laws = [rng.choice([" ".join(words[a : a + rng.randint(1, 4)]), "luật đất", "no such", "", "Luật đất đai."]) for _ in range(rng.randint(0, 3))]
        arts = [rng.choice(["5", "7", "5.", " 5 ", "", "9"]) for _ in range(rng.randint(0, 4))]
        first, last = rng.randint(0, 20), rng.randint(0, 24)
        raw = rng.choice([f"ART: 7 | LAW: {first}-{last}", "NL", None])
        entries.append(("f", i, 0, " ".join(words), raw, [(arts, law) for law in laws] if laws else None))
    rows = spark.createDataFrame(entries, KIND)
    parsed = {r["entry_index"]: r for r in rows.select("entry_index", T.normalize_legal(T.F.col("input"), "tagger").alias("text"), __import__("lawmill.operators.labels", fromlist=["x"]).parse_first(T.F.coalesce("output_raw", T.F.lit(""))).alias("p")).collect()}
    norm = {r["law"]: r["n"] for r in rows.select(T.F.explode("citations").alias("c")).select("c.law", T.normalize_legal(T.F.col("c.law"), "tagger").alias("n")).collect()}
    for name, i, _, _, _, cited in entries:
        laws, arts = [x[1] for x in cited or []], [a for x in cited or [] for a in x[0]]
        p = parsed[i]["p"]
        law = p["law"]
        want[i] = plain_tags.tag(parsed[i]["text"], [(norm[x], x) for x in laws], arts + list(p["articles"]), (law["first"], law["last"]) if law and law["first"] is not None else None)
    got = {r["entry_index"]: list(r["tags"]) for r in A.samples(rows).collect()}
    assert got == want


def test_nulls_and_empties(spark):
    rows = [("f", 0, 0, None, None, None), ("f", 1, 0, "", "NL", []), ("f", 2, 0, "a b", None, [(None, None)]), ("f", 3, 0, "  ", None, None), ("f", 4, 0, "Luật A", None, [([None, "1"], "luật a")])]
    got = {r["entry_index"]: list(r["tags"]) for r in A.samples(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {2: ["O", "O"], 4: ["B-LAW", "I-LAW"]}


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(A, "NAME_CHARS", 3)
    names = spark.createDataFrame([(1, "one two"), (2, "two three four"), (3, "Two"), (4, None), (5, "")], "name int, form string")
    docs = spark.createDataFrame([(1, "x one two three four two", ["9"]), (2, None, None), (3, "ONETWO one  two", []), (4, "điều 9 9", ["9", "9."])], "k long, text string, arts array<string>")
    got = sorted((r["k"], r["pos"], r["token"], r["tag"]) for r in A.document_tags(docs, names, "k", articles="arts").collect())
    assert got == [(1, 1, "one", "B-LAW"), (1, 2, "two", "B-LAW"), (1, 3, "three", "I-LAW"), (1, 4, "four", "I-LAW"), (3, 0, "ONETWO", "B-LAW"), (4, 0, "điều", "B-ART"), (4, 1, "9", "I-ART"), (4, 2, "9", "B-ART")]


def test_only_tagged_tokens_leave_their_documents(spark):
    """A name's longest place is taken in its document, and the tokens of a text are joined with nothing."""
    from lawmill.operators import sample_tags as A

    assert A.longest_places([(1, 0, 1, 5), (2, 3, 3, 4), (1, 2, 5, 9), (1, 7, 9, 9)]) == [(1, 2, 5, 9), (2, 3, 3, 4)]
    docs = spark.createDataFrame([(1, "theo điều 5 luật đất đai, điều 5. luật", ["5", "5.", "6"]), (2, None, ["5"]), (3, "luật", None)], "k long, text string, arts array<string>")
    names = spark.createDataFrame([(0, "Luật"), (1, "luật đất đai"), (0, "luật đất")], "name int, form string")
    made = A.document_tags(docs, names, "k", articles="arts")
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.columns == ["k", "pos", "token", "tag"]
    want = [(1, 1, "điều", "B-ART"), (1, 2, "5", "I-ART"), (1, 3, "luật", "B-LAW"), (1, 4, "đất", "I-LAW"), (1, 5, "đai", "I-LAW"), (1, 7, "điều", "B-ART"), (1, 8, "5", "I-ART"), (3, 0, "luật", "B-LAW")]
    assert sorted(map(tuple, made.collect())) == want
