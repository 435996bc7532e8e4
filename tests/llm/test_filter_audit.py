"""The filter audit against plain counting."""

import random
import re
from itertools import permutations

from lawmill.llm import filter_audit as A

KIND = "doc_id long, text string, lang string"


def flags_of(rows):
    out = []
    for doc_id, text, lang in rows:
        x = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == x for o in rows)
        out.append((lang or "", doc_id, dict(A=len(words) < 100, B=100 * len(set(words)) < 80 * len(words), C=100 * len(re.findall("[A-Z]", x)) > 10 * len(x), D=bool(re.search(r"[#$%&*|]", x)), E=copy)))
    return out


def brute(rows, labels):
    docs = flags_of(rows)
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    out, taken = [], {}
    for part in {p for p, _, _ in docs}:
        mine = [(d, f) for p, d, f in docs if p == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fails = [x for x in mine if x[1][f]]
                only = [x for x in fails if sum(x[1].values()) == 1]
                taken[part, f] = taken.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), len(only), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
    return sorted((*r, taken[r[0], r[1][r[2] - 1]]) for r in out)


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, KIND)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in A.audit(docs, marks).collect()) == brute(rows, labels)


def test_every_order_and_step(spark):
    rng = random.Random(4)
    made = ["short text", "A B C D", "x " * 150, " ".join(f"w{i}" for i in range(130)), " ".join(f"w{i}" for i in range(130)) + " 5%", "ABC " * 120, "", None]
    rows = [(i, rng.choice(made) if i % 3 else f"{rng.choice(made)} {i}", rng.choice(["en", "de", None, ""])) for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 220, 2)] + [(4, 1, 1), (None, 1, 1)]
    check(spark, rows, labels)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None), (None, "a", "en"), (1, "a", "en"), (1, "a", "en"), (2, "a", "de"), (3, "  \t", "en"), (4, "", "en"), (5, None, "en")]
    check(spark, rows, [(1, 1, 0), (1, 0, 1), (2, None, None)])


def test_empty_tables_and_other_columns(spark, messy):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(spark.createDataFrame([], KIND), none).count() == 0
    got = A.audit(messy, none)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in messy.collect()]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [])


def test_600_rows_a_part(spark):
    steps = A.steps(spark).collect()
    assert len(steps) == 600 and len({r["filter_order"] for r in steps}) == 120
