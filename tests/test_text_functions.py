"""Normal forms, accents, running sums and spans against plain Python, odd and long texts too."""

import re
import unicodedata
from itertools import accumulate

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawmill.functions import text as T

TEXTS = st.lists(st.one_of(st.text(max_size=20), st.text("aăâđéeẹ̣̃́́ẛÅÅﬁ가각﻿ ", max_size=20)), min_size=1, max_size=20)


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_normal_form_and_accents(spark, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, x string")
    for r in rows.select("x", T.nfc(F.col("x")).alias("n"), T.strip_accents(F.col("x")).alias("s")).collect():
        if r["x"] is None:
            assert r["n"] is None and r["s"] is None
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", r["x"]) if unicodedata.category(c) != "Mn")
        assert r["n"] == unicodedata.normalize("NFC", r["x"])
        assert r["s"] == unicodedata.normalize("NFC", bare).replace("đ", "d").replace("Đ", "D")


def test_composed_characters_never_change():
    every = [chr(c) for c in range(0x110000) if re.match(f"[{T.COMPOSED}]", chr(c))]
    assert len(every) > 1000 and all(unicodedata.is_normalized("NFC", x + y) for x in every for y in "aéạ")


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 5000):
        sizes = [(7 * i) % 5 for i in range(n)]
        assert spark.createDataFrame([(sizes,)], "a array<int>").select(T.running_sums(F.col("a"))).first()[0] == list(accumulate(sizes))


def test_spans_of_many_matches(spark):
    text = "".join(f"é{'x' * (i % 4)} ab\U0001f600" for i in range(20_000))
    got = spark.createDataFrame([(text,), ("none",), (None,), ("",)], "t string").select(T.match_spans(F.col("t"), "ab|x+").alias("s")).collect()
    assert [(s["text"], s["start"], s["end"]) for s in got[0]["s"]] == [(m.group(), *m.span()) for m in re.finditer("ab|x+", text)]
    assert got[1]["s"] == [] and got[2]["s"] is None and got[3]["s"] == []
