"""License notices do not follow line ends."""

import pytest

from lawmill.llm import license_join

CASES = [
    ("bsd", "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that", 1.0),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated", 1.0),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy", 1.0),
    ("", "the book was released last year and nothing more was said of it. under the tree sat a student of mit with a license in hand", 0.0),
    ("mit", "word " * 400 + "released\nunder\nthe\nmit\nlicense" + " word" * 400, 1.0),
]


@pytest.mark.parametrize("threshold", [0.9, 0.8])
def test_notices_over_line_ends(spark, threshold):
    docs = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_join.scan(docs, threshold=threshold).collect()}
    assert got == {i: (label, score) for i, (label, _, score) in enumerate(CASES)}


def test_join_finds_what_a_plain_scan_finds(spark):
    import random
    import re

    rng = random.Random(4)
    pool = [w for _, t in license_join.TEMPLATES for w in t.split()] + ["x", "y"]
    rows = []
    for i in range(120):
        words = [rng.choice(pool) for _ in range(rng.choice([5, 60, 200]))]
        for _ in range(2):
            notice = [w for w in rng.choice(license_join.TEMPLATES)[1].split() if rng.random() > 0.05]
            at = rng.randrange(len(words))
            words[at:at] = notice
        rows.append((i, "".join(w + rng.choice([" ", "\n", ", "]) for w in words)))
    got = {r["doc_id"]: (set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(","))), r["n_base"], r["score"]) for r in license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words, want, best = re.findall(r"[a-z0-9]+", text), set(), 0.0
        for label, notice in license_join.TEMPLATES:
            t, w = set(notice.split()), license_join.width(notice)
            share = max(len(t & set(words[s : s + w])) for s in range(len(words))) / len(t)
            if share >= 0.9:
                want.add(label)
                best = max(best, share)
        base = {label for phrase, label in license_join.PHRASES if f" {phrase} " in f" {' '.join(words)} "}
        assert got[i][0] == want - base, i
        assert got[i][2] == pytest.approx(1.0 if got[i][1] else best), i
