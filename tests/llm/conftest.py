import random

import pytest

MESSY = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, unit int, size int, score double, fp long, tile int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), vocabulary)}{rng.choice(['', '.', ','])}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source): copies, near copies, a shared passage, long and short texts."""
    rng = random.Random(3)
    passage = words(rng, 70)
    out, made = [], []
    for i in range(160):
        text = words(rng, rng.choice([3, 30, 60, 120, 300]))
        if i % 7 == 0:
            text += " " + passage + "\nend " + words(rng, 20)
        if i % 11 == 5:
            text = rng.choice(made)
        if i % 13 == 6:
            text = rng.choice(made).replace(" ", "  ", 3) + " tail"
        made.append(text)
        out.append((i, text, "en" if i % 3 else "xx", f"s{i % 4}"))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls everywhere, empty and very long texts, repeats, ties, and columns whose names clash with inner ones."""
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [(None, None, None, None), (1, None, "en", None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "one", "en", "b"), (5, long, "en", None), (6, long, "de", "b"), (7, "İstanbul Été <|endoftext|> x", "tr", ""), (7, "İstanbul Été <|endoftext|> x", "tr", ""), (None, "no id here", "en", "a"), (8, "12 34 !!", "en", "c")]
    return spark.createDataFrame([(*r, None, 1, "k", 2, 3, 0.5, 9, 4) for r in rows], MESSY)


@pytest.fixture
def tables(tmp_path):
    """Writes frames as <name>.parquet and returns the folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
