"""Cut texts give the ids of the library's own tokenizer, added tokens included."""

import random

import numpy as np
import pytest

from lawmill.llm.token_bins import Encoder


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_ids_of_odd_strings(path):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(path), random.Random(1)
    parts = ["a", "the", "Word", "été", "Ж", "中", "\U0001f600", "12", "7", " ", "  ", "\n", "\n\n", "\t", "\r", ".", ",", "..", "$$$", "'s", "'", "!", "_", "-", "\0", "\x1c", "\x85", " ", "　", "ẞ", "กำ", "<|endoftext|>", "<|endoftext", "x" * 70]
    encode = Encoder(path, most=40)  # small generations, so that pieces go and come back
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text
        assert len(encode.kept) <= 40
    assert encode(None).tolist() == []
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_very_long_texts_are_cut(path, monkeypatch):
    from tokenizers import Tokenizer

    from lawmill.llm import token_bins

    monkeypatch.setattr(token_bins, "_PART", 50)
    rng = random.Random(2)
    text = "".join(rng.choice(["word", " ", " ", "\n", ", ", "x9", ". "]) for _ in range(3000)) + "q" * 500
    encode = Encoder(path)
    assert sum(map(len, encode.parts(text))) == len(text)
    np.testing.assert_array_equal(encode(text), Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
