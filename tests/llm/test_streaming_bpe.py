"""Streaming BPE against the untouched library."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lawmill.llm import streaming_bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = B.Codec(PATH)
#: Small chunks and few kept words, so that every word over 64 bytes streams.
SMALL = B.Codec(PATH, chunk=64, most=5)
ODD = ["a", "b", "th", "ing", " ", "  ", "\n", "É", "é", "Σ", "ΑΣ", "İ", "\x1c", "\x85", "\xa0", "　", "᠎", "​", "中", "한국", "ǆ", "<|endoftext|>", "<|end", "'s", "'", "S", "!", "=", "9", "½", "\U0001f600", "ͅ", "ſ", "K", "ạ", "ạ"]


def ids(codec, text):
    return [int(x) for part in codec.encode(text) for x in part]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(ODD), max_size=40).map("".join)))
def test_ids_and_text_are_the_library_s(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(CODEC, text) == ids(SMALL, text) == want
    machine = CODEC.decoder()
    got = "".join([machine.feed(want[k : k + 3]) for k in range(0, len(want), 3)] + [machine.end()])
    assert got == LIBRARY.decode(want, skip_special_tokens=False)


def test_long_words_stream():
    rng = random.Random(5)
    words = [rng.choice(["a", "the", "=", "ab", "-!", "ing"]) * rng.choice([400, 1500]) for _ in range(12)]
    words += ["".join(rng.choice("abcdeinhtrs") for _ in range(3000)) for _ in range(12)]
    for text in words:
        assert ids(SMALL, text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_memory_of_a_stream_is_bounded():
    stream = B.Transducer(SMALL.merges, SMALL.lengths, 64)
    held = 0
    for x in "abcdefgh" * 3000:
        list(stream.feed([SMALL.middle[ord(x)]]))
        held = max(held, len(stream.held))
    longest = max(SMALL.lengths.values())
    assert held <= SMALL.merges.lookahead + 64 + longest
    assert len(stream.end([SMALL.final[ord("z")]])) > 0


def test_stable_tokens_never_change():
    """Whatever follows, what the stream has emitted is a beginning of the whole word's tokens."""
    rng = random.Random(6)
    stream, out, said = B.Transducer(SMALL.merges, SMALL.lengths, 8), [], ""
    for _ in range(2500):
        x = rng.choice("aeinst")
        said += x
        out += stream.feed([SMALL.middle[ord(x)]])
    for tail in ("x", "ing", "tiesness", "ssss"):
        whole = LIBRARY.encode(said + tail, add_special_tokens=False).ids
        assert len(out) > 100 and whole[: len(out)] == out


def test_lists_that_are_not_proper_are_refused():
    vocab = {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4, "bc": 5}
    assert B.Merges(vocab, [("a", "b"), ("ab", "c")]).lookahead == 2
    with pytest.raises(ValueError):
        B.Merges(vocab, [("ab", "c"), ("a", "b")])
    with pytest.raises(ValueError):
        B.Merges(vocab, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def test_bytes_become_text_as_they_come():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    tokens = B.byte_tokens(library.get_vocab(), ["<|endoftext|>"])
    rng = random.Random(7)
    for _ in range(50):
        some = [rng.randrange(50257) for _ in range(40)]
        machine = B.Decoder(tokens, b"")
        assert "".join([machine.feed([x]) for x in some] + [machine.end()]) == library.decode(some, skip_special_tokens=False)


def test_tables(spark, messy):
    long = "a" * 200_000
    docs = messy.unionByName(spark.createDataFrame([(50, long + " " + "b c " * 300_000)], "doc_id long, text string"), allowMissingColumns=True)
    want = sorted(((r["doc_id"], LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()), key=str)
    made = B.encode(docs, PATH)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in made.collect()), key=str) == want
    said = sorted(((r["doc_id"], r["text"]) for r in B.decode(made, PATH).collect()), key=str)
    assert said == sorted(((i, LIBRARY.decode(x, skip_special_tokens=False)) for i, x in want), key=str)
    assert B.decode(B.encode(messy.limit(0), PATH), PATH).count() == 0


def test_query(spark, docs, tables):
    from hashlib import sha256

    folder = tables(documents=docs)
    digest = lambda x: sha256(x.encode()).hexdigest()
    want = []
    for r in docs.collect():
        some = LIBRARY.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(some), digest(" ".join(map(str, some))), digest(LIBRARY.decode(some, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in B.op13_streaming_bpe(spark, folder).collect()) == sorted(want)
    assert np.array_equal(ids(CODEC, ""), [])
