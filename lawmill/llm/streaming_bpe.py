"""BPE encoding and decoding as streams: tokens leave once no continuation can change them; bytes become text as they come.

Encoding. Merges run in order of rank, leftmost first. Take a text whose end is not known yet, and two continuations. At every
rank the two results agree up to some place, at first the end of what is known. A rule (c, d) moves that place to the left
only if it joins the last common token c with what follows in one of them; then by the length of c. The next rule that moves it
has a later rank, and its right side begins where c began, so c is a prefix of it. The longest such chain, weighed by the lengths
of its left sides, is the *sufficient lookahead* of the merge list (after Berglund and van der Merwe, Formalizing BPE
Tokenization, 2023); all tokens that end that far before the end of what is known are stable. No merge crosses the edge of a
stable token, so the rest is encoded on its own: memory is the lookahead and one chunk, however long a word is.

The argument needs a proper list, each token made by one rule and used by later ones only; any other list is refused.

Decoding. A token is bytes; they go through the UTF-8 state machine, which holds back a character until it is whole and puts
U+FFFD for what can't be one. A tokenizer without a decoder joins its tokens' strings by blanks.

Defined results: a null text is an empty one and has no ids; a null doc_id stays null; repeated rows stay; the strings of added
tokens give their ids, as in the library; very long texts are cut at white space and very long words stream; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm.common import table
from lawmill.llm.token_bins import Kept

#: Symbols of a word that are encoded at once beyond the lookahead; words, and pieces of words, kept in each of two generations.
CHUNK, _MOST_KEPT = 4096, 150_000
#: Characters of a text that are cut into words at once; ids that are decoded at once; bytes of a batch.
_PART, _IDS, _BATCH = 500_000, 65_536, 2_000_000
#: White space as Unicode has it (the interpreter's own notion has four more).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: How the tokenizer parts words, and its normal form.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """Ranked merges over token ids, whether they are proper, and their sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.wide = 1 + max(vocab.values(), default=0)
        #: rank by pair (left * wide + right), and the token that each rank makes
        self.rank: dict[int, int] = {}
        self.makes: list[int] = []
        made: set[int] = set()
        for rank, (a, b) in enumerate(merges):
            out = vocab[a + b]
            early = any(len(self.bare(x)) > 1 and vocab[x] not in made for x in (a, b))
            if out in made or early:
                raise ValueError(f"merge {rank} makes a token again or uses one before it is made")
            made.add(out)
            self.rank[vocab[a] * self.wide + vocab[b]] = rank
            self.makes.append(out)
        self.lookahead = self.sufficient(merges)

    def bare(self, token: str) -> str:
        return token.removesuffix(self.suffix) if self.suffix else token

    def sufficient(self, merges: list[tuple[str, str]]) -> int:
        """The longest chain of rules, later ones having the left side before them as a prefix of their right side, in symbols."""
        reach: dict[str, int] = {}
        most = 0
        for a, b in merges:
            bare = self.bare(b)
            got = len(a) + max((reach.get(bare[:k], 0) for k in range(1, len(bare) + 1)), default=0)
            reach[a] = max(reach.get(a, 0), got)
            most = max(most, got)
        return most

    def encode(self, symbols: list[int]) -> list[int]:
        """All merges of a sequence of symbols."""
        return self._scan(symbols) if len(symbols) <= 40 else self._heap(symbols)

    def _scan(self, symbols: list[int]) -> list[int]:
        ids, wide, get, none = list(symbols), self.wide, self.rank.get, len(self.makes)
        ranks = [get(a * wide + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            at = ranks.index(low)
            made = self.makes[low]
            ids[at : at + 2] = [made]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(made * wide + ids[at + 1], none)
            if at:
                ranks[at - 1] = get(ids[at - 1] * wide + made, none)
        return ids

    def _heap(self, symbols: list[int]) -> list[int]:
        ids, n, wide, get = list(symbols), len(symbols), self.wide, self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(rank, i) for i in range(n - 1) if (rank := get(ids[i] * wide + ids[i + 1])) is not None]
        heapq.heapify(todo)
        while todo:
            rank, i = heapq.heappop(todo)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] * wide + ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = self.makes[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := get(ids[a] * wide + ids[b])) is not None:
                    heapq.heappush(todo, (rank, a))
        return [x for x in ids if x >= 0]


class Transducer:
    """One word as a stream of symbols in, stable tokens out; it holds at most the lookahead, a chunk and a token."""

    def __init__(self, merges: Merges, lengths: dict[int, int], chunk: int = CHUNK):
        self.merges, self.lengths, self.chunk, self.held = merges, lengths, chunk, []

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        """Symbols that more will follow."""
        most = self.merges.lookahead + self.chunk
        for x in symbols:
            self.held.append(x)
            if len(self.held) > most:
                yield from self.stable()

    def stable(self) -> list[int]:
        safe, done, out = len(self.held) - self.merges.lookahead, 0, []
        for token in self.merges.encode(self.held):
            if done + self.lengths[token] > safe:
                break
            done += self.lengths[token]
            out.append(token)
        del self.held[:done]
        return out

    def end(self, symbols: Iterable[int]) -> list[int]:
        """The last symbols of the word."""
        out = self.merges.encode([*self.held, *symbols])
        self.held = []
        return out


class Codec:
    """The tokenizer of a file as streams of ids and of text.

    Words are parted at white space, which the tokenizer drops, and brought to normal form one by one. Letters beyond the scripts that
    all Unicode versions agree on go through the library's own normal form and pattern; merges are always made here.
    """

    def __init__(self, path: str, chunk: int = CHUNK, most: int = _MOST_KEPT):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model, self.chunk = spec["model"], chunk
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if normal != _NORMAL or spec["pre_tokenizer"]["pretokenizers"][0].get("pattern") != {"Regex": _PIECES}:
            raise ValueError(f"{path} parts its words in another way")
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, self.suffix)
        letters = byte_letters()
        self.middle = [model["vocab"][x] for x in letters]
        self.final = [model["vocab"][x + self.suffix] for x in letters]
        self.byte = {x: b for b, x in enumerate(letters)}
        added = spec["added_tokens"]
        self.strings = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in added}
        self.said = {i: t.encode() for i, t in self.strings.items()}
        self.lengths = {i: len(self.merges.bare(t)) for i, t in self.strings.items()}
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(_PIECES).findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self.young = re.compile(r"[^\0-\u052F]").search
        self.white = re.compile(f"[{_WHITE}]+").split
        self.gap = re.compile(f"[{_WHITE}]").search
        self.kept, self.known = Kept(self.word, most), Kept(self.piece, most)

    def word(self, word: str) -> bytes:
        """The ids of what stands between white space."""
        if self.young(word) or self.odd(word):
            normal = self.library.normalizer.normalize_str(word)
            found = [bytes(self.byte[x] for x in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        else:
            plain = word.lower() if word.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", word)))
            found = [plain] if plain.isalpha() else self.pieces(plain)
        return b"".join(map(self.known.__getitem__, found))

    def piece(self, piece: str) -> bytes:
        """The ids of a run of letters, a digit or a run of marks."""
        data = piece.encode()
        if len(data) <= self.chunk:
            ids = self.merges.encode([*map(self.middle.__getitem__, data[:-1]), self.final[data[-1]]])
        else:
            stream = Transducer(self.merges, self.lengths, self.chunk)
            ids = [*stream.feed(map(self.middle.__getitem__, data[:-1])), *stream.end([self.final[data[-1]]])]
        return array("I", ids).tobytes()

    def parts(self, text: str) -> Iterator[str]:
        """A very long text in parts that end at white space."""
        at = 0
        while len(text) - at > _PART and (cut := self.gap(text, at + _PART)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> Iterator[np.ndarray]:
        """The ids of a text, part by part."""
        for k, span in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                yield np.array([self.added[span]], np.uint32)
            else:
                for part in self.parts(span):
                    # split() parts at four more characters, which are rare
                    plain = part.isascii() and not any(c in part for c in "\x1c\x1d\x1e\x1f")
                    found = part.split() if plain else filter(None, self.white(part))
                    yield np.frombuffer(b"".join(map(self.kept.__getitem__, found)), np.uint32)

    def decoder(self) -> Decoder:
        """A tokenizer of this kind has no decoder of its own: token strings, joined by blanks."""
        return Decoder(self.said, b" ")


def byte_tokens(vocab: dict[str, int], added: Iterable[str] = ()) -> dict[int, bytes]:
    """The bytes of a byte-level vocabulary's tokens; added tokens stand for their strings."""
    byte, plain = {x: b for b, x in enumerate(byte_letters())}, set(added)
    return {i: t.encode() if t in plain else bytes(byte[x] for x in t) for t, i in vocab.items()}


class Decoder:
    """Ids to text as they come: token bytes, what joins them, and the state of the UTF-8 machine between calls."""

    def __init__(self, tokens: dict[int, bytes], joint: bytes):
        self.tokens, self.joint = tokens, joint
        self.machine, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Iterable[int]) -> str:
        said = self.joint.join(map(self.tokens.__getitem__, ids))
        if not said and self.joint:
            return ""
        head, self.begun = self.joint if self.begun else b"", True
        return self.machine.decode(head + said)

    def end(self) -> str:
        self.begun = False
        return self.machine.decode(b"", True)


_CACHE: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    """One a worker process, so that tasks which follow find the kept words."""
    if path not in _CACHE:
        _CACHE[path] = Codec(path)
    return _CACHE[path]


def _sent(rows: Iterator[tuple], kinds: dict[str, pa.DataType], sizes) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sizes(row)
        if size > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


def _encoded(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            yield doc_id.as_py(), np.concatenate([*codec.encode(text.as_py()), np.empty(0, np.uint32)]).astype(np.int32)


def _decoded(codec: Codec, rows: Iterable[tuple]) -> Iterator[tuple]:
    for doc_id, ids in rows:
        machine = codec.decoder()
        said = [machine.feed(ids[k : k + _IDS].tolist()) for k in range(0, len(ids), _IDS)]
        yield doc_id, ids, "".join([*said, machine.end()])


_IDS_ROW = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32())}
_TEXT_ROW = _IDS_ROW | {"text": pa.string()}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(_encoded(_codec(path), batches), _IDS_ROW, lambda r: 4 * len(r[1]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of rows(doc_id, ids): the text that the ids stand for, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((i.as_py(), x.values.to_numpy()) for b in batches for i, x in zip(b.column(0), b.column(1), strict=True))
        yield from _sent(_decoded(_codec(path), given), _TEXT_ROW, lambda r: 4 * len(r[1]) + len(r[2]))

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def transcode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): decode(encode(docs)) in one worker, whose ids never travel in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        yield from _sent(_decoded(codec, _encoded(codec, batches)), _TEXT_ROW, lambda r: 4 * len(r[1]) + len(r[2]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = transcode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))
