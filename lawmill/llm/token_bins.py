"""Token-ID / binary output: length-delimited binary records with masked checksums and a separate offset index.

A shard is a plain concatenation of records:

    u64 length of the payload | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload | 0x0A

and a payload is ``i64 doc_id | u8 has_id | u8 bytes per id (2 or 4) | ids``, all little-endian. Shard k holds smaller
doc_ids than shard k+1 and is itself sorted, so the shards in order are the corpus in ascending doc_id order.

Python only encodes; Spark's own file writer commits the shards. So any store that Spark can write will do, and the
task of a lost executor is written again without leaving halves behind. The trailing newline byte is what that writer
puts after a record; it is part of the format and checked. The index is a Parquet table next to the shards, made from
the written files: one row a record with its shard, offset and length, which is what a shuffled reader needs.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawmill.llm.common import fresh_path, table

END_ID = 2
SHARD_BYTES = 32 << 20
INDEX = "doc_id long, shard int, offset long, length long, before long, n_tokens long, ids_crc32 long"
_HEAD = struct.Struct("<qBB")
_CACHE: dict[str, tuple] = {}
#: Pieces kept in each of two generations (about 200 bytes each), and the longest that is kept.
_MOST_PIECES, _LONGEST = 150_000, 64
#: What stands for a blank in a byte-level vocabulary.
_BLANK = chr(256 + 32)
#: Characters of a text that are cut into pieces at once, and rows and bytes of a batch.
_PART, _ROWS, _BATCH = 1_000_000, 200, 2_000_000


def masked(crc: int) -> int:
    """The rotation and offset that keep a checksum of checksummed data from degenerating."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(data: bytes | memoryview) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length of the whole record, payload) of each record; a damaged file raises ValueError."""
    view, at = memoryview(data), 0
    while at < len(data):
        if at + 17 > len(data):
            raise ValueError(f"record at {at} is cut off")
        size, check = struct.unpack_from("<QI", data, at)
        end = at + 12 + size
        if masked(zlib.crc32(view[at : at + 8])) != check or end + 5 > len(data):
            raise ValueError(f"record at {at} has a bad length")
        payload = view[at + 12 : end]
        if masked(zlib.crc32(payload)) != struct.unpack_from("<I", data, end)[0] or data[end + 4] != 10:
            raise ValueError(f"record at {at} has a bad payload")
        yield at, end + 5 - at, payload
        at = end + 5


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = 4 if len(ids) and ids.max() > 0xFFFF else 2
    return _HEAD.pack(doc_id or 0, doc_id is not None, wide) + ids.astype(f"<u{wide}").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, known, wide = _HEAD.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{wide}", offset=_HEAD.size)


class Kept(dict):
    """piece -> its ids as bytes, made where they lack; two generations of at most `most` pieces each, so what is seldom met goes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= _LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """The ids of whole texts, as the library gives them without its own start and end tokens.

    The tokenizer's pattern always cuts after a letter or digit that a full stop, comma or line end follows, and between
    a character that is no white space and a following blank; so a text may be cut there and each piece encoded alone.
    Pieces repeat, so their ids are kept, as many as memory is given for. Texts in which white space or marks follow
    each other, or with letters of scripts that younger Unicode versions add to, are cut before blanks only. A piece that
    is a single run of the pattern goes to the library's merges directly, one of several runs is cut into these; with
    letters of such scripts it goes to the whole tokenizer, and so does a whole text with the string of an added token.
    """

    def __init__(self, path: str, most: int = _MOST_PIECES):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = Kept(self.ids, most)
        self.double = re.compile(r"\s\s").search
        self.mark = regex.compile(r"(?<![\p{L}\p{N}])[.,]").search
        self.young = re.compile(r"[^\0-\u052F]").search
        self.blank = re.compile(r"(?<=\S)(?= )")
        self.runs = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        # the printable stand-ins of bytes in a byte-level vocabulary
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}

    def ids(self, piece: str) -> bytes:
        if piece.isascii():
            if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
                return self.merged(piece.replace(" ", _BLANK))
        elif self.young(piece):
            ids = self.whole(piece)
            return struct.pack(f"<{len(ids)}I", *ids)
        runs = self.runs(piece)
        if len(runs) == 1:
            return self.merged(piece.encode().decode("latin1").translate(self.letters))
        return b"".join(map(self.kept.__getitem__, runs))

    def merged(self, letters: str) -> bytes:
        ids = [x.id for x in self.merge(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []

    def pieces(self, text: str) -> list[str]:
        if (not text.isascii() and self.young(text)) or "\0" in text or self.double(text) or self.mark(text):
            return self.blank.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(".", "\0.").replace(",", "\0,").split("\0")

    def parts(self, text: str) -> Iterator[str]:
        """A very long text in parts that end before a blank."""
        at = 0
        while len(text) - at > _PART and (cut := self.blank.search(text, at + _PART)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if any(token in text for token in self.added):
            return np.array(self.whole(text), np.uint32)
        found = [b"".join(map(self.kept.__getitem__, self.pieces(part))) for part in self.parts(text)]
        return np.frombuffer(b"".join(found), "<u4")


def _encoder(path: str) -> Encoder:
    """One a worker process, so that tasks which follow find the kept pieces."""
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]


def encode_frames(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch, frames, size = whole.slice(at, _ROWS), [], 0
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    frames.append(frame(pack(doc_id, np.append(encode(text.as_py()), np.uint32(end_id)))))
                    size += len(frames[-1])
                    if size > _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
                        frames, size = [], 0
                if frames:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    return run


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index rows of whole shards (shard, content)."""
    names = ["doc_id", "shard", "offset", "length", "before", "n_tokens", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    for batch in batches:
        for i in range(batch.num_rows):
            shard, content = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())
            rows, before = [], 0
            for offset, length, payload in unframe(content):
                doc_id, ids = unpack(payload)
                rows.append((doc_id, shard, offset, length, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content) of each shard, read by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")


def write_token_bins(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode docs(doc_id, text), write shards and index under path, return the index.

    Null and empty texts give the end id alone; a null doc_id sorts first; rows that share a doc_id are kept, ordered
    by a hash of their text, which also lets the range partitioning split them; other columns are not read, whatever
    their names. An empty table gives no shards and an empty index. The only shuffle is the range partitioning by doc_id;
    the number of shards follows the bytes of all texts, which one aggregate counts first.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # ids take no more than their text
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    framed = dealt.select("doc_id", "text").mapInArrow(encode_frames(tokenizer, end_id), "frame binary")
    # the cast keeps the bytes as they are; the text writer puts them out unchanged, with a newline after each record
    framed.select(F.col("frame").cast("string").alias("value")).write.option("compression", "none").text(f"{path}/shards")
    read_shards(spark, path).mapInArrow(index_rows, INDEX).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def digest(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record; start counts the ids of all records before it.

    Only the totals of the shards are summed in order: one row for each shard.
    """
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return index.join(starts, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(position, doc_id, ids) of all records in a seeded order of the whole corpus, by the offsets of the index.

    The order is that of a hash of (seed, shard, offset). Each shard is sliced at its own offsets, so no record is
    parsed to find another, and only then rows move.
    """
    order = F.xxhash64(F.lit(seed), F.col("shard"), F.col("offset"))
    plan = read_index(spark, path).select("shard", "offset", "length", order.alias("position"))
    slices = F.col("content").substr(F.col("offset").cast("int") + 1, F.col("length").cast("int"))
    records = read_shards(spark, path).join(plan, "shard").select("position", slices.alias("record"))

    def parse(batches):
        for batch in batches:
            ids, docs = [], []
            for record in batch.column(1).to_pylist():
                (_, _, payload), *_ = unframe(record)
                doc_id, tokens = unpack(payload)
                docs.append(doc_id)
                ids.append(tokens.astype("<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["position", "doc_id", "ids"])

    return records.mapInArrow(parse, "position long, doc_id long, ids array<int>").orderBy("position")


def op1_token_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bins_stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def token_bins_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(write_token_bins(docs, fresh_path(spark, "token-bins"), public_tokenizers.path("byte_bpe_50k.json")))
