"""Token ids in binary files, in the order of doc_id.

Documents are dealt by ranges of doc_id and sorted; each task encodes its texts with
the ``tokenizers`` library, appends the end id, and packs whole documents into segments
of about ``SEGMENT_IDS`` ids.  A file (Parquet, so that any store that Spark writes to
can hold it) has a row for each segment: place, ids of its documents, their lengths and
the segment's bytes by ``rans``.  Reading needs nothing but the files.

A byte-level vocabulary cuts words before a space between two other characters, so only
words that a worker has not seen lately are encoded.  The library's own model merges
their parts; those that hold other letters than Latin ones go through its whole encoder.

Defined results: null text counts as empty and has the end id alone; a null doc_id
comes first; rows of equal doc_id stand in the order of their texts; repeated rows are
stored each; other columns are ignored; an empty table gives no segments.  A very long
text is one document in one segment, however many blocks that takes.
"""

from __future__ import annotations

import array
import gc
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .bpe import byte_letters
from .common import Recent, resident, shared_path, small_batches, trim, vocabulary

SEGMENT_IDS = 1 << 20
MEMO_WORDS, MEMO_STARTS = 600_000, 50_000

BETWEEN = re.compile(r"(?<=\S) (?=\S)")

#: Below this character, what is a letter or a number does not depend on the version of Unicode.
LATIN = 0x250
BEYOND = re.compile(f"[^\0-{chr(LATIN - 1)}]")


def byte_level_parts() -> re.Pattern:
    """What the library's byte-level pattern finds in texts of characters below ``LATIN``."""
    letter, number = ("".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
    space = r"\t-\r \x85\xa0"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


PARTS = byte_level_parts()
LETTERS = dict(enumerate(byte_letters()))
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Irregular(Exception):
    """A text has a space beside other white space."""


class ByteLevel:
    """The library's encoder for a byte-level vocabulary, with a memory of words."""

    def __init__(self, data: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        spec = json.loads(data)
        self.by_parts = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and BYTE_LEVEL.items() <= (spec["pre_tokenizer"] or {}).items()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.inner = Recent(self.after_space, MEMO_WORDS)
        self.outer = Recent(self.start, MEMO_STARTS)
        self.parts = Recent(self.part, MEMO_WORDS // 4)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def merged(self, letters: str) -> bytes:
        """Ids of what the library's pattern finds at once, given by the letters of its bytes."""
        return array.array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def part(self, text: str) -> bytes:
        return self.merged(text.encode().decode("latin-1").translate(LETTERS))

    def start(self, word: str) -> bytes:
        if word[-1:].isspace():
            raise Irregular
        return self.whole(word)

    def after_space(self, word: str) -> bytes:
        """Ids of a word with a space before it."""
        if self.by_parts and word.isalpha():
            if word.isascii():
                return self.merged(LETTERS[32] + word)
            if not BEYOND.search(word):
                return self.part(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise Irregular
        if not self.by_parts or BEYOND.search(word):
            return self.whole(" " + word)
        return b"".join(map(self.parts.__getitem__, PARTS.findall(" " + word)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out, inner = [], self.inner.__getitem__
        for text in texts:
            if any(a in text for a in self.added):
                out.append(self.whole(text))
                continue
            try:
                first, *rest = text.split(" ")
                out.append(self.outer[first] + b"".join(map(inner, rest)))
            except Irregular:
                first, *rest = BETWEEN.split(text)
                out.append(self.whole(first) + b"".join([self.whole(" " + w) if w[-1].isspace() else inner(w) for w in rest]))
        return out


def byte_level(data: bytes) -> ByteLevel:
    return resident(ByteLevel, data)


SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
SEGMENTS_DDL = "part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int) -> None:
    """Encode ``docs`` into files under ``path``."""
    spark = docs.sparkSession
    shared = vocabulary(spark, vocabulary_path)
    small_batches(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # a worker here makes no cycles, and many objects
        coder, end = byte_level(shared.value), np.array([end_id], "<u4").tobytes()
        part, segment = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        data: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, size
            lengths = [len(d) // 4 for d in data]
            row = [[part], [segment], [sum(lengths)], [ids[:]], [lengths], [rans.encode(np.frombuffer(b"".join(data), "<u4"))]]
            segment, size = segment + 1, 0
            ids.clear()
            data.clear()
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(row, SEGMENTS, strict=True)], SEGMENTS)

        try:
            for batch in batches:
                encoded = coder.encode([t or "" for t in batch["text"].to_pylist()])
                for doc, own in zip(batch["doc_id"].to_pylist(), encoded, strict=True):
                    ids.append(doc)
                    data.append(own + end)
                    size += len(own) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
            if data:
                yield flush()
        finally:
            gc.enable()
            trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(pack, SEGMENTS_DDL).write.option("compression", "none").parquet(path)


READ = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("in_segment", pa.int64()), ("ids", pa.binary())])
READ_DDL = "part int, segment int, doc_id long, in_segment long, ids binary"


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, and
    ids (little-endian unsigned 32-bit integers) or, with ``digest``, their CRC-32.

    Only segments' places and counts are summed up in order; ids stay where they are decoded.
    """
    small_batches(spark, 1)
    files = spark.read.schema(SEGMENTS_DDL).parquet(path)
    last = pa.field("ids_crc32", pa.int64()) if digest else READ.field("ids")
    schema = pa.schema([*list(READ)[:-1], pa.field("n_tokens", pa.int64()), last])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = rans.decode(row["data"]), np.array(row["lengths"], np.int64)
                if len(ids) != lengths.sum():
                    raise rans.Corrupt("lengths and ids disagree")
                ends = np.cumsum(lengths)
                own = [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                n = len(own)
                values = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array(own, pa.binary())
                yield pa.record_batch([pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), values], schema)

    ddl = READ_DDL.replace("ids binary", "n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))
    docs = files.select("part", "segment", "doc_ids", "lengths", "data").mapInArrow(unpack, ddl)
    # segments are summed up within their part, and parts (one for each writing task) among themselves
    before = "coalesce(sum({0}) over ({1} rows between unbounded preceding and 1 preceding), 0)"
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("part_start", F.expr(before.format("ids", "order by part"))).select("part", "part_start")
    starts = files.select("part", "segment", F.expr(before.format("n_ids", "partition by part order by segment")).alias("inside"))
    starts = starts.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("inside")).alias("before"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("in_segment")).alias("start"), "n_tokens", last.name)


def round_trip(docs: DataFrame, vocabulary_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write ``docs`` and read the files back: doc_id, start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-files")
    write(docs, path, vocabulary_path, end_id)
    return read(spark, path, digest=True)
