"""Media columns as content-defined chunks.

A text's UTF-8 bytes, padded by spaces to frames of ``FRAME`` bytes, are the 8-bit
samples of a mono WAV file.  A rolling gear hash over the file's bytes cuts them into
chunks; equal chunks have equal digests, and a Spark join of the digests with the
first place of each (document and position) decides who stores a chunk.  The store
holds every distinct chunk once, compressed; manifests list a payload's chunks in
order.  Reading joins manifests with the store, puts the chunks in order, and verifies
each chunk's digest and the payload's.

The chunks that one payload alone has lie together in one row of the store; a chunk
that several payloads share is a row of its own.  So reading moves only the bytes of
payloads that share chunks.

Defined results: null text counts as empty, whose payload is one frame of spaces; equal
texts have equal values, and share all chunks; repeated rows give a row each; other
columns are ignored.  Texts of any length are stored whole; chunks have at most
``MOST`` bytes.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, cut, shared_path, small_batches

FRAME = 192
RATE = 8000
LEAST, MOST = 2 << 10, 64 << 10
#: A cut follows a byte where these bits of the gear hash are zero: about every 8 KiB.
MASK = np.uint64(((1 << 13) - 1) << 51)
#: Texts that the compressor's dictionary is trained on, their characters at most, and its size.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 8000, 112_640
LEVEL = 17
#: Bytes that a 64-bit gear hash remembers.
MEMORY = 64

U64 = np.uint64


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(FRAME, -(-len(data) // FRAME) * FRAME), b" ")


def header(n: int) -> bytes:
    """RIFF header of ``n`` unsigned 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


HEADER_BYTES = len(header(0))


def media(text: str | None) -> bytes:
    """The file that is stored: header and samples."""
    data = payload(text)
    return header(len(data)) + data


@functools.lru_cache(1)
def gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_091)).integers(0, 2**64, 256, U64, endpoint=False)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``.

    The gear hash at a byte is the sum of the last 64 bytes' gears, each shifted by its
    distance; six doublings compute it for all bytes at once.
    """
    n = len(data)
    if n <= LEAST:
        return [n]
    h = gear()[np.frombuffer(data, np.uint8)]
    for k in range(MEMORY.bit_length() - 1):
        d = 1 << k
        h[d:] = h[d:] + (h[:-d] << U64(d))
    places = np.flatnonzero((h & MASK) == 0) + 1
    out, at = [], 0
    for p in [*places.tolist(), n]:
        while p - at > MOST:
            at += MOST
            out.append(at)
        if p - at >= LEAST or p == n and p > at:
            out.append(p)
            at = p
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def features(data: bytes) -> str:
    """Level statistics of 8-bit samples: mean, spread, peak, zero crossings about the mean, and a 16-step histogram."""
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    total = int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int64) ** 2).sum())
    above = x.astype(np.int64) * n >= total
    crossings = int((above[1:] != above[:-1]).sum())
    steps = np.bincount(x >> 4, minlength=16).tolist()
    return f"sum={total};square={square};peak={int(x.max())};crossings={crossings};steps=" + ",".join(map(str, steps))


def dictionary(docs: DataFrame) -> bytes:
    """A zstd dictionary trained on at most ``SAMPLE`` texts (those of least hash) of at most ``SAMPLE_CHARS`` characters."""
    rows = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("text").withColumn("draw", F.xxhash64("text"))
    # the hashes are chosen first, so that no task sends texts that are not in the sample
    last = rows.select("draw").distinct().orderBy("draw").limit(SAMPLE).agg(F.max("draw")).first()[0]
    found = rows.where(F.col("draw") <= last).groupBy("draw").agg(F.min("text").alias("text")).collect() if last is not None else []
    texts = [r["text"].encode() for r in sorted(found)]
    if sum(map(len, texts)) < 8 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()


def squeezer(words: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)


def opener(words: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)


@functools.lru_cache(1)
def tools(words: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return squeezer(words), opener(words)


LISTED = pa.schema([("doc_id", pa.int64()), ("payload_id", pa.binary()), ("n_bytes", pa.int64()), ("digests", pa.list_(pa.binary()))])
BLOBS = pa.schema([("doc_id", pa.int64()), ("payload_id", pa.binary()), ("blob", pa.binary())])
#: A row of the store: what a payload alone has (``digest`` null), or one chunk that several payloads have.
STORED = pa.schema([("payload_id", pa.binary()), ("digest", pa.binary()), ("positions", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("blob", pa.binary())])
STORED_DDL = "payload_id binary, digest binary, positions array<int>, ends array<long>, digests array<binary>, blob binary"


def payload_id(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def write(docs: DataFrame, path: str) -> None:
    """Store ``docs`` under ``path``: documents with their chunk lists, chunks, and the dictionary of the compressor.

    Equal texts are one payload.  The first place of a chunk decides which row brings its bytes;
    the join with ``bring`` moves each payload once, compressed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = dictionary(rows)
    spark.createDataFrame([(bytearray(words),)], "words binary").write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(words)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            data = media(text)
            found.append((doc, payload_id(data), len((text or "").encode()), [digest(c) for c in chunks(data)]))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), LISTED, strict=True)], LISTED)

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [media(t) for t in batch["text"].to_pylist()]
        press = tools(shared.value)[0].compress
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(map(payload_id, data), pa.binary()), pa.array(map(press, data), pa.binary())], BLOBS)

    rows.mapInArrow(by_batch(LISTED, describe), "doc_id long, payload_id binary, n_bytes long, digests array<binary>").write.parquet(f"{path}/documents")
    manifests = cut(spark.read.parquet(f"{path}/documents").groupBy("payload_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id")).alias("d"), F.first("digests").alias("digests")).select("payload_id", "d.doc_id", "digests"))
    places = manifests.select("payload_id", F.posexplode("digests").alias("position", "digest"))
    owners = places.groupBy("digest").agg(F.min(F.struct("payload_id", "position")).alias("first"), (F.min("payload_id") != F.max("payload_id")).alias("lent"))
    owned = owners.groupBy(F.col("first.payload_id").alias("payload_id")).agg(F.collect_list(F.struct(F.col("first.position").alias("position"), "lent")).alias("own"))
    bring = manifests.join(owned.hint("merge"), "payload_id").select("payload_id", "doc_id", "digests", "own")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        press, expand = tools(shared.value)
        for key, blob, digests, own in zip(*(batch[c].to_pylist() for c in ("payload_id", "blob", "digests", "own")), strict=True):
            alone = sorted(o["position"] for o in own if not o["lent"])
            parts = chunks(expand.decompress(blob))
            ends = np.cumsum([len(p) for p in parts]).tolist()
            if len(alone) < len(parts):
                ends = np.cumsum([len(parts[i]) for i in alone]).tolist()
                blob = press.compress(b"".join(parts[i] for i in alone))
            if alone:  # a chunk that the payload repeats is stored at its first place
                found.append((key, None, alone, ends, digests, blob))
            found += [(None, digests[o["position"]], None, None, None, press.compress(parts[o["position"]])) for o in own if o["lent"]]
        return pa.record_batch([pa.array([r[i] for r in found], f.type) for i, f in enumerate(STORED)], STORED)

    blobs = rows.mapInArrow(by_batch(BLOBS, squeeze), "doc_id long, payload_id binary, blob binary").withColumnRenamed("doc_id", "from_doc")
    chosen = blobs.join(bring.hint("merge"), (blobs["payload_id"] == bring["payload_id"]) & blobs["from_doc"].eqNullSafe(bring["doc_id"])).select(blobs["payload_id"], "blob", "digests", "own")
    chosen.mapInArrow(by_batch(STORED, keep), STORED_DDL).write.option("compression", "none").parquet(f"{path}/chunks")


class Corrupt(ValueError):
    """Stored bytes that do not match their digest."""


def verified(key: bytes, parts: list[bytes], digests: list[bytes]) -> bytes:
    """The payload of the listed chunks in order, each found by its digest among ``parts``, if the whole agrees."""
    by_digest = {digest(p): p for p in parts}
    if not by_digest.keys() >= set(digests):
        raise Corrupt(key.hex())
    data = b"".join(map(by_digest.__getitem__, digests))
    if payload_id(data) != key:
        raise Corrupt(key.hex())
    return data


MEASURED = pa.schema([("payload_id", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
MEASURED_DDL = "payload_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measure(key: bytes, stored: bytes) -> tuple:
    data = stored[HEADER_BYTES:]
    return key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(data)


def payloads(spark: SparkSession, path: str, use: Callable[[bytes, bytes], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """``use(payload_id, payload)`` of every payload in the store, verified.

    A payload with chunks of its own alone is rebuilt where its row is read.  For the others, their
    lists are joined with the shared chunks and with their own rows, and grouped by payload: a group
    is one payload, however many share its chunks.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first()["words"]))
    store = spark.read.parquet(f"{path}/chunks")
    mine = store.where("digest is null")

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, expand = [], tools(shared.value)[1]
        for key, ends, digests, blob in zip(*(batch[c].to_pylist() for c in ("payload_id", "ends", "digests", "blob")), strict=True):
            data = expand.decompress(blob)
            found.append(use(key, verified(key, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], digests)))
        return pa.record_batch([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema)

    whole = mine.where("size(positions) = size(array_distinct(digests))").select("payload_id", "ends", "digests", "blob").mapInArrow(by_batch(schema, rebuild), ddl)
    partly = mine.where("size(positions) < size(array_distinct(digests))")
    lent = store.where("digest is not null").select("digest", "blob").dropDuplicates(["digest"])
    lists = spark.read.parquet(f"{path}/documents").groupBy("payload_id").agg(F.first("digests").alias("digests"))
    needed = lists.select("payload_id", "digests", F.posexplode("digests").alias("position", "digest")).join(lent.hint("merge"), "digest")
    empty = lambda t: F.lit(None).cast(t)
    rows = needed.select("payload_id", F.array("position").alias("positions"), empty("array<long>").alias("ends"), "digests", "blob")
    rows = rows.unionByName(partly.select("payload_id", "positions", "ends", "digests", "blob"))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        expand, key, digests = tools(shared.value)[1], bytes(group["payload_id"].iloc[0]), [bytes(d) for d in group["digests"].iloc[0]]
        parts: list[bytes] = []
        for ends, blob in zip(group["ends"], group["blob"], strict=True):
            data = expand.decompress(bytes(blob))
            ends = [len(data)] if ends is None else list(ends)
            parts += [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        return pd.DataFrame([use(key, verified(key, parts, digests))], columns=schema.names)

    return whole.unionByName(rows.groupBy("payload_id").applyInPandas(gather, ddl))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and text of every stored document (null texts come back empty)."""
    schema = pa.schema([("payload_id", pa.binary()), ("payload", pa.binary())])
    found = payloads(spark, path, lambda key, data: (key, data), schema, "payload_id binary, payload binary").dropDuplicates(["payload_id"])
    documents = spark.read.parquet(f"{path}/documents").select("doc_id", "payload_id", "n_bytes")
    return documents.join(found.hint("merge"), "payload_id").select("doc_id", F.expr(f"cast(substring(payload, {HEADER_BYTES + 1}, cast(n_bytes as int)) as string)").alias("text"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store ``docs``, read the store back, and measure every document's payload and media file."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "media")
    write(docs, path)
    found = payloads(spark, path, measure, MEASURED, MEASURED_DDL).dropDuplicates(["payload_id"])
    documents = spark.read.parquet(f"{path}/documents").select("doc_id", "payload_id", "n_bytes")
    return documents.join(found.hint("merge"), "payload_id").select("doc_id", "n_bytes", *MEASURED.names[1:])
