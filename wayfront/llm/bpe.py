"""BPE encoding and decoding with a contiguous rank array.

A short word is held as two parallel arrays: its parts, and for each boundary
between adjacent parts the rank of the merge that would delete it.  Encoding
scans the rank array for its minimum (the leftmost one on ties), deletes that
boundary and refreshes the ranks at its two neighbours, until no boundary has a
rank.  Words of more than 48 bytes keep their boundaries in a heap instead, as scans of
their arrays would take time that grows with their square.  Words repeat, so each worker
remembers a bounded number of them.

Defined results: null text counts as empty; an empty text has no ids and decodes
to the empty string; repeated rows and repeated ids give a row each; other
columns of the input are ignored.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, by_batch, resident, small_batches, vocabulary

NO_RANK = 1 << 60

#: Words that a worker remembers.
MEMO_WORDS = 150_000

#: Bytes of a short word, by the width of the block that it shares.
SHORT = (4, 8, 12, 16, 24, 48)

#: Words in a block of rank arrays.
BLOCK_WORDS = 8192

#: Characters of texts that are encoded together.
GROUP_CHARS = 1 << 19

#: Unicode White_Space, which the vocabulary's patterns mean by \s.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: ASCII separators that str.split() would take for white space.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` BPE file with word-end suffix and without decoder."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        v = self.vocab
        self.merge = {(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        parts = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(parts[0].replace(r"\s", WHITE_SPACE)).findall
        self.spaces = re.compile(f"[{WHITE_SPACE}]+")
        self.specials = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")")
        letters = byte_letters()
        self.first = [v.get(c) for c in letters]
        self.last = [v.get(c + self.suffix) for c in letters]
        size = 1 + max([*v.values(), *self.added.values()])
        self.token: list[bytes] = [b""] * size
        for text, i in [*v.items(), *self.added.items()]:
            self.token[i] = text.encode()
        pairs = sorted((a * size + b, rank, new) for (a, b), (rank, new) in self.merge.items())
        self.size = size
        self.pair, self.pair_rank, self.pair_new = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [], [])))
        self.all_letters = None not in self.first and None not in self.last
        self.by_word = Memo(self.encode_words, MEMO_WORDS)
        self.by_chunk = Memo(self.encode_chunks, MEMO_WORDS)

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        raw = word.encode()
        parts = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        parts = [p for p in parts if p is not None]
        if len(parts) > SHORT[-1]:
            return self.encode_long(parts)
        merge, none = self.merge.get, (NO_RANK, 0)
        found = [merge(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        ranks = [r for r, _ in found]
        while ranks and (least := min(ranks)) != NO_RANK:
            k = ranks.index(least)
            parts[k] = merge((parts[k], parts[k + 1]))[1]
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = merge((parts[k - 1], parts[k]), none)[0]
            if k < len(ranks):
                ranks[k] = merge((parts[k], parts[k + 1]), none)[0]
        return np.array(parts, "<u4").tobytes()

    def encode_long(self, parts: list[int]) -> bytes:
        """The same for the parts of a long word, by a heap of ranks over linked parts: scans of its array would grow with its square."""
        merge, n = self.merge.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (found := merge(pair))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # a part that is gone has the id -1; a boundary whose parts have changed since has another rank
            if j == n or not (found := merge((parts[i], parts[j]))) or found[0] != rank:
                continue
            parts[i], parts[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merge((parts[i], parts[k])):
                    heapq.heappush(heap, (found[0], i))
            if (h := before[i]) >= 0 and (found := merge((parts[h], parts[i]))):
                heapq.heappush(heap, (found[0], h))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """``encode_word`` of each; words of like length share one block of rank arrays."""
        out: list[bytes] = [b""] * len(words)
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        least = 0
        for width in SHORT:
            rows = np.flatnonzero((lengths > least) & (lengths <= width)) if self.all_letters else lengths[:0]
            least = width
            for at in range(0, len(rows), BLOCK_WORDS):
                some = rows[at : at + BLOCK_WORDS]
                for k, ids in zip(some.tolist(), self._block([raw[i] for i in some.tolist()], lengths[some], width), strict=True):
                    out[k] = ids
        for k in np.flatnonzero(lengths > SHORT[-1]).tolist() if self.all_letters else range(len(words)):
            out[k] = self.encode_word(words[k])
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of adjacent parts; parts below 0 stand for none."""
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.pair_rank[at], NO_RANK), self.pair_new[at]

    def _block(self, raw: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        n, col = len(raw), np.arange(width)
        letters = np.zeros((n, width), np.int64)
        inside = col < lengths[:, None]
        letters[inside] = np.frombuffer(b"".join(raw), np.uint8)
        parts = np.where(inside, np.array(self.first)[letters], -1)
        ends = (np.arange(n), lengths - 1)
        parts[ends] = np.array(self.last)[letters[ends]]
        counts = lengths.copy()
        done = np.full((n, width), -1, np.int64)
        if width > 1 and len(self.pair):
            ranks = self._rank(parts[:, :-1], parts[:, 1:])[0]
            alive = np.arange(n)
            while len(alive):
                k = ranks.argmin(1)
                row = np.arange(len(alive))
                on = ranks[row, k] != NO_RANK
                if not on.all():
                    done[alive[~on]] = parts[~on]
                    alive, parts, ranks, k = alive[on], parts[on], ranks[on], k[on]
                    row = row[: len(alive)]
                    if not len(alive):
                        break
                merged = self._rank(parts[row, k], parts[row, k + 1])[1]
                # delete the boundary: what stands to its right moves one place to the left
                parts = np.where(col[:-1] > k[:, None], parts[:, 1:], parts[:, :-1])
                parts = np.concatenate([parts, np.full((len(alive), 1), -1)], 1)
                parts[row, k] = merged
                kept = np.where(col[: width - 2] >= k[:, None], ranks[:, 1:], ranks[:, :-1])
                ranks = np.concatenate([kept, np.full((len(alive), 1), NO_RANK)], 1)
                ranks[row, k] = self._rank(merged, parts[row, k + 1])[0]
                left = np.flatnonzero(k)
                ranks[left, k[left] - 1] = self._rank(parts[left, k[left] - 1], merged[left])[0]
                counts[alive] -= 1
        else:
            done = parts
        data, size = done.astype("<u4").tobytes(), 4 * width
        return [data[i * size : i * size + 4 * c] for i, c in enumerate(counts.tolist())]

    def split(self, chunk: str) -> list[str]:
        """Pre-tokens of a run without white space: normalised and lower-cased letter by letter."""
        if chunk.isascii():
            chunk = chunk.lower()
            return [chunk] if chunk.isalpha() else self.words(chunk)
        chunk = unicodedata.normalize("NFC", chunk)
        chunk = "".join(map(str.lower, chunk)) if "\u03a3" in chunk else chunk.lower()
        return self.words(chunk)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self.split(c) for c in chunks]
        known = self.by_word.get({w for s in split for w in s})
        return [known[s[0]] if len(s) == 1 else b"".join([known[w] for w in s]) for s in split]

    def chunks(self, text: str) -> list[str]:
        if SEPARATORS.search(text):
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        out: list[bytes] = []
        size = 0
        split: list[list] = []
        for text in texts:
            pieces = self.specials.split(text) if any(a in text for a in self.added) else [text]
            split.append([self.chunks(p) if n % 2 == 0 else self.added[p] for n, p in enumerate(pieces)])
            size += len(text)
            if size > GROUP_CHARS:
                out.extend(self._encode(split))
                size, split = 0, []
        return out + self._encode(split)

    def _encode(self, split: list[list]) -> list[bytes]:
        known = self.by_chunk.get({c for pieces in split for p in pieces if isinstance(p, list) for c in p}).__getitem__
        return [b"".join([b"".join(map(known, p)) if isinstance(p, list) else np.array([p], "<u4").tobytes() for p in pieces]) for pieces in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the tokens with a space between two, as the file names no decoder."""
        return b" ".join(map(self.token.__getitem__, ids))


def coder(data: bytes) -> WordBpe:
    return resident(WordBpe, data)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every row of ``docs``."""
    spark = docs.sparkSession
    shared = vocabulary(spark, path)
    small_batches(spark)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(shared.value)
        ids = bpe.encode([t or "" for t in batch["text"].to_pylist()])
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(ids, pa.binary())], ENCODED)

    return docs.select("doc_id", "text").mapInArrow(by_batch(ENCODED, work), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encoded``."""
    spark = encoded.sparkSession
    shared = vocabulary(spark, path)
    small_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(shared.value)
        texts = [bpe.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in batch["ids"].to_pylist()]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], schema)

    return encoded.select("doc_id", "ids").mapInArrow(by_batch(schema, work), "doc_id long, text string")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: number and digest of the ids, and digest of what they decode to.

    Both directions run in one pass, so that ids and decoded text, which are
    larger than the input, stay in the worker's current batch.
    """
    spark = docs.sparkSession
    shared = vocabulary(spark, path)
    small_batches(spark)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(shared.value)
        counts, ids, back = [], [], []
        for data in bpe.encode([t or "" for t in batch["text"].to_pylist()]):
            counts.append(len(data) // 4)
            ids.append(hashlib.sha256(data).hexdigest())
            back.append(hashlib.sha256(bpe.decode(np.frombuffer(data, "<u4").tolist())).hexdigest())
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], DIGEST)

    return docs.select("doc_id", "text").mapInArrow(by_batch(DIGEST, work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
