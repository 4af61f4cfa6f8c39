"""Static range asymmetric numeral system over token ids.

One frequency table (the symbols of a segment, scaled to a sum of 2^20) is shared by
the segment's blocks.  A block holds up to ``LANES`` x ``STEPS`` ids, dealt over
interleaved lanes; each lane is a 64-bit state that is renormalised by 32-bit words.
A block begins at a checkpoint (its lanes' states and its offset among the words), so
blocks decode independently and all at once; each has a CRC-32 of its ids.

Layout, little-endian: magic, counts of ids, symbols and blocks (u64); symbols (u32),
frequencies (u32); first word of each block and the end (u64); CRC-32s (u32); states
(u64, by block and lane); words (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"WFRANS1\0"
HEAD = struct.Struct("<8s3Q")
BITS = 20
LANES, STEPS = 128, 256
LOW = np.uint64(1 << 32)
U64 = np.uint64


class Corrupt(ValueError):
    """The bytes are not what was written."""


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their frequencies (each from 1 to 2^20 - 1, in sum 2^20), and the symbol number of each id."""
    if int(ids.max()) < 1 << BITS:  # count instead of sorting
        seen = np.bincount(ids)
        symbols = np.flatnonzero(seen).astype(np.uint32)
        counts, number = seen[symbols], np.zeros(len(seen), np.int64)
        number[symbols] = np.arange(len(symbols))
        index = number[ids]
    else:
        symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    if len(symbols) == 1:  # a second symbol, never used, keeps the only one's frequency below 2^20
        symbols, counts = np.array([symbols[0], symbols[0] ^ 1], np.uint32), np.array([counts[0], 0])
    if len(symbols) > 1 << (BITS - 1):
        raise ValueError(f"{len(symbols)} symbols are too many for a table of 2^{BITS}")
    freq = 1 + counts * ((1 << BITS) - len(symbols)) // len(ids)
    freq[counts.argmax()] += (1 << BITS) - freq.sum()
    return symbols.astype(np.uint32), freq.astype(U64), index


def encode(ids: np.ndarray) -> bytes:
    """The bytes of a segment."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if not n:
        return HEAD.pack(MAGIC, 0, 0, 0)
    symbols, freq, index = table(ids)
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(U64)[:-1]
    size = LANES * STEPS
    blocks = -(-n // size)
    last = -(-(n - (blocks - 1) * size) // LANES)
    grid = np.full(blocks * size, freq.argmax(), np.int64)
    grid[:n] = index
    grid = grid.reshape(blocks, STEPS, LANES)
    x = np.full((blocks, LANES), LOW)
    words, owners = [], []
    for t in range(STEPS - 1, -1, -1):
        on = blocks if t < last else blocks - 1
        if not on:
            continue
        s, v = grid[:on, t], x[:on]
        f = freq[s]
        full = v >= f << U64(64 - BITS)
        words.append((v[full] & U64(0xFFFFFFFF)).astype(np.uint32))
        owners.append(np.repeat(np.arange(on, dtype=np.uint32), full.sum(1)))
        v = np.where(full, v >> U64(32), v)
        x[:on] = ((v // f) << U64(BITS)) + v % f + cum[s]
    word, owner = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
    word = word[np.argsort(owner, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=blocks))])
    crcs = [zlib.crc32(ids[b * size : (b + 1) * size]) for b in range(blocks)]
    parts = (symbols.astype("<u4"), freq.astype("<u4"), first.astype("<u8"), np.array(crcs, "<u4"), x.astype("<u8"), word.astype("<u4"))
    return HEAD.pack(MAGIC, n, len(symbols), blocks) + b"".join(p.tobytes() for p in parts)


def decode(data: bytes, from_block: int = 0, to_block: int | None = None) -> np.ndarray:
    """The ids of blocks ``from_block`` to ``to_block`` (all of them unless told otherwise), checked."""
    magic, n, n_symbols, blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise Corrupt("no segment of token ids")
    to_block = blocks if to_block is None else min(to_block, blocks)
    if from_block >= to_block:
        return np.zeros(0, "<u4")
    at = HEAD.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, dtype, count, at)
        at += found.nbytes
        return found

    symbols, freq = take("<u4", n_symbols), take("<u4", n_symbols).astype(U64)
    first, crcs = take("<u8", blocks + 1).astype(np.int64), take("<u4", blocks)
    x = take("<u8", blocks * LANES).reshape(blocks, LANES)[from_block:to_block].copy()
    words = np.frombuffer(data, "<u4", -1, at)
    if freq.sum() != 1 << BITS or len(words) != first[-1]:
        raise Corrupt("the table or the words are damaged")
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(U64)[:-1]
    slots = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq.astype(np.int64))
    size, count = LANES * STEPS, to_block - from_block
    last = -(-(n - (blocks - 1) * size) // LANES)
    out = np.zeros((count, STEPS, LANES), "<u4")
    next_word = first[from_block:to_block].copy()
    for t in range(STEPS):
        on = count if t < last or to_block < blocks else count - 1
        if not on:
            break
        v = x[:on]
        slot = v & U64((1 << BITS) - 1)
        s = slots[slot]
        out[:on, t] = symbols[s]
        v = freq[s] * (v >> U64(BITS)) + slot - cum[s]
        low = v < LOW
        which = next_word[:on, None] + np.cumsum(low, 1) - 1
        v[low] = (v[low] << U64(32)) | words[np.minimum(which[low], len(words) - 1)]
        next_word[:on] += low.sum(1)
        x[:on] = v
    if (x != LOW).any():  # every lane ends where its encoder began
        raise Corrupt("the words of a block are damaged")
    out = out.reshape(-1)[: min(n, to_block * size) - from_block * size]
    for b in range(count):
        if zlib.crc32(out[b * size : (b + 1) * size]) != crcs[from_block + b]:
            raise Corrupt(f"block {from_block + b} fails its checksum")
    return out
