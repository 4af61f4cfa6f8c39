"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the sum of a hashed word embedding and of hashed embeddings of its
character n-grams with word bounds.  Windows of ``WINDOW`` words, each starting
``STRIDE`` (half a window) after the one before, cover a whole text, so a stretch of
up to WINDOW - STRIDE + 1 words lies whole in one of them; forward and backward recurrent
units read each window, attention pools their states, and a logistic unit scores it.
A document's score is its highest window.  Training (numpy, Adam, on the driver) sees
whole documents and puts the loss on the highest window, as the labels speak of
documents and not of passages.

The sample for training is bounded: at most ``SAMPLE`` documents of each label, those
with the least hash of their id.  A text of more than ``SAMPLE_WORDS`` words gives a run
of so many of its words, at a place that the hash chooses; as a run may miss what a
document is labelled toxic for, long toxic texts are drawn after all shorter ones.  The
broadcast table has at most 2 * SAMPLE ids.  Scoring covers all windows of all texts.

Defined results: null and empty texts have one window without words, whose score comes
from the bias alone; labels that are null are left out; several labels of one document
count as its highest; if the labels lack one of the two classes, every score is the
share of toxic labels (0 without labels); repeated rows give a row each; other columns
are ignored by ``score``.  Equal texts get equal scores.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_VOCABULARY_BYTES, by_batch, resident, small_batches
from .minhash import mix64

WINDOW, STRIDE = 48, 24
WIDTH, HIDDEN = 10, 8
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 14
GRAMS = (4, 5)
THRESHOLD = 0.7

SAMPLE, SAMPLE_WORDS = 2000, 2500
#: Characters of a sampled text: a run of words beyond them is cut.
SAMPLE_CHARS = 32_768
#: Passes over the sample: at least ``EPOCHS``, more for small ones until there are ``STEPS`` steps, at most ``MOST_EPOCHS``.
EPOCHS, MOST_EPOCHS, STEPS = 6, 24, 700
RATE, BATCH_DOCS, SEED = 0.01, 32, 20_031
#: Characters of texts that are scored together.
GROUP_CHARS = 1 << 19

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Inputs(NamedTuple):
    words: np.ndarray  # row of the word table, for each word
    grams: np.ndarray  # row of the n-gram table, for each n-gram
    owners: np.ndarray  # offset of each word's first n-gram
    docs: np.ndarray  # offset of each text's first word, and the end


def read(texts: list[str]) -> Inputs:
    """Hashed inputs of all words of ``texts``."""
    data = [t.lower().encode() for t in texts]
    raw = np.frombuffer(b" " + b" ".join(data) + b" " * (max(GRAMS) + 1), np.uint8)
    inside = ~SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.cumsum([1] + [len(d) + 1 for d in data])
    docs = np.searchsorted(starts, offsets)
    if not len(starts):
        return Inputs(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), docs)
    letters = raw.astype(U64)
    letters[~inside] = 1
    positions = np.arange(len(raw))
    codes = mix64(letters + (U64(257) * (positions - starts[np.maximum(np.searchsorted(starts, positions, "right") - 1, 0)]).astype(U64)))
    codes[~inside] = 0
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(codes, dtype=U64)])
    words = (mix64(sums[ends] - sums[starts]) % U64(WORD_ROWS)).astype(np.int32)
    # n-grams start at the space before a word, and end with the space after it or with the window
    found, rows = [], []
    for n in GRAMS:
        h = np.zeros(len(raw) - n + 1, U64)
        for k in range(n):
            h = h * U64(0x100000001B3) + letters[k : len(raw) - n + 1 + k]
        first = starts - 1
        last = np.maximum(ends - n, first)
        counts = last - first + 1
        base = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        at = base + np.arange(len(base))
        found.append(counts)
        rows.append((mix64(h[np.minimum(at, len(h) - 1)] * U64(31) + U64(n)) % U64(GRAM_ROWS)).astype(np.int32))
    total = found[0] + found[1]
    owners = np.concatenate([[0], np.cumsum(total)])
    grams = np.empty(owners[-1], np.int32)
    shift = owners[:-1].copy()
    for counts, own in zip(found, rows, strict=True):
        base = np.repeat(shift - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        grams[base + np.arange(len(base))] = own
        shift += counts
    return Inputs(words, grams, owners, docs)


def windows(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window; a text without words has one of length 0."""
    lengths = np.diff(docs)
    counts = np.maximum(1, -(-np.maximum(lengths - WINDOW, 0) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = docs[:-1][owner] + nth * STRIDE
    return first, np.minimum(WINDOW, docs[1:][owner] - first), owner


SHAPES = {"word": (WORD_ROWS, WIDTH), "gram": (GRAM_ROWS, WIDTH), **{f"{p}_{d}": s for d in "fb" for p, s in (("in", (WIDTH, 3 * HIDDEN)), ("state", (HIDDEN, 3 * HIDDEN)), ("bias", (3 * HIDDEN,)))}, "look": (2 * HIDDEN,), "out": (2 * HIDDEN,), "off": (1,)}


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    scale = {"word": 0.05, "gram": 0.05, "off": 0.0, "bias_f": 0.0, "bias_b": 0.0}
    return {k: (rng.standard_normal(s) * scale.get(k, 0.3)).astype(np.float32) for k, s in SHAPES.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def embed(p: dict, x: Inputs) -> np.ndarray:
    """One input row for each word."""
    grams = np.add.reduceat(p["gram"][x.grams], x.owners[:-1], 0) if len(x.words) else np.zeros((0, WIDTH), np.float32)
    return p["word"][x.words] + grams


def run_direction(p: dict, d: str, rows: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, window, hidden); ``index`` and ``mask`` have a row for each time step."""
    given = rows @ p[f"in_{d}"] + p[f"bias_{d}"]
    h = np.zeros((index.shape[1], HIDDEN), np.float32)
    states, tape = np.empty((*index.shape, HIDDEN), np.float32), []
    steps = range(len(index)) if d == "f" else range(len(index) - 1, -1, -1)
    u = p[f"state_{d}"]
    for t in steps:
        x = given[index[t]]
        gates = sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        reset = r * h
        n = np.tanh(x[:, 2 * HIDDEN :] + reset @ u[:, 2 * HIDDEN :])
        new = h + mask[t][:, None] * z * (n - h)
        if keep:
            tape.append((t, h, z, r, n, reset))
        states[t] = h = new
    return states, tape


def forward(p: dict, rows: np.ndarray, first: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Logits of windows."""
    steps = np.arange(max(1, int(lengths.max(initial=0))))[:, None]
    mask = (steps < lengths).astype(np.float32)
    index = np.minimum(first + steps, max(len(rows) - 1, 0))
    if not len(rows):
        rows = np.zeros((1, WIDTH), np.float32)
    ahead, tape_f = run_direction(p, "f", rows, index, mask, keep)
    back, tape_b = run_direction(p, "b", rows, index, mask, keep)
    states = np.concatenate([ahead, back], 2)
    squashed = np.tanh(states)
    look = np.where(mask > 0, squashed @ p["look"], -1e9)
    weight = np.exp(look - look.max(0)) * mask
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tw,twh->wh", weight, states)
    return pooled @ p["out"] + p["off"], (index, mask, states, squashed, weight, pooled, tape_f, tape_b)


def backward(p: dict, rows: np.ndarray, memory: tuple, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters beyond the embeddings, and of ``rows``."""
    index, mask, states, squashed, weight, pooled, *tapes = memory
    g = {"out": pooled.T @ d_logit, "off": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("twh,wh->tw", states, d_pooled)
    d_look = weight * (d_weight - (weight * d_weight).sum(0))
    g["look"] = np.einsum("tw,twh->h", d_look, squashed)
    d_states += d_look[:, :, None] * p["look"] * (1 - squashed**2)
    d_rows = np.zeros((len(rows), WIDTH), np.float32)
    for d, tape, part in (("f", tapes[0], slice(0, HIDDEN)), ("b", tapes[1], slice(HIDDEN, None))):
        u = p[f"state_{d}"]
        d_u, d_h = np.zeros_like(u), np.zeros((index.shape[1], HIDDEN), np.float32)
        d_given = np.zeros((len(rows), 3 * HIDDEN), np.float32)
        for t, h, z, r, n, reset in reversed(tape):
            d_h = d_h + d_states[t][:, part]
            m = mask[t][:, None]
            d_n = d_h * m * z * (1 - n**2)
            d_z = d_h * m * (n - h) * z * (1 - z)
            d_reset = d_n @ u[:, 2 * HIDDEN :].T
            d_r = d_reset * h * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r], 1)
            d_u[:, : 2 * HIDDEN] += h.T @ d_gates
            d_u[:, 2 * HIDDEN :] += reset.T @ d_n
            np.add.at(d_given, index[t], np.concatenate([d_gates, d_n], 1))
            d_h = d_h * (1 - m * z) + d_reset * r + d_gates @ u[:, : 2 * HIDDEN].T
        g[f"state_{d}"], g[f"bias_{d}"], g[f"in_{d}"] = d_u, d_given.sum(0), rows.T @ d_given
        d_rows += d_given @ p[f"in_{d}"].T
    return g, d_rows


def train(texts: list[str], labels: np.ndarray, epochs: int | None = None, seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters fitted to documents' labels (1 toxic, 0 not)."""
    rng = np.random.default_rng(seed)
    p = start(rng)
    if not len(texts) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        p["out"][:] = 0
        p["off"][:] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return p
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    step, order = 0, rng.permutation(len(texts))
    groups = [order[at : at + BATCH_DOCS] for at in range(0, len(order), BATCH_DOCS)]
    inputs = [read([texts[i] for i in some]) for some in groups]
    epochs = epochs or int(np.clip(STEPS // len(groups), EPOCHS, MOST_EPOCHS))
    for epoch in range(epochs):
        for turn in rng.permutation(len(groups)):
            some, x = groups[turn], inputs[turn]
            first, lengths, owner = windows(x.docs)
            rows = embed(p, x)
            logits, _ = forward(p, rows, first, lengths)
            # the highest window of each text bears the loss, and one at random of the texts that are not toxic
            by_score = np.lexsort((logits, owner))
            best = by_score[np.flatnonzero(np.diff(owner[by_score], append=len(some)))]
            y = labels[some][owner[best]].astype(np.float32)
            extra = rng.integers(0, len(first), len(some))
            extra = extra[labels[some][owner[extra]] == 0]
            best, y = np.concatenate([best, extra]), np.concatenate([y, np.zeros(len(extra), np.float32)])
            logits, memory = forward(p, rows, first[best], lengths[best], keep=True)
            g, d_rows = backward(p, rows, memory, ((sigmoid(logits) - y) / len(best)).astype(np.float32))
            g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
            used = np.flatnonzero(d_rows.any(1))
            if len(used):
                counts = x.owners[used + 1] - x.owners[used]
                at = np.repeat(x.owners[used] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                np.add.at(g["word"], x.words[used], d_rows[used])
                np.add.at(g["gram"], x.grams[at], np.repeat(d_rows[used], counts, 0))
            step += 1
            rate = RATE * (1 - epoch / epochs) ** 0.5 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-6)).astype(np.float32)
    return p


def scores(p: dict, texts: list[str]) -> np.ndarray:
    """The highest window's probability of each text; windows of all texts are scored, in groups of bounded size."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_CHARS):
            size += len(texts[end])
            end += 1
        x = read(texts[at:end])
        first, lengths, owner = windows(x.docs)
        rows = embed(p, x)
        best = np.full(end - at, -np.inf)
        order = np.argsort(lengths, kind="stable")  # short windows run few steps
        for k in range(0, len(order), 4096):
            some = order[k : k + 4096]
            np.maximum.at(best, owner[some], forward(p, rows, first[some], lengths[some])[0].astype(float))
        out[at:end] = sigmoid(best)
        at = end
    return out


def pack(p: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def unpack(data: bytes) -> dict[str, np.ndarray]:
    return resident(load, data)


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Train on a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (count > SAMPLE_WORDS).alias("long")).groupBy("doc_id").agg(F.max("long").alias("long"))
    known = known.join(sizes, "doc_id").withColumn("draw", F.xxhash64("doc_id"))
    drawn = known.where("toxic = 0").orderBy("draw").limit(SAMPLE).unionByName(known.where("toxic = 1").orderBy("long", "draw").limit(SAMPLE)).drop("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"))
    run = F.array_join(F.slice(words, F.pmod("draw", count - (SAMPLE_WORDS - 1)).cast("int") + 1, SAMPLE_WORDS), " ")
    # rows of the same id are one document: the least of their texts
    sample = rows.withColumn("text", F.substring(F.when(count > SAMPLE_WORDS, run).otherwise(F.col("text")), 1, SAMPLE_CHARS)).groupBy("draw", "toxic").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda r: (r["draw"], r["text"]))
    return train([r["text"] for r in sample], np.array([r["toxic"] for r in sample], np.int64))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    data = pack(model)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the model is too large to be broadcast")
    shared = spark.sparkContext.broadcast(data)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scores(unpack(shared.value), [t or "" for t in batch["text"].to_pylist()])
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(found, pa.float64())], SCORED)

    out = docs.select("doc_id", "text").mapInArrow(by_batch(SCORED, work), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(pack(model))
    schema = docs.schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scores(unpack(shared.value), [t or "" for t in batch["text"].to_pylist()])
        return batch.filter(pa.array(found < THRESHOLD))

    return docs.mapInArrow(by_batch(schema, work), schema)
