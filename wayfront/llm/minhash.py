"""Near duplicates by b-bit MinHash.

Each document's shingle set gives 512 minima.  Before they are cut to their low bits,
the first 128 make the keys of 32 bands, four at a time; then 2 bits of each are packed
into sixteen longs.  Documents with equal sets are one class.  In every bucket of a band
one class leads, the one whose buckets are largest together: where many texts are near
copies of one, that one.  The others are compared with it, by the collision-corrected
estimate from bit counts, and then on the full sets.  The heaviest leader that a class is
linked with is its root.

A bucket whose classes have several roots stays open.  If many of them haven't its main
root, it is dealt into finer buckets, by the bits of more functions, which
are led in the same way; that only adds links.  Every bucket that is open then is compared whole: classes without a bucket's main root meet all its
classes, by estimates, in blocks of bounded size, and those that may reach the threshold
are confirmed on full sets, in blocks again.  Neither step sends pairs on: the first one
says which class has to visit which cell (the classes whose first leader is the same),
the second one gives a visitor's links, one to each root.  Links give components.  So no link between
classes that share a bucket is lost, and no bucket is paired out that leaders settle.

Keys that many rows share are joined by merge joins, whose hot keys adaptive execution
splits, and are aggregated before they are shuffled.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8^4)^32 < 5e-8, and
its estimate falls below ``LEAST_ESTIMATE`` with a probability below 1e-6, whatever the
size of the input and its buckets.

Defined results: null and empty texts, and texts without words, have no shingles and
link with nothing; a text with fewer words than a shingle has one, its whole sequence;
equal sets are linked; repeated rows are linked like copies; a row with null doc_id
never names a component that has another id; other columns are ignored.  Texts of any
length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, cut, drop, groups, partitions, resident, small_batches, tasks_for
from .components import components

HASHES = 512
BANDS, ROWS = 32, 4
LOW_BITS = 2
#: Estimates below this are not confirmed: about five standard deviations below 0.8.
LEAST_ESTIMATE = 0.7
#: Members of a bucket whose estimates are compared in one block; a bucket with more of them without its main root is led by finer ones first.
BLOCK = 1024
#: Hashes of full sets on one side of a group.
BLOCK_HASHES = 1 << 16
#: The first of the packed longs that deal a wide bucket anew; those before are of the bands' functions.
FIRST_LONG = 4
#: Full sets of one side of a group of pairs.
SETS = 64
#: Bytes of texts that are hashed at once.
GROUP_BYTES = 1 << 20
#: Bytes of a text, cut at white space, that are hashed at once.
LONGEST = 2 << 20

SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants() -> dict[str, np.ndarray]:
    return resident(drawn)


def drawn() -> dict[str, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20_021))
    n = LONGEST + 1
    base = int(draw.integers(0, 2**63)) * 2 + 1
    powers = np.full(n + 1, U64(base))
    powers[0] = 1
    inverse = np.full(n + 1, U64(pow(base, -1, 2**64)))
    inverse[0] = 1
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return {"letters": draw.integers(0, 2**64, 256, U64, endpoint=False), "powers": np.multiply.accumulate(powers), "inverse": np.multiply.accumulate(inverse), "space": space,
            "first": draw.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), "second": draw.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), "bands": draw.integers(0, 2**64, (BANDS, ROWS + 1), U64, endpoint=False)}


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut at white space into parts of at most ``LONGEST`` bytes; a longer word is a part of its own."""
    at = 0
    while len(data) - at > LONGEST:
        end = max(data.rfind(space, at, at + LONGEST) for space in SPACES)
        if end <= at:
            after = [k for space in SPACES if (k := data.find(space, at + 1)) > 0]
            end = min(after, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and 64-bit hashes of the words of ``data`` (at most ``LONGEST`` bytes, or else one word)."""
    c = constants()
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if n > LONGEST:
        return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(data.strip(), digest_size=8).digest(), U64)
    inside = ~c["space"][raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(c["letters"][raw] * c["powers"][:n], dtype=U64)])
    return starts, mix64((sums[ends] - sums[starts]) * c["inverse"][starts] + (ends - starts).astype(U64))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        if not group:
            return
        if len(group) > 1:
            starts, words = word_hashes(b" ".join(group))
            cuts = np.searchsorted(starts, np.cumsum([0] + [len(g) + 1 for g in group]))
        else:
            words = np.concatenate([word_hashes(p)[1] for p in pieces(group[0])])
            cuts = np.array([0, len(words)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = words[a:b]
            if len(own) > size:
                n = len(own) - size + 1
                hashes = np.zeros(n, U64)
                for k in range(size):
                    hashes = mix64(hashes * U64(0x9E3779B97F4A7C15) + own[k : k + n])
                out.append(np.unique(hashes))
            elif len(own):
                hashes = np.zeros(1, U64)
                for k in range(len(own)):
                    hashes = mix64(hashes * U64(0x9E3779B97F4A7C15) + own[k : k + 1])
                out.append(hashes)
            else:
                out.append(own)
        group.clear()

    used = 0
    for text in texts:
        data = text.encode().lower()
        if used + len(data) + 1 > GROUP_BYTES:
            flush()
            used = 0
        group.append(data)
        used += len(data) + 1
    flush()
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of nonempty sets, one row for each of the hash functions."""
    c = constants()
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(sets)), np.uint32)
    for k in range(HASHES):
        v = x * c["first"][k]
        v ^= v >> np.uint32(15)
        v *= c["second"][k]
        out[k] = np.minimum.reduceat(v, starts)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band (column) of each set (row)."""
    c = constants()["bands"]
    wide = low[: BANDS * ROWS].astype(U64).reshape(BANDS, ROWS, -1)
    keys = c[:, ROWS][:, None] + sum(wide[:, r, :] * (c[:, r][:, None] | U64(1)) for r in range(ROWS))
    return mix64(mix64(keys) + c[:, 0][:, None]).T.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima, packed into four longs for each set."""
    bits = (low ^ (low >> np.uint32(16))).astype(U64) & U64((1 << LOW_BITS) - 1)
    per = 64 // LOW_BITS
    shifts = (np.arange(per, dtype=U64) * U64(LOW_BITS))[None, :, None]
    return (bits.reshape(HASHES // per, per, -1) << shifts).sum(1, dtype=U64).T.view(np.int64)


LONGS = HASHES * LOW_BITS // 64
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def sign(docs: DataFrame, size: int) -> DataFrame:
    """Per row of ``docs``: set size, class (digest of the set), packed bits and band keys; nulls without shingles."""
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([t or "" for t in batch["text"].to_pylist()], size)
        full = [s for s in sets if len(s)]
        bits, bands = np.zeros((0, LONGS), np.int64), np.zeros((0, BANDS), np.int64)
        if full:
            low = minima(full)
            bits, bands = packed(low), band_keys(low)
        row, at = [], 0
        for s in sets:
            row.append(at if len(s) else None)
            at += len(s) > 0
        take = pa.array(row, pa.int64())
        listed = lambda x, n: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), n).cast(pa.list_(pa.int64())).take(take)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), listed(bits, LONGS), listed(bands, BANDS)], SIGNED)

    return docs.select("doc_id", "text").mapInArrow(by_batch(SIGNED, work), "doc_id long, n_shingles long, class binary, bits array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from bit counts, corrected for chance collisions of low bits."""
    odd = F.lit(0x5555555555555555).cast("long")
    apart = [a[i].bitwiseXOR(b[i]) for i in range(LONGS)]
    missed = sum(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd)) for x in apart)
    chance = 1 / (1 << LOW_BITS)
    return (1 - missed / F.lit(float(HASHES)) - chance) / (1 - chance)


def _possible(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b, weight) of classes whose sizes and bits allow a link."""
    side = lambda s: classes.select(F.col("class").alias(s), F.col("bits").alias(f"bits_{s}"), F.col("n_shingles").alias(f"n_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    near = (100 * F.least("n_a", "n_b") >= per_cent * F.greatest("n_a", "n_b")) & (estimate(F.col("bits_a"), F.col("bits_b")) >= LEAST_ESTIMATE)
    return both.where(near).select("a", "b", "weight")


LINKED = pa.schema([("a", pa.binary()), ("b", pa.binary())])
CONFIRMED = pa.schema([*LINKED, ("weight", pa.int64())])
SETS_SCHEMA = pa.schema([("class", pa.binary()), ("hashes", pa.binary())])


def _sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """class and hashes (its full set) of the ``wanted`` classes, from the texts of their owners."""
    owners = wanted.join(classes.select("class", "owner"), "class")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [s.tobytes() for s in shingle_sets([t or "" for t in batch["text"].to_pylist()], size)]
        own = [hashlib.blake2b(s, digest_size=16).digest() for s in out]
        asked = batch["class"].to_pylist() if "class" in batch.schema.names else own
        good = [i for i, (c, d) in enumerate(zip(asked, own, strict=True)) if c == d]
        return pa.record_batch([pa.array([own[i] for i in good], pa.binary()), pa.array([out[i] for i in good], pa.binary())], SETS_SCHEMA)

    found = docs.join(owners.where("owner is not null").withColumnRenamed("owner", "doc_id"), "doc_id")
    full = found.select("class", "text").mapInArrow(by_batch(SETS_SCHEMA, sets), "class binary, hashes binary")
    if not owners.where("owner is null").isEmpty():  # classes of which no row has an id: one row each, by the set itself
        nameless = docs.where("doc_id is null").select("text").mapInArrow(by_batch(SETS_SCHEMA, sets), "class binary, hashes binary").dropDuplicates(["class"])
        full = full.unionByName(nameless.join(owners.where("owner is null").select("class"), "class", "left_semi"))
    return full


def _confirmed(pairs: DataFrame, full: DataFrame, classes: int, per_cent: int) -> DataFrame:
    """Pairs (a, b, weight) whose full sets reach the threshold.

    Classes are dealt into blocks of about ``SETS``; a group has the sets of two blocks, once each,
    and their pairs.  So a set is sent once for each other block, not once for each pair.
    """
    n = partitions(pairs.sparkSession)
    blocks = max(1, -(-classes // SETS))
    block = lambda c: F.expr(f"pmod(xxhash64({c}), {blocks})")
    dealt = pairs.select(block("a").alias("p"), block("b").alias("q"), "a", "b", "weight")
    wanted = dealt.select("p", "q", F.col("a").alias("class")).unionByName(dealt.select("p", "q", F.col("b").alias("class"))).distinct()
    rows = wanted.join(full, "class").select("p", "q", F.col("class").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(0).cast("long").alias("weight"), "hashes")
    rows = rows.unionByName(dealt.withColumn("hashes", F.lit(None).cast("binary")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = None, {}
        for batch in batches:
            good = []
            for p, q, a, b, weight, hashes in zip(*(batch[c].to_pylist() for c in ("p", "q", "a", "b", "weight", "hashes")), strict=True):
                if group != (p, q):
                    group, known = (p, q), {}
                if b is None:
                    known[a] = np.frombuffer(hashes, U64)
                elif a in known and b in known:  # a class is unknown only if its document is gone
                    x, y = known[a], known[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= per_cent * (len(x) + len(y) - both):
                        good.append((a, b, weight))
            yield pa.record_batch([pa.array([g[i] for g in good], f.type) for i, f in enumerate(CONFIRMED)], CONFIRMED)

    # within a group the sets come first
    ordered = rows.repartition(n, "p", "q").sortWithinPartitions("p", "q", F.col("b").isNotNull())
    return ordered.mapInArrow(check, "a binary, b binary, weight long")


def _heads(links: DataFrame) -> DataFrame:
    """class and root: the heaviest leader that each class is linked with, or that leader's own.

    A leader is heavier than those that it leads, so there is no circle.  Classes of one
    component may have several roots; they are told apart less often than that in
    buckets that the same classes lead, and a bucket that seems open is compared once more.
    """
    up = links.groupBy(F.col("a").alias("class")).agg(F.max(F.struct("weight", "b")).alias("m")).select("class", F.col("m.b").alias("root"))
    above = up.select(F.col("class").alias("root"), F.col("root").alias("top"))
    return up.join(above, "root", "left").select("class", F.coalesce("top", "root").alias("root"))


def _stars(shared: DataFrame) -> DataFrame:
    """a, b, bands and weight: classes and the leaders of their buckets, and in how many buckets they meet.

    ``shared`` has key, class and weight.  The heaviest class of a bucket leads it.
    """
    leaders = shared.groupBy("key").agg(F.max(F.struct("weight", "class")).alias("top")).select("key", F.col("top.class").alias("leader"), F.col("top.weight").alias("leader_weight"))
    met = shared.join(leaders, "key").where("class <> leader")
    return met.groupBy(F.col("class").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("bands"), F.first("leader_weight").alias("weight"))


def _weighed(keys: DataFrame) -> DataFrame:
    """``keys`` (key, class) of buckets with several classes, and each class's weight: the sizes of its buckets together.

    A text that many others were copied from shares more bands with them than they do
    with each other, so it weighs most.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return keys.join(sizes, "key").select("key", "class", F.sum("members").over(Window.partitionBy("class")).alias("weight"))


def _finer(members: DataFrame) -> DataFrame:
    """key and class: a bucket's classes dealt anew, by the packed bits of sixteen more functions at a time."""
    halves = [F.xxhash64("key", F.lit(2 * i + h), F.shiftrightunsigned(F.col("bits")[i], 32 * h).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))) for i in range(FIRST_LONG, LONGS) for h in (0, 1)]
    return members.select("class", F.explode(F.array(*halves)).alias("key")).distinct()


def _open(keys: DataFrame, known: DataFrame) -> DataFrame:
    """key, class, root, cell, members, major and major_n of buckets whose classes have more than one root; major is the root of most of them."""
    named = keys.join(known, "class", "left").select("key", "class", F.coalesce("root", "class").alias("root"), F.coalesce("cell", "class").alias("cell"))
    counts = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("major"), F.sum("n").alias("members"), F.count("*").alias("roots")).where("roots > 1")
    return named.join(sizes.select("key", "members", F.col("major.root").alias("major"), F.col("major.n").alias("major_n")), "key")


VISITS = pa.schema([("cell", pa.binary()), ("class", pa.binary()), ("visitor", pa.bool_())])


def _visits(members: DataFrame, per_cent: int) -> DataFrame:
    """cell, class and visitor: which classes have to be compared with which cell's, by their estimates.

    Most members of an open bucket share a root.  Only the others, its minor
    members, can have links that are missing: they meet all members.  Minor members and
    all members are each cut into blocks of about ``BLOCK``, and a group holds one block
    of either kind, however large its bucket is.  What is sent on is not the pairs but
    which class visits which cell, and whom it may meet there.
    """
    n = partitions(members.sparkSession)
    lists = members.groupBy("class").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    dealt = members.join(lists, "class").withColumn("blocks", F.expr(f"(members + {BLOCK - 1}) div {BLOCK}")).withColumn("minor_blocks", F.expr(f"(members - major_n + {BLOCK - 1}) div {BLOCK}")).withColumn("minor", F.col("root") != F.col("major"))
    row = ["key", "class", "root", "cell", "bits", "n_shingles", "keys"]
    everyone = dealt.select(*row, F.lit(False).alias("minor"), F.expr("pmod(xxhash64(class), blocks)").alias("block"), F.explode(F.expr("sequence(0L, minor_blocks - 1)")).alias("minor_block"))
    few = dealt.where("minor").select(*row, F.lit(True).alias("minor"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.expr("pmod(xxhash64(class, 1), minor_blocks)").alias("minor_block"))
    odd = U64(0x5555555555555555)
    chance = 2.0**-LOW_BITS
    # 1 - missed / HASHES >= chance + (1 - chance) * LEAST_ESTIMATE
    most_missed = HASHES * (1 - chance) * (1 - LEAST_ESTIMATE)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "key", "block", "minor_block"):
            minor = group["minor"].to_numpy()
            left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
            if not len(left) or not len(right):
                continue
            bits = np.ascontiguousarray(group["bits"].combine_chunks().flatten().to_numpy()).reshape(-1, LONGS).view(U64)
            size = group["n_shingles"].to_numpy()
            name, cell = group["class"].to_pylist(), group["cell"].to_pylist()
            root = group["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            # which lesser open buckets each member is in
            lists = group["keys"].combine_chunks()
            owner, held = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            lesser = held < group["key"][0].as_py()
            owner, (names, place) = owner[lesser], np.unique(held[lesser], return_inverse=True)
            member = np.zeros((len(name), len(names)), np.float32)
            member[owner, place] = 1
            member = member[:, member.sum(0) > 1]
            out = set()
            for at in range(0, len(left), 64):
                some = left[at : at + 64]
                apart = bits[some][:, None, :] ^ bits[right][None, :, :]
                missed = np.bitwise_count((apart | (apart >> U64(1))) & odd).sum(2)
                good = (missed <= most_missed) & (root[some][:, None] != root[right][None, :])
                good &= member[some] @ member[right].T == 0
                good &= 100 * np.minimum(size[some][:, None], size[right][None, :]) >= per_cent * np.maximum(size[some][:, None], size[right][None, :])
                for i, j in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
                    x, y = some[i], right[j]
                    out.add((cell[y], name[x], True))
                    out.add((cell[y], name[y], False))
            if out:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), VISITS, strict=True)], VISITS)

    ordered = everyone.unionByName(few).repartition(n, "key", "block", "minor_block").sortWithinPartitions("key", "block", "minor_block")
    return ordered.mapInArrow(compare, "cell binary, class binary, visitor boolean").distinct()


def _rest(visits: DataFrame, full: DataFrame, classes: DataFrame, known: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) between a cell's visitors and the classes that they may meet there, on full sets.

    Both sides of a cell are cut into blocks of about ``BLOCK_HASHES`` hashes.  A group
    holds one block of each, and gives at most one link of a visitor to each root.
    """
    n = partitions(visits.sparkSession)
    # a visitor that others may meet, too, is here twice
    rows = visits.join(classes.select("class", "n_shingles"), "class").join(known.select("class", "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    sums = rows.groupBy("cell").agg(*[F.expr(f"1 + sum(if({w}, n_shingles, 0L)) div {BLOCK_HASHES}").alias(c) for c, w in (("blocks", "not visitor"), ("visitor_blocks", "visitor"))])
    dealt = rows.join(sums, "cell").join(full, "class")
    row = ["cell", "class", "root", "visitor", "hashes"]
    rows = dealt.where("not visitor").select(*row, F.expr("pmod(xxhash64(class), blocks)").alias("block"), F.explode(F.expr("sequence(0L, visitor_blocks - 1)")).alias("visitor_block"))
    rows = rows.unionByName(dealt.where("visitor").select(*row, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.expr("pmod(xxhash64(class, 1), visitor_blocks)").alias("visitor_block")))
    rows = rows.withColumn("cell", F.xxhash64("cell"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "cell", "block", "visitor_block"):
            visitor, name = group["visitor"].to_numpy(), group["class"].to_pylist()
            root = group["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            sets = [np.frombuffer(h, U64) for h in group["hashes"].to_pylist()]
            home = np.flatnonzero(~visitor)
            if not len(home) or len(home) == len(sets):
                continue
            size = np.array([len(sets[k]) for k in home])
            owner = np.repeat(np.arange(len(home)), size)
            every = np.concatenate([sets[k] for k in home])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            good = []
            for k in np.flatnonzero(visitor).tolist():
                low, high = np.searchsorted(every, sets[k]), np.searchsorted(every, sets[k], "right")
                n_each = high - low
                at = np.repeat(low - (np.cumsum(n_each) - n_each), n_each) + np.arange(n_each.sum())
                both = np.bincount(owner[at], minlength=len(home))
                hit = home[(100 * both >= per_cent * (len(sets[k]) + size - both)) & (root[home] != root[k])]
                good += [(name[k], name[j]) for j in hit[np.unique(root[hit], return_index=True)[1]]]
            if good:
                yield pa.record_batch([pa.array([g[i] for g in good], pa.binary()) for i in (0, 1)], LINKED)

    ordered = rows.repartition(n, "cell", "block", "visitor_block").sortWithinPartitions("cell", "block", "visitor_block")
    return ordered.mapInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, per_cent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links) and kept (whether it is its own).

    ``size`` is words in a shingle, ``per_cent`` the least similarity of a link.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(sign(docs, size))
    classes = cut(signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("owner"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
    n_classes = classes.count()
    few = tasks_for(docs.sparkSession, n_classes)
    shared = cut(_weighed(classes.select("class", F.explode("bands").alias("key"))))
    full = cut(_sets(shared.select("class").distinct(), docs, classes, size))

    def confirmed(stars: DataFrame) -> DataFrame:
        possible = cut(_possible(stars, classes, per_cent), few)
        links = cut(_confirmed(possible, full, n_classes, per_cent), few)
        drop(possible)
        return links

    # each class and the leaders of its buckets; its cell is led by the one that it meets most often
    stars = cut(_stars(shared), few)
    links = confirmed(stars)
    homes = stars.groupBy(F.col("a").alias("class")).agg(F.max(F.struct("bands", "weight", "b")).alias("m")).select("class", F.col("m.b").alias("cell"))
    known = cut(homes.join(_heads(links), "class", "left"), few)
    unsettled = cut(_open(shared.select("key", "class"), known), few)
    drop(stars, shared)
    wide = unsettled.where(f"members - major_n > {BLOCK}")
    if not wide.isEmpty():
        # a bucket with many minor members is dealt into finer ones, whose leaders find more links; what stays open in it is compared whole, as in any other
        finer = cut(_weighed(_finer(wide.select("key", "class").join(classes.select("class", "bits"), "class"))))
        stars = cut(_stars(finer))
        more = confirmed(stars)
        links = links.unionByName(more)
        before, known = known, cut(known.select("class", "cell").join(_heads(links), "class", "full_outer").select("class", F.coalesce("cell", "class").alias("cell"), "root"))
        still, unsettled = unsettled, cut(_open(unsettled.select("key", "class"), known))
        drop(before, still, finer, stars)
    visits = cut(_visits(unsettled.join(classes.select("class", "bits", "n_shingles"), "class"), per_cent), few)
    rest = cut(_rest(visits, full, classes, known, per_cent), few)
    roots = components(links.select("a", "b").unionByName(rest), few)
    drop(visits, rest, unsettled, full, known)
    named = classes.select("class", "owner").join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "owner", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    by_class = cut(named.join(least, "root").select("class", "component_id"), few)
    drop(classes, roots)
    out = signed.select("doc_id", "n_shingles", "class").join(by_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of ``docs`` that name their component, unchanged.

    Rows without doc_id stay, and so do all rows of a doc_id of which one is kept.
    """
    found = near_duplicates(docs, size, per_cent).where("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def oracle_sql(size: int, per_cent: int) -> str:
    """All pairs with a common shingle, in DuckDB's SQL."""
    gram = " || ' ' || ".join(["w[i]", *[f"w[i + {k}]" for k in range(1, size)]])
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {size} then [array_to_string(w, ' ')]
                    else list_transform(range(1, len(w) - {size - 2}), lambda i: {gram}) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c.n >= {per_cent} * (x.n + y.n - c.n)),
pairs as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join pairs l on r.b = l.a),
named as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from named left join sizes using (doc_id)"""
