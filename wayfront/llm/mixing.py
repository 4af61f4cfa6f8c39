"""Mixing sources to target weights, with DataFrame functions only.

The words of a source's documents are packed, one document after the other, into
blocks of a fixed number of words.  A source's target and the number of its blocks
give its quota of items.  Output shards come in groups of bounded size, and a group gets
its share of each quota.  A share is dealt over the group's shards by a multinomial draw:
it is split between the two halves of the shards, and each half again, by a binomial
count of pseudorandom bits of what is left there.  So targets are met without sampling
error, and a shard's items of a source are a range of indices.  A permutation per source and
turn maps an index to a block, and items and blocks are joined by block index.  A block
is taken at most ``CAP`` times, hence so is each document.

Permutations are swap-or-not networks (Hoang, Morris and Rogaway, 2012): a bijection
of any range [0, n) by integer arithmetic, with neither a sort nor a table.

Positions within a source are prefix sums in three levels over hashed bins of
documents, so that a source that holds most rows is not summed in one task.  Joins whose
sides both grow with the input are merge joins, as estimates of written tables may mislead.

Defined results: null text has no words; a null source is a source, the last one;
a document without words takes 0; a source without words has target 0; repeated rows
are packed one after the other and give a row each; other columns are ignored by
``plan`` and kept by ``mixed``.  Empty tables give empty results.  Very long texts
span many blocks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, partitions, word_count

BLOCK_WORDS = 128
SHARD_SLOTS = 256
CAP = 3
WEIGHTS = 3

ROUNDS = 12
PRIME = 2_147_483_647
#: Multipliers below 2^30, so that products of two residues and their sum fit into 64 bits.
A, B, C = 630_360_016, 742_938_285, 950_706_376
#: Documents in a bin and bins in a superbin, on average.
BIN_ROWS, SUPER_BINS = 128, 128
#: Slots of a group of shards.  A group gets its share of every source's quota.
GROUP_SLOTS = 1 << 18
#: Pseudorandom bits that one hash gives.
BITS = 64


class Plan(NamedTuple):
    positions: DataFrame  # doc_id, skey, size, start, and carried columns
    sources: DataFrame  # skey, rank, source_size, target, blocks, quota
    slots: DataFrame  # skey, rank, item, block, turn, shard
    pieces: DataFrame  # skey, block, start (of the document), first (word in it), n_words


def round_key(key: str, r: str, n: str) -> str:
    """The r-th round's reflection point in [0, n)."""
    k = f"(({key}) + (({r}) * 40503 + 7) * 65537 % {PRIME}) % {PRIME}"
    return f"((({k}) * {A} % {PRIME}) * 2147483648 + (({k}) * {B} + 12345) % {PRIME}) % ({n})"


def round_bit(m: str, key: str, r: str, div: str) -> str:
    """Whether the larger one of two mirrored positions swaps in round r."""
    y = f"((({m}) % {PRIME}) * {A} + (({m}) {div} {PRIME}) * {B} + ({key}) * 7919 + (({r}) * 69069 + 1) * 16807 % {PRIME}) % {PRIME}"
    return f"((({y}) % 65521) * {C} % {PRIME}) % 2048 >= 1024"


def permuted(x: str, key: str, n: str) -> str:
    """SQL of ``x`` moved by the permutation of [0, n) that ``key`` selects; a fold, so that the expression stays small."""
    mirror = f"(({round_key(key, 'r', n)} + {n} - x) % ({n}))"
    swap = f"case when {round_bit(f'greatest(x, {mirror})', key, 'r', 'div')} then {mirror} else x end"
    return f"aggregate(sequence(0L, {ROUNDS - 1}L), {x}, (x, r) -> {swap})"


def permuted_sql(table: str, column: str, key: str, n: str) -> str:
    """The same as a DuckDB subquery."""
    for r in range(ROUNDS):
        mirror = f"(select *, ({round_key(key, f'{r}::bigint', n)} + {n} - {column}) % ({n}) as mirror from {table})"
        table = f"(select * exclude (mirror) replace (case when {round_bit(f'greatest({column}, mirror)', key, f'{r}::bigint', '//')} then mirror else {column} end as {column}) from {mirror})"
    return table


#: A word with the white space before it, and with what ends the text after it: the text itself, cut up.
SPACED_WORD_SQL = (r"[\x20\x09-\x0D]*" + WORD_PATTERN + r"(?:[\x20\x09-\x0D]+\z)?").replace("\\", "\\\\")


def source_key() -> Column:
    """Sources as text that sorts like them; the null source is ''."""
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))


def left_count(level: int) -> str:
    """SQL of how many of the ``count`` items at ``node`` of a level go to its left half: Binomial(count, 1/2), by counting random bits."""
    mask = f"shiftrightunsigned(-1L, cast({BITS} - least({BITS}, count - {BITS} * i) as int))"
    return f"aggregate(sequence(0L, (count - 1) div {BITS}), 0L, (s, i) -> s + bit_count(xxhash64(rank, cell, {level}, node, i) & {mask}))"


def draws(sources: DataFrame, n_slots: int) -> DataFrame:
    """skey, rank, blocks, shard, first and count: a source's items in each output shard, from index ``first`` on.

    Shards are dealt in groups of about ``GROUP_SLOTS`` slots, so that a draw's size and the
    depth of its tree of halves don't grow with the input; a shard has about ``SHARD_SLOTS``
    items, of all sources.
    """
    groups = max(1, -(-n_slots // GROUP_SLOTS))
    tasks = max(partitions(sources.sparkSession), groups)
    levels = max(0, -(-n_slots // (groups * SHARD_SLOTS)) - 1).bit_length()
    shares = sources.where("quota > 0").withColumn("cell", F.explode(F.expr(f"sequence(0L, {groups - 1}L)"))).repartition(tasks, "skey", "cell")
    dealt = shares.select("skey", "rank", "blocks", "cell", F.lit(0).cast("long").alias("node"), F.expr(f"quota * cell div {groups}").alias("first"), F.expr(f"quota * (cell + 1) div {groups} - quota * cell div {groups}").alias("count")).where("count > 0")
    for level in range(levels):
        dealt = dealt.withColumn("left", F.expr(left_count(level)))
        halves = F.expr("array(struct(2 * node as node, first as first, left as count), struct(2 * node + 1 as node, first + left as first, count - left as count))")
        dealt = dealt.select("skey", "rank", "blocks", "cell", F.inline(halves)).where("count > 0")
    return dealt.select("skey", "rank", "blocks", F.expr(f"cell * {1 << levels} + node").alias("shard"), "first", "count").repartition(tasks, "skey", "shard")


HASH = f"((((coalesce(doc_id, 0) % {PRIME}) + {PRIME}) % {PRIME}) * {A} + 12345) % {PRIME}"


def _positions(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (doc_id, skey, size, ...) with each one's start in its source's stream of words."""
    bins = max(1, -(-n_rows // BIN_ROWS))
    rows = rows.withColumn("bin", F.expr(f"{HASH} % {bins}"))
    by_bin = rows.groupBy("skey", "bin").agg(F.sum("size").alias("words")).withColumn("super", F.expr(f"bin div {SUPER_BINS}"))
    by_super = by_bin.groupBy("skey", "super").agg(F.sum("words").alias("super_words"))
    before = "coalesce(sum({0}) over (partition by {1} order by {2} rows between unbounded preceding and 1 preceding), 0)"
    by_super = by_super.withColumn("super_start", F.expr(before.format("super_words", "skey", "super")))
    by_bin = by_bin.withColumn("bin_start", F.expr(before.format("words", "skey, super", "bin")))
    starts = by_bin.join(by_super, ["skey", "super"]).select("skey", "bin", (F.col("super_start") + F.col("bin_start")).alias("bin_start"))
    rows = rows.withColumn("in_bin", F.expr(before.format("size", "skey, bin", "doc_id, size")))
    return rows.join(starts.hint("merge"), ["skey", "bin"]).withColumn("start", F.col("bin_start") + F.col("in_bin")).drop("bin", "in_bin", "bin_start")


def _sources(sized: DataFrame) -> DataFrame:
    """Targets by water filling: with caps in order of cap by weight, the level is the largest of
    (total less the caps before) / (weights from here on)."""
    totals = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.expr("row_number() over (order by skey = '', skey) - 1")).withColumn("weight", F.expr(f"rank % {WEIGHTS} + 1"))
    order = f"order by {CAP} * source_size / cast(weight as double), rank"
    levels = ranked.withColumn("level", F.expr(
        f"cast(sum(source_size) over () - coalesce(sum({CAP} * source_size) over ({order} rows between unbounded preceding and 1 preceding), 0) as double)"
        f" / sum(weight) over ({order} rows between current row and unbounded following)"
    ))
    filled = levels.withColumn("target", F.expr(f"least(cast({CAP} * source_size as double), max(level) over () * weight)")).withColumn("blocks", F.expr(f"(source_size + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}"))
    quota = f"case when source_size = 0 then 0L else least({CAP} * blocks, cast(floor(target * blocks / source_size + 0.5) as bigint)) end"
    filled = filled.withColumn("quota", F.expr(quota))
    return filled.select("skey", F.col("rank").cast("long"), "source_size", "target", "blocks", "quota")


def plan(docs: DataFrame, *carry: str) -> Plan:
    """The mix of ``docs``: where each document lies, and which slots take which blocks.

    ``carry`` names columns that ``positions`` and ``pieces`` keep beside the measures.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("skey"), word_count(F.col("text")).alias("size"), *carry)
    sized = rows if carry else cut(rows)
    small = cut(sized.select("doc_id", "skey", "size")) if carry else sized
    sources = cut(_sources(small))
    n_slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    positions = _positions(sized, small.count())
    items = draws(sources, n_slots).withColumn("item", F.explode(F.expr("sequence(first, first + count - 1)")))
    slots = items.select("skey", "rank", "blocks", "shard", "item", F.expr("item div blocks").alias("turn"), F.expr("item % blocks").alias("block"))
    slots = slots.withColumn("block", F.expr(permuted("block", f"(rank * {CAP + 1} + turn)", "blocks"))).drop("blocks")
    return Plan(positions, sources, slots, pieces_of(positions))


def pieces_of(positions: DataFrame) -> DataFrame:
    """A row for each document and block that overlap."""
    spread = positions.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK_WORDS}, (start + size - 1) div {BLOCK_WORDS})")))
    first = F.expr(f"greatest(block * {BLOCK_WORDS} - start, 0L)")
    return spread.select("skey", "block", "doc_id", "start", first.alias("first"), (F.expr(f"least((block + 1) * {BLOCK_WORDS} - start, size)") - first).alias("n_words"))


def taken(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its size, its source's size and target, and the words that the mix takes of it."""
    p = plan(docs)
    positions = cut(p.positions)
    found = pieces_of(positions).join(p.slots.select("skey", "block").hint("merge"), ["skey", "block"]).groupBy("skey", "start").agg(F.sum("n_words").alias("taken"))
    # documents without words take part in the join by keys that no block has, and not all by the same one
    keyed = positions.withColumn("key", F.when(F.col("size") > 0, F.col("start")).otherwise(F.expr("-1 - pmod(xxhash64(doc_id), 1048576)")))
    out = keyed.join(found.withColumnRenamed("start", "key").hint("merge"), ["skey", "key"], "left").join(p.sources.select("skey", "source_size", "target"), "skey")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def shard_counts(docs: DataFrame) -> DataFrame:
    """shard, skey and slots: the multinomial draws, as counts of items by output shard and source."""
    return plan(docs).slots.groupBy("shard", "skey").agg(F.count("*").alias("slots"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself in the columns of ``docs``: a row for each piece of a document that a block has, as often as the block is taken.

    A piece is a slice of the text as it stands, white space included; ``n_chars`` (if
    there) is counted again.  Partitions hold whole output shards, one after the other,
    and rows stand in the order of a shard's slots: the pieces of a block follow each
    other.  Documents without words have no piece.
    """
    names = docs.columns
    carry = [c for c in names if c not in ("doc_id", "text")]
    renamed = docs.select("doc_id", "source", "text", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    p = plan(renamed, "text", *[f"_c{i}" for i in range(len(carry))])
    # the words of a text are found once, and each piece joins its own slice of them
    cut_up = rf"""flatten(transform(array(regexp_extract_all(text, '{SPACED_WORD_SQL}', 0)), w -> transform(
        sequence(start div {BLOCK_WORDS}, (start + size - 1) div {BLOCK_WORDS}), b -> named_struct('block', b, 'text', array_join(
            slice(w, cast(greatest(b * {BLOCK_WORDS} - start, 0L) + 1 as int), cast(least((b + 1) * {BLOCK_WORDS} - start, size) - greatest(b * {BLOCK_WORDS} - start, 0L) as int)), '')))))"""
    kept = [f"_c{i}" for i in range(len(carry))]
    pieces = p.positions.where("size > 0").select("skey", "doc_id", "start", *kept, F.inline(F.expr(cut_up)))
    order = ["shard", F.xxhash64("rank", "item"), "rank", "item", "start"]
    slots = p.slots.select("skey", "block", "shard", "rank", "item")
    out = pieces.join(slots.hint("merge"), ["skey", "block"]).repartition(partitions(docs.sparkSession), "shard").sortWithinPartitions(*order)
    back = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"_c{i}") for i, c in enumerate(carry)}
    if "n_chars" in back:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[back[c].cast(docs.schema[c].dataType).alias(c) for c in names])


def _oracle() -> str:
    items = "(select s.skey, rank, blocks, item // blocks as turn, item % blocks as block, base + item as slot, (select greatest(sum(quota), 1)::bigint from sources) as n from sources s, lateral (select unnest(range(0, quota)) as item))"
    dealt = permuted_sql(items, "block", f"rank * {CAP + 1} + turn", "blocks")
    order = f"order by {CAP} * source_size / weight::double, rank"
    prefix = "rows between unbounded preceding and 1 preceding"
    return rf"""
with sized as (select doc_id, case when source is null then '' else '=' || source end as skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                      {HASH} % greatest(1, ((select count(*) from documents) + {BIN_ROWS - 1}) // {BIN_ROWS}) as bin from documents),
positions as (select *, (coalesce(sum(size) over (partition by skey order by bin, doc_id, size {prefix}), 0))::bigint as start from sized),
totals as (select skey, sum(size)::bigint as source_size from sized group by skey),
ranked as (select *, row_number() over (order by skey = '', skey) - 1 as rank from totals),
weighed as (select *, rank % {WEIGHTS} + 1 as weight from ranked),
levels as (select *, (sum(source_size) over () - coalesce(sum({CAP} * source_size) over ({order} {prefix}), 0))::double / sum(weight) over ({order} rows between current row and unbounded following) as level from weighed),
filled as (select *, least(({CAP} * source_size)::double, max(level) over () * weight) as target, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} as blocks from levels),
quotas as (select *, case when source_size = 0 then 0 else least({CAP} * blocks, floor(target * blocks / source_size + 0.5)::bigint) end as quota from filled),
sources as (select *, coalesce(sum(quota) over (order by rank {prefix}), 0)::bigint as base from quotas),
slots as (select skey, block, count(*) as times from {dealt} group by skey, block),
spread as (select *, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) as block from positions where size > 0),
found as (select skey, start, sum(times * (least((block + 1) * {BLOCK_WORDS}, start + size) - greatest(block * {BLOCK_WORDS}, start))) as taken from spread join slots using (skey, block) group by skey, start)
select p.doc_id, p.size, s.source_size, s.target, coalesce(f.taken, 0)::bigint as taken
from positions p join sources s using (skey) left join found f on f.skey = p.skey and f.start = p.start and p.size > 0"""


ORACLE_SQL = _oracle()
