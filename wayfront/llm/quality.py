"""Quality rules with risk-controlled cutoffs.

Every document gets counts.  Each rule turns them into one integer, and rejects
what lies above a cutoff.  Cutoffs come from a fixed grid and are certified, per
stratum (``lang``), on all labelled documents: a cutoff counts as safe if the
exact binomial test rejects "it refuses more than ``risk / rules`` of the good
documents" at level ``delta / hypotheses`` (Bonferroni over all strata, rules and
cutoffs).  Among the safe cutoffs of a stratum and rule the one with the largest
net gain is used: bad documents refused less ``GOOD_COST`` times the good ones;
on ties the largest cutoff.  A stratum with too few labels has no safe cutoff, and
then only the base rules apply there.

Defined results: null text has no words; a null ``lang`` is the stratum ''; labels
that are null, or contradict each other for one document, count once for each
value; repeated rows give a row each; other columns are ignored.  Empty tables
give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, cut, small_batches

SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Largest share of a stratum's good documents that all rules together may refuse.
RISK = 0.04
#: Probability that any certified cutoff exceeds its share.
DELTA = 0.05
#: Good documents that weigh as much as one bad document, when a safe cutoff is chosen.
GOOD_COST = 5

#: Rules: (name, numerator, denominator, scale, cutoffs); a rule's value is
#: scale * numerator div max(denominator, 1).
RULES = (
    ("symbols", "n_symbols", "word_chars", 1000, tuple(range(10, 310, 20))),
    ("dup_lines", "n_dup_lines", "n_lines", 1000, tuple(range(50, 800, 50))),
    ("repeats", "n_repeat_words", "n_words", 1000, tuple(range(50, 800, 50))),
    ("word_length", "word_chars", "n_words", 10, tuple(range(60, 210, 10))),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pairs = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # else the cube of n could leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= again
    return int(covered.sum())


def count(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = text.encode().split()
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    spaces = sum(map(text.count, ASCII_SPACE))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids), len(lines)


MEASURED = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((c, pa.int64()) for c in COUNTS)])


def measure(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, stratum and counts."""
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [count(t or "") for t in batch["text"].to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), batch["stratum"].cast(pa.string()), *columns], MEASURED)

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), "text")
    return rows.mapInArrow(by_batch(MEASURED, work), "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def rule_value(rule: tuple) -> F.Column:
    _, part, whole, scale, _ = rule
    return F.floor(F.lit(scale) * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed: each term from the one before."""
    i = np.arange(1, k + 1)
    log = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + math.log(p) - math.log1p(-p))])
    return float(np.exp(log).sum())


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule and cutoff: the cutoffs in force.

    The labelled rows are counted in one aggregation, by stratum, rule and grid
    cell; no more rows than that go on, whatever the number of documents.
    """
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).distinct()
    cells = F.array(*[F.struct(F.lit(r[0]).alias("rule"), sum((rule_value(r) > c).cast("int") for c in r[4]).alias("above")) for r in RULES])
    seen = measured.join(known, "doc_id").select("stratum", "quality", F.explode(cells).alias("cell"))
    tallies = seen.groupBy("stratum", "cell.rule", "cell.above").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") != 1).cast("long")).alias("bad"))
    hypotheses = tallies.select("stratum").distinct().count() * sum(len(r[4]) for r in RULES)
    share, grids = risk / len(RULES), {r[0]: r[4] for r in RULES}

    def choose(tally: pd.DataFrame) -> pd.DataFrame:
        stratum, rule = tally["stratum"].iloc[0], tally["rule"].iloc[0]
        level, n = delta / max(hypotheses, 1), int(tally["good"].sum())
        best = None
        for at, cutoff in enumerate(grids[rule]):
            over = tally[tally["above"] > at]
            good, bad = int(over["good"].sum()), int(over["bad"].sum())
            gain = bad - GOOD_COST * good
            if n and gain > 0 and good < share * n and binomial_tail(good, n, share) <= level and (best is None or gain >= best[0]):
                best = gain, cutoff
        return pd.DataFrame([(stratum, rule, best[1])] if best else [], columns=["stratum", "rule", "cutoff"])

    return tallies.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff long")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: counts, base_failed, kept, and the rules that refused it."""
    measured = cut(measure(docs))
    cutoffs = certify(measured, labels, risk, delta).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r[0], F.col("cutoff"))).alias(f"cut_{r[0]}") for r in RULES])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    refused = F.concat_ws(",", *[F.when(rule_value(r) > F.col(f"cut_{r[0]}"), F.lit(r[0])) for r in RULES])
    out = measured.join(cutoffs, "stratum", "left").withColumn("base_failed", failed).withColumn("refused_by", refused)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("refused_by") == "")).select("doc_id", *COUNTS[:5], "base_failed", "kept", "refused_by")


def _oracle() -> str:
    """The same in DuckDB's SQL."""
    values = "\nunion all by name ".join(f"select doc_id, stratum, '{name}' as rule, {scale} * {part} // greatest({whole}, 1) as value from counts" for name, part, whole, scale, _ in RULES)
    grid = ", ".join(f"('{r[0]}', {c})" for r in RULES for c in r[4])
    p = RISK / len(RULES)
    return rf"""
with words as (select doc_id, generate_subscripts(w, 1) as pos, unnest(w) as word
               from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)),
lines as (select doc_id, line, count(*) as times from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)
          where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id, line),
line_counts as (select doc_id, sum(times - 1) as n_dup_lines, sum(times) as n_lines from lines group by doc_id),
grams as (select doc_id, pos, word || ' ' || lead(word) over (partition by doc_id order by pos) || ' ' || lead(word, 2) over (partition by doc_id order by pos) as gram from words),
again as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, gram) as times from grams where gram is not null) where times > 1),
covered as (select doc_id, count(distinct pos + step) as n from again, (values (0), (1), (2)) s(step) group by doc_id),
word_counts as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars from words group by doc_id),
counts as (select d.doc_id, coalesce(d.lang, '') as stratum, coalesce(w.n_words, 0)::bigint as n_words, coalesce(w.word_chars, 0)::bigint as word_chars,
                  length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(l.n_dup_lines, 0)::bigint as n_dup_lines,
                  coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(l.n_lines, 0)::bigint as n_lines
           from documents d left join word_counts w using (doc_id) left join line_counts l using (doc_id) left join covered c using (doc_id)),
rule_values as ({values}),
grid(rule, cutoff) as (values {grid}),
known as (select distinct doc_id, quality from labels where quality is not null),
tested as (select v.stratum, g.rule, g.cutoff, sum((quality = 1)::int) as n, sum((quality = 1 and value > cutoff)::int) as k, sum((quality <> 1 and value > cutoff)::int) as bad
           from rule_values v join known using (doc_id) join grid g using (rule) group by all),
judged as (select *, bad - {GOOD_COST} * k as gain, (select count(distinct stratum) from tested) * (select count(*) from grid) as hypotheses from tested),
safe as (select * from judged where gain > 0 and k < {p} * n and
         list_sum(list_transform(range(0, k::bigint + 1), lambda i: exp(lgamma(n::double + 1) - lgamma(i + 1.0) - lgamma(n::double - i + 1) + i * ln({p}) + (n::double - i) * ln(1 - {p})))) <= {DELTA} / hypotheses),
cutoffs as (select stratum, rule, arg_max(cutoff, gain * 100000 + cutoff) as cutoff from safe group by stratum, rule),
refused as (select v.doc_id, string_agg(v.rule, ',' order by list_position([{", ".join(f"'{r[0]}'" for r in RULES)}], v.rule)) as refused_by
            from rule_values v join cutoffs c using (stratum, rule) where v.value > c.cutoff group by v.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and r.refused_by is null as kept, coalesce(r.refused_by, '') as refused_by
from counts left join refused r using (doc_id)"""


ORACLE_SQL = _oracle()
