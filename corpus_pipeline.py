"""From documents to token ids: toxicity, near duplicates, personal data, mixing, BPE.

Each stage takes what the one before kept, written as Parquet and read again.  The
whole has no SQL: the first stage is a trained network.

Defined results: documents with null or empty text are scored like any other, are near
copies of nothing, have no personal data, and have no piece in the mix, which holds
words only; so they give no row of ids.  Documents without doc_id stay until the mix and
are mixed as well.  Repeated rows of a document are near copies of each other, and all
of them stay if their doc_id does.  A null source is a source.  An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfront.llm import bpe, minhash, mixing, pii, toxicity
from wayfront.llm.common import read_table, shared_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return minhash.keep_one(docs, size=5, per_cent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents that the mix takes, each as often as it is taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every piece."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("pii", private), ("mixing", mix), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
