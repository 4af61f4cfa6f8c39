"""The thin ``opN_<name>`` queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_extract, media, minhash, mixing, passages, pii, quality, token_files, toxicity
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the word-end vocabulary, and what they decode to, as digests."""
    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text."""
    return pii.find(read_table(spark, sf_dir, "documents"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLES["op5_quality"] = quality.ORACLE_SQL


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.taken(read_table(spark, sf_dir, "documents"))


ORACLES["op2_mixing"] = mixing.ORACLE_SQL


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are alike."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=2, per_cent=80)


ORACLES["op4_minhash"] = minhash.oracle_sql(2, 80)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a network trained on the folds that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text written to binary files and read back."""
    return token_files.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a media payload, stored in deduplicated chunks and read back."""
    return media.round_trip(read_table(spark, sf_dir, "documents"))


@query
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


@query
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least fifty words that documents repeat."""
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))
