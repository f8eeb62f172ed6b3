"""The corpus pipeline over the documents table: rejects, duplicates and surplus go, and what stays becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of documents; the last one returns the
token table. The classifiers learn from `labels` and the documents that reach them; empty tables go through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provalake.llm import byte_bpe, minhash, mixing, quality_classifier, toxicity
from provalake.llm.common import stored, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.keep_harmless(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return minhash.keep_one_of_each(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the rates that bring the languages' tokens to their target weights. At least mixing.KEEP of
    the tokens stay: scarce languages are repeated, up to mixing.MOST_RATE times, and a missing one leaves its weight to the
    others."""
    return mixing.resampled(docs, mixing.labelled_by(docs, "lang"), mixing.TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    return byte_bpe.token_table(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("toxicity", keep_harmless),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing to target weights", mix_to_targets),
    ("byte-level bpe", encode),
]
#: The classifiers, the mixing fit and BPE can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
