"""The corpus pipeline: language, near-duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that it
keeps; the last returns the packed sequences.  Stages are written as Parquet to
the shared folder and read again, so each starts from a finished table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, packing, simhash
from tessera.storage import materialize

#: Independent fingerprints by which near-duplicates are looked for.
NEAR_WORDS = 16


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages; null, empty and letterless texts go, and those whose
    trigrams are less likely in any mixture of the languages than drawn evenly from all learned ones."""
    model = langid.fit(docs.filter(~langid.held_out()))
    if not model.languages:
        return docs
    judged = langid.predict(docs, model, prefix="_langid_")
    return judged.filter((F.col("_langid_lang_pred") != langid.UNKNOWN) & (F.col("_langid_evidence") > 0)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the
    smallest id, null ids last.  Rows equal in every column are one; rows without an id and different texts
    under one id are documents like others."""
    return simhash.representatives(docs, words=NEAR_WORDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics are closer to even, with four fifths of the tokens.

    Null sources and languages are classes of their own, null and empty texts are drawn at four
    fifths, rows that share an id are drawn together, rows without one by their content."""
    return mixing.mixed_documents(docs, power=0.8, keep_share=0.8)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 1,024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: fingerprints, mixtures and packing are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
