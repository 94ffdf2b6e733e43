"""From raw documents to packed training sequences: five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm import jaccard, language, mixing, packing, privacy
from triagelake.llm.shared import in_written_order, stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents and keeps those whose language is accepted."""
    return language.keep_identified(docs, language.train(docs))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that give it away, in the texts."""
    return privacy.sanitise(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders all documents so that every stretch mixes the sources by their weights."""
    return mixing.in_mix_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences in the order of the mix; a row per piece.

    The mix is the order in which its table was written, so docs must be read from files.
    """
    return packing.pack(in_written_order(docs, "doc_id", "text"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("privacy", privacy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizing, training and the search for near duplicates have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
