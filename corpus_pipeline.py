"""From raw documents to packed training sequences: five stages, each by one operator.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
``run`` writes every stage as Parquet in the shared folder and reads it back, so no
stage is computed twice and none depends on executors that may be lost.

Defined results: a null text counts as an empty one in every stage; a text without
words is near no other; rows with a null doc_id are scored, of equal texts the one with
a doc_id stays, they are never near copies and are mixed and packed like others; of rows
that repeat doc_id and text one stays; rows with a null source form a source; an empty
table gives no pieces. Further columns, whatever they are called, pass all stages but
the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from wayfarer.llm.common import documents, new_folder, session


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    session(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 over five-word shingles the smallest doc_id stays."""
    session(spark)
    return ngram_join.drop_near_copies(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat at the rate that gives every source the same weight."""
    return mixing.replicated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 4096 tokens."""
    session(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing have no SQL form; tests compare stage by stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(session(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
