"""The corpus pipeline: STAGES over the documents table, each on all that its predecessor kept.

All stages but the last return the columns of documents; the last returns token pieces with their sequences. Rows with
null or empty texts leave with the first stage, since their language is unknown. No SQL can express the learned stages;
tests hold each stage against plain Python instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import decontam, jaccard, language, packing, pii
from evigraph.llm.shared import write_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the filters know; learned from the labels of the same documents."""
    return language.keep_identified(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars as it is then."""
    return pii.redact(docs, pii.fit(docs), length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
