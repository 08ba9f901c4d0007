"""A training corpus made from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet to the shared folder and reread as the next stage's docs.
Stages 1 to 4 return the columns of documents, the last one the packed pieces.

Defined results, for every stage: a null or empty text is kept by the filters (it is no copy of
another, toxic or contaminated) and stays as it is; rows without doc_id are documents of
their own that only the toxicity and benchmark stages can drop; rows that share a doc_id are judged
each by its text, but near copies take them as one document and keep the least; other
columns than those of documents are left out; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, packing, pii, toxicity
from tessera.llm.common import table, text_batches
from tessera.session import delete_path, intermediate_tables, scratch_path

_DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model calls toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(*_DOCUMENTS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    text_batches(spark)
    return jaccard.one_of_each(docs).select(*_DOCUMENTS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*_DOCUMENTS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text where it changed."""
    text_batches(spark)
    clean = pii.redact(docs.withColumn("_before", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        *_DOCUMENTS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 ids, with their digests."""
    text_batches(spark)
    return packing.pack(docs, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  The intermediate tables of a stage end with it, and a stage's
    result with the next one."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with intermediate_tables(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs


# the stages train models, align with edits and use a tokenizer: tests hold them against brute force
ORACLE_SQL = None
