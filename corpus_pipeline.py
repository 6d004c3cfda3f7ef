"""A corpus pipeline: quality, lines, near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, minhash_dedup, packing, quality
from tidemark.llm.common import shared_folder, table
from tidemark.llm.queries import VOCABULARY


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps: none without a word, so no null or empty text."""
    return quality.keep_good(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur before; one that had nothing else goes.

    n_chars follows the text where lines went. A null text stays; rows of equal doc_id and text keep the same lines.
    """
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_lines_removed") > 0) & ~F.col("text").rlike(r"\S")
    columns = [
        F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns
    ]
    return cleaned.where(~emptied | F.col("text").isNull()).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; of several rows of its doc_id one. Rows without a doc_id stay."""
    return minhash_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark passage; a null text holds none, and rows of one doc_id go together."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; a null or empty text is a piece of one token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", deduplicate_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The stages train models, tokenize and follow components, which SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs
