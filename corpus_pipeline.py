"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Stages 1 to 4 return the columns of documents; the last returns the packed pieces.  Every stage works on all rows its
predecessor kept: rejected documents go, one document of each near-duplicate group stays (the smallest id), contaminated
documents go, personal data is replaced, and the rest is packed.

Defined cases are those of the operators; a document with a null id is kept by the join, for it links to nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontamination, near_duplicates, packing, pii, quality_rules
from skein.llm.common import table
from skein.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.corpus_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op7_packing(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard", deduplicate), ("decontamination", decontaminate), ("pii", protect), ("packing", pack)]
#: No stage but decontamination can be put in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    base = shared_folder(spark)
    base, docs = f"{base}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
