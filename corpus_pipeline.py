"""The corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

quality: documents that the classifier rejects go. near_duplicates: one document of each group, the one with the least
doc_id, stays. decontamination: documents with benchmark passages go. personal_data: spans are masked. packing: what is
left is placed in length buckets and batches. Each result is written (by run() to the checkpoint folder) before the
next stage reads it, so a lost executor costs at most the stage at hand.

Defined results: a null or empty text is scored as one without words, has no near-duplicates, benchmark passages or
personal data, and takes a place of its own if the classifier keeps it; a very long text goes through whole; a row
without doc_id is never removed as a near-duplicate or for a benchmark passage; rows that share doc_id and text stay or go
together; all stages but the last carry every column along, whatever its name; empty tables give no rows, and an empty
labels or benchmark table leaves all documents in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, minhash, packing, pii, quality
from quire.llm.common import cut, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]
#: A fitted classifier and connected components aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
