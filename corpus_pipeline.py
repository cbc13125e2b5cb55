"""The corpus pipeline over ``documents``.

Stages, in order: quality rules (rejected documents go), n-gram Jaccard join (one document of each
group stays), benchmark decontamination (documents with an overlap go), secret scans (secrets are
masked in the text), best-fit packing (the last; it returns the packed pieces).

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept, and all but
the last return the columns of ``docs``.  ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again for the next one.

The stages use tokenisers, hashing and approximate candidate search, which SQL cannot express, so
``ORACLE_SQL`` is None and the tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import decontaminate, near_duplicates, packing, quality_rules, secrets
from loomstone.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near),
    ("decontamination", benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
