"""The corpus pipeline: its stages, in order, and a run over ``documents``.

Each stage reads what its predecessor kept and has all columns of documents,
but for the last, which returns the packed pieces. Null texts count as empty.
From the second stage on documents are named by doc_id: rows that share one go
or stay together, and rows without one stay. Further columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cortexa.llm import common, decontaminate, exact_dedup as exact, packing, simhash, toxicity
from cortexa.sources import shared


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on what came in, does not call toxic; null and empty texts and repeated rows are judged like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id."""
    return common.without(docs, exact.exact_dedup(docs).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links, the one with the smallest doc_id."""
    return common.without(docs, simhash.near_duplicates(docs).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return common.without(docs, decontaminate.contained(docs, _benchmark(spark, sf_dir)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of each document go in the training sequences."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the packing have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage keeps is written in the shared folder, read by the next one
    and deleted after that; the result goes with the session.
    """
    docs, path = common.documents(spark, sf_dir), None
    folder = f"{shared.scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        before, path = path, f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            shared.discard(spark, before)
    return docs
