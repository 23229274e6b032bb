"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the cluster's shared checkpoint folder, reads it again as the
next stage's documents, and deletes the one before.

Rows are told apart by their content, not by their ids: equal ids, rows without id and repeated rows
are no special case. Null and empty texts are rejected by language ID; an empty table gives an empty
result; further columns pass through, ``shard`` and ``slot`` of the caller as ``shard_before`` and ``slot_before``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphtrail.llm import decontaminate, langid, mixing, neardup, sharding
from glyphtrail.llm.common import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of the smallest id."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it, in that order."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Trigram models and Spark's Fisher-Yates order can't be told in SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever file system its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # What the next stage has read and written anew is not needed any more.
        if last:
            _remove(spark, last)
        last = path
    return docs
