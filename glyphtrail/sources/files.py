"""Files beside the base tables: capped scans, annotation sheets, checkpoints, history."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .artifacts import replace


def shard_names(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """Data files of a table in name order, by whatever file system its path names."""
    return sorted(f for f in spark.read.parquet(path).inputFiles() if f.split("?")[0].endswith(suffix))


def capped_scan(spark: SparkSession, path: str | list[str], max_shards: int | None) -> tuple[DataFrame, int, int]:
    """(rows of the first ``max_shards`` shards, shards read, shards there). The shards of one path are its files;
    of a list, its members, each a file or a folder that is read whole, however many part files it was written in."""
    names = shard_names(spark, path) if isinstance(path, str) else sorted(path)
    used = names if max_shards is None else names[:max_shards]
    return spark.read.parquet(*used), len(used), len(names)


def json_dir(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A folder of documents, one JSON value a file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("file", F.input_file_name())


def read_sheet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV sheet whose cells may hold line ends and quotes; a byte order mark is no part of a name."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("enforceSchema", True).option("encoding", "UTF-8").csv(path)
    )


def write_sheet(df: DataFrame, path: str, fields: list[str]) -> None:
    """One CSV file with the given columns; others are left out."""
    df.select(*fields).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def missing(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to do."""
    return expected.join(done.select(key).distinct(), key, "left_anti")


def append_checkpoint(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not there yet; how many they were."""
    spark = rows.sparkSession
    try:
        rows = missing(rows, spark.read.parquet(path), key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows = rows.dropDuplicates([key]).persist()
    n = rows.count()
    rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


# --- history of traces ----------------------------------------------------------

HISTORY = "id string, ts string, model string, question string, slug string, n_spans int, longest int, trace string"


def record(trace: dict, now: datetime | None = None) -> dict:
    """A history record: its id is the time to the millisecond."""
    now = now or datetime.now(UTC)
    spans = trace.get("pretraining", {}).get("matched_spans", [])
    return {
        "id": now.strftime("%Y%m%d-%H%M%S-") + f"{now.microsecond // 1000:03d}",
        "ts": now.isoformat(timespec="seconds"),
        "model": trace.get("model", ""),
        "question": trace.get("question", ""),
        "n_spans": len(spans),
        "longest": max((s["words"] for s in spans), default=0),
        "trace": json.dumps(trace, ensure_ascii=False),
    }


def save_history(spark: SparkSession, path: str, trace: dict, now: datetime | None = None) -> str:
    rec = record(trace, now)
    rows = spark.createDataFrame([rec], HISTORY.replace("slug string, ", "")).withColumn("slug", T.slugify(F.col("question")))
    rows.select("id", "ts", "model", "question", "slug", "n_spans", "longest", "trace").coalesce(1).write.mode("append").json(path)
    return rec["id"]


def list_history(spark: SparkSession, path: str) -> DataFrame:
    """Newest first, without the traces."""
    return spark.read.schema(HISTORY).json(path).drop("trace").orderBy(F.desc("id"))


def load_history(spark: SparkSession, path: str, record_id: str) -> dict | None:
    rows = spark.read.schema(HISTORY).json(path).filter(F.col("id") == T.safe_id(F.lit(record_id))).limit(1).collect()
    return {**rows[0].asDict(), "trace": json.loads(rows[0].trace)} if rows else None


def delete_history(spark: SparkSession, path: str, record_id: str) -> bool:
    """Rewrites the store without a record, by way of a whole new version; whether it was there."""
    rows = spark.read.schema(HISTORY).json(path)
    wanted = F.col("id").eqNullSafe(T.safe_id(F.lit(record_id)))
    found = rows.filter(wanted).limit(1).count() > 0
    if found:
        replace(rows.filter(~wanted).coalesce(1), path, "json")
    return found
