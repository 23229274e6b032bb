"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: The six characters that part words, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of ids that a partition holds at least, where their number is known.
ROWS_A_PART = 25_000
#: Copies of one row that one task makes.
RUN = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's
    checkpoint folder. Only a local session without either gets a temporary one."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return spark.conf.get("spark.checkpoint.dir", None) or known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, so that neither
    later steps nor lost executors compute it again. With ``rows``, a bound on its
    rows, it is put into no more partitions than these fill."""
    spark = df.sparkSession
    context = spark.sparkContext
    shared_folder(spark)
    if rows is not None:
        df = df.coalesce(max(context.defaultParallelism, rows // ROWS_A_PART))
    return df.checkpoint()


def fresh(df: DataFrame) -> DataFrame:
    """``df``, a result of ``cut``, without the planner's estimate of its size. The estimate of a join
    is a product, and ``checkpoint`` hands it on: in a loop of joins its digits double
    every round, until they fill the driver."""
    spark = df.sparkSession
    rows = spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema())
    return DataFrame(rows, spark)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it
    is, for the planner to shuffle. ``df`` should be cheap to count."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def row_key() -> Column:
    """The id of a row, or, where that is null, a large number made of its text: rows
    without id can then be told apart, and stand behind all ids of other rows."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))


def mark(df: DataFrame, columns: list[str] | None = None) -> Column:
    """128 bits, as a struct, that are equal in rows that agree in ``columns`` (all of
    them if None). Nulls count as values; nested columns are compared as JSON."""
    kinds = {f.name: f.dataType for f in df.schema}
    parts: list[Column] = []
    for name in columns or df.columns:
        c = F.col(f"`{name}`")
        nested = isinstance(kinds[name], (ArrayType, MapType, StructType))
        parts += [c.isNull(), F.to_json(F.struct(c)) if nested else c]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"))


def marked(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """_row (a whole row as a struct, so that no name of it can clash) and _mark."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), mark(df, columns).alias("_mark"))


def beside(columns: list[str], taken: list[str]) -> list[Column]:
    """The fields of ``_row``; one with a name that an operator gives out, ``taken``, is
    kept under its name with ``_before`` behind it."""
    return [F.col(f"_row.`{c}`").alias(f"{c}_before" if c in taken else c) for c in columns]


def any_above(df: DataFrame, column: str, most: int) -> bool:
    return df.filter(F.col(column) > most).limit(1).count() > 0


def repeated(df: DataFrame, times: str, often: bool, by: list[str]) -> DataFrame:
    """Each row as often as its column ``times`` says (at least once), numbered from 1 in ``copy``. With
    ``often`` (some row more than ``RUN`` times), such rows are dealt out by ``by`` and runs of ``RUN`` first."""
    long = lambda v: F.lit(v).cast("long")
    first = F.col("_run") * RUN
    some = df.withColumn("_run", long(0))
    if often:
        many = df.filter(F.col(times) > RUN).withColumn("_run", F.explode(F.sequence(long(0), F.floor((F.col(times) - 1) / RUN))))
        some = some.filter(F.col(times) <= RUN).unionByName(many.repartition(*by, "_run"))
    return some.withColumn("copy", F.explode(F.sequence(first + 1, F.least(first + RUN, F.col(times).cast("long"))))).drop("_run")
