"""Two-pass external shuffle into shards.

Pass 1 scatters the rows by seeded hashes: a document's shard depends only on its
id and the number of shards (law ``key``), and within a shard a second hash picks
one of as many buckets as keep a bucket near ``bucket_bytes`` and ``bucket_rows``. Pass 2 lays each
bucket out by a Fisher-Yates shuffle (Spark's ``shuffle``, whose generator belongs to the
partition, which follows from the bucket) and puts the buckets of
a shard one after the other. Only ids, sizes and checksums move for the layout;
``shard_documents`` moves the texts once to bring them to their copies and once to
write them in order.

Monotone growth: a row sits in the highest j below the number of shards whose hash
draw of chance 1 / (j + 1) succeeds, so each shard is equally likely and one shard
more takes rows only into itself.

Cases: an empty table gives an empty result; a null text has size 16 and checksum 0;
a null id is one more id; equal rows stay as many as they were, each with a slot of
its own (they are counted first, so a row that is a third of the table does not meet
in one task); rows of one id, even of one text, that differ in any other column stay apart; a very
long text is only measured for the layout and moves whole after it. Further columns do not matter to the
layout, whatever their names; the caller's ``shard`` and ``slot`` come out as ``shard_before`` and ``slot_before``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import RUN, any_above, beside, cut, marked, repeated, table

OVERHEAD = 16
SEED = 7
BUCKET_BYTES, BUCKET_ROWS = 64 << 20, 250_000
SHARDS = 40


def shard_of(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """Shard 0 .. n_shards - 1 of ``key``."""
    drawn = F.filter(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda j: F.pmod(F.xxhash64(F.lit(seed), j, key), j + 1) == 0,
    )
    return F.array_max(drawn).cast("int")


def digest(docs: DataFrame, mark: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32 of each row, and ``mark``, which tells apart rows that agree in these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        (F.lit(0) if mark is None else mark).alias("mark"),
    )


def layout(digests: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row per row of ``digests`` (see ``digest``): doc_id, size, text_crc32, mark, shard, bucket, slot, grown_shard."""
    counted = cut(digests.groupBy("doc_id", "size", "text_crc32", "mark").agg(F.count(F.lit(1)).alias("copies")))
    sums = counted.agg(F.sum(F.col("size") * F.col("copies")), F.sum("copies")).first()
    per_shard = max(1, -(-(sums[0] or 0) // (n_shards * bucket_bytes)), -(-(sums[1] or 0) // (n_shards * bucket_rows)))
    each = repeated(counted, "copies", any_above(counted, "copies", RUN), ["doc_id", "text_crc32", "mark"])
    rows = (
        each.withColumn("shard", shard_of(F.col("doc_id"), n_shards, seed))
        .withColumn("grown_shard", shard_of(F.col("doc_id"), n_shards + 1, seed))
        .withColumn(
            "bucket",
            F.col("shard") * F.lit(per_shard)
            + F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "size", "mark", "copy"), F.lit(per_shard)).cast("int"),
        )
    )
    held = rows.groupBy("shard", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "size", "text_crc32", "mark", "copy", "grown_shard"))).alias("rows")
    )
    # Each bucket at its own partition number, up to 4,096 of them; beyond, partition and place in it
    # follow from the bucket's number, and with them the permutation.
    n_parts = min(n_shards * per_shard, 4096)
    shuffled = (
        held.repartitionById(n_parts, F.col("bucket") % n_parts)
        .sortWithinPartitions("bucket")
        .select("shard", "bucket", F.shuffle("rows", seed + 2).alias("rows"))
    )
    if per_shard == 1:
        placed = shuffled.withColumn("before", F.lit(0).cast("long"))
    else:
        ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        # One row a bucket.
        sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long").alias("before"))
        placed = shuffled.join(before, "bucket")
    return placed.select("shard", "bucket", "before", F.posexplode("rows").alias("at", "row")).select(
        "row.doc_id", "row.size", "row.text_crc32", "row.mark", "shard", "bucket",
        (F.col("before") + F.col("at")).alias("slot"), "row.grown_shard",
    )


def shard_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with columns ``shard`` and ``slot``, dealt by bucket and sorted by slot,
    ready to be written (see ``write_shards``). Whole rows are told apart by all their columns,
    and equal ones come out as often as they went in."""
    rows = marked(docs)
    at = layout(digest(rows.select("_row.doc_id", "_row.text", "_mark"), F.col("_mark")), **options)
    return (
        rows.dropDuplicates(["_mark"])
        .join(at.select(F.col("mark").alias("_at"), "shard", "bucket", "slot"), F.col("_mark") == F.col("_at"))
        .select("_row", "shard", "slot", "bucket")
        .repartition("bucket")
        .sortWithinPartitions("shard", "slot")
        .select(*beside(docs.columns, ["shard", "slot"]), "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes ``path``/shard=<n>/ with the rows in slot order."""
    shard_documents(docs, **options).write.partitionBy("shard").mode("overwrite").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(digest(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
