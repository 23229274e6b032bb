"""Mixing sources to target weights.

Each row gets a hash-random key from its id and text; within a source the rows are taken in
key order until the source's word budget is used up, going round again (epochs)
where the budget is more than the source has. Running totals are distributed: the
leading hex digits of the key cut a source into ranges of about ``RANGE_ROWS`` rows,
the ranges' sums are added up, and only inside a range are rows sorted. The row at
the cut is taken in part, so a source's words meet its budget exactly.

Equal rows are counted first, so that a row that is a third of the table is one row in the running
totals; its copies come one after the other.

Cases: an empty table gives an empty result; null or empty texts have size 0 and are
taken 0 times; a null source is a source of its own and comes last; a null id is one
more id; rows of one id differ in key by their texts, and rows that agree in id and text but in no other
column stay apart; equal rows are interchangeable; a very long text is one row, taken in part at the cut
by the query and as a whole by ``mixed_documents``. Further columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import RUN, WORD, any_above, cut, marked, repeated, small, table

SEED = 11
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: A table of sources is broadcast up to this many rows.
SMALL_SOURCES = 10_000


def targets(stats: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``stats`` (source, source_size) with ``target``: all words shared by weight, each
    source stopping at ``max_epochs`` times its size. In ascending order of that limit
    per weight, the first source that need not stop fixes the level of all after it; levels
    that count later sources as stopped are lower, so it is the highest that fits.
    One row per source, so its windows see sources, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1
    )
    limit = F.col("source_size").cast("double") * max_epochs
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, here_on = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(here_on)
    return (
        stats.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(everything))
        .withColumn("target", F.least("limit", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))
        .drop("limit", "level")
    )


def shares(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, source, text, mark) by what makes them equal: doc_id, source, mark, size, copies,
    source_size, target, rounds (how often each copy is taken whole) and ``rest``: the words left for the copies
    after these rounds, which go to the first copies first."""
    groups = cut(
        rows.select(
            "doc_id", "source", "mark",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))).alias("key"),
        ).groupBy("doc_id", "source", "mark", "size", "key").agg(F.count(F.lit(1)).alias("copies"))
    )
    words = F.col("size") * F.col("copies")
    stats = groups.groupBy("source").agg(F.sum(words).alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = cut(
        targets(stats, weights, max_epochs)
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("left", F.col("budget") - F.col("rounds") * F.col("source_size"))
        .withColumn("digits", F.least(F.lit(12), F.greatest(F.lit(0), F.ceil(F.log(F.sqrt("n") / 8) / F.log(F.lit(16.0))))).cast("int"))
        .withColumnRenamed("source", "name")
    )
    known = groups.join(small(goals, SMALL_SOURCES), F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "range", F.expr("substr(key, 1, digits)")
    )
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        known.groupBy("source", "range")
        .agg(F.sum(words).alias("range_size"))
        .select(
            F.col("source").alias("r_source"), F.col("range").alias("r_range"),
            F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("range_before"),
        )
    )
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "mark")
    before = F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - words
    return (
        known.withColumn("before", before)
        .join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
        .withColumn("rest", F.greatest(F.lit(0), F.least(words, F.col("left") - F.col("before") - F.col("range_before"))).cast("long"))
        .select("doc_id", "source", "mark", "size", "copies", "source_size", "target", "rounds", "rest")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row per row of ``docs``: doc_id, source, size, source_size, target, taken."""
    parts = cut(shares(docs.select("doc_id", "source", "text", F.lit(0).alias("mark")), **options))
    copies = repeated(parts, "copies", any_above(parts, "copies", RUN), ["doc_id", "size"])
    own = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("copy") - 1) * F.col("size")))
    return copies.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + own).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, the one at a
    source's cut as a whole row."""
    rows = marked(docs)
    parts = shares(rows.select("_row.doc_id", "_row.source", "_row.text", F.col("_mark").alias("mark")), **options)
    times = F.col("rounds") * F.col("copies") + F.ceil(F.try_divide(F.col("rest"), F.col("size")))
    taken = cut(parts.select(F.col("mark").alias("_of"), F.col("copies").alias("_copies"), times.cast("long").alias("_times")).filter("_times > 0"))
    # Whole rows meet by mark only where some are equal.
    one = rows.dropDuplicates(["_mark"]) if taken.filter("_copies > 1").limit(1).count() else rows
    met = one.join(taken, F.col("_mark") == F.col("_of"))
    return repeated(met, "_times", any_above(taken, "_times", RUN), ["_mark"]).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
             source_size::DOUBLE * 3 AS lim FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER ()
        - coalesce(sum(lim) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
g AS (SELECT source, source_size,
        least(lim, coalesce(max(CASE WHEN lev * weight <= lim THEN lev END) OVER (), 0.0) * weight) AS target FROM l),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM g),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
        CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS rounds,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS bef
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(size, budget - rounds * source_size - bef)))::BIGINT AS taken
FROM r
"""
