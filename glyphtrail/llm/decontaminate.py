"""Benchmark decontamination by size-partitioned MinHash containment search.

Shingle values are 64-bit hashes under one permutation; a sketch is the smallest of them.
An item of n distinct shingles that a document holds to ``threshold`` percent lacks at most
n - need of them there, so of its n - need + 1 smallest values at least one is in the document: that
many minima are its sketch, and no item is missed. Documents are partitioned by size, in powers of two of
their number of shingles. A partition holds items up to its size only, so of a document's
values those up to the largest minimum of these items are its sketch (the same permutation
cut at a partition's own level); the rest is never looked up. Where sketches meet is a
candidate, verified by the exact number of the item's distinct shingles in the document.

Words are runs outside ``\\x20\\x09-\\x0D`` of the lower-cased text. An item of fewer than
five words is one shingle of its own length, looked for as such in the documents.

Cases: empty tables give an empty result; a null or empty text or item matches nothing; each
row of either table stands for itself, and of rows of one document id and one item id (null
is an id too) with equal item sizes the best match is given; a very long text is one array
of words in one task. Further columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, marked, small, table

SHINGLE = 5
THRESHOLD = 75
SEED = 5
#: Rows of ids up to which minima and candidates are broadcast; beyond, they are shuffled.
SMALL_ROWS = 200_000
#: Items, with their shingles, are broadcast up to this many rows.
SMALL_ITEMS = 10_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda w: w != "")


def grams(words: Column, size: int) -> Column:
    """Array of the word n-grams of ``words``, joined by one space."""
    last = F.size(words) - (size - 1)
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, size), " ")),
    ).otherwise(F.array().cast("array<string>"))


def gram_values(words: Column, size: int, seed: int) -> Column:
    """As ``grams``, but their hash values, without building the strings."""
    last = F.size(words) - (size - 1)
    return F.when(
        last >= 1,
        F.transform(
            F.sequence(F.lit(0), last - 1),
            lambda i: F.xxhash64(F.lit(seed), *[F.get(words, i + t) for t in range(size)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def items_of(benchmark: DataFrame, threshold: int, seed: int) -> DataFrame:
    """item_id, gram (its shingle length), grams (distinct shingles), n, need, minima (of their values)."""
    words = F.col("_w")
    by_size = lambda make: F.coalesce(*[F.when(F.size(words) >= s if s == SHINGLE else F.size(words) == s, make(s)) for s in range(SHINGLE, 0, -1)])
    return (
        benchmark.select("item_id", words_of(F.coalesce("text", F.lit(""))).alias("_w"))
        .filter(F.size("_w") > 0)
        .select(
            "item_id", F.least(F.lit(SHINGLE), F.size("_w")).alias("gram"),
            F.array_distinct(by_size(lambda s: grams(words, s))).alias("grams"),
            F.array_sort(F.array_distinct(by_size(lambda s: gram_values(words, s, seed)))).alias("values"),
        )
        .withColumn("n", F.size("grams"))
        .withColumn("need", F.ceil(F.col("n") * threshold / 100).cast("int"))
        .withColumn("minima", F.slice("values", 1, F.col("n") - F.col("need") + 1))
        .drop("values")
    )


def levels(items: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """gram -> (size class, largest minimum of the items that fit into it), by size class: a
    class k has fewer than 2^(k + 1) shingles. At most one row a gram length and class."""
    fits = F.floor(F.log2(F.col("need").cast("double"))).cast("int")
    top = items.groupBy("gram", fits.alias("k")).agg(F.max(F.array_max("minima")).alias("top")).collect()
    out: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(top, key=lambda r: (r.gram, r.k)):
        have = out.setdefault(r.gram, [])
        have.append((r.k, max(r.top, have[-1][1] if have else r.top)))
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD, seed: int = SEED
) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of each document that holds at least
    ``threshold`` percent of an item's distinct shingles."""
    # Each row by a name of its own; equal rows are one.
    items = cut(items_of(benchmark, threshold, seed).withColumn("item", F.xxhash64("item_id", F.col("item_id").isNull(), "gram", "grams")))
    probes = cut(items.select("item", "need", F.explode("minima").alias("value")))
    cuts = levels(items)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not cuts:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_item long, n_shared long")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text", F.crc32("text")).alias("text_key"), "text")
    words = texts.select("doc_id", "text_key", words_of(F.col("text")).alias("_w"))
    found = None
    for s, steps in cuts.items():
        # A document's partition, and with it the level of its sketch, follow from its size.
        size = F.size("_w") - (s - 1)
        level = None
        for k, top in steps:
            here = size >= (1 << k)
            level = F.when(here, F.lit(top)) if level is None else F.when(here, F.lit(top)).otherwise(level)
        sized = words.filter(size >= (1 << steps[0][0])).withColumn("level", level)
        # The array is made inside explode: as a column of its own, the optimiser infers a
        # filter on it and pushes that down to the scan, where it is far dearer.
        values = F.filter(gram_values(F.col("_w"), s, seed), lambda v: v <= F.col("level"))
        part = sized.select("doc_id", "text_key", F.explode(values).alias("value"))
        found = part if found is None else found.unionByName(part)
    candidates = cut(found.join(small(probes.drop("need"), SMALL_ROWS), "value").select("doc_id", "text_key", "item").distinct())
    # Candidates find their texts; the items' shingles join them after that.
    wanted = small(candidates.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "item"), SMALL_ROWS)
    checked = texts.join(wanted, (F.col("text_key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_id")))
    checked = checked.join(small(items.drop("minima"), SMALL_ITEMS), "item")
    checked = checked.withColumn("_w", words_of(F.col("text")))
    here = F.coalesce(*[F.when(F.col("gram") == s, grams(F.col("_w"), s)) for s in range(1, SHINGLE + 1)])
    return (
        # Filtered after the aggregation: pushed below it, the shared count would be
        # worked out from the text anew for each shingle.
        checked.select("doc_id", "item_id", "n", "need", F.size(F.array_intersect("grams", here)).alias("n_shared"))
        .groupBy("doc_id", "item_id", "n", "need")
        .agg(F.max("n_shared").cast("long").alias("n_shared"))
        .filter(F.col("n_shared") >= F.col("need"))
        .select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), "n_shared")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item, told apart by their texts."""
    rows = marked(docs, ["text"])
    bad = cut(contaminated(rows.select(F.col("_mark").alias("doc_id"), "_row.text"), benchmark, **options).select(F.col("doc_id").alias("_mark")).distinct())
    return rows.join(small(bad, SMALL_ROWS), "_mark", "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(lower({}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ORACLE = f"""
WITH i AS (SELECT row_number() OVER () AS ir, item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT ir, w, least(5, len(w)) AS s FROM i WHERE len(w) > 0),
ig AS MATERIALIZED (SELECT DISTINCT ir, s, array_to_string(w[p:p + s - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS p FROM k)),
n AS (SELECT ir, count(*) AS n_item FROM ig GROUP BY ir),
dw AS MATERIALIZED (SELECT row_number() OVER () AS dr, doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT DISTINCT s FROM k),
dg AS MATERIALIZED (SELECT DISTINCT dr, s, array_to_string(w[p:p + s - 1], ' ') AS g FROM (SELECT dr, s, w, unnest(range(1, len(w) - s + 2)) AS p FROM dw, l)),
m AS (SELECT dr, ir, count(*) AS n_shared FROM ig JOIN dg USING (s, g) GROUP BY dr, ir)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, max(n_shared)::BIGINT AS n_shared FROM m JOIN n USING (ir) JOIN i USING (ir) JOIN dw USING (dr)
WHERE 100 * n_shared >= {THRESHOLD} * n_item GROUP BY doc_id, item_id, n_item
"""
