"""Language ID by Bayesian evidence fusion.

For each text and language the log posterior is the sum of
  * the text's log likelihood under the language's byte trigrams, times ``TEMPER`` over the
    square root of their number, since neighbouring trigrams are not independent;
  * the log likelihood of the declared language (markup ``lang`` or a table's own column)
    and of the address suffix, each from smoothed counts of what texts of that language declare;
  * the log prior of the host: the host's counts smoothed towards its domain's, the domain's towards the
    corpus', the row's own vote left out.
Trigram counts come from all rows with a declared language; the counts behind the other terms are
grouped aggregations over all rows, by the language that the text alone suggests. A text with
fewer than ``LEAST_LETTERS`` letters, or a best posterior below ``LEAST_POSTERIOR``, is rejected as
``und``; one with fewer than ``VOTE_LETTERS`` has no vote in the counts.

Languages are all the declared ones with at least ``LEAST_ROWS`` rows, a count that does not
depend on how many other rows there are. The texts of rarer ones train one more model together,
and a text that is likest to it is ``und``. The model that goes to the executors has 32 KB a language;
declared values are subtags of two or three letters, so their number is bounded by the codes there
are, and it does not grow with the rows. A declared ``und`` names no language.

Cases: an empty table gives an empty result; a null or empty text is rejected; a null declared
language, suffix or host is evidence of its own kind; equal rows get equal results; if no row
declares a language, every row is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, marked, small, table
from .textops import U64, blocks, mix, pieces, texts_of

UNKNOWN = "und"
BUCKETS = 1 << 13
SMOOTH = 0.5
TEMPER = 1.0
LEAST_LETTERS = 1
VOTE_LETTERS = 12
LEAST_POSTERIOR = 0.5
#: Rows that a declared language needs for a model of its own.
LEAST_ROWS = 3
#: Weight of the coarser level in a host's or domain's prior, in rows.
HOST_ROWS, DOMAIN_ROWS = 20.0, 50.0
#: Hosts and declared values are broadcast up to this many rows.
SMALL_ROWS = 50_000

#: The registrable part of a host: two labels, or three under a second level such as co.uk.
DOMAIN = r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]+))$"

# A-Z as a-z, digits and signs as one space; bytes of other letters as they are.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each trigram that has a letter, and the number of letters by text."""
    buf = _FOLD[np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)]
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = buf != 32
    n_letters = np.bincount(owner, letter, len(texts)).astype(np.int64)
    # The space before a text is the last of the two after its predecessor.
    mid = np.flatnonzero(letter[1:-1]) + 1
    wide = buf.astype(U64)
    code = (wide[mid - 1] << U64(16)) | (wide[mid] << U64(8)) | wide[mid + 1]
    return owner[mid], (mix(code) & U64(BUCKETS - 1)).astype(np.int64), n_letters


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {v: i for i, v in enumerate(languages)}
        codes, counts, held = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            code, place = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(place, np.concatenate(counts), len(code)).astype(np.int64)

        for batch in pieces(batches):
            lang = np.array([at[v] for v in batch.column("declared").to_pylist()], np.int64)
            for first, part in blocks(texts_of(batch)):
                owner, bucket, _ = trigrams(part)
                code, n = np.unique(lang[first + owner] * BUCKETS + bucket, return_counts=True)
                codes.append(code)
                counts.append(n)
                held += len(code)
            if held > 1 << 20:
                code, n = summed()
                codes, counts, held = [code], [n], 0
        if codes:
            code, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(code // BUCKETS), pa.array(code % BUCKETS), pa.array(n)], names=["lang", "bucket", "c"])

    return run


def _likelihoods(log_p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, letters = [], []
            for _, part in blocks(texts_of(batch)):
                owner, bucket, n_letters = trigrams(part)
                grams = np.maximum(1, np.bincount(owner, minlength=len(part)))
                ll = np.stack([np.bincount(owner, p[bucket], len(part)) for p in log_p], axis=1)
                rows.append(ll * (TEMPER / np.sqrt(grams))[:, None])
                letters.append(n_letters)
            ll = (np.concatenate(rows) if rows else np.zeros((0, len(log_p)))).astype(np.float64)
            arrays = [batch.column(c) for c in ("id", "declared", "suffix", "host", "domain")]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * len(log_p), pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(np.concatenate(letters) if letters else np.zeros(0, np.int64)), lists],
                names=["id", "declared", "suffix", "host", "domain", "letters", "ll"],
            )

    return run


def normal(declared: Column) -> Column:
    """Primary subtag of two or three letters, lower case; anything else is null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), "^([a-z]{2,3})(?![a-z])", 1), F.lit(""))


def trained(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, from all rows that declare one. If some
    are declared by fewer than ``LEAST_ROWS`` rows, the last is ``und``, the model of all of these."""
    rows = rows.filter(F.col("declared").isNotNull() & (F.col("declared") != UNKNOWN))
    # One row a language code.
    found = rows.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).collect()
    languages = sorted(r.declared for r in found if r.n >= LEAST_ROWS)
    if not found:
        return [], np.zeros((0, BUCKETS), np.float32)
    known = F.col("declared").isin(languages)
    if len(found) > len(languages):
        languages.append(UNKNOWN)
    sums = (
        rows.select(F.when(known, F.col("declared")).otherwise(F.lit(UNKNOWN)).alias("declared"), "text")
        .mapInArrow(_count(languages), "lang long, bucket long, c long")
        .groupBy("lang", "bucket").agg(F.sum("c").alias("c"))
        .toArrow()
    )
    c = np.full((len(languages), BUCKETS), SMOOTH)
    c[sums["lang"].to_numpy(), sums["bucket"].to_numpy()] += sums["c"].to_numpy()
    return languages, np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)


def _numbers(values: list[float]) -> Column:
    """A constant array, short in the plan however many values it has."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def tallies(seen: DataFrame, by: str, n: int) -> DataFrame:
    """``by``, votes: how many rows with that value vote for each of ``n`` languages."""
    counted = seen.filter("vote is not null").groupBy(by, "vote").agg(F.count(F.lit(1)).cast("double").alias("c"))
    lists = counted.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("vote", "c"))).alias("by_vote"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    # The map is bound first, or it would be built anew for each language.
    votes = F.get(F.transform(F.array("by_vote"), lambda m: F.transform(every, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))), F.lit(0))
    return lists.select(by, votes.alias("votes"))


def _smoothed(n: Column, weight: float):
    return lambda votes, coarser: (votes + F.lit(weight) * coarser) / (n + F.lit(weight))


def identify(rows: DataFrame) -> DataFrame:
    """id, language (or ``und``), posterior of each row of ``rows`` (id, text, declared,
    suffix, host, domain)."""
    languages, log_p = trained(rows)
    if not languages:
        return rows.select("id", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"))
    n = len(languages)
    seen = cut(
        rows.select("id", "text", "declared", "suffix", "host", "domain")
        .mapInArrow(_likelihoods(log_p), f"id {dict(rows.dtypes)['id']}, declared string, suffix string, host string, domain string, letters long, ll array<double>")
        .withColumn("vote", F.when(F.col("letters") >= VOTE_LETTERS, F.array_position("ll", F.array_max("ll")) - 1).cast("int"))
    )
    zeros = _numbers([0.0] * n)
    # One number a language.
    every = [0.0] * n
    for r in seen.filter("vote is not null").groupBy("vote").agg(F.count(F.lit(1)).alias("c")).collect():
        every[r.vote] = float(r.c)
    all_votes = _numbers(every)
    share = _numbers([(v + 1.0) / (sum(every) + n) for v in every])

    def evidence(column: str) -> DataFrame:
        """log P(value | language) of each value of ``column``, by language."""
        out = tallies(seen, column, n).select(
            F.col(column).alias(f"{column}_value"),
            F.zip_with("votes", all_votes, lambda a, b: F.log((a + SMOOTH) / (b + 20 * SMOOTH))).alias(f"{column}_log"),
        )
        return small(cut(out), SMALL_ROWS)

    def counts(column: str) -> DataFrame:
        out = tallies(seen, column, n).select(F.col(column).alias(f"{column}_name"), F.col("votes").alias(f"{column}_votes"))
        return small(cut(out), SMALL_ROWS)

    out = seen.withColumn("share", share)
    for column in ("declared", "suffix"):
        out = out.join(evidence(column), F.col(column).eqNullSafe(F.col(f"{column}_value")), "left")
    for column in ("host", "domain"):
        out = out.join(counts(column), F.col(column).eqNullSafe(F.col(f"{column}_name")), "left")
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == F.col("vote"), 1.0).otherwise(0.0))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    out = out.withColumn("own", own)
    for column, weight, coarser in (("domain", DOMAIN_ROWS, "share"), ("host", HOST_ROWS, "domain_prior")):
        votes = F.zip_with(F.coalesce(f"{column}_votes", zeros), "own", lambda a, b: a - b)
        out = out.withColumn(f"{column}_rest", votes).withColumn(f"{column}_n", total(F.col(f"{column}_rest")))
        out = out.withColumn(f"{column}_prior", F.zip_with(f"{column}_rest", coarser, _smoothed(F.col(f"{column}_n"), weight)))
    none = lambda c: F.coalesce(c, zeros)
    score = F.zip_with(
        F.zip_with("ll", F.transform("host_prior", lambda p: F.log(F.greatest(p, F.lit(1e-9)))), lambda a, b: a + b),
        F.zip_with(none("declared_log"), none("suffix_log"), lambda a, b: a + b),
        lambda a, b: a + b,
    )
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    out = out.withColumn("posterior", F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top"))))
    names = F.split(F.lit(" ".join(languages)), " ")
    best = F.element_at(names, F.array_position("score", F.col("top")).cast("int"))
    sure = (F.col("letters") >= LEAST_LETTERS) & (F.col("posterior") >= LEAST_POSTERIOR)
    return out.select("id", F.when(sure, best).otherwise(F.lit(UNKNOWN)).alias("language"), "posterior")


def of_documents(docs: DataFrame, id: Column | None = None) -> DataFrame:
    """Documents as rows for ``identify``: their column lang is what they declare, their source the host."""
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id")) if id is None else id
    return docs.select(
        own.alias("id"),
        "text", normal(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"),
        F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"),
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages as rows for ``identify``: text without markup, declared by ``<html lang>``."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    return pages.select(
        F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id")).alias("id"),
        F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ").alias("text"),
        normal(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)).alias("declared"),
        F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"),
        F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.regexp_extract(host, DOMAIN, 1), F.lit("")).alias("domain"),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are rejected. What is told of a row follows from its text,
    language and source alone, so rows are told apart by these, whatever their ids."""
    rows = marked(docs, ["text", "lang", "source"])
    kind = of_documents(rows.select("_row.text", "_row.lang", "_row.source", "_mark"), F.col("_mark"))
    gone = cut(identify(kind).filter(F.col("language") == UNKNOWN).select(F.col("id").alias("_mark")).distinct())
    return rows.join(small(gone, SMALL_ROWS), "_mark", "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_documents(table(spark, sf_dir, "documents")).unionByName(of_pages(table(spark, sf_dir, "pages")))
    return identify(rows).select("id.doc_id", "id.page_id", "language", "posterior", (F.col("language") != UNKNOWN).alias("accepted"))
