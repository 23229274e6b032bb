"""Secret scan with corpus-wide ownership frequency.

Base spans are found per kind by a fixed pattern. Beyond them every opaque string
(long, of letters and digits mixed) is a candidate. Candidates are hashed and
counted over the whole corpus by distinct owners (``source``) and distinct repositories
(texts, so that exact copies of a document are one): a value that at most ``MAX_OWNERS`` owners and at most
``MAX_REPOSITORIES`` repositories hold is owner-specific and live-looking, and its spans are added under the
kind ``owned``; any other value is a widely copied example and adds nothing. Base spans stay whatever their count says.

Positions come from the pieces between the matches: a match starts behind all pieces and
matches before it. Whether a base span covers a candidate is told from the spans in
order, so the work grows little more than in proportion to the matches in a text.

Cases: an empty table gives an empty result; a null text counts as empty; rows that
are equal get equal results each; a null source is one more owner; ids do not matter; offsets are
code points, end exclusive; a very long text is searched whole in one task; further columns do not
matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .common import cut, table

# The base patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

#: Candidates of the ownership count.
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
#: A value of at most so many owners and repositories is owner-specific; any other is an example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20
#: A value in more texts than this meets them by broadcast; there are at most texts / HOT_TEXTS of these.
HOT_TEXTS = 1_000_000
_SPANS = "array<struct<s:int,kind:string,e:int,value:string>>"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def placed(text: Column, pattern: str, kind: str, matches: Column, values: Column) -> Column:
    """Array of (s, kind, e, value) of all ``matches`` of ``pattern`` in ``text``."""
    # As many pieces as matches stand before a match.
    facts = F.arrays_zip(
        F.slice(F.transform(F.split(text, pattern), lambda p: F.length(p)), 1, F.size(matches)).alias("gap"),
        F.transform(matches, lambda m: F.length(m)).alias("n"), values.alias("value"),
    )

    def spans(x: Column) -> Column:
        ends = T.running_sums(F.transform(x, lambda m: m["gap"] + m["n"]))
        return T.bound(ends, lambda at: F.transform(x, lambda m, i: F.struct(
            (F.get(at, i) + m["gap"]).cast("int").alias("s"), F.lit(kind).alias("kind"),
            (F.get(at, i) + m["gap"] + m["n"]).cast("int").alias("e"), m["value"].alias("value"),
        )))

    return F.when(F.size(matches) == 0, F.array().cast(_SPANS)).otherwise(T.bound(facts, spans).cast(_SPANS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """doc_id, owner, text_key and per kind the spans (s, kind, e, value) of each row."""
    text = F.col("_text")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(owner_col).alias("owner"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
    )
    least = HEX.replace("+", f"{{{HEX_CHARS},}}")
    rows = rows.select(
        "doc_id", "owner", "_text",
        found(text, ASSIGN).alias("a0"),
        found(text, ACCESS).alias("c0"),
        found(text, least).alias("h0"),
        found(text, OPAQUE).alias("o0"),
    ).withColumn("a2", F.when(F.size("a0") > 0, found(text, ASSIGN, 2)).otherwise(F.array().cast("array<string>")))
    long_enough = lambda spans, n: F.filter(spans, lambda x: F.length(x["value"]) >= n)
    mixed = lambda spans: F.filter(spans, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    return rows.select(
        "doc_id",
        "owner",
        F.sha2(text, 256).alias("text_key"),
        long_enough(placed(text, ASSIGN, "assign", F.col("a0"), F.col("a2")), ASSIGN_CHARS).alias("assign"),
        long_enough(placed(text, ACCESS, "access", F.col("c0"), F.col("c0")), ACCESS_CHARS).alias("access"),
        placed(text, least, "hex", F.col("h0"), F.col("h0")).alias("hex"),
        mixed(placed(text, OPAQUE, "owned", F.col("o0"), F.col("o0"))).alias("opaque"),
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """value -> n_owners, n_repositories, from (value, owner, text_key). No value is dealt out
    with more than a row an owner or a text."""
    return candidates.groupBy("value").agg(
        F.count_distinct(F.struct("owner")).alias("n_owners"), F.count_distinct("text_key").alias("n_repositories")
    )


def free(texts: DataFrame) -> DataFrame:
    """text_key, v, free of each span of ``texts`` (text_key, base, opaque): ``free`` if no base span overlaps it."""
    each = texts.select("text_key", F.explode(F.concat("base", "opaque")).alias("v"))
    is_base = F.col("v.kind") != "owned"
    # The farthest end of base spans that start up to here, and the nearest start of one from here on.
    end = F.max(F.when(is_base, F.col("v.e"))).over(Window.partitionBy("text_key").orderBy("v.s"))
    start = F.min(F.when(is_base, F.col("v.s"))).over(Window.partitionBy("text_key").orderBy(F.desc("v.s")))
    each = each.withColumn("end", end).withColumn("start", start)
    meets = F.coalesce(F.col("end") > F.col("v.s"), F.lit(False)) | F.coalesce(F.col("start") < F.col("v.e"), F.lit(False))
    return each.select("text_key", "v", (~is_base & ~meets).alias("free"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """A row per row of ``docs``: doc_id, the base spans, and ``added``: spans of opaque
    values that are live-looking and that no base span overlaps, with
    the numbers of live-looking and of widely copied values."""
    rows = cut(scan(docs, id_col, owner_col))
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    some = rows.filter((F.size("base") > 0) | (F.size("opaque") > 0))
    value = F.sha2(F.col("v.value"), 256).alias("value")
    counts = cut(ownership(some.select("owner", "text_key", F.explode(F.concat("base", "opaque")).alias("v")).select("owner", "text_key", value)))
    counts = counts.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    spans = free(some.groupBy("text_key").agg(F.first("base").alias("base"), F.first("opaque").alias("opaque"))).withColumn("value", value)
    hot = counts.filter(F.col("n_repositories") > HOT_TEXTS)
    if hot.limit(1).count():
        met = spans.join(F.broadcast(hot), "value").unionByName(
            spans.join(F.broadcast(hot.select("value")), "value", "left_anti").join(counts.filter(F.col("n_repositories") <= HOT_TEXTS), "value")
        )
    else:
        met = spans.join(counts, "value")
    # Equal values of a text are one for the counts; a text's spans are in no order yet.
    judged = met.groupBy("text_key").agg(
        F.collect_list(F.when(F.col("free") & F.col("live"), F.col("v"))).alias("own"),
        F.count_distinct(F.when(F.col("live"), F.col("value"))).alias("n_live"),
        F.count_distinct(F.when(~F.col("live"), F.col("value"))).alias("n_example"),
    )
    j = judged.select(*[F.col(c).alias(f"j_{c}") for c in judged.columns])
    return rows.join(j, F.col("text_key") == F.col("j_text_key"), "left").select(
        "doc_id", "assign", "access", "hex", "base",
        F.coalesce("j_own", F.array().cast(_SPANS)).alias("added"),
        F.coalesce("j_n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("j_n_example", F.lit(0)).cast("long").alias("n_example"),
    )


def in_order(spans: Column) -> Column:
    """By start, then kind as listed (their names sort as they are listed, but for access)."""
    rank = lambda x: F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).when(x["kind"] == "hex", 2).otherwise(3)
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), rank(x).alias("r"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        size("assign").alias("n_assign"),
        size("access").alias("n_access"),
        size("hex").alias("n_hex"),
        F.sha2(joined(in_order(F.col("base"))), 256).alias("base_sha256"),
        joined(in_order(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_example",
    )


def _spans_sql(kind: str, pattern: str, value: str, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
SELECT rid, '{kind}' AS kind, s, s + len(m) AS e, v FROM (
  SELECT rid, unnest(range(1, len(p) // 2 + 1)) AS k, p, p[2 * k] AS m,
         coalesce(list_sum(list_transform(p[1:2 * k - 1], lambda x: len(x))), 0)::BIGINT AS s,
         {value} AS v
  FROM (SELECT rid, string_split(regexp_replace(text, '{quoted}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM t))
WHERE len(v) >= {least}"""


ORACLE = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
b AS MATERIALIZED (
{_spans_sql("assign", ASSIGN, "regexp_extract(m, '" + ASSIGN.replace("'", "''") + "', 2)", ASSIGN_CHARS)}
UNION ALL {_spans_sql("access", ACCESS, "m", ACCESS_CHARS)}
UNION ALL {_spans_sql("hex", HEX, "m", HEX_CHARS)}),
o AS MATERIALIZED (SELECT * FROM ({_spans_sql("owned", OPAQUE, "m", 0)}) WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')),
c AS (SELECT t.doc_id, t.source, x.* FROM (SELECT * FROM b UNION ALL SELECT * FROM o) x JOIN t USING (rid)),
fo AS (SELECT v, count(*) AS n_owners FROM (SELECT DISTINCT v, source FROM c) GROUP BY v),
fr AS (SELECT v, count(*) AS n_repositories FROM (SELECT DISTINCT v, md5(text) FROM c JOIN t USING (rid)) GROUP BY v),
f AS MATERIALIZED (SELECT v, n_owners <= {MAX_OWNERS} AND n_repositories <= {MAX_REPOSITORIES} AS live FROM fo JOIN fr USING (v)),
extra AS (SELECT o.* FROM o JOIN f USING (v) WHERE live
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = o.rid AND b.s < o.e AND o.s < b.e)),
every AS (SELECT rid, kind, s, e, v, true AS base FROM b UNION ALL SELECT rid, kind, s, e, v, false FROM extra),
g AS (SELECT rid, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position(['assign', 'access', 'hex', 'owned'], kind), e) FILTER (base) AS base_spans,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position(['assign', 'access', 'hex', 'owned'], kind), e) AS spans
  FROM every GROUP BY rid),
l AS (SELECT rid, count(DISTINCT v) FILTER (live) AS n_live, count(DISTINCT v) FILTER (NOT live) AS n_example
  FROM c JOIN f USING (v) GROUP BY rid)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM t LEFT JOIN g USING (rid) LEFT JOIN l USING (rid)
"""
