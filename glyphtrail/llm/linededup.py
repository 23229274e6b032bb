"""Line deduplication by a fixed-depth log-template tree.

A line's tokens are its words; tokens with a digit, and e-mail addresses or links, are
variable fields at once (``<*>``). The tree has fixed depth: number of tokens, then the
leading ``DEPTH`` masked tokens; a leaf holds the lines that agree in these. Inside a
leaf that enough texts reach, the template is generalised: a position keeps its token
where at least ``SHARE`` percent of the leaf's distinct texts have it, else it becomes ``<*>``; a
leaf template counts if at least ``FIXED`` percent of its positions, and more than the
leading ones, stay fixed. A leaf may hold several templates: where two or more tokens of one
position are each found in ``MIN_TEXTS`` distinct texts, the leaf branches, and lines that agree
in all such tokens are generalised once more by themselves, by the same rule. Fields that
vary among frequent values at several positions at once part a template's lines
into as many branches, each of which has to reach ``MIN_TEXTS``. A line that recurs by itself is a template too: as masked, or
as it is where fewer than ``FIXED`` percent of its tokens would be fixed. A template found in at
least ``MIN_TEXTS`` distinct texts is boilerplate: its lines are dropped in every document but the
first (smallest id) that has it. Exact copies of a document count as one text, so being
copied does not make a document boilerplate.

Cases: an empty table gives an empty result; a null text has no lines; blank lines are
never templates and stay, and so does a line of fewer than ``MIN_TOKENS`` tokens and ``MIN_CHARS`` characters (a long line
of one token, as in scripts without spaces, recurs like any other); a very long text is split in one task; further columns
stay as they are, ``n_lines`` and ``n_dropped`` of the caller with ``_before`` behind their names; equal rows get equal results, and copies of a template's
first document keep it too; null ids come last among the first documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, beside, cut, fresh, small, table

DEPTH = 3
MIN_TEXTS = 10
SHARE = 50
FIXED = 60
MIN_TOKENS, MIN_CHARS = 2, 40
#: Leaves and templates are broadcast up to this many rows (of 16 bytes).
SMALL_KEYS = 200_000
#: What counts as a variable field, in masked form.
VARIABLE = r"[^\x20\x09-\x0D]*(?:[0-9]|@|://)[^\x20\x09-\x0D]*"
WILD = "<*>"


def lines_of(docs: DataFrame) -> DataFrame:
    """A row per line: doc_id, text_key, at, tokens, n, leaf, line_key; leaf is 0 where a line is too short to
    count. It is no null, and nothing is filtered here: a filter on what tokens tell, also the one that a join infers
    for keys that may be null, would be pushed down and split every line a second time. Each line is searched
    once for variable fields; most have none, and single spaces only, for which a plain split does."""
    text = F.col("text")
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(c))
    texts = docs.select("doc_id", F.xxhash64("text", F.crc32("text")).alias("text_key"), odd.alias("odd"), "text")
    lines = texts.select("doc_id", "text_key", "odd", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("variable", F.col("line").rlike("[0-9@]|://"))
    lines = lines.withColumn("masked", F.when(F.col("variable"), F.regexp_replace("line", VARIABLE, WILD)).otherwise(F.col("line")))
    lines = lines.withColumn("parts", F.split("masked", " "))
    full = lambda parts: F.filter(parts, lambda t: t != "")
    tokens = (
        F.when(F.col("odd"), full(F.split("masked", f"{SPACE}+")))
        .when(F.array_contains("parts", ""), full(F.col("parts")))
        .otherwise(F.col("parts"))
    )
    lines = lines.withColumn("tokens", tokens)
    fixed = F.size("tokens") - F.when(F.col("variable"), F.size(F.filter("tokens", lambda t: t == WILD))).otherwise(0)
    counts = (F.size("tokens") >= MIN_TOKENS) | ((F.size("tokens") > 0) & (F.length("line") >= MIN_CHARS))
    return lines.select(
        "doc_id", "text_key", "at", "tokens",
        F.size("tokens").alias("n"),
        F.when(counts, F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH))).otherwise(F.lit(0).cast("long")).alias("leaf"),
        F.when(fixed * 100 >= F.size("tokens") * FIXED, F.xxhash64(F.size("tokens"), "tokens")).otherwise(F.xxhash64("line")).alias("line_key"),
    )


def recurring(lines: DataFrame, key: str, min_texts: int) -> DataFrame:
    """Keys found in at least ``min_texts`` texts, with the smallest document id."""
    return (
        lines.groupBy(key, "text_key").agg(F.min("doc_id").alias("first_id"))
        .groupBy(key).agg(F.count(F.lit(1)).alias("n_texts"), F.min("first_id").alias("first_id"))
        .filter(F.col("n_texts") >= min_texts)
        .drop("n_texts")
    )


def token_texts(seen: DataFrame, kinds: DataFrame) -> DataFrame:
    """node, n, pos, token, c: the number of distinct texts that have the token there, from lines (node, n, line_key,
    text_key) and their kinds (node, line_key, tokens). Texts with the same kinds of line in a node are counted first;
    tokens are made once for all of them. No key holds more than one row a text when it is dealt out."""
    sets = (
        seen.groupBy("node", "n", "text_key").agg(F.array_sort(F.collect_set("line_key")).alias("keys"))
        .groupBy("node", "n", "keys").agg(F.count(F.lit(1)).alias("texts"))
    )
    each = sets.select("node", "n", "texts", "keys", F.explode("keys").alias("line_key")).join(kinds.select("node", "line_key", "tokens"), ["node", "line_key"])
    return (
        each.select("node", "n", "keys", "texts", F.posexplode("tokens").alias("pos", "token"))
        .groupBy("node", "n", "pos", "token", "keys").agg(F.first("texts").alias("texts"))
        .groupBy("node", "n", "pos", "token").agg(F.sum("texts").alias("c"))
    )


def templates(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """node -> fixed: the (position, token) that stay, of nodes worth a template, from
    their lines and the lines' ``token_texts``."""
    total = seen.groupBy("node", "text_key").agg(F.lit(1).alias("one")).groupBy("node").agg(F.count("one").alias("all"))
    sized = counts.groupBy("node", "n", "pos").agg(F.max_by("token", F.struct("c", "token")).alias("token"), F.max("c").alias("c"))
    return (
        sized.join(small(cut(total), SMALL_KEYS), "node")
        .filter((F.col("token") != WILD) & (F.col("c") * 100 >= F.col("all") * SHARE))
        .groupBy("node", "n").agg(F.collect_list(F.struct("pos", "token")).alias("fixed"))
        .filter((F.size("fixed") * 100 >= F.col("n") * FIXED) & (F.size("fixed") > F.least(F.lit(DEPTH), F.col("n") - 1)))
        .select("node", "fixed")
    )


def fitting(kinds: DataFrame, found: DataFrame) -> DataFrame:
    """line_key, node of the kinds of line (node, line_key, tokens) that fit their node's template."""
    return kinds.join(found, "node").filter(F.forall("fixed", lambda f: F.get("tokens", f["pos"]) == f["token"])).select("line_key", "node")


def branches(kinds: DataFrame, counts: DataFrame, min_texts: int) -> DataFrame | None:
    """line_key, branch of each kind of line in leaves that branch; None if no leaf does."""
    often = counts.filter((F.col("token") != WILD) & (F.col("c") >= min_texts)).select("node", "pos", "token")
    forks = often.groupBy("node", "pos").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1").select("node", "pos")
    often = cut(often.join(forks, ["node", "pos"]))
    if not often.limit(1).count():
        return None
    forked = kinds.join(small(cut(often.select("node").distinct()), SMALL_KEYS), "node")
    # Only tokens that part lines go on; a line without any has a branch of its own kind.
    taken = forked.select("node", "line_key", F.posexplode("tokens").alias("pos", "token")).join(small(often, SMALL_KEYS), ["node", "pos", "token"])
    ways = taken.groupBy("line_key").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("way"))
    return forked.select("node", "line_key").join(ways, "line_key", "left").select("line_key", F.xxhash64("node", "way").alias("branch"))


def dropped_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """doc_id, text_key, drop: the positions of a text's lines that go, if any. Only
    keys are written for every line; tokens are made anew for lines of recurring leaves."""
    keys = cut(lines_of(docs).select("doc_id", "text_key", "at", "leaf", "line_key")).filter("leaf <> 0")
    # A checkpoint hands on what the planner knows of its values, and a join infers a filter from that.
    near = small(fresh(cut(recurring(keys, "leaf", min_texts).select("leaf"))), SMALL_KEYS)
    lines = cut(keys.join(near, "leaf"))
    seen = cut(
        lines_of(docs).join(near, "leaf").groupBy(F.col("leaf").alias("node"), "n", "line_key", "text_key").agg(F.first("tokens").alias("tokens"))
    )
    kinds = cut(seen.groupBy("node", "line_key").agg(F.first("tokens").alias("tokens")))
    counts = cut(token_texts(seen, kinds))
    fits = cut(fitting(kinds, templates(seen, counts)))
    member = lines.join(small(fits, SMALL_KEYS), "line_key")
    whole = cut(recurring(member, "node", min_texts))
    by_leaf = member.join(small(whole, SMALL_KEYS), "node")
    by_line = lines.join(small(cut(recurring(lines, "line_key", min_texts)), SMALL_KEYS), "line_key")
    places = ["doc_id", "text_key", "at", "first_id"]
    out = by_leaf.select(places).unionByName(by_line.select(places))
    ways = branches(kinds, counts, min_texts)
    if ways is not None:
        ways = small(cut(ways), SMALL_KEYS)
        seen = cut(seen.drop("node").join(ways, "line_key").withColumnRenamed("branch", "node"))
        kinds = kinds.drop("node").join(ways, "line_key").withColumnRenamed("branch", "node")
        # Lines of a recurring leaf template count for their branch, but stay or go by the leaf.
        settled = fits.join(whole.select("node"), "node", "left_semi").select("line_key", F.lit(True).alias("settled"))
        inner = cut(fitting(kinds, templates(seen, cut(token_texts(seen, kinds)))).join(settled, "line_key", "left"))
        member = lines.join(small(inner, SMALL_KEYS), "line_key")
        found = small(cut(recurring(member, "node", min_texts).select("node")), SMALL_KEYS)
        rest = cut(member.filter("settled is null").join(found, "node"))
        first = rest.groupBy("node").agg(F.min("doc_id").alias("first_id"))
        out = out.unionByName(rest.join(small(cut(first), SMALL_KEYS), "node").select(places))
    # A line of several kinds stays only where it is the first of all.
    return (
        out.filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("drop"))
    )


def drop_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``docs`` with ``text`` freed of boilerplate, and ``n_lines``, ``n_dropped``."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_texts).select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), F.col("drop"))
    text = F.col("_row.text")
    lines = F.split(text, "\n")
    # Texts without a dropped line are not rebuilt.
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).join(
        gone, F.col("_row.doc_id").eqNullSafe(F.col("g_id")) & (F.xxhash64(text, F.crc32(text)) == F.col("g_key")), "left"
    )
    left = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n"))
    kept = [left.alias("text") if c == "text" else col for c, col in zip(docs.columns, beside(docs.columns, ["n_lines", "n_dropped"]), strict=True)]
    return out.select(
        *kept,
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("drop")), F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), F.length("text").cast("long").alias("kept_chars")
    )


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT rid, doc_id, md5(text) AS tk, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT * FROM (SELECT *, list_filter(regexp_split_to_array(regexp_replace(line, '{VARIABLE}', '{WILD}', 'g'), '{SPACE}+'), lambda t: t <> '') AS w FROM x) WHERE len(w) >= {MIN_TOKENS} OR (len(w) > 0 AND length(line) >= {MIN_CHARS})),
k AS MATERIALIZED (SELECT *, len(w) AS n, len(w) || ' ' || array_to_string(w[1:{DEPTH}], ' ') AS leaf, CASE WHEN 100 * len(list_filter(w, lambda t: t <> '{WILD}')) >= {FIXED} * len(w) THEN array_to_string(w, ' ') ELSE 'raw: ' || line END AS lk FROM l),
lv AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT tk) >= {MIN_TEXTS}),
c AS (SELECT leaf, n, p, w[p] AS token, count(*) AS c FROM (SELECT leaf, n, w, unnest(range(1, n + 1)) AS p FROM k SEMI JOIN lv USING (leaf)) GROUP BY ALL),
s AS (SELECT leaf, n, p, sum(c) AS total, max(c) AS c, arg_max(token, (c, token)) AS token FROM c GROUP BY leaf, n, p),
t AS MATERIALIZED (SELECT leaf, n, list(p ORDER BY p) AS ps, list(token ORDER BY p) AS ts FROM s WHERE token <> '{WILD}' AND c * 100 >= total * {SHARE} GROUP BY leaf, n
  HAVING count(*) * 100 >= n * {FIXED} AND count(*) > least({DEPTH}, n - 1)),
m AS MATERIALIZED (SELECT k.* FROM k JOIN t USING (leaf) WHERE list_transform(ps, lambda p: w[p]) = ts),
fl AS (SELECT leaf, min(doc_id) AS first_id FROM m GROUP BY leaf HAVING count(DISTINCT tk) >= {MIN_TEXTS}),
fk AS (SELECT lk, min(doc_id) AS first_id FROM k GROUP BY lk HAVING count(DISTINCT tk) >= {MIN_TEXTS}),
g AS (SELECT DISTINCT rid, pos FROM (SELECT rid, pos, doc_id, first_id FROM m JOIN fl USING (leaf) UNION ALL SELECT rid, pos, doc_id, first_id FROM k JOIN fk USING (lk)) WHERE doc_id IS DISTINCT FROM first_id),
gg AS (SELECT rid, list(pos) AS drops FROM g GROUP BY rid),
o AS (SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(drops), 0)::BIGINT AS n_dropped,
  CASE WHEN drops IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda q, i: NOT list_contains(drops, i - 1)), chr(10)) END AS kept FROM d LEFT JOIN gg USING (rid))
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256, length(kept)::BIGINT AS kept_chars FROM o
"""
