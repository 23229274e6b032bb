"""Where benchmark texts come from in the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import attribution as A
from ..sources import tables as S
from .registry import LEX, any_of, query
from .text_queries import KEYWORDS, QUESTIONS, WORD, questions


def answers(spark, d):
    return S.table(spark, d, "benchmark").withColumnRenamed("item_id", "answer_id")


def corpus(spark, d):
    return S.table(spark, d, "documents").select("doc_id", "text")


#: All lengths by recursion over counts, in documents that share a 4-gram with an answer.
SPANS = f"""WITH RECURSIVE
bt AS MATERIALIZED (SELECT item_id, regexp_extract_all(text, {WORD}) AS w FROM benchmark),
dt AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, {WORD}) AS w FROM documents),
b4 AS MATERIALIZED (SELECT DISTINCT array_to_string(w[i + 1:i + 4], ' ') AS g FROM (SELECT w, unnest(range(len(w) - 3)) AS i FROM bt)),
d4 AS (SELECT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 3)) AS i FROM dt)),
hd AS MATERIALIZED (SELECT DISTINCT doc_id FROM d4 SEMI JOIN b4 USING (g)),
ag AS MATERIALIZED (SELECT item_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT item_id, w, i, unnest(range(4, least(16, len(w) - i) + 1)) AS n FROM (SELECT item_id, w, unnest(range(len(w) - 3)) AS i FROM bt))),
gs AS MATERIALIZED (SELECT DISTINCT n, g FROM ag),
hw AS MATERIALIZED (SELECT doc_id, w, unnest(range(len(w) - 3)) AS i FROM dt SEMI JOIN hd USING (doc_id)),
h4 AS MATERIALIZED (SELECT doc_id, w, i FROM hw WHERE array_to_string(w[i + 1:i + 4], ' ') IN (SELECT g FROM b4)),
dg AS (SELECT n, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT w, i, unnest(range(4, least(16, len(w) - i) + 1)) AS n FROM h4)),
cnt AS MATERIALIZED (SELECT n, g, count(*) AS c FROM dg SEMI JOIN gs USING (n, g) GROUP BY n, g),
l AS MATERIALIZED (SELECT item_id, i, max(n) AS l FROM ag JOIN cnt USING (n, g) GROUP BY item_id, i),
st(item_id, pos, l) AS (
  SELECT item_id, min(i), arg_min(l, i) FROM l GROUP BY item_id
  UNION ALL
  SELECT s.item_id, x.pos, x.l FROM st s, LATERAL (SELECT min(i) AS pos, arg_min(l.l, i) AS l FROM l WHERE l.item_id = s.item_id AND i >= s.pos + s.l) x WHERE x.pos IS NOT NULL),
spans AS MATERIALIZED (SELECT st.item_id, st.pos, st.l, c, g FROM st JOIN ag ON ag.item_id = st.item_id AND ag.i = st.pos AND ag.n = st.l JOIN cnt USING (n, g))"""


def spans(spark, d):
    return A.longest_matches(answers(spark, d), corpus(spark, d))


@query("longest_matches", SPANS + ' SELECT item_id AS answer_id, pos::INTEGER AS "start", l::INTEGER AS n_words, c AS n_occurrences, g AS phrase FROM spans')
def longest_matches(spark, d):
    return spans(spark, d)


BUDGET = 40
_VISIT = f"""bs(item_id, nx, calls, s, len) AS (
  SELECT item_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, 0::BIGINT FROM bt
  UNION ALL
  SELECT item_id, CASE WHEN k > 0 THEN nx + k ELSE nx + 1 END, calls + least(cost, {BUDGET} - calls), CASE WHEN k > 0 THEN nx END, k FROM (
    SELECT b.item_id, b.nx, b.calls, CASE WHEN coalesce(l.l, 0) >= 4 THEN least(l.l, {BUDGET} - b.calls + 3) ELSE 0 END AS k,
      CASE WHEN coalesce(l.l, 0) >= 4 THEN l.l - 3 + CASE WHEN l.l < 16 AND b.nx + l.l + 1 <= len(bt.w) THEN 1 ELSE 0 END WHEN b.nx + 4 <= len(bt.w) THEN 1 ELSE 0 END AS cost
    FROM bs b JOIN bt USING (item_id) LEFT JOIN l ON l.item_id = b.item_id AND l.i = b.nx WHERE b.calls < {BUDGET} AND b.nx < len(bt.w)))"""


@query(
    "longest_matches_budget",
    SPANS + f""", {_VISIT} SELECT bs.item_id AS answer_id, s::INTEGER AS "start", len::INTEGER AS n_words, c AS n_occurrences, g AS phrase
FROM bs JOIN ag ON ag.item_id = bs.item_id AND ag.i = bs.s AND ag.n = bs.len JOIN cnt USING (n, g) WHERE s IS NOT NULL""",
)
def longest_matches_budget(spark, d):
    """With at most ``BUDGET`` look-ups an answer."""
    return A.longest_matches_budget(answers(spark, d), corpus(spark, d), BUDGET)


RANKED = SPANS + ", rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY l DESC, c, pos) AS r FROM spans)"


@query("top_spans", RANKED + ' SELECT item_id AS answer_id, r::INTEGER AS rank, pos::INTEGER AS "start", l::INTEGER AS n_words, c AS n_occurrences FROM rk WHERE r <= 12')
def top_spans(spark, d):
    return A.ranked(spans(spark, d)).filter("rank <= 12").select("answer_id", "rank", "start", "n_words", "n_occurrences")


@query("export_spans", RANKED + " SELECT b.text AS question, l::INTEGER AS span_words, c AS corpus_count, g AS phrase FROM rk JOIN benchmark b USING (item_id)")
def export_spans(spark, d):
    """The rows of the CSV export: question, words, count and phrase of each span."""
    return (
        spans(spark, d).join(answers(spark, d), "answer_id")
        .select(F.col("text").alias("question"), F.col("n_words").alias("span_words"), F.col("n_occurrences").alias("corpus_count"), "phrase")
    )


@query(
    "novelty",
    SPANS + """, c AS (SELECT item_id, sum(l)::BIGINT AS covered FROM spans GROUP BY item_id)
SELECT item_id AS answer_id, len(w)::INTEGER AS n_tokens, coalesce(covered, 0) AS covered, coalesce(covered, 0)::DOUBLE / greatest(1, len(w)) AS verbatim_coverage,
  1 - coalesce(covered, 0)::DOUBLE / greatest(1, len(w)) AS novelty_rate FROM bt LEFT JOIN c USING (item_id)""",
)
def novelty(spark, d):
    return A.novelty(answers(spark, d), spans(spark, d))


@query(
    "ngram_count",
    f"""WITH dt AS (SELECT doc_id, regexp_extract_all(text, {WORD}) AS w FROM documents), p AS (SELECT unnest(['of the', 'in the', 'the', 'All rights reserved', 'zzz none']) AS phrase),
g AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dt, (SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM p)))
SELECT phrase, count(DISTINCT doc_id) AS n_docs, count(doc_id) AS n_occurrences FROM p LEFT JOIN g USING (phrase) GROUP BY phrase""",
)
def ngram_count(spark, d):
    phrases = spark.createDataFrame([("of the",), ("in the",), ("the",), ("All rights reserved",), ("zzz none",)], "phrase string")
    return A.phrase_counts(corpus(spark, d), phrases)


@query(
    "search_docs",
    """WITH p AS (SELECT unnest(['of the', 'All rights reserved']) AS phrase)
SELECT phrase, row_number() OVER (PARTITION BY phrase ORDER BY doc_id)::INTEGER AS rank, doc_id, substr(text, greatest(1, instr(text, phrase) - 50), 250) AS passage
FROM p JOIN documents ON contains(text, phrase) QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY doc_id) <= 3""",
)
def search_docs(spark, d):
    return A.search_docs(corpus(spark, d), spark.createDataFrame([("of the",), ("All rights reserved",)], "phrase string"))


@query(
    "attribution_summary",
    RANKED + """, dj AS MATERIALIZED (SELECT ' ' || array_to_string(w, ' ') || ' ' AS t FROM dt SEMI JOIN hd USING (doc_id)),
ps AS (SELECT g, least(2, count(*)) AS n FROM (SELECT DISTINCT g FROM rk WHERE r <= 5) JOIN dj ON contains(t, ' ' || g || ' ') GROUP BY g)
SELECT item_id AS answer_id, count(g) AS n_matches, coalesce(max(l), 0)::BIGINT AS longest_span_words, coalesce(sum(CASE WHEN r <= 5 THEN coalesce(n, 0) ELSE 0 END), 0)::BIGINT AS n_passages
FROM bt LEFT JOIN rk USING (item_id) LEFT JOIN ps USING (g) GROUP BY item_id""",
)
def attribution_summary(spark, d):
    return A.attribution_summary(answers(spark, d), corpus(spark, d))


FLOOR = 2


@query(
    "rarest_term",
    f"""WITH {QUESTIONS}, {KEYWORDS}, dw AS (SELECT unnest(regexp_extract_all(text, {WORD})) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
k AS (SELECT conv_id, kw.w, ord, coalesce(n, 0) AS n FROM kw LEFT JOIN c ON c.w = kw.w)
SELECT conv_id AS question_id, coalesce(arg_min(w, (n, ord)) FILTER (n >= {FLOOR}), arg_min(w, (-n, ord))) AS term FROM k GROUP BY conv_id""",
)
def rarest_term(spark, d):
    words = questions(spark, d).select(F.col("conv_id").alias("question_id"), F.posexplode(T.keywords(F.col("question"), L.KEYWORD_STOP)).alias("ord", "word"))
    counts = A.phrase_counts(corpus(spark, d), words.select(F.col("word").alias("phrase")))
    return A.rarest_term(words, counts, FLOOR)


_TERM = f"""dw AS (SELECT unnest(regexp_extract_all(text, {WORD})) AS w FROM documents), fr AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
kf AS (SELECT conv_id, kw.w, ord, coalesce(n, 0) AS n FROM kw LEFT JOIN fr ON fr.w = kw.w),
tm AS (SELECT conv_id, coalesce(arg_min(w, (n, ord)) FILTER (n >= {FLOOR}), arg_min(w, (-n, ord))) AS term FROM kf GROUP BY conv_id)"""
_SEARCHED = "SELECT count(*) AS total, least(3, count(*))::INTEGER AS n_hits, min(c.conv_id * 1000 + c.turn) AS first_hit FROM conversations c WHERE contains(lower(c.text), lower(z.query))"


def dataset(spark, d):
    """The instruction data to search: every turn, by a key of conversation and place."""
    return S.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")


@query(
    "search_instruction",
    f"""WITH {QUESTIONS}, {KEYWORDS}, z AS (SELECT conv_id, coalesce(arg_min(kw.w, (-length(kw.w), ord)), substr(any_value(question), 1, 40)) AS query FROM questions LEFT JOIN kw USING (conv_id) GROUP BY conv_id)
SELECT conv_id AS question_id, query, total, n_hits, first_hit FROM z, LATERAL ({_SEARCHED}) x""",
)
def search_instruction(spark, d):
    q = questions(spark, d).withColumn("k", T.keywords(F.col("question"), L.KEYWORD_STOP))
    return A.search_instruction(q.select(F.col("conv_id").alias("question_id"), A.instruction_query(F.col("question"), F.col("k")).alias("query")), dataset(spark, d))


@query(
    "trace",
    RANKED.replace("WITH RECURSIVE", f"WITH RECURSIVE {QUESTIONS}, {KEYWORDS}, {_TERM},") + f""", dj AS MATERIALIZED (SELECT ' ' || array_to_string(w, ' ') || ' ' AS t FROM dt SEMI JOIN hd USING (doc_id)),
ps AS (SELECT g, least(2, count(*)) AS n FROM (SELECT DISTINCT g FROM rk WHERE r <= 5) JOIN dj ON contains(t, ' ' || g || ' ') GROUP BY g),
a AS (SELECT item_id, len(any_value(w))::INTEGER AS n_tokens, count(g) AS n_matches, coalesce(max(l), 0)::INTEGER AS longest_span_words, coalesce(sum(l), 0)::BIGINT AS covered,
  coalesce(sum(CASE WHEN r <= 5 THEN coalesce(n, 0) ELSE 0 END), 0)::BIGINT AS n_passages, coalesce(string_agg(g, '|' ORDER BY r), '') AS phrases FROM bt LEFT JOIN rk USING (item_id) LEFT JOIN ps USING (g) GROUP BY item_id),
z AS (SELECT a.*, coalesce(term, substr(question, 1, 40)) AS query FROM a LEFT JOIN questions ON questions.conv_id = a.item_id LEFT JOIN tm ON tm.conv_id = a.item_id)
SELECT item_id AS answer_id, n_tokens, covered, n_matches, longest_span_words, n_passages, md5(phrases) AS phrases_md5, query, total, n_hits, first_hit FROM z, LATERAL ({_SEARCHED}) x""",
)
def trace(spark, d):
    """The whole trace of each benchmark text, as the answer to the question of the conversation with its number."""
    asked = questions(spark, d).withColumnRenamed("conv_id", "answer_id")
    out = A.trace(answers(spark, d), corpus(spark, d), asked, dataset(spark, d), L.KEYWORD_STOP, floor=FLOOR)
    phrases = F.array_join(F.transform("spans", lambda x: x["phrase"]), "|")
    return out.select("answer_id", "n_tokens", "covered", "n_matches", "longest_span_words", "n_passages", F.md5(F.coalesce(phrases, F.lit(""))).alias("phrases_md5"), "query", "total", "n_hits", "first_hit")


_PRESENT = ", ".join(f"CASE WHEN {any_of('lower(text)', ps)} THEN '{c}' END" for c, ps in sorted(L.DEMO.items()))


@query(
    "answer_profile",
    SPANS.replace("WITH RECURSIVE", f"WITH RECURSIVE {LEX},") + f""", c AS (SELECT item_id, sum(l)::BIGINT AS covered, max(l) AS longest FROM spans GROUP BY item_id),
q AS (SELECT item_id, count(DISTINCT phrase) AS n_phrases FROM benchmark JOIN lex ON contains(lower(text), phrase) GROUP BY item_id)
SELECT item_id AS answer_id, length(text)::INTEGER AS answer_chars, array_to_string(list_filter([{_PRESENT}], lambda x: x IS NOT NULL), ';') AS categories,
  coalesce(n_phrases, 0)::INTEGER AS n_phrases, coalesce(covered, 0)::DOUBLE / greatest(1, len(w)) AS verbatim_coverage, coalesce(longest, 0)::INTEGER AS longest_span
FROM benchmark JOIN bt USING (item_id) LEFT JOIN c USING (item_id) LEFT JOIN q USING (item_id)""",
)
def answer_profile(spark, d):
    found = spans(spark, d)
    longest = found.groupBy("answer_id").agg(F.max("n_words").alias("longest"))
    low = F.lower("text")
    n_phrases = sum((F.contains(low, F.lit(p)).cast("int") for _, p, _ in L.rows(L.DEMO)), F.lit(0))
    return (
        answers(spark, d)
        .select("answer_id", F.length("text").alias("answer_chars"), F.array_join(T.categories_present(low, L.DEMO), ";").alias("categories"), n_phrases.alias("n_phrases"))
        .join(A.novelty(answers(spark, d), found).select("answer_id", "verbatim_coverage"), "answer_id")
        .join(longest, "answer_id", "left")
        .select("answer_id", "answer_chars", "categories", "n_phrases", "verbatim_coverage", F.coalesce("longest", F.lit(0)).alias("longest_span"))
    )
