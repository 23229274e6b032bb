"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import corpus
from ..sources import tables as S
from .registry import LEX, any_of, query, quoted, values

WORD, SIMPLE = quoted(T.WORD), quoted(T.SIMPLE_WORD)
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LOWER_WORDS = "regexp_extract_all(lower({}), {})"


def docs(spark, d):
    return S.table(spark, d, "documents")


def listed(words, separator=" "):
    return F.md5(F.array_join(words, separator))


@query("tokenize", f"SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(text, {WORD}) AS t FROM documents)")
def tokenize(spark, d):
    return docs(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), listed("t").alias("tokens_md5"))


@query("simple_words", f"SELECT doc_id, len(t)::INTEGER AS n_words, md5(array_to_string(t, ' ')) AS words_md5 FROM (SELECT doc_id, regexp_extract_all(text, {SIMPLE}) AS t FROM documents)")
def simple_words(spark, d):
    return docs(spark, d).select("doc_id", T.simple_words(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_words"), listed("t").alias("words_md5"))


def _sentences_sql(least: int) -> str:
    return f"""SELECT doc_id, len(s)::INTEGER AS n_sentences, md5(array_to_string(s, chr(1))) AS sentences_md5 FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace({STRIP.format("text")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= {least}) AS s FROM documents)"""


def _sentences(spark, d, least):
    s = docs(spark, d).select("doc_id", T.sentences(F.col("text"), least).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), listed("s", "\x01").alias("sentences_md5"))


@query("sentences", _sentences_sql(1))
def sentences(spark, d):
    return _sentences(spark, d, 1)


@query("sentences_min4", _sentences_sql(4))
def sentences_min4(spark, d):
    return _sentences(spark, d, 4)


def questions(spark, d):
    """conv_id, question: the first sentence of a conversation's first user turn."""
    turns = S.table(spark, d, "conversations").filter("role = 'user'")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.coalesce(F.get(T.sentences(F.col("text")), F.lit(0)), F.lit("")).alias("question"))


QUESTIONS = f"""questions AS (SELECT conv_id, coalesce(list_filter(string_split(regexp_replace({STRIP.format("text")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0)[1], '') AS question
  FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id))"""
_KW = f"""list_filter(regexp_extract_all(lower(question), '[A-Za-z'']+'), lambda w: length(w) > 3 AND NOT list_contains([{", ".join(map(quoted, dict.fromkeys(L.KEYWORD_STOP)))}], w))"""
KEYWORDS = f"""kw AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS ord FROM (
  SELECT conv_id, w, min(p) AS p FROM (SELECT conv_id, unnest({_KW}) AS w, generate_subscripts({_KW}, 1) AS p FROM questions) GROUP BY conv_id, w) QUALIFY ord < 4)"""


@query("keywords", f"WITH {QUESTIONS}, {KEYWORDS} SELECT conv_id, count(w) AS n_keywords, coalesce(string_agg(w, ' ' ORDER BY ord), '') AS keywords FROM questions LEFT JOIN kw USING (conv_id) GROUP BY conv_id")
def keywords(spark, d):
    q = questions(spark, d).select("conv_id", T.keywords(F.col("question"), L.KEYWORD_STOP).alias("k"))
    return q.select("conv_id", F.size("k").cast("long").alias("n_keywords"), F.array_join("k", " ").alias("keywords"))


SPANS = f"""spans AS MATERIALIZED (SELECT doc_id, category, phrase,
    (coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + (k - 1) * length(phrase))::BIGINT AS s
  FROM (SELECT doc_id, category, phrase, string_split(lower(text), phrase) AS p, unnest(range(1, len(string_split(lower(text), phrase)))) AS k FROM documents, lex WHERE contains(lower(text), phrase)))"""


@query("find_behaviors", f'WITH {LEX}, {SPANS} SELECT doc_id, category, phrase, s::INTEGER AS "start", (s + length(phrase))::INTEGER AS "end" FROM spans')
def find_behaviors(spark, d):
    low = docs(spark, d).select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.explode(T.find_behaviors(F.col("low"), L.DEMO)).alias("h")).select("doc_id", "h.*")


_PRESENT = ", ".join(f"CASE WHEN {any_of('lower(text)', ps)} THEN '{c}' END" for c, ps in sorted(L.DEMO.items()))


@query("lexicon_categories", f"SELECT doc_id, array_to_string(list_filter([{_PRESENT}], lambda x: x IS NOT NULL), ';') AS categories FROM documents")
def lexicon_categories(spark, d):
    low = docs(spark, d).select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.array_join(T.categories_present(F.col("low"), L.DEMO), ";").alias("categories"))


@query(
    "behavioral_coverage",
    f"""WITH {LEX}, {SPANS},
p AS (SELECT doc_id, string_split(regexp_replace(text, '({T.SIMPLE_WORD.replace("'", "''")})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
x AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM p),
w AS MATERIALIZED (SELECT doc_id, k, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS st FROM x),
c AS (SELECT DISTINCT w.doc_id, w.k FROM w JOIN spans ON spans.doc_id = w.doc_id AND s <= st AND st < s + length(phrase) WHERE w.k % 2 = 0),
n AS (SELECT doc_id, count_if(k % 2 = 0) AS n_words FROM w GROUP BY doc_id), m AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, n_words::INTEGER AS n_words, coalesce(m.n, 0)::INTEGER AS n_covered, CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE coalesce(m.n, 0)::DOUBLE / n_words END AS coverage FROM n LEFT JOIN m USING (doc_id)""",
)
def behavioral_coverage(spark, d):
    base = docs(spark, d).select("doc_id", "text", F.lower("text").alias("low"))
    base = base.select("doc_id", "text", T.find_behaviors(F.col("low"), L.DEMO).alias("h"))
    n = F.when(F.size("h") > 0, T.covered_words(F.col("text"), F.col("h"))).otherwise(0)
    counted = base.select("doc_id", F.regexp_count("text", F.lit(T.SIMPLE_WORD)).alias("n_words"), n.alias("n_covered"))
    return counted.select("*", F.coalesce(F.try_divide(F.col("n_covered").cast("double"), F.col("n_words")), F.lit(0.0)).alias("coverage"))


_BUCKET = "CASE " + " ".join(f"WHEN {any_of('lower(url)', ps)} THEN '{b}'" for b, ps in L.DEMO_BUCKETS) + " ELSE 'other' END"


@query("bucket_source", f"SELECT page_id, {_BUCKET} AS bucket FROM pages")
def bucket_source(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.bucket_source(F.col("url"), L.DEMO_BUCKETS).alias("bucket"))


@query(
    "source_split",
    f"""WITH b AS (SELECT {_BUCKET} AS bucket FROM pages),
t AS (SELECT greatest(count(*), 1) AS m, count(*) AS n, count_if(bucket IN ('blog')) AS f, count_if(bucket IN ('www', 'mobile')) AS c FROM b)
SELECT bucket, count(*) AS n_bucket, any_value(n) AS n, any_value(f)::DOUBLE / any_value(m) AS forum_share, any_value(c)::DOUBLE / any_value(m) AS curated_share FROM b, t GROUP BY bucket""",
)
def source_split(spark, d):
    per = bucket_source(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_bucket"))
    share = lambda names: F.sum(F.when(F.col("bucket").isin(names), F.col("n_bucket")).otherwise(0))
    total = per.agg(F.sum("n_bucket").alias("n"), share(L.DEMO_FORUM).alias("f"), share(L.DEMO_CURATED).alias("c"))
    out = per.crossJoin(F.broadcast(total))
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n")), F.lit(0.0))
    return out.select("bucket", "n_bucket", "n", ratio("f").alias("forum_share"), ratio("c").alias("curated_share"))


@query("snippet", S.ctes("sft") + " SELECT conv_id, substr(regexp_replace(to_json(messages)::VARCHAR, '\\s+', ' ', 'g'), 1, 300) AS snippet FROM sft")
def snippet(spark, d):
    return S.conversations_nested(S.table(spark, d, "conversations")).select("conv_id", T.snippet(F.to_json("messages")).alias("snippet"))


@query(
    "hit_snippet",
    S.ctes("sft")
    + f""", r AS (SELECT 'turns' AS kind, conv_id AS id, array_to_string(list_transform(messages, lambda m: m.content), ' / ') AS t, len(messages) AS n FROM sft
  UNION ALL SELECT 'text', doc_id, text, 0 FROM documents)
SELECT kind, id, n::INTEGER AS n_turns, substr({STRIP.format("regexp_replace(t, '\\s+', ' ', 'g')")}, 1, 300) AS snippet FROM r""",
)
def hit_snippet(spark, d):
    nested = S.conversations_nested(S.table(spark, d, "conversations")).select(F.lit("turns").alias("kind"), F.col("conv_id").alias("id"), F.to_json("messages").alias("raw"))
    rows = nested.unionByName(docs(spark, d).select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw")))
    return rows.select("kind", "id", F.coalesce(F.size(T.hit_turns(F.col("raw"))), F.lit(0)).alias("n"), T.hit_snippet(F.col("raw")).alias("snippet")).select(
        "kind", "id", F.greatest("n", F.lit(0)).alias("n_turns"), "snippet"
    )


_BEH_WORDS = "flatten([" + ", ".join(f"CASE WHEN contains(low, {quoted(p)}) THEN [{', '.join(map(quoted, p.split()))}]::VARCHAR[] ELSE []::VARCHAR[] END" for _, p, _ in L.rows(L.DEMO)) + "])"
_TOPICAL_STOP = "[" + ", ".join(map(quoted, L.TOPICAL_STOP)) + "]"


@query(
    "topical_terms",
    f"""WITH a AS (SELECT doc_id, low, {_BEH_WORDS} AS bw FROM (SELECT doc_id, lower(text) AS low FROM documents)),
w AS (SELECT doc_id, list_filter(regexp_extract_all(low, '[a-z'']{{5,}}'), lambda x: NOT list_contains({_TOPICAL_STOP}, x) AND NOT list_contains(bw, x)) AS l FROM a),
f AS (SELECT doc_id, x, min(p) AS p FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM w) GROUP BY doc_id, x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(p)) <= 4)
SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY p), '') AS terms FROM w LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
)
def topical_terms(spark, d):
    low = F.lower("text")
    words = F.flatten(F.array(*[F.when(F.contains(low, F.lit(p)), F.array(*[F.lit(w) for w in p.split()])).otherwise(F.array().cast("array<string>")) for _, p, _ in L.rows(L.DEMO)]))
    base = docs(spark, d).select("doc_id", "text", words.alias("bw"))
    return base.select("doc_id", F.array_join(T.topical_terms(F.col("text"), L.TOPICAL_STOP, F.col("bw")), " ").alias("terms"))


LENGTHS = sorted({len(p.split()) for _, p, _ in L.rows(L.DEMO)})
_ANSWER_SPANS = SPANS.replace("doc_id", "item_id").replace("documents", "benchmark")
GRAMS = f"""bp AS (SELECT item_id, string_split(regexp_replace(text, '({T.SIMPLE_WORD.replace("'", "''")})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM benchmark),
bx AS (SELECT item_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM bp),
bw AS (SELECT item_id, lower(piece) AS w, k // 2 AS i, sum(length(piece)) OVER (PARTITION BY item_id ORDER BY k) AS e, length(piece) AS n, k FROM bx),
bt AS MATERIALIZED (SELECT item_id, i, w, e - n AS s, e FROM bw WHERE k % 2 = 0),
bg AS (SELECT a.item_id, l.n AS len, a.i, min(b.s) AS s, max(b.e) AS e, string_agg(b.w, ' ' ORDER BY b.i) AS g, bool_and(list_contains([{", ".join(map(quoted, L.GRAM_STOP))}], b.w)) AS stop
  FROM bt a, (SELECT unnest({LENGTHS}) AS n) l JOIN bt b ON b.item_id = a.item_id AND b.i >= a.i AND b.i < a.i + l.n GROUP BY a.item_id, l.n, a.i HAVING count(*) = l.n),
bf AS (SELECT * FROM bg WHERE NOT stop AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.item_id = bg.item_id AND ((x.s <= bg.s AND bg.s < x.s + length(phrase)) OR (x.s < bg.e AND bg.e <= x.s + length(phrase))))),
bo AS (SELECT item_id, len, g, row_number() OVER (PARTITION BY item_id, len ORDER BY min(i)) - 1 AS ord FROM bf GROUP BY item_id, len, g),
grams AS MATERIALIZED (SELECT * FROM bo WHERE ord < 3)"""
ANSWER_SPANS = _ANSWER_SPANS


@query("body_ngrams", f'WITH {LEX}, {ANSWER_SPANS}, {GRAMS} SELECT item_id AS answer_id, len::INTEGER AS "length", ord::INTEGER AS ord, g AS gram FROM grams')
def body_ngrams(spark, d):
    answers = S.table(spark, d, "benchmark").withColumnRenamed("item_id", "answer_id")
    return corpus.topical_grams(answers, L.DEMO, LENGTHS, L.GRAM_STOP)


_KEY = "model || '__' || stage || '__' || condition || '_' || lpad(prompt_idx::VARCHAR, 2, '0') || '__s' || seed"


@query("parse_key", S.ctes("generations") + f" SELECT doc_id, {_KEY} AS key, model, stage, condition, prompt_idx, seed FROM generations")
def parse_key(spark, d):
    keyed = S.generations(docs(spark, d)).select("doc_id", S.generation_key().alias("key"))
    return keyed.select("doc_id", "key", *[c.alias(n) for n, c in T.parse_key(F.col("key")).items()])


DIRTY = ["a; b", "none", "", "b,a,a", "none,a", "c"]
VOCABULARY = ["a", "b"]


def dirty(spark):
    return spark.createDataFrame([(x,) for x in DIRTY], "label string")


_DIRTY = values([(x,) for x in DIRTY], "dirty", "label")
_PARTS = f"list_filter(list_transform(regexp_split_to_array(label, '[;,]'), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


@query("parse_label", f"WITH {_DIRTY} SELECT label, len(l)::INTEGER AS n_labels, array_to_string(l, ';') AS labels FROM (SELECT label, list_sort(list_distinct(list_filter({_PARTS}, lambda x: x <> 'none'))) AS l FROM dirty)")
def parse_label(spark, d):
    parsed = dirty(spark).select("label", T.parse_label(F.col("label")).alias("l"))
    return parsed.select("label", F.size("l").alias("n_labels"), F.array_join("l", ";").alias("labels"))


@query(
    "canonical_label",
    f"""WITH {_DIRTY}, p AS (SELECT label, list_sort(list_distinct({_PARTS})) AS l FROM dirty),
s AS (SELECT label, l, CASE WHEN len(l) = 0 THEN 'empty' WHEN len(list_filter(l, lambda x: x NOT IN ('a', 'b', 'none'))) > 0 THEN 'unknown'
  WHEN list_contains(l, 'none') AND len(l) > 1 THEN 'none_not_alone' ELSE 'ok' END AS status FROM p)
SELECT label, status, CASE WHEN status = 'ok' THEN array_to_string(l, ';') END AS canonical FROM s""",
)
def canonical_label(spark, d):
    return dirty(spark).select("label", T.label_status(F.col("label"), VOCABULARY).alias("status"), T.canonical_label(F.col("label"), VOCABULARY).alias("canonical"))


@query("stable_item_id", "SELECT doc_id, 'v3_r_' || substr(sha256('response' || chr(10) || doc_id || chr(10) || text), 1, 16) AS item_id FROM documents")
def stable_item_id(spark, d):
    return docs(spark, d).select("doc_id", T.stable_item_id(F.lit("response"), F.col("doc_id").cast("string"), F.col("text")).alias("item_id"))


@query("slugify", """SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id,
  regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '^-+|-+$', '', 'g') AS s FROM documents)""")
def slugify(spark, d):
    return docs(spark, d).select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), event_type) AS tag FROM events")
def json_field(spark, d):
    return S.table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.col("event_type")).alias("tag")
    )


ALIASES = {"A": ["empathy_opener"], "B": ["validation"], "C": ["disclaimer"], "D": ["crisis_referral"], "E": ["structure"], "N": []}
CODES = ["A", "AB", "EDC", "N", "BX"]


@query(
    "alias_map",
    "WITH " + values([(x,) for x in CODES], "codes", "code") + ", " + values([(k, v[0] if v else None) for k, v in ALIASES.items()], "m", "letter, category")
    + ", x AS (SELECT code, unnest(string_split(code, '')) AS letter FROM codes) SELECT code, coalesce(string_agg(category, ';' ORDER BY category), '') AS categories FROM x LEFT JOIN m USING (letter) GROUP BY code",
)
def alias_map(spark, d):
    known = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]).cast("array<string>"))])
    codes = spark.createDataFrame([(x,) for x in CODES], "code string")
    names = F.flatten(F.transform(F.split("code", ""), lambda c: F.coalesce(F.try_element_at(known, c), F.array().cast("array<string>"))))
    return codes.select("code", F.array_join(F.array_sort(names), ";").alias("categories"))


@query("qa_template", f"WITH {QUESTIONS} SELECT conv_id, 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM questions")
def qa_template(spark, d):
    return questions(spark, d).select("conv_id", F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer:")).alias("prompt"))


@query("rename_category", f"WITH {LEX}, " + values(list(L.PAIR_NAMES.items()), "m", "category, shown") + " SELECT category, coalesce(shown, category) AS shown, count(*) AS n_phrases FROM lex LEFT JOIN m USING (category) GROUP BY ALL")
def rename_category(spark, d):
    names = spark.createDataFrame(list(L.PAIR_NAMES.items()), "category string, shown string")
    lex = spark.createDataFrame(L.rows(L.DEMO), "category string, phrase string, ord int")
    return lex.join(F.broadcast(names), "category", "left").groupBy("category", F.coalesce("shown", "category").alias("shown")).agg(F.count(F.lit(1)).alias("n_phrases"))
