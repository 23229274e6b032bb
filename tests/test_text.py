import random
import re

import pytest
from pyspark.sql import functions as F

from glyphtrail.functions import lexicon as L
from glyphtrail.functions import text as T


def column(spark, values, expression, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expression).collect()]


def test_tokens_keep_inner_hyphens(spark):
    got = column(spark, ["It's a well-known and/or case - yes", "", None], T.tokenize(F.col("x")))
    assert got == [["It's", "a", "well-known", "and/or", "case", "yes"], [], None]


def test_sentences(spark):
    texts = ["One. Two!  Three?\nFour", "  Hm. A. ", "", "..."]
    assert column(spark, texts, T.sentences(F.col("x"))) == [["One.", "Two!", "Three?", "Four"], ["Hm.", "A."], [], ["..."]]
    assert column(spark, texts, T.sentences(F.col("x"), 4))[1] == []


def test_keywords_first_distinct(spark):
    got = column(spark, ["What does Friendship mean when friendship ends badly today forever?"], T.keywords(F.col("x"), L.KEYWORD_STOP))
    assert got == [["friendship", "mean", "ends", "badly"]]


def plain_hits(text, lexicon):
    low, out = text.lower(), []
    for c, p, _ in L.rows(lexicon):
        out += [(c, p, i, i + len(p)) for i in range(len(low)) if low.startswith(p, i)]
    return out


def test_find_behaviors_overlapping(spark):
    lexicon = {"a": ["aa", "aba"], "b": ["b.", "ünd "]}
    draw = random.Random(4)
    texts = ["".join(draw.choice("aab. üünd") for _ in range(n)) for n in (0, 1, 5, 40, 200)] + ["aaaa", "ababa", "b.b."]
    got = column(spark, texts, T.find_behaviors(F.lower("x"), lexicon))
    assert [[tuple(h) for h in g] for g in got] == [plain_hits(t, lexicon) for t in texts]


def test_stock_lexicon_sizes():
    assert [len(v) for v in L.STOCK.values()] == [12, 8, 13, 8, 7]
    assert len(L.rows(L.paired(L.STOCK))) == 12 + 7 + 12 + 7


def test_word_starts(spark):
    texts = ["", "a", " it's  été x-1 ", "!!", "ab"]
    got = column(spark, texts, T.word_starts(F.col("x")))
    assert [[tuple(w) for w in g] for g in got] == [[(m.start(), m.group()) for m in re.finditer(r"[A-Za-z0-9']+", t)] for t in texts]


def test_covered_words(spark):
    lexicon = {"a": ["b c", "c d", "ab"], "b": ["d"]}
    draw = random.Random(8)
    texts = ["".join(draw.choice("abcd  .'é") for _ in range(n)) for n in (0, 1, 7, 30, 200, 900)] + ["ab", "xab cab", "abab d"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", F.lower("x").alias("low"))
    got = [r[0] for r in rows.select("x", T.find_behaviors(F.col("low"), lexicon).alias("h")).select(T.covered_words(F.col("x"), F.col("h"))).collect()]
    want = []
    for t in texts:
        spans = [(s, e) for _, _, s, e in plain_hits(t, lexicon)]
        want.append(sum(any(s <= m.start() < e for s, e in spans) for m in re.finditer(r"[A-Za-z0-9']+", t)))
    assert got == want


def test_buckets_in_order(spark):
    paths = ["s3://x/reddit/c4", "cc_en_head-1", "WIKI", "pes2o", "math_code", "none", None]
    assert column(spark, paths, T.bucket_source(F.col("x"), L.BUCKETS)) == ["reddit", "cc_head", "wiki", "academic", "code", "other", "other"]


def test_like_wildcards_and_literal(spark):
    texts = ["100% sure", "100 sure", "a_b", "AxB"]
    assert column(spark, texts, T.literal_like(F.col("x"), "0% s")) == [True, True, False, False]
    assert column(spark, texts, T.literal_like(F.col("x"), "0% S", literal=True)) == [True, False, False, False]
    assert column(spark, texts, T.literal_like(F.col("x"), "a_b")) == [False, False, True, True]


def test_labels(spark):
    raw = ["a; b", "none", "", "b,a,a", "none,a", "c"]
    assert column(spark, raw, T.parse_label(F.col("x"))) == [["a", "b"], [], [], ["a", "b"], ["a"], ["c"]]
    assert column(spark, raw, T.canonical_label(F.col("x"), ["a", "b"])) == ["a;b", "none", None, "a;b", None, None]
    assert column(spark, raw, T.label_status(F.col("x"), ["a", "b"])) == ["ok", "ok", "empty", "ok", "none_not_alone", "unknown"]


def test_key_and_slug_and_url(spark):
    key = T.parse_key(F.col("x"))
    got = column(spark, ["1B__sft__neutral_advice_03__s2"], F.struct(*[c.alias(n) for n, c in key.items()]))
    assert tuple(got[0]) == ("1B", "sft", "neutral_advice", 3, 2)
    assert column(spark, ["Hello,  World!", "---", "x" * 60], T.slugify(F.col("x"))) == ["hello-world", "untitled", "x" * 40]
    assert column(spark, ["a b/c&d"], T.viewer_query(F.col("x"))) == ["a%20b/c%26d"]
    assert column(spark, ["../2024-01x"], T.safe_id(F.col("x"))) == ["2024-01"]


def test_hit_snippet(spark):
    raw = ['[{"role":"user","content":"a  b"},{"role":"assistant","content":"c"}]', " plain \n text ", "[1]"]
    assert column(spark, raw, T.hit_snippet(F.col("x"))) == ["a b / c", "plain text", "[1]"]


@pytest.mark.parametrize("phrase", ["a.b", "x|y", "(z)", "50%", "q?", "it's"])
def test_escape(spark, phrase):
    assert re.findall(L.escape(phrase), f"..{phrase}..") == [phrase]
    assert column(spark, [f"..{phrase}.."], F.regexp_count("x", F.lit(L.alternation([phrase, "nothing"])))) == [1]
