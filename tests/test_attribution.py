"""The set-based spans against a plain loop over all n-grams."""

import random
from collections import Counter

import pytest

from glyphtrail.operators import attribution as A


def plain(answers, corpus, max_calls=None, least=4, most=16):
    counts = Counter()
    for _, t in corpus:
        w = t.split()
        for i in range(len(w)):
            for n in range(least, most + 1):
                if i + n <= len(w):
                    counts[tuple(w[i : i + n])] += 1
    out = []
    for key, t in answers:
        w, i, calls = t.split(), 0, 0
        while i < len(w) and (max_calls is None or calls < max_calls):
            best, n = None, least
            while i + n <= len(w) and n <= most and (max_calls is None or calls < max_calls):
                calls += 1
                c = counts[tuple(w[i : i + n])]
                if not c:
                    break
                best, n = (i, n, c), n + 1
            if best:
                out.append((key, *best))
                i += best[1]
            else:
                i += 1
    return sorted(out)


def tables(spark, seed, words="abc"):
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    answers = [(i, text(draw.choice([0, 3, 4, 9, 30]))) for i in range(6)] + [(9, "a " * 40)]
    corpus = [(i, text(draw.choice([0, 5, 40]))) for i in range(8)] + [(8, "a " * 25), (9, answers[4][1])]
    return answers, corpus, spark.createDataFrame(answers, "answer_id long, text string"), spark.createDataFrame(corpus, "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans(spark, seed):
    answers, corpus, a, c = tables(spark, seed)
    got = A.longest_matches(a, c).collect()
    assert sorted((r.answer_id, r.start, r.n_words, r.n_occurrences) for r in got) == plain(answers, corpus)
    words = {k: t.split() for k, t in answers}
    assert all(r.phrase.split() == words[r.answer_id][r.start : r.start + r.n_words] for r in got)


@pytest.mark.parametrize("budget", [1, 5, 12, 80])
def test_budget(spark, budget):
    answers, corpus, a, c = tables(spark, 5)
    got = A.longest_matches_budget(a, c, budget).collect()
    assert sorted((r.answer_id, r.start, r.n_words, r.n_occurrences) for r in got) == plain(answers, corpus, budget)


def test_novelty_and_rank(spark):
    answers, corpus, a, c = tables(spark, 2)
    spans = A.longest_matches(a, c)
    for r in A.novelty(a, spans).collect():
        n = len(dict(answers)[r.answer_id].split())
        covered = sum(s[2] for s in plain(answers, corpus) if s[0] == r.answer_id)
        assert (r.n_tokens, r.covered) == (n, covered) and r.novelty_rate == 1 - covered / max(1, n)
    ranked = A.ranked(spans).filter("answer_id = 9").orderBy("rank").collect()
    assert [(-r.n_words, r.n_occurrences, r.start) for r in ranked] == sorted((-r.n_words, r.n_occurrences, r.start) for r in ranked)


def test_nothing(spark):
    _, _, a, c = tables(spark, 1)
    assert A.longest_matches(a.limit(0), c).count() == 0
    assert A.longest_matches(a, c.limit(0)).count() == 0
    assert A.attribution_summary(a, c.limit(0)).filter("n_matches = 0").count() == a.count()


def test_phrase_counts(spark):
    c = spark.createDataFrame([(1, "a b a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    p = spark.createDataFrame([("a b",), ("b",), ("zz",)], "phrase string")
    got = {r.phrase: (r.n_docs, r.n_occurrences) for r in A.phrase_counts(c, p).collect()}
    assert got == {"a b": (2, 3), "b": (2, 3), "zz": (0, 0)}


def test_search_instruction(spark):
    draw = random.Random(4)
    texts = [(draw.randrange(40), "".join(draw.choice("abAB .é") for _ in range(draw.choice([0, 3, 30])))) for _ in range(120)]
    texts += [(7, None), (50, "aaaaaaaaaa aaaaaaaaaa"), (50, "aaaaaaaaaa aaaaaaaaaa"), (51, " "), (52, "in the a.  in\tthe")]
    asked = ["".join(draw.choice("abA .é") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 9) for _ in range(8)]
    asked += ["", " ", "  ", "a", "A", "aaaa", "aaaaaaaaa", "in the", "n the a.", "a.  in", "in\tthe", "a%", "zzz", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "question_id long, query string")
    got = A.search_instruction(queries, spark.createDataFrame(texts, "key long, text string")).collect()
    assert len(got) == len(asked)
    for r in got:
        keys = sorted(k for k, t in texts if t is not None and r.query is not None and r.query.lower() in t.lower())
        assert (r.query, r.total, r.n_hits, r.first_hit) == (asked[r.question_id], len(keys), min(3, len(keys)), keys[0] if keys else None)
    assert A.search_instruction(queries.limit(0), spark.createDataFrame(texts, "key long, text string")).count() == 0
    # No join without keys: queries times texts would be compared.
    plan = A.search_instruction(queries, spark.createDataFrame(texts, "key long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_trace_looks_up_only_its_answers(spark):
    answers, corpus, a, c = tables(spark, 2)
    asked = spark.createDataFrame([(i, f"word{i % 7} wonders") for i in range(500)], "answer_id long, question string")
    data = spark.createDataFrame([(1, "word0 wonders"), (2, "WONDERS")], "key long, text string")
    seen, real = [], A.search_instruction
    A.search_instruction = lambda q, d: seen.append(q.count()) or real(q, d)
    try:
        rows = A.trace(a, c, asked, data, []).collect()
    finally:
        A.search_instruction = real
    assert seen == [len(answers)] and len(rows) == len(answers)
    assert {(r.query, r.total, r.first_hit) for r in rows} == {("word", 1, 1)}
