"""Reports, exports, artifacts, settings, hooks, gates."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from glyphtrail.functions import lexicon as L
from glyphtrail.operators import attribution as A
from glyphtrail.operators import embeddings, sampling, validation
from glyphtrail.sources import artifacts, files, reports

TRACE = {
    "model": "m1", "is_proxy": True, "question": "How to rest?", "answer": "x" * 600,
    "pretraining": {"n_matches": 2, "longest_span_words": 5, "matched_spans": [{"words": 5, "count": 1200, "phrase": 'a "b" c d e', "passages": [{"text": "p" * 300, "source": "site"}]}, {"words": 4, "count": 1, "phrase": "w x y z"}]},
    "instruction_tuning": {"query_used": "rest", "query_terms": ["rest"], "datasets": [{"dataset": "d1", "total_matches": 3, "scan_note": "first file", "hits": [{"turns": [{"role": "user", "content": "hi"}]}, {"snippet": "s"}]}, {"dataset": "d2", "error": "gone"}]},
}


def test_trace_report():
    text = reports.trace_report(TRACE)
    for part in ("`m1`", "not public", "How to rest?", "x" * 500 + "\n", '5 words, 1,200 times: "a "b" c d e"', "p" * 200 + " (site)", "d1: 3 examples (first file)", "- user: hi", "- s", "d2: not available (gone)"):
        assert part in text
    assert "p" * 201 not in text and "x" * 501 not in text
    none = reports.trace_report({**TRACE, "is_proxy": False, "pretraining": {}, "instruction_tuning": {}})
    assert "No span of several words" in none and "not public" not in none


def test_exports(spark, tmp_path):
    path = str(tmp_path / "h")
    ids = [files.save_history(spark, path, {**TRACE, "question": q}) for q in ("one", "two")]
    rec = files.load_history(spark, path, ids[0])
    assert json.loads(reports.export_json(rec)) == rec and reports.export_markdown(rec) == reports.trace_report(rec["trace"])
    rows = list(csv.reader(io.StringIO(reports.export_csv(rec))))
    assert rows[0] == ["question", "model", "ts", "span_words", "corpus_count", "phrase"] and rows[1][3:] == ["5", "1200", 'a "b" c d e'] and len(rows) == 3
    reports.export_all(spark.read.schema(files.HISTORY).json(path), str(tmp_path / "all"))
    back = spark.read.schema(files.HISTORY).json(str(tmp_path / "all")).collect()
    assert sorted(r.id for r in back) == sorted(set(ids))


def test_tables(spark):
    df = spark.createDataFrame([("b_1|x", 0.12345, 2), ("a", None, 10)], "name string, rate double, n int")
    assert reports.table_of(df, ["n"]) == "| name | rate | n |\n| --- | ---: | ---: |\n| b_1\\|x | 0.123 | 2 |\n| a | - | 10 |"
    latex = reports.latex_table(["stage", "n"], [["base->sft_1 {50%}", 3]])
    assert r"base$\rightarrow$sft\_1 \{50\%\} & 3 \\" in latex and latex.startswith(r"\begin{tabular}{lr}")
    with pytest.raises(ValueError):
        reports.table_of(df, ["n"], most=1)
    assert [reports.p_text(p) for p in (0.0, 5e-4, 0.0314, None)] == ["<1e-4", "<1e-3", "0.031", "-"] and reports.p_text(0.0, True) == "$<$1e-4"


def test_settings_and_texts(spark, tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nGT_KEY = no\nGT_KEY='from file'\n")
    monkeypatch.delenv("GT_KEY", raising=False)
    assert artifacts.setting(spark, "GT_KEY", str(tmp_path / ".env")) == "from file" and artifacts.setting(spark, "GT_NONE") == ""
    monkeypatch.setenv("GT_KEY", " set ")
    assert artifacts.setting(spark, "GT_KEY", str(tmp_path / ".env")) == "set"
    with pytest.raises(KeyError):
        artifacts.setting(spark, "GT_NONE", required=True)
    (tmp_path / "a.txt").write_text("two\nlines é")
    assert artifacts.answer_text(spark, path=str(tmp_path / "a.txt")) == "two\nlines é"
    assert artifacts.answer_text(spark, text="t") == "t" and artifacts.answer_text(spark, generate=lambda: "g") == "g"
    for bad in ({"text": " \n"}, {}):
        with pytest.raises(ValueError):
            artifacts.answer_text(spark, **bad)
    df = spark.createDataFrame([("x", [1, 2])], "a string, b array<int>")
    assert tuple(df.select(artifacts.text_column(df, "a"), artifacts.text_column(df, "b")).first()) == ("x", "[1,2]")


def test_summaries_of_any_version(spark, tmp_path):
    new = {"n_prompts": {"advice": 60, "emotional": 20}, "per_model": {"1B": {"condition_emission": {"c": 1}, "condition_emission_by_threshold": {"t": 1}, "stagewise_emission": {"s": 1}}}}
    old = {"per_model": {"1B": {"n_advice": 8, "n_factual": 4, "emission_rate": {"c": 2}, "emission_rate_by_threshold": {"t": 2}}}}
    for name, v in (("s2.json", new), ("s1.json", old)):
        (tmp_path / name).write_text(json.dumps(v, indent=1))
    folder = str(tmp_path)
    path = artifacts.latest(spark, folder, ["s3.json", "s2.json", "s1.json"])
    assert path.endswith("s2.json")
    s = artifacts.Summary(artifacts.load_json(spark, path))
    assert (s.conditions(), s.prompts("1B", "emotional"), s.rates("1B"), s.rates_by_threshold("1B"), s.stagewise("1B")) == (["advice", "emotional"], 20, {"c": 1}, {"t": 1}, {"s": 1})
    s = artifacts.Summary(artifacts.load_json(spark, artifacts.latest(spark, folder, ["s1.json"])))
    assert (s.conditions(), s.prompts("1B", "factual"), s.rates("1B"), s.rates_by_threshold("1B"), s.stagewise("1B")) == (["advice", "factual"], 4, {"c": 2}, {"t": 2}, None)
    with pytest.raises(FileNotFoundError):
        artifacts.latest(spark, folder, ["s9.json"])
    assert artifacts.corrected({"a": [{"perm_p": 0.0, "n": 0.5}, {"perm_p": None}]}) == {"a": [{"perm_p": 1 / 10_001, "n": 0.5}, {"perm_p": None}]}


def test_tables_written_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    artifacts.replace(spark.range(5), path)
    artifacts.replace(spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4] and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]
    assert artifacts.spilled(spark.range(3), str(tmp_path / "s")).count() == 3


def test_models_of_the_caller(spark):
    prompts = spark.createDataFrame([(f"p{i}", i % 2) for i in range(10)], "prompt string, seed int")
    got = artifacts.generated(prompts, lambda ps, seeds: [f"{p}/{s}/{len(ps)}" for p, s in zip(ps, seeds, strict=True)], batch=4).collect()
    assert len(got) == 10 and all(r.answer.startswith(f"{r.prompt}/{1000 + r.seed}/") for r in got)
    v = artifacts.encoded(prompts.withColumnRenamed("prompt", "text"), lambda ts: [[3.0, 4.0 if t else 0.0] for t in ts]).collect()
    assert all(r.vec == [0.6, 0.8] for r in v)


def test_kmeans_and_size_matched_clusters(spark):
    points = [(i, [10.0 * (i % 3) + (i % 5) * 0.01, 1.0], i % 3 == 0) for i in range(60)]
    df = sampling.kmeans_labels(spark.createDataFrame(points, "id long, vec array<double>, flagged boolean"), "vec", 3, 1)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.cluster, set()).add(r.id % 3)
    assert len(groups) == 3 and all(len(v) == 1 for v in groups.values())
    taken = sampling.size_matched(df, "cluster", "flagged", 30).collect()
    assert sum(r.taken for r in taken) == 30 and all(r.flagged == 0 for r in taken)


def test_many_exemplars_make_several_rows(spark):
    sentences = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc int, vec array<double>")
    exemplars = spark.createDataFrame([(f"c{i % 2}", [i / 10, 1 - i / 10]) for i in range(11)], "category string, vec array<double>")
    assert embeddings.exemplar_table(exemplars, 3).count() > 1 and embeddings.exemplar_table(exemplars.limit(0)).count() == 0
    got = {(r.doc, r.category): r.sim for r in embeddings.similarities(sentences, exemplars).collect()}
    assert got == {(1, "c0"): 1.0, (1, "c1"): 0.9, (2, "c0"): 1.0, (2, "c1"): 0.9}


def test_gate(spark):
    items = spark.createDataFrame([(i,) for i in range(3)], "item_id int")
    sheet = lambda *rows: spark.createDataFrame(rows, "annotator int, item_id int, annotator_type string, label string")
    who = lambda *rows: spark.createDataFrame(rows, "annotator int, annotator_id string, annotator_type string, independent boolean")
    full = [(a, i, "human", "x") for a in (1, 2) for i in range(3)]
    both = who((1, "ann", "human", True), (2, "bob", "human", True))
    check = lambda s, w: tuple(validation.gate(items, s, w, "item_id").first())
    assert check(sheet(*full), both) == ("ready", None)
    assert check(sheet(*full[:3]), both)[1] == "an annotation is missing"
    assert check(sheet(*full), who((1, "ann", "human", True), (2, "bob", "ai", True)))[1] == "a certificate is missing or not valid"
    assert check(sheet(*full), who((1, "ann", "human", True), (2, "ann", "human", True)))[1] == "the annotators are not different people"
    for bad in (full[:5], [*full, full[0]], [*full[:5], (2, 9, "human", "x")]):
        assert check(sheet(*bad), both) == ("pending", "an annotation does not cover the items exactly")
    assert check(sheet(*full[:5], (2, 2, "ai", "x")), both)[1] == "a row is not by a human"
    assert check(sheet(*full[:5], (2, 2, "human", " ")), both)[1] == "a label is empty"


def test_phrases_of_any_length(spark):
    corpus = spark.createDataFrame([(1, "a b c d"), (2, "b c"), (3, None), (4, "")], "doc_id long, text string")
    long = " ".join(f"w{i}" for i in range(100))
    corpus = corpus.unionByName(spark.createDataFrame([(5, long)], "doc_id long, text string"))
    phrases = [" ".join(long.split()[:n]) for n in range(1, 100)] + ["b c", "zz"]
    got = {r.phrase: (r.n_docs, r.n_occurrences) for r in A.phrase_counts(corpus, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    assert len(got) == 101 and got["b c"] == (2, 2) and got["zz"] == (0, 0) and all(got[p] == (1, 1) for p in phrases[:99])
    assert A.phrase_counts(corpus, spark.createDataFrame([], "phrase string")).count() == 0


def test_instruction_search(spark):
    rows = spark.createDataFrame([(1, "Sleep well and rest"), (2, "REST now"), (3, "other")], "key int, text string")
    q = spark.createDataFrame([(1, "how to sleep or to slumber", None), (2, "to be", None), (3, "how to sleep", "rest")], "question_id int, question string, given string")
    from glyphtrail.functions import text as T

    asked = q.select("question_id", A.instruction_query(F.col("question"), T.keywords(F.col("question"), L.KEYWORD_STOP), F.col("given")).alias("query"))
    got = {r.question_id: (r.query, r.total, r.n_hits, r.first_hit) for r in A.search_instruction(asked, rows).collect()}
    assert got == {1: ("slumber", 0, 0, None), 2: ("to be", 0, 0, None), 3: ("rest", 2, 2, 1)}


def test_trace_within_a_budget(spark):
    corpus = spark.createDataFrame([(1, "one two three four five six seven"), (2, "zero one two three four")], "doc_id long, text string")
    answers = spark.createDataFrame([(1, "one two three four five"), (2, "nothing of that")], "answer_id long, text string")
    asked = spark.createDataFrame([(1, "what of three things"), (2, "why")], "answer_id long, question string")
    turns = corpus.withColumnRenamed("doc_id", "key")
    free = {r.answer_id: r for r in A.trace(answers, corpus, asked, turns, L.KEYWORD_STOP, floor=1).collect()}
    tight = {r.answer_id: r for r in A.trace(answers, corpus, asked, turns, L.KEYWORD_STOP, floor=1, max_calls=1).collect()}
    assert (free[1].n_matches, free[1].longest_span_words, free[1].n_passages, free[1].query, free[1].total) == (1, 5, 1, "three", 2)
    assert tight[1].longest_span_words == 4 and (free[2].n_matches, free[2].query, free[2].spans) == (0, "why", None)


def test_the_stock_lexicon(spark):
    from glyphtrail.functions import text as T

    texts = [(c, f"It is so: {ps[0].upper()} indeed") for c, ps in L.STOCK.items()]
    got = spark.createDataFrame(texts, "category string, text string").select("category", T.categories_present(F.lower("text"), L.STOCK).alias("found")).collect()
    assert got and all(r.category in r.found for r in got)
