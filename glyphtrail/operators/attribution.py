"""Longest verbatim spans that a text shares with a corpus, as set operations.

An n-gram occurs only if its beginnings do, so extending a match word by word from a
position equals taking the longest corpus match that starts there. All 4-grams of the texts are
joined to those of the corpus; runs of consecutive pairs on one diagonal (document position
minus text position) are matches, found by gaps and islands; then each text picks spans
from left to right, jumping behind each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

MIN_WORDS, MAX_WORDS = 4, 16
#: Rows up to which the texts' grams are broadcast.
SMALL_GRAMS = 1_000_000
#: Lengths of the beginnings by which queries are looked up, and how much of the words around a space is.
ANCHORS, AROUND = (8, 5, 3, 2, 1, 0), 2


def _grams(df: DataFrame, key: str, n: int, pos: str) -> DataFrame:
    """A row per word n-gram: key, pos (0-based), h (hash of the n words)."""
    words = df.select(key, T.tokenize(F.col("text")).alias("_w"))
    last = F.size("_w") - n
    values = F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_w", i + t) for t in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return words.select(key, F.posexplode(values).alias(pos, "h"))


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """With a broadcast hint if ``df`` has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def match_places(answers: DataFrame, corpus: DataFrame, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """answer_id, doc_id, i, len: for each corpus place, how many words (at most ``max_words``)
    match from word i of an answer on."""
    own = _grams(answers, "answer_id", min_words, "i")
    there = _grams(corpus, "doc_id", min_words, "p")
    hits = there.join(small(own, SMALL_GRAMS), "h").select("answer_id", "doc_id", "i", (F.col("p") - F.col("i")).alias("diag"))
    line = Window.partitionBy("answer_id", "doc_id", "diag")
    runs = hits.withColumn("run", F.col("i") - F.row_number().over(line.orderBy("i")))
    end = F.max("i").over(Window.partitionBy("answer_id", "doc_id", "diag", "run"))
    return runs.select("answer_id", "doc_id", "i", F.least(F.lit(max_words), end + min_words - F.col("i")).cast("int").alias("len"))


def match_lengths(places: DataFrame) -> DataFrame:
    """answer_id, i, len, n: how many places match exactly ``len`` words."""
    return places.groupBy("answer_id", "i", "len").agg(F.count(F.lit(1)).alias("n"))


def _by_answer(answers: DataFrame, lengths: DataFrame) -> DataFrame:
    """answer_id, words, at: per matching position (i, longest, hist of (len, n)), by position."""
    spots = lengths.groupBy("answer_id", "i").agg(F.max("len").alias("m"), F.collect_list(F.struct("len", "n")).alias("hist"))
    spots = spots.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("i", "m", "hist"))).alias("at"))
    return answers.select("answer_id", T.tokenize(F.col("text")).alias("words")).join(spots, "answer_id")


_SPAN = "array<struct<start:int,words:int,count:bigint>>"


def _count(hist: Column, length: Column) -> Column:
    """Places that match at least ``length`` words."""
    return F.aggregate(hist, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["len"] >= length, x["n"]).otherwise(F.lit(0).cast("bigint")))


def _spell(df: DataFrame, spans: Column) -> DataFrame:
    return (
        df.select("answer_id", "words", F.explode(spans).alias("s"))
        .select(
            "answer_id",
            F.col("s.start").alias("start"),
            F.col("s.words").alias("n_words"),
            F.col("s.count").alias("n_occurrences"),
            F.array_join(F.slice("words", F.col("s.start") + 1, F.col("s.words")), " ").alias("phrase"),
        )
    )


def longest_matches(answers: DataFrame, corpus: DataFrame, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """answer_id, start, n_words, n_occurrences, phrase: each answer's greedy spans."""
    return spans_of(answers, match_places(answers, corpus, min_words, max_words))


def spans_of(answers: DataFrame, places: DataFrame) -> DataFrame:
    """The greedy spans, from the places."""
    by = _by_answer(answers, match_lengths(places))
    picked = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("next"), F.array().cast(_SPAN).alias("out")),
        lambda s, x: F.when(
            x["i"] >= s["next"],
            F.struct(
                (x["i"] + x["m"]).alias("next"),
                F.concat(s["out"], F.array(F.struct(x["i"].alias("start"), x["m"].alias("words"), _count(x["hist"], x["m"]).alias("count")))).alias("out"),
            ),
        ).otherwise(s),
        lambda s: s["out"],
    )
    return _spell(by, picked)


def longest_matches_budget(answers: DataFrame, corpus: DataFrame, max_calls: int = 80, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """As ``longest_matches``, with each look-up of an n-gram counting against ``max_calls``
    of an answer; a span whose extension runs out of look-ups keeps its best length."""
    by = _by_answer(answers, match_lengths(match_places(answers, corpus, min_words, max_words))).withColumn("n", F.size("words"))

    def step(s: Column, i: Column) -> Column:
        here = F.get(F.filter("at", lambda x: x["i"] == i), F.lit(0))
        m = F.coalesce(here["m"], F.lit(0))
        left = F.lit(max_calls) - s["calls"]
        # What a visit costs: every length that is found, and the one that is not, if it is asked for.
        cost = F.when(m >= min_words, m - (min_words - 1) + F.when((m < max_words) & (i + m + 1 <= F.col("n")), 1).otherwise(0)).otherwise(
            F.when(i + min_words <= F.col("n"), 1).otherwise(0)
        )
        length = F.when(m >= min_words, F.least(m, left + (min_words - 1))).otherwise(0)
        taken = F.concat(s["out"], F.array(F.struct(i.alias("start"), length.alias("words"), _count(here["hist"], length).alias("count"))))
        visit = F.struct(
            F.when(length > 0, i + length).otherwise(i + 1).alias("next"),
            (s["calls"] + F.least(cost, left)).alias("calls"),
            F.when(length > 0, taken).otherwise(s["out"]).alias("out"),
        )
        return F.when((i >= s["next"]) & (left > 0), visit).otherwise(s)

    picked = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - 1)),
        F.struct(F.lit(0).alias("next"), F.lit(0).alias("calls"), F.array().cast(_SPAN).alias("out")),
        step,
        lambda s: s["out"],
    )
    return _spell(by, picked)


def ranked(spans: DataFrame) -> DataFrame:
    """With ``rank`` in an answer: longer first, then rarer, then earlier."""
    w = Window.partitionBy("answer_id").orderBy(F.desc("n_words"), F.asc("n_occurrences"), F.asc("start"))
    return spans.withColumn("rank", F.row_number().over(w))


def novelty(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """answer_id, n_tokens, covered, verbatim_coverage, novelty_rate. Spans don't overlap."""
    covered = spans.groupBy("answer_id").agg(F.sum("n_words").alias("covered"))
    n = F.greatest(F.lit(1), F.col("n_tokens"))
    return (
        answers.select("answer_id", F.size(T.tokenize(F.col("text"))).alias("n_tokens"))
        .join(covered, "answer_id", "left")
        .withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
        .withColumn("verbatim_coverage", F.col("covered").cast("double") / n)
        .withColumn("novelty_rate", 1 - F.col("verbatim_coverage"))
    )


def phrase_counts(corpus: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, n_docs, n_occurrences: word n-grams of the corpus equal to each phrase, of any
    length. The corpus is read once: a text gives, for each length that occurs, the hashes of its n-grams."""
    wanted = phrases.select("phrase").distinct().withColumn("words", F.split("phrase", " ")).withColumn("n", F.size("words"))
    # The lengths are a few numbers, however many phrases there are.
    lengths = F.broadcast(wanted.select("n").distinct().agg(F.array_sort(F.collect_list("n")).alias("lengths")))
    words = corpus.select("doc_id", T.tokenize(F.col("text")).alias("_w")).crossJoin(lengths)
    each = words.select("doc_id", "_w", F.explode(F.filter("lengths", lambda n: n <= F.size("_w"))).alias("n"))
    grams = each.select("doc_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("n") + 1), lambda i: F.xxhash64(F.slice("_w", i, F.col("n"))))).alias("h"))
    keyed = wanted.select("phrase", "n", F.xxhash64("words").alias("h"))
    found = grams.join(small(keyed, SMALL_GRAMS), ["n", "h"]).groupBy("phrase", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    counted = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_occurrences"))
    return wanted.select("phrase").join(counted, "phrase", "left").na.fill(0, ["n_docs", "n_occurrences"])


def search_docs(corpus: DataFrame, phrases: DataFrame, max_docs: int = 3, display: int = 250) -> DataFrame:
    """phrase, rank, doc_id, passage: the first documents that contain a phrase literally,
    with ``display`` characters from shortly before it."""
    hit = corpus.join(small(phrases.select("phrase").distinct(), SMALL_GRAMS), F.contains("text", "phrase"))
    start = F.greatest(F.lit(1), F.expr("locate(phrase, text)") - F.lit(50))
    w = Window.partitionBy("phrase").orderBy("doc_id")
    return (
        hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_docs)
        .select("phrase", "rank", "doc_id", F.col("text").substr(start, F.lit(display)).alias("passage"))
    )


def attribution_summary(answers: DataFrame, corpus: DataFrame, top: int = 5, per_span: int = 2) -> DataFrame:
    """answer_id, n_matches, longest_span_words, n_passages: passages are documents that hold one of the
    ``top`` spans, at most ``per_span`` each. They are read off the places that made the spans."""
    places = match_places(answers, corpus)
    best = ranked(spans_of(answers, places))
    wanted = best.filter(F.col("rank") <= top).select("answer_id", F.col("start").alias("i"), "n_words")
    held = places.join(wanted, ["answer_id", "i"]).filter(F.col("len") >= F.col("n_words")).select("answer_id", "i", "doc_id").distinct()
    passages = held.groupBy("answer_id", "i").agg(F.least(F.lit(per_span), F.count(F.lit(1))).alias("n")).groupBy("answer_id").agg(F.sum("n").alias("n_passages"))
    per_answer = best.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_matches"), F.max("n_words").cast("long").alias("longest_span_words"))
    return answers.select("answer_id").join(per_answer, "answer_id", "left").join(passages, "answer_id", "left").na.fill(0)


def rarest_term(questions: DataFrame, counts: DataFrame, floor: int) -> DataFrame:
    """question_id, term: of a question's keywords (word, ord) the rarest with at least
    ``floor`` occurrences, else the commonest; the earlier of equals."""
    known = questions.join(counts, questions["word"] == counts["phrase"], "left").withColumn("n", F.coalesce("n_occurrences", F.lit(0)))
    real = F.col("n") >= floor
    return known.groupBy("question_id").agg(
        F.coalesce(
            F.min_by(F.when(real, F.col("word")), F.when(real, F.struct("n", "ord"))),
            F.min_by("word", F.struct((-F.col("n")).alias("c"), "ord")),
        ).alias("term")
    )


def instruction_query(question: Column, keywords: Column, given: Column | None = None) -> Column:
    """What to look up: the given term, else the longest keyword (the first of equals), else the
    question's beginning."""
    longest = F.element_at(F.filter(keywords, lambda w: F.length(w) == F.array_max(F.transform(keywords, lambda v: F.length(v)))), 1)
    found = F.when(F.size(keywords) > 0, longest).otherwise(F.substring(question, 1, 40))
    return found if given is None else F.coalesce(F.nullif(given, F.lit("")), found)


def _met_in_words(texts: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """q, key of the texts (key, low, words) that contain a query without a space: it lies inside a word, and
    is looked up by its beginning at each place of each distinct word. The first word that has it counts."""
    w, i, q = F.col("word"), F.col("i"), F.col("q")
    places = texts.select("key", "low", F.explode(F.array_distinct("words")).alias("word"))
    places = places.select("key", "low", "word", F.explode(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)))).alias("i"))
    anchors = F.array(*[F.when(F.length(w) >= i + (n - 1), F.substr(w, i, F.lit(n))) for n in sizes])
    met = places.select("key", "low", "word", "i", F.explode(anchors).alias("anchor")).join(wanted, "anchor").filter(F.instr(w, q) == i)
    start = F.instr("low", q)
    here = F.concat(F.substring_index(F.left("low", start - 1), " ", -1), F.substring_index(F.substr("low", start), " ", 1))
    return met.filter(here == w).select("q", "key")


def _met_around_spaces(texts: DataFrame, wanted: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """The same for queries with a space, looked up by what stands around their first space at each
    distinct context of a space in the text. The context of the first occurrence counts."""
    q, c = F.col("q"), F.col("context")
    context = lambda before, after: F.concat(F.right(before, F.lit(AROUND)), F.lit(" "), F.left(after, F.lit(AROUND)))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), context)
    places = texts.select("key", "low", F.explode(F.array_distinct(pairs)).alias("context"))
    at = F.instr(c, " ")
    anchors = F.array(*[F.when((at > a) & (F.length(c) - at >= b), F.substr(c, at - a, F.lit(a + 1 + b))) for a, b in shapes])
    met = places.select("key", "low", "context", F.explode(anchors).alias("anchor")).join(wanted, "anchor")
    start, bend = F.instr("low", q), F.instr("low", q) + F.instr(q, " ") - 1
    here = context(F.substring_index(F.left("low", bend - 1), " ", -1), F.substring_index(F.substr("low", bend + 1), " ", 1))
    return met.filter((start > 0) & (here == c)).select("q", "key")


def search_instruction(queries: DataFrame, dataset: DataFrame, max_hits: int = 3) -> DataFrame:
    """question_id, query, total, n_hits, first_hit: how many rows of ``dataset`` (key, text) contain the query in any
    case, how many of them are shown, and the first of their keys. Queries don't meet texts one by one: each is looked up by an
    anchor, some characters at its beginning or around its first space, and confirmed on the text.
    Queries (question_id, query) are broadcast up to ``SMALL_GRAMS`` rows."""
    q = F.col("q")
    j, parts = F.instr(q, " "), F.split(q, " ")
    begins = F.coalesce(*[F.when(F.length(q) >= n, F.left(q, F.lit(n))) for n in ANCHORS])
    around = F.concat(F.right(F.get(parts, F.lit(0)), F.lit(AROUND)), F.lit(" "), F.left(F.get(parts, F.lit(1)), F.lit(AROUND)))
    distinct = queries.select(F.lower("query").alias("q")).filter(q.isNotNull()).distinct().select("q", (j > 0).alias("spaced"), F.when(j > 0, around).otherwise(begins).alias("anchor"))
    # A handful of lengths, however many queries there are.
    before = F.when(F.col("spaced"), F.instr("anchor", " ") - 1).otherwise(0)
    kinds = distinct.groupBy("spaced", before.alias("a"), F.length("anchor").alias("n")).count().collect()
    few = F.broadcast(distinct) if sum(k["count"] for k in kinds) <= SMALL_GRAMS else distinct
    texts = dataset.select("key", F.lower("text").alias("low")).filter("low is not null").select("key", "low", F.split("low", " ").alias("words"))
    found = []
    if sizes := sorted(k.n for k in kinds if not k.spaced):
        found.append(_met_in_words(texts, few.filter("not spaced").select("q", "anchor"), sizes))
    if shapes := sorted((k.a, k.n - k.a - 1) for k in kinds if k.spaced):
        found.append(_met_around_spaces(texts, few.filter("spaced").select("q", "anchor"), shapes))
    if not found:
        found.append(distinct.crossJoin(dataset.select("key")).limit(0).select("q", "key"))
    met = found[0] if len(found) == 1 else found[0].unionAll(found[1])
    counted = met.groupBy("q").agg(F.count(F.lit(1)).alias("total"), F.min("key").alias("first_hit"))
    out = queries.join(counted, F.lower("query") == q, "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    return out.select("question_id", "query", "total", F.least(F.lit(max_hits), F.col("total")).cast("int").alias("n_hits"), "first_hit")


def trace(answers: DataFrame, corpus: DataFrame, questions: DataFrame, dataset: DataFrame, stop: list[str], floor: int = 1000, max_calls: int | None = None, top: int = 5, per_span: int = 2) -> DataFrame:
    """A row an answer: its spans (longest first), how many, the longest, words covered, passages found for the ``top``
    spans, and what the rarest term of its question (answer_id, question) finds in ``dataset`` (key, text).
    With ``max_calls`` spans are found within that many look-ups an answer."""
    places = match_places(answers, corpus)
    spans = longest_matches_budget(answers, corpus, max_calls) if max_calls else spans_of(answers, places)
    best = ranked(spans)
    listed = best.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("n_matches"), F.max("n_words").cast("int").alias("longest_span_words"),
        F.array_sort(F.collect_list(F.struct("rank", "start", "n_words", "n_occurrences", "phrase"))).alias("spans"),
    )
    wanted = best.filter(F.col("rank") <= top).select("answer_id", F.col("start").alias("i"), "n_words")
    held = places.join(wanted, ["answer_id", "i"]).filter(F.col("len") >= F.col("n_words")).select("answer_id", "i", "doc_id").distinct()
    passages = held.groupBy("answer_id", "i").agg(F.least(F.lit(per_span), F.count(F.lit(1))).alias("n")).groupBy("answer_id").agg(F.sum("n").alias("n_passages"))
    # Only what was asked of an answer here: there may be a question for every conversation, and few answers.
    asked = questions.join(answers.select("answer_id").distinct(), "answer_id", "left_semi").select("answer_id", "question", T.keywords(F.col("question"), stop).alias("k"))
    words = asked.select(F.col("answer_id").alias("question_id"), F.posexplode("k").alias("ord", "word"))
    term = rarest_term(words, phrase_counts(corpus, words.select(F.col("word").alias("phrase"))), floor)
    queries = asked.join(term, F.col("answer_id") == F.col("question_id"), "left").select(
        F.col("answer_id").alias("question_id"), instruction_query(F.col("question"), F.col("k"), F.col("term")).alias("query")
    ).persist()  # a row an answer; made anew, the corpus would be read for each use
    told = search_instruction(queries, dataset).withColumnRenamed("question_id", "answer_id")
    return (
        novelty(answers, spans).join(listed, "answer_id", "left").join(passages, "answer_id", "left").join(told, "answer_id", "left")
        .na.fill(0, ["n_matches", "longest_span_words", "n_passages", "total", "n_hits"])
    )
