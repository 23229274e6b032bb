"""Phrase counts in nested conversations, by role, and what is derived from them.

Many phrases are counted in one pass: a conversation's turns are reduced to flags first,
so nothing is exploded per phrase and no shuffle carries text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def search(df: DataFrame, text: Column, query: str, literal: bool = False) -> DataFrame:
    """The rows whose text contains ``query`` in any case."""
    return df.filter(T.literal_like(text, query, literal))


def hits(df: DataFrame, text: Column, query: str, key: str, n: int = 3) -> DataFrame:
    """The first n of them by key (a top-k, so that reruns agree)."""
    return search(df, text, query).orderBy(key).limit(n)


def json_blob(messages: Column) -> Column:
    return F.to_json(messages)


def has_role_phrase(messages: Column, role: str, query: str) -> Column:
    return F.exists(messages, lambda m: (m["role"] == role) & T.literal_like(m["content"], query))


def role_text(messages: Column, role: str, separator: str) -> Column:
    """Contents of a role's turns, in order; a null content counts as empty."""
    own = F.filter(messages, lambda m: m["role"] == role)
    return F.array_join(F.transform(own, lambda m: F.coalesce(m["content"], F.lit(""))), separator)


def role_flags(turns: DataFrame, phrases: list[str], role: str = "assistant") -> DataFrame:
    """conv_id and per phrase p: a<p> (in a turn of the role), b<p> (in any turn)."""
    low = F.lower("text")
    cols = []
    for i, p in enumerate(phrases):
        here = F.contains(low, F.lit(p))
        cols += [F.max(here.cast("int")).alias(f"b{i}"), F.max((here & (F.col("role") == role)).cast("int")).alias(f"a{i}")]
    return turns.groupBy("conv_id").agg(*cols)


def role_scoping(turns: DataFrame, phrases: list[tuple[str, str]], role: str = "assistant") -> DataFrame:
    """category, phrase, blob, assistant, inflation: conversations with a phrase in any
    turn and in a turn of the role; the ratio is null without the latter."""
    flags = role_flags(turns, [p for _, p in phrases], role)
    sums = flags.agg(
        *[F.coalesce(F.sum(f"{k}{i}"), F.lit(0)).alias(f"{k}{i}") for i in range(len(phrases)) for k in "ab"]
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(p).alias("phrase"), F.col(f"b{i}").alias("blob"), F.col(f"a{i}").alias("assistant"))
        for i, (c, p) in enumerate(phrases)
    ])
    return sums.select(F.explode(rows).alias("r")).select(
        "r.*", F.try_divide(F.col("r.blob").cast("double"), F.col("r.assistant")).alias("inflation")
    )


def topical_grams(answers: DataFrame, lexicon: dict[str, list[str]], lengths: list[int], stop: list[str], k: int = 3) -> DataFrame:
    """answer_id, length, ord, gram (lower-cased words): the first k distinct n-grams of
    each length that overlap no behaviour phrase and are not stop words only."""
    base = answers.select("answer_id", "text", F.lower("text").alias("low")).select(
        "answer_id",
        T.word_starts(F.col("text")).alias("w"),
        T.find_behaviors(F.col("low"), lexicon).alias("spans"),
    )

    def of_length(n: int) -> DataFrame:
        last = F.size("w") - n
        gram = lambda i: F.struct(
            F.get("w", i)["start"].alias("s"),
            (F.get("w", i + (n - 1))["start"] + F.length(F.get("w", i + (n - 1))["word"])).alias("e"),
            F.transform(F.slice("w", i + 1, n), lambda x: F.lower(x["word"])).alias("words"),
        )
        overlaps = lambda b, g: ((b["start"] <= g["s"]) & (g["s"] < b["end"])) | ((b["start"] < g["e"]) & (g["e"] <= b["end"]))
        free = F.filter(
            F.transform(F.sequence(F.lit(0), last), gram),
            lambda g: ~F.exists("spans", lambda b: overlaps(b, g)) & ~F.forall(g["words"], lambda w: w.isin(stop)),
        )
        # Naming spans twice keeps the optimiser from working them out for every gram.
        free = F.when(F.size("spans") >= 0, free)
        text = F.transform(free, lambda g: F.array_join(g["words"], " "))
        return base.filter(last >= 0).select("answer_id", F.lit(n).alias("length"), F.posexplode(T.first_distinct(text, k)).alias("ord", "gram"))

    parts = [of_length(n) for n in lengths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leave_one_out(counts: DataFrame, value: str, words: str = "n_words") -> DataFrame:
    """Mean of ``value`` by number of words, with and without its largest phrase."""
    return counts.groupBy(words).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.max_by("phrase", F.struct(value, "phrase")).alias("dominant"),
        F.max(value).alias("largest"),
    ).withColumn("mean", F.col("total").cast("double") / F.col("n")).withColumn(
        "mean_without", F.try_divide((F.col("total") - F.col("largest")).cast("double"), F.col("n") - 1)
    )
