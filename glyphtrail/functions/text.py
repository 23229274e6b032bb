"""Text functions: Columns in, Columns out, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two word patterns (with and without inner hyphen or slash).
WORD = r"[A-Za-z0-9']+(?:[-/][A-Za-z0-9']+)*"
SIMPLE_WORD = r"[A-Za-z0-9']+"

SPANS = "array<struct<category:string,phrase:string,start:int,end:int>>"


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def simple_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SIMPLE_WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def sentences(text: Column, min_chars: int = 1) -> Column:
    parts = F.transform(F.split(strip(text), r"(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


def first_distinct(words: Column, k: int) -> Column:
    """The first k distinct elements, in order."""
    return F.slice(F.array_distinct(words), 1, k)


def keywords(question: Column, stop: list[str], k: int = 4) -> Column:
    words = F.regexp_extract_all(F.lower(question), F.lit("[A-Za-z']+"), F.lit(0))
    return first_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(stop)), k)


def topical_terms(text: Column, stop: list[str], behaviour_words: Column, k: int = 4) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']{5,}"), F.lit(0))
    # array_except keeps order; a look-up inside the lambda would work the other array out for every word.
    return F.slice(F.array_except(F.filter(words, lambda w: ~w.isin(stop)), behaviour_words), 1, k)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: inside a lambda an expression of the
    row would be worked out again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """Sums of the elements before each element, and of all at the end: n + 1 numbers of n.
    Arrays can't be appended to in place, so the sums are made in blocks of about sqrt(n)
    and the blocks' offsets are added after: n * sqrt(n) copied cells at most, not n^2."""
    start = lambda: F.array(F.lit(0).cast("bigint"))
    add = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    width = lambda v: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
    parts = lambda v: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(v) / width(v)).cast("int") - 1),
        lambda k: F.aggregate(F.slice(v, k * width(v) + 1, width(v)), start(), add),
    )
    shifted = lambda s: F.flatten(F.transform(s["parts"], lambda p, k: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + F.get(s["at"], k))))
    joined = lambda s: F.concat(shifted(s), F.slice(s["at"], -1, 1))
    with_offsets = lambda p: F.struct(p.alias("parts"), F.aggregate(p, start(), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + F.element_at(x, -1)))).alias("at"))
    return F.when(F.size(lengths) == 0, start()).otherwise(bound(bound(bound(lengths, parts), with_offsets), joined))


def starts_of(low: Column, phrase: str) -> Column:
    """0-based starts of all, also overlapping, occurrences of ``phrase``: the text is
    parted before each occurrence, and starts are the running sums of the pieces."""
    from .lexicon import escape

    none = F.array().cast("array<int>")
    pieces = F.split(low, f"(?={escape(phrase)})")
    # Every piece begins with an occurrence, but for the first one, perhaps.
    places = lambda at: F.slice(at, 2 - low.startswith(phrase).cast("int"), F.size(at) - 2 + low.startswith(phrase).cast("int"))
    found = bound(running_sums(F.transform(pieces, lambda p: F.length(p))), places).cast("array<int>")
    return F.when(F.contains(low, F.lit(phrase)), found).otherwise(none)


def find_behaviors(low: Column, lexicon: dict[str, list[str]]) -> Column:
    """Spans of all lexicon occurrences in a lower-cased text, in the lexicon's order. Give
    a column, not ``lower(text)`` itself, which would be worked out for every phrase."""

    def spans(category: str, phrase: str) -> Column:
        span = lambda i: F.struct(F.lit(category).alias("category"), F.lit(phrase).alias("phrase"), i.alias("start"), (i + len(phrase)).alias("end"))
        return F.transform(starts_of(low, phrase), span)

    parts = [spans(c, p) for c, ps in lexicon.items() for p in ps]
    return F.concat(*[x.cast(SPANS) for x in parts]) if parts else F.array().cast(SPANS)


def categories_present(low: Column, lexicon: dict[str, list[str]]) -> Column:
    """Sorted categories with a phrase in the text."""
    flags = F.array(*[F.when(any_of(low, ps), F.lit(c)) for c, ps in sorted(lexicon.items())])
    return F.array_compact(flags)


def any_of(low: Column, phrases: list[str]) -> Column:
    """Whether one of the literals is in ``low``."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def word_starts(text: Column, pattern: str = SIMPLE_WORD) -> Column:
    """Array of (start, word): words alternate with what parts them, so a word starts behind
    the words before it and the gaps up to it."""
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = F.zip_with(F.slice(F.split(text, pattern), 1, F.greatest(F.size(words), F.lit(1))), words, lambda g, w: F.struct(F.length(g).alias("gap"), w.alias("w")))
    found = lambda s: bound(
        running_sums(F.transform(s, lambda x: x["gap"] + F.length(x["w"]))),
        lambda ends: F.transform(s, lambda x, i: F.struct((F.get(ends, i) + x["gap"]).cast("int").alias("start"), x["w"].alias("word"))),
    )
    return bound(F.filter(spans, lambda x: x["w"].isNotNull()), found)


def covered_words(text: Column, spans: Column, pattern: str = SIMPLE_WORD) -> Column:
    """How many words start inside a span. Spans are merged first; then words are counted in
    each stretch, but for one that began before it. No list of all words is made."""
    stretch = "array<struct<start:int,end:int>>"
    ordered = F.array_sort(F.transform(spans, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))
    merged = F.aggregate(
        ordered,
        F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.array().cast(stretch).alias("out")),
        lambda m, h: F.when(h["start"] <= m["e"], F.struct(m["s"].alias("s"), F.greatest(m["e"], h["end"]).alias("e"), m["out"].alias("out"))).otherwise(
            F.struct(h["start"].alias("s"), h["end"].alias("e"), F.concat(m["out"], F.array(F.struct(m["s"].alias("start"), m["e"].alias("end")))).alias("out"))
        ),
        lambda m: F.concat(m["out"], F.array(F.struct(m["s"].alias("start"), m["e"].alias("end")))),
    )
    inside = lambda x: F.regexp_count(F.substr(text, x["start"] + 1, x["end"] - x["start"]), F.lit(pattern))
    goes_on = lambda x: (x["start"] > 0) & F.substr(text, x["start"], F.lit(2)).rlike(f"^(?:{pattern})$") & (F.length(F.substr(text, x["start"], F.lit(2))) == 2)
    counted = F.transform(F.filter(merged, lambda x: x["start"] >= 0), lambda x: inside(x) - F.when(goes_on(x), 1).otherwise(0))
    return F.aggregate(counted, F.lit(0), lambda a, b: a + b)


def bucket_source(path: Column, buckets: list[tuple[str, list[str]]]) -> Column:
    """The first bucket one of whose patterns is in the lower-cased path, else ``other``."""
    low = F.lower(F.coalesce(path, F.lit("")))
    out = None
    for name, patterns in buckets:
        out = F.when(any_of(low, patterns), name) if out is None else out.when(any_of(low, patterns), name)
    return F.lit("other") if out is None else out.otherwise("other")


def clean(text: Column, limit: int = 300) -> Column:
    return F.substring(strip(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def snippet(*candidates: Column, limit: int = 300) -> Column:
    """The first non-empty candidate, white space collapsed, cut to ``limit``."""
    first = F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])
    return F.substring(F.regexp_replace(first, r"\s+", " "), 1, limit)


TURNS = "array<struct<role:string,content:string>>"


def hit_turns(raw: Column) -> Column:
    """Turns of a JSON list of messages; null if ``raw`` is not one."""
    return F.when(raw.startswith("[{"), F.from_json(raw, TURNS))


def hit_snippet(raw: Column) -> Column:
    turns = hit_turns(raw)
    joined = F.array_join(F.transform(turns, lambda t: F.coalesce(t["content"], F.lit(""))), " / ")
    return clean(F.when(turns.isNotNull() & (F.size(turns) > 0), joined).otherwise(raw))


def viewer_query(query: Column) -> Column:
    """Percent-encoded, space as %20 and slash as it is."""
    return F.replace(F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def parse_key(key: Column) -> dict[str, Column]:
    """model, stage, condition, prompt_idx, seed of ``model__stage__condition_ii__sN``."""
    part = F.split(key, "__")
    return {
        "model": part[0],
        "stage": part[1],
        "condition": F.regexp_extract(part[2], r"^(.*)_(\d+)$", 1),
        "prompt_idx": F.regexp_extract(part[2], r"^(.*)_(\d+)$", 2).cast("int"),
        "seed": F.regexp_extract(part[3], r"^s(\d+)$", 1).cast("int"),
    }


def parse_label(label: Column) -> Column:
    """Distinct labels of a list parted by ; or , without ``none``, sorted."""
    parts = F.transform(F.split(label, "[;,]"), strip)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "none"))))


def label_status(label: Column, vocabulary: list[str]) -> Column:
    """``ok``, or why a label can't be made canonical."""
    parts = F.filter(F.transform(F.split(label, "[;,]"), strip), lambda x: x != "")
    return (
        F.when(F.size(parts) == 0, "empty")
        .when(F.size(F.array_except(parts, F.array(*[F.lit(v) for v in [*vocabulary, "none"]]))) > 0, "unknown")
        .when(F.array_contains(parts, "none") & (F.size(F.array_distinct(parts)) > 1), "none_not_alone")
        .otherwise("ok")
    )


def canonical_label(label: Column, vocabulary: list[str]) -> Column:
    """Sorted distinct labels joined by ;, ``none`` alone, null where the status is not ok."""
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(label, "[;,]"), strip), lambda x: x != "")))
    return F.when(label_status(label, vocabulary) == "ok", F.array_join(parts, ";"))


def stable_item_id(unit: Column, key: Column, text: Column) -> Column:
    return F.concat(F.lit("v3_"), F.substring(unit, 1, 1), F.lit("_"), F.substring(F.sha2(F.concat_ws("\n", unit, key, text), 256), 1, 16))


def slugify(text: Column, limit: int = 40, default: str = "untitled") -> Column:
    slug = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, limit), "^-+|-+$", "")
    return F.when(slug == "", default).otherwise(slug)


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9-]", "")


def per_million(n: Column, of: Column) -> Column:
    return F.try_divide(F.lit(1e6) * n, of)


def literal_like(text: Column, query: str, literal: bool = False) -> Column:
    """Case-insensitive substring. ``%`` and ``_`` in the query are wildcards unless ``literal``."""
    if literal:
        return F.contains(F.lower(text), F.lit(query.lower()))
    return text.ilike("%" + query.replace("\\", "\\\\") + "%")
