"""Phrase families, stop words and source buckets. Operators take them as parameters."""

from __future__ import annotations

# The stock lexicon (category -> phrases, in order).
STOCK = {
    "empathy_opener": [
        "i'm sorry to hear", "i am sorry to hear", "i'm really sorry", "that sounds really", "that sounds very", "i can understand",
        "i can imagine", "it's understandable", "that must be", "i'm here for you", "i hear you", "it sounds like you",
    ],
    "validation": [
        "your feelings are valid", "it's okay to feel", "it is okay to feel", "it's normal to feel", "it's completely normal",
        "what you're feeling", "there's nothing wrong with", "it's natural to",
    ],
    "disclaimer": [
        "consult a", "talk to a", "speak with a", "see a doctor", "seek medical", "i am not a doctor", "i'm not a doctor", "i'm not a medical",
        "medical professional", "healthcare professional", "mental health professional", "seek professional", "professional help",
    ],
    "crisis_referral": ["crisis", "hotline", "helpline", "988", "call 911", "emergency services", "suicide", "crisis line"],
    "structure": [
        "here are some", "here are a few", "consider the following", "steps you can take", "a few things you can", "first,", "secondly,",
    ],
}

# What the paired analysis leaves out, and its names for categories.
PAIR_OMITS = {"it is okay to feel", "i'm not a medical"}
PAIR_NAMES = {
    "empathy_opener": "empathy_expression",
    "validation": "validation",
    "disclaimer": "professional_referral",
    "structure": "structuring_language",
}
#: The causal study leaves out the same two phrases and one more.
CAUSAL_OMITS = PAIR_OMITS | {"crisis line"}

#: A lexicon that the synthetic test tables contain.
DEMO = {
    "empathy_opener": ["the and", "and the"],
    "validation": ["that the"],
    "disclaimer": ["to the", "of the"],
    "crisis_referral": ["license", "@"],
    "structure": ["this ", "with ", "les ", "und "],
}

# Stop words of the keyword, n-gram and topical-term operators.
KEYWORD_STOP = """a an the and or but if then of to in on at for with about into over
after is are was were be been being do does did have has had i you he she it we they
how what why when where who which this that these those my your our their can could
would should will my me your stop while during without my mine""".split()
GRAM_STOP = """the a an and or but if then of to in on at for with about into over after is are
was were be been being do does did have has had you your my me it this that these
those can could would should will what how why when""".split()
TOPICAL_STOP = [*GRAM_STOP, "i'm", "i've", "don't"]

# Source buckets in the order that they are tried, and their groups.
BUCKETS = [
    ("reddit", ["reddit"]), ("cc_head", ["cc_en_head"]), ("cc_middle", ["cc_en_middle"]), ("cc_tail", ["cc_en_tail"]),
    ("falcon", ["falcon"]), ("c4", ["c4"]), ("wiki", ["wiki"]), ("books", ["gutenberg", "books"]),
    ("academic", ["pes2o", "s2orc", "paper"]), ("code", ["stack", "starcoder", "code"]), ("math", ["math"]),
]
FORUM = ["reddit", "falcon", "cc_tail"]
CURATED = ["cc_head", "c4", "wiki", "books", "academic"]

#: Buckets that the synthetic pages contain; the order matters, since patterns overlap.
DEMO_BUCKETS = [("blog", ["blog"]), ("www", ["www"]), ("mobile", ["m."])]
DEMO_FORUM, DEMO_CURATED = ["blog"], ["www", "mobile"]


def rows(lexicon: dict[str, list[str]]) -> list[tuple[str, str, int]]:
    """(category, phrase, position) of each phrase."""
    flat = [(c, p) for c, phrases in lexicon.items() for p in phrases]
    return [(c, p, i) for i, (c, p) in enumerate(flat)]


def paired(lexicon: dict[str, list[str]]) -> dict[str, list[str]]:
    """The paired analysis' view of a lexicon: its names, without what it leaves out."""
    return {PAIR_NAMES[c]: [p for p in ps if p not in PAIR_OMITS] for c, ps in lexicon.items() if c in PAIR_NAMES}


def escape(phrase: str) -> str:
    """``phrase`` as a pattern that Java's and RE2's engines read alike."""
    return "".join(c if c.isalnum() or c in " ',@_" or ord(c) > 127 else "\\" + c for c in phrase)


def alternation(phrases: list[str]) -> str:
    """Any of ``phrases``, longer ones first, as one pattern."""
    return "(?:" + "|".join(escape(p) for p in sorted(phrases, key=len, reverse=True)) + ")"
