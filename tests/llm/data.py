"""Small tables with the cases that every operator must stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(9000))


def words(draw, n, alphabet=400):
    return " ".join(f"tok{draw.randrange(alphabet)}" for _ in range(n))


def rows(seed=1, n=40):
    """(doc_id, text, lang, source, n_chars): random texts, copies, near copies, nulls, empty,
    blank and very long texts, repeated rows, null ids and sources."""
    draw = random.Random(seed)
    texts = [words(draw, draw.choice([1, 3, 5, 30, 80])) for _ in range(n)]
    base = words(draw, 120)
    near = []
    for k in range(12):
        w = base.split()
        for _ in range(draw.choice([1, 2, 3, 6])):
            w[draw.randrange(len(w))] = f"new{k}"
        near.append(" ".join(w))
    texts += near + [base] * 4 + [texts[0]] * 3 + [None, "", "  \n\t ", "Two words", "two\x0bWORDS", LONG, LONG + " end"]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, words(draw, 20), None, "s1", 5), (None, base, None, None, None)]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def plain_words(text):
    out, word = [], ""
    for c in text or "":
        if c in "\t\n\x0b\x0c\r ":
            out, word = out + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + [word] * bool(word)


def plain_shingles(text, n=5):
    w = plain_words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
