import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphtrail.llm import components, neardup
from glyphtrail.llm import textops as T

from .data import docs, plain_shingles, plain_words, rows, words


def brute(data, threshold=75):
    sets = [plain_shingles(r[1]) for r in data]
    up = list(range(len(data)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(data):
        groups.setdefault(find(i), []).append(r[0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], len(sets[i]), least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(data)), key=str)


def run(spark, data):
    df = docs(spark, data).withColumnsRenamed({"lang": "node", "source": "sig"})  # clashing names
    return sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)


def test_against_brute_force(spark):
    assert run(spark, rows()) == brute(rows())


def test_large_group_of_near_copies(spark):
    """A chain of edits: neighbours are alike, ends are not, so stars alone can't link it."""
    draw = random.Random(9)
    w = words(draw, 150).split()
    data = []
    for i in range(60):
        w[draw.randrange(len(w))] = f"x{i}"
        w[draw.randrange(len(w))] = f"y{i}"
        data.append((i, " ".join(w), None, None, None))
    assert run(spark, data) == brute(data)


@pytest.mark.parametrize("tile", [4, 256])
def test_links_that_no_star_shows(spark, tile):
    data = [r for r in rows(3) if r[0] is not None]
    df = docs(spark, data)
    nodes = neardup.signed(df).filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("sig").alias("sig"))
    clusters = nodes.selectExpr("node", "cast('one' as binary) as label")
    none = nodes.limit(0).selectExpr("node", "node as label")
    sets = neardup.shingle_sets(df, nodes.select("node", "rep"))
    links = neardup.remaining_links(nodes, clusters, none, sets, tile=tile)
    found = components.components(links)
    label = {bytes(r.node): bytes(r.label) for r in found.collect()}
    rep = {r.rep: bytes(r.node) for r in nodes.select("node", "rep").collect()}
    groups = {}
    for d, n in rep.items():
        groups.setdefault(label.get(n, n), []).append(d)
    expected = {}
    for d, _, c, _ in brute(data):
        if d in rep:
            expected.setdefault(c, set()).add(d)
    assert sorted(sorted(v) for v in groups.values()) == sorted(sorted(v) for v in expected.values())


def test_empty_table(spark):
    assert run(spark, []) == []
    assert neardup.deduplicated(docs(spark, [])).count() == 0


def test_deduplicated_keeps_one_of_each(spark):
    data = [r for r in rows() if r[0] is not None]
    kept = sorted(r.doc_id for r in neardup.deduplicated(docs(spark, data)).collect())
    assert kept == sorted({d for d, _, _, k in brute(data) if k})


def test_rows_without_id_are_told_apart(spark):
    draw = random.Random(4)
    own, other = words(draw, 40), words(draw, 40)
    data = [(1, own, None, None, 0), (None, own, None, None, 0), (None, other, None, None, 0), (None, other, None, None, 0), (None, "", None, None, 0)]
    kept = neardup.deduplicated(docs(spark, data)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", own), ("None", other), ("None", "")])


def test_unlike_texts_of_one_id_stay(spark):
    draw = random.Random(6)
    a, b, c, e = (words(draw, 40) for _ in range(4))
    data = [(1, a, "en", None, 0), (1, b, "en", None, 0), (2, a + " more", None, None, 0), (1, a + " end", None, None, 0), (-5, c, None, None, 0), (3, c, None, None, 0)]
    data += [(9, e, "x", "y", 1)] * 3 + [(None, None, None, None, None)] * 2 + [(4, None, None, None, 0)]
    for renamed in ({"lang": "_row", "source": "_mark"}, {"lang": "_name", "source": "node", "n_chars": "component_id"}):
        df = docs(spark, data).withColumnsRenamed(renamed)
        kept = neardup.deduplicated(df)
        assert kept.columns == df.columns
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert len(got) == 6 and {(1, b), (-5, c), (None, None), (4, None), (9, e)} <= set(got)
        assert sum(t in (a, a + " end") for _, t in got) == 1


def test_words_and_shingles():
    for text in ["", " ", "A b\tC\x0bd\ne", "ÄÖ é", "x" * 5000, "one two three four five six"]:
        w = T.Words([text.encode(), b"zz"])
        got = [w.buf[a:b].tobytes().lower().decode() for a, b in zip(w.start[: w.first[1]], w.end[: w.first[1]], strict=True)]
        assert got == plain_words(text)
        assert len(w.shingles(0)) == len(plain_shingles(text))
    a, b = T.Words([b"The END of it", b"the end  OF\tit"]), T.Words([b"x the end of it"])
    assert (a.shingles(0) == a.shingles(1)).all() and (a.hash[:4] == b.hash[1:]).all()


def test_signature_estimates_likeness():
    draw = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        got = []
        for _ in range(40):
            common = draw.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            own = [draw.integers(0, 2**63, 400 - len(common), dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate([common, o])) for o in own)
            got.append((neardup.signature(a) == neardup.signature(b)).mean())
        assert abs(np.mean(got) - len(common) / (800 - len(common))) < 0.03


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(50)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
