"""Classifiers, fingerprints, language ID and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphtrail.llm import boosting, fingerprint, langid, neardup, quality, toxicity
from glyphtrail.llm.labelled import held_out, sample, slices

from ..conftest import SF
from .data import LONG, docs, rows

ODD = [None, "", " \n ", "x", "é𝄞ß", LONG, "\x00\x01", "!!!"]


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- classifiers -------------------------------------------------------------------


@pytest.mark.parametrize("module,label,folds,out", [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_held_out_accuracy(spark, module, label, folds, out):
    """Recall and precision of the rarer label and the chance that a row of label 1 scores above one of label 0."""
    d = "/root/testdata/sf0.1"
    got = module.query(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    judged = got.join(labels, "doc_id").filter("held_out").select(label, "predicted", "score").collect()
    rare = 1 if 2 * sum(r[0] for r in judged) < len(judged) else 0
    hit = sum(r[0] == r[1] == rare for r in judged)
    assert hit >= 0.9 * sum(r[0] == rare for r in judged) > 20 and hit >= 0.9 * sum(r[1] == rare for r in judged)
    ones, zeros = (np.array([r[2] for r in judged if r[0] == v]) for v in (1, 0))
    above = (ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2
    assert above >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in judged)
    assert all(r.held_out == (fold(r.doc_id, folds) == out) for r in got.select("doc_id", "held_out").collect())


def plain_text(draw, bad, n=60):
    return " ".join(draw.choice(["you", "moron", "scum"] if bad and draw.random() < 0.3 else ["tree", "river", "stone", "and"]) for _ in range(n)).encode()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_texts(spark, module):
    draw = random.Random(3)
    model = module.fit_texts([(plain_text(draw, i % 2), i % 2) for i in range(400)])
    texts = [b"" if t is None else t.encode() for t in ODD] + [plain_text(draw, 1), plain_text(draw, 0)]
    together = model.score(texts)
    assert np.isfinite(together).all() and (together >= 0).all() and (together <= 1).all()
    assert [model.score([t])[0] for t in texts] == list(together)  # neighbours don't matter
    assert together[-2] > 0.5 > together[-1]
    df = docs(spark, [(i, t, None, None, 0) for i, t in enumerate(ODD)] + [(None, "x", None, None, 0)] * 2).withColumnRenamed("lang", "score")
    scored = {r.doc_id: r.score for r in toxicity.score_texts(df, model).collect()}
    assert scored == {**dict(enumerate(together[: len(ODD)])), None: together[3]}
    assert toxicity.score_texts(df, model).count() == len(ODD) + 2
    assert toxicity.score_texts(docs(spark, []), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_fit_on_executors_is_the_fit_at_hand(spark, module):
    """The distributed fit gives the model of the same rows in the same order, long texts among them."""
    draw = random.Random(8)
    data = [(i, plain_text(draw, i % 3 == 0, 9000 if i % 50 == 0 else 40).decode(), None, None, 0) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    folds, out = module.FOLDS, module.FOLD
    model = module.fit(docs(spark, data).repartition(3), labels)
    order = spark.range(300).select("id", F.xxhash64(F.lit(module.SEED), "id").alias("h")).collect()
    used = [(data[r.id][1].encode(), int(r.id % 3 == 0)) for r in sorted(order, key=lambda r: (r.h, r.id)) if fold(r.id, folds) != out]
    assert any(len(t) > 40_000 for t, _ in used)
    texts = [plain_text(draw, i % 2) for i in range(10)]
    assert np.allclose(model.score(texts), module.fit_texts(used).score(texts), atol=1e-9)


def plain_score(model, text):
    """The quality score of one text, feature by feature."""
    low = text.split()
    feats = []
    word = lambda w: quality.Spans([w], quality._TABLE, quality._WORD)
    hashes = [int(word(w).hash(np.array([0]), np.array([len(w)]))[0]) for w in low]
    mask, mixed = quality.BUCKETS - 1, lambda v: int(quality.mix(np.array([v % 2**64], np.uint64))[0])
    feats += [h & mask for h in hashes]
    for w in low:
        for n in quality.GRAMS:
            for i in range(len(w) - n + 1):
                feats.append(mixed(int(word(w).hash(np.array([i]), length=n)[0]) + n) & mask)
    feats += [7 if a == b else mixed(a * 3 + b) & mask for a, b in zip(hashes, hashes[1:], strict=False)]
    z = sum(float(model.level[f]) for f in feats) / max(1, len(feats)) + model.bias
    return 1 / (1 + math.exp(-z))


def test_quality_score_against_brute_force():
    draw = random.Random(11)
    model = quality.fit_texts([(plain_text(draw, i % 2), i % 2) for i in range(60)])
    texts = [b"", b"a", b"tree moron tree", plain_text(draw, 1), "Über straße 𝄞".encode()]
    assert np.allclose(model.score(texts), [plain_score(model, t) for t in texts], atol=1e-6)


def plain_features(text, strong, weak):
    """The toxicity features of one text, word by word."""
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ01345@$", b"abcdefghijklmnopqrstuvwxyzoieasas")
    words = re.findall(rb"[A-Za-z\x80-\xff01345@$]+", text)
    key = lambda w, k: int(toxicity._keys(toxicity.Spans([w], toxicity._TABLE, toxicity._LETTER), k)[1][0])
    known = lambda w, keys: any(key(w, k) in keys for k in toxicity.BEGINNINGS if not k or len(w) >= k)
    second = {w.encode().translate(table) for w in toxicity.SECOND_PERSON.split()}
    hits, soft = [known(w, strong) for w in words], [known(w, weak) for w in words]
    you = [w.translate(table) in second for w in words]
    near = [h and any(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, h in enumerate(hits)]
    n, chars = max(1, len(words)), max(1, len(text))
    signs = [sum(c in b"01345@$" for c in w) for w in words]
    return [
        sum(hits) / n, math.log1p(sum(hits)), sum(soft) / n, math.log1p(sum(soft)), sum(near) / max(1, sum(hits)),
        sum(65 <= c <= 90 for c in text) / chars, sum(c in b".,;:?!*#$%&|-" for c in text) / chars, text.count(b"!") / chars,
        sum(k > 0 and len(w) - k >= 2 for k, w in zip(signs, words, strict=True)) / n, math.log1p(len(words)),
    ]


def test_toxicity_score_against_brute_force():
    draw = random.Random(12)
    model = toxicity.fit_texts([(plain_text(draw, i % 2), i % 2) for i in range(400)])
    texts = [b"", b"you M0ron!!", b"tree. you scum, you m@ron and river", plain_text(draw, 1), "Dú escoria ß".encode(), b"a" * 70_000]
    strong, weak = set(map(int, model.strong)), set(map(int, model.weak))
    x = np.array([plain_features(t, strong, weak) for t in texts])
    assert np.allclose(toxicity.features(texts, model.strong, model.weak), x)
    for row, got in zip(x, model.score(texts), strict=True):
        raw = model.trees.base
        for feature, cut, value in model.trees.nodes:
            at = 0
            for _ in range(model.trees.depth):
                if feature[at] >= 0:
                    f = feature[at]
                    at = 2 * at + 1 + int(sum(e <= row[f] for e in model.trees.edges[f]) > cut[at])
            raw += value[at]
        assert abs(got - np.interp(raw, model.level.x, model.level.p)) < 1e-12


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels(module):
    assert list(module.fit_texts([]).score([b"", b"a b"])) == [0.5, 0.5]
    assert len(module.fit_texts([(b"a", 1)] * 5).score([b"a"])) == 1


def test_few_toxic_rows_are_no_constant():
    """Twelve positives in front of the others, and as few as two."""
    draw = random.Random(1)
    for n in (12, 2):
        model = toxicity.fit_texts([(plain_text(draw, 1), 1) for _ in range(n)] + [(plain_text(draw, 0), 0) for _ in range(200 - n)])
        assert model.constant is None
    many = toxicity.fit_texts([(plain_text(draw, 1), 1) for _ in range(12)] + [(plain_text(draw, 0), 0) for _ in range(188)])
    assert many.score([plain_text(draw, 1)])[0] > 0.5 > many.score([plain_text(draw, 0)])[0]


def test_sample_leaves_out_the_held_out_fold(spark):
    data = [(i, f"t{i}" * (9000 if i == 7 else 1), None, None, 0) for i in range(200)] + [(5, "t5", None, None, 0), (None, "n", None, None, 0), (9, None, None, None, 0)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(220)] + [(5, 1), (None, 1)], "doc_id long, y int")
    got = sample(docs(spark, data), labels, "y", 5, 0, 1000, 1).collect()
    assert sorted(r.text for r in got) == sorted(data[i][1] for i in range(200) if fold(i, 5) != 0)
    ordered = sorted(got, key=lambda r: tuple(r.draw))
    assert slices([r.y for r in ordered]) == [r.slice for r in ordered] and {r.slice for r in got} == set(range(10))
    assert sample(docs(spark, data), labels, "y", 5, 0, 10, 1).count() == 10
    assert sample(docs(spark, data), labels.limit(0), "y", 5, 0, 10, 1).collect() == []
    assert spark.range(3).select(held_out(F.lit(None).cast("long"), 5, 0)).distinct().first()[0] is False


def test_isotonic():
    draw = np.random.default_rng(1)
    raw = draw.normal(size=500)
    y = (draw.random(500) < 1 / (1 + np.exp(-3 * raw))).astype(float)
    fit = boosting.Isotonic().fit(raw, y)
    p = fit(np.sort(raw))
    assert (np.diff(p) >= 0).all() and 0 < p[0] < 0.2 and 0.8 < p[-1] < 1
    x = np.stack([raw, draw.normal(size=500)], axis=1)
    score = boosting.Boosted(trees=30).fit(x, y).raw(x)
    assert score[y == 1].mean() > score[y == 0].mean() + 1


# --- fingerprints ------------------------------------------------------------------


def plain_walk(text):
    """One character at a time."""
    chars = fingerprint.symbols(text)
    out, i = [], 0
    for j in range(3 * len(chars)):
        c = int(chars[i]) if i < len(chars) else 0
        out.append(c)
        i += int(fingerprint._coins[j % fingerprint.PERIOD][c])
    kept = [out[j] if j < len(out) else 0 for j in fingerprint.sample(fingerprint.size_class(len(chars)))]
    return [c % 15 + 1 if c else 0 for c in kept]


def test_walks():
    draw = random.Random(2)
    texts = ["", "a", "ab", "é𝄞"] + ["".join(draw.choice("abcdé ") for _ in range(n)) for n in (31, 32, 33, 64, 65, 500, 2000)] + ["aaaa" * 50]
    for group in (texts, texts[::-1], texts[:3]):
        got = fingerprint.fingerprints(group)
        assert [list(map(int, g)) for g in got] == [plain_walk(t) for t in group]
    n, kept = len(texts[-2]), fingerprint.fingerprints([texts[-2]])[0]
    k, back = fingerprint.decode(fingerprint.encode(n, kept))
    assert k == fingerprint.size_class(n) and (back == kept).all()


def test_edits_stay_near():
    draw = random.Random(5)
    text = "".join(draw.choice("abcdefgh ") for _ in range(1500))
    other = "".join(draw.choice("abcdefgh ") for _ in range(1400))
    few = text[:300] + "X" + text[301:900] + text[903:]
    of = lambda t: (fingerprint.size_class(len(t)), fingerprint.fingerprints([t])[0])
    assert fingerprint.likeness(of(text), of(text)) == 1.0 == fingerprint.likeness(of(""), of(""))
    assert fingerprint.likeness(of(text), of(few)) > 0.7 > 0.35 > fingerprint.likeness(of(text), of(other))
    longer = text + other[:600]  # of the next size class
    assert fingerprint.likeness(of(text), of(longer)) > 0.5 > fingerprint.likeness(of(other), of(longer))


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_edits_against_brute_force(spark, parts):
    data = [(i, t, None, None, 0) for i, t in enumerate(ODD)] + [r for r in rows() if r[0] is not None and r[0] > 10]
    data = [(d * 3, *r) for d, *r in data]
    random.Random(1).shuffle(data)
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs(spark, data).withColumnRenamed("lang", "part"), parts).collect()}
    order = sorted({(d, t or "") for d, t, *_ in data})
    assert len(got) == len(order) == len(data)
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        changed = t[: len(t) - q] + n[:q]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        of = lambda x: (fingerprint.size_class(len(x)), fingerprint.fingerprints([x])[0])
        assert r.fingerprint == fingerprint.encode(len(t), of(t)[1]) and r.edited_fingerprint == fingerprint.encode(len(changed), of(changed)[1])
        assert r.near_edited == fingerprint.likeness(of(t), of(changed)) and r.near_next == fingerprint.likeness(of(t), of(n))


def test_fingerprints_of_few_rows(spark):
    assert fingerprint.fingerprint_edits(docs(spark, [])).count() == 0
    one = fingerprint.fingerprint_edits(docs(spark, [(1, "abcdefgh", None, None, 0)])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    same = fingerprint.fingerprint_edits(docs(spark, [(None, "q", None, None, 0), (1, "q", None, None, 0), (1, "q", None, None, 0)])).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 1


def plain_classes(data):
    """(id, class) by all pairs of texts."""
    keys = [d if d is not None else ("null", t) for d, t in data]
    packs = [fingerprint.pack(len(t or ""), [fingerprint.fingerprints([t or ""], w)[0] for w in range(fingerprint.WALKS)]) for _, t in data]
    up = list(range(len(data)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if data[i][1] and data[j][1] and (data[i][1] == data[j][1] or fingerprint.best_likeness(packs[i], packs[j]) >= fingerprint.LEAST_LIKE):
                up[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        least.setdefault(find(i), []).append(k)
    return [min((k for k in least[find(i)] if not isinstance(k, tuple)), default=None) for i in range(len(data))]


def edit_some(draw, text, edits):
    t = list(text)
    for _ in range(edits):
        p, kind = draw.randrange(len(t)), draw.choice(["put", "in", "out"])
        t[p : p + (kind != "in")] = [] if kind == "out" else [draw.choice("abcdefgh")]
    return "".join(t)


def test_near_classes_against_all_pairs(spark):
    """Texts with up to 20 edits of 900 characters, at the edge of a size class, chains, copies, odd rows."""
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    data = []
    for k in range(40):
        base = text(900)
        data += [(10 * k, base), (10 * k + 1, edit_some(draw, base, draw.choice([1, 5, 10, 20])))]
    edge, chain = text(1024), [text(900)]
    for _ in range(12):
        chain.append(edit_some(draw, chain[-1], 12))
    data += [(1001, edge), (1002, edge + "x"), (1003, edge), (None, edge), (1005, None), (1006, None), (1007, ""), (1008, "ab"), (1009, "ab"), (1010, LONG)]
    data += [(2000 + i, c) for i, c in enumerate(chain)]
    want = plain_classes(data)
    got = {}
    for r in fingerprint.near_classes(docs(spark, [(d, t, None, None, 0) for d, t in data]).withColumnsRenamed({"lang": "node", "source": "sig"})).collect():
        got.setdefault(r.doc_id, r)
    same = [got[d].class_id == w for (d, _), w in zip(data, want, strict=True) if d is not None]
    assert len(same) - sum(same) <= 2 and len(got) == len(data)  # bands are probable
    assert sum(got[10 * k + 1].class_id == 10 * k for k in range(40)) >= 38
    assert got[1002].class_id == 1001 and (got[1002].edits, got[1003].edits, got[1001].edits) == (1, 0, 0) and got[1001].class_size == 4
    assert got[1005].class_id == 1005 and got[1006].class_size == 1 and got[1009].class_id == 1008
    assert all(got[10 * k + 1].edits is None or 0 <= got[10 * k + 1].edits <= 20 for k in range(40))
    assert fingerprint.near_classes(docs(spark, [])).count() == 0


def test_tile_links_find_what_stars_miss():
    """All nodes apart: a meeting of tiles gives links that join exactly the classes."""
    import pyarrow as pa

    draw = random.Random(3)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(n)) for n in (900, 1020, 300)]
    texts = [edit_some(draw, b, k) for b in base for k in (1, 3, 6, 9)]
    sigs = [fingerprint.pack(len(t), [fingerprint.fingerprints([t], w)[0] for w in range(fingerprint.WALKS)]) for t in texts]
    names = [bytes([i]) for i in range(len(texts))]
    for tile in (["x"] * 12, ["x", "y"] * 6):
        group = pa.table({"node": names, "comp": names, "sig": sigs, "tile": tile})
        links = fingerprint._tile_links((pa.scalar(b""), pa.scalar("x"), pa.scalar(max(tile))), group).to_pylist()
        assert all(r["a"][0] // 4 == r["b"][0] // 4 for r in links)
        assert len(links) == (9 if max(tile) == "x" else 9)


# --- language ID -------------------------------------------------------------------


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(langid.of_documents(d)).select("id.doc_id", "language").join(d, "doc_id")
    assert got.filter("language = lang").count() >= 0.98 * d.count()
    assert got.filter("language = 'und'").count() <= 2


def test_wrong_declaration_is_overruled(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 300")
    lie = d.withColumn("lang", F.when(F.col("doc_id") % 20 == 0, F.when(F.col("lang") == "en", "de").otherwise("en")).otherwise(F.col("lang")))
    got = langid.identify(langid.of_documents(lie)).select("id.doc_id", "language").join(d, "doc_id").filter("doc_id % 20 = 0")
    assert got.filter("language = lang").count() >= 0.9 * got.count()


def test_pages(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    rows_ = langid.of_pages(p).collect()
    assert all(r.declared and r.suffix in ("com", "net", "org") and r.host.endswith(r.domain) and "<p" not in r.text for r in rows_)
    got = langid.identify(langid.of_pages(p)).collect()
    assert len(got) == len(rows_) and sum(r.language != "und" for r in got) >= 0.98 * len(got)


def test_language_of_odd_rows(spark):
    data = rows() + [(1000 + i, t, l, None, 0) for i, (t, l) in enumerate([(None, "EN-us"), ("123 !!", "en"), ("plain words here", "xx-invalid"), ("plain words here", "!!")])]
    got = {}
    for r in langid.identify(langid.of_documents(docs(spark, data))).collect():
        got.setdefault(r.id.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(data)
    assert got[1000][0].language == got[1001][0].language == "und" and all(0 <= r.posterior <= 1 for v in got.values() for r in v)
    assert langid.identify(langid.of_documents(docs(spark, []))).count() == 0
    none = langid.identify(langid.of_documents(docs(spark, [(1, "some text", None, None, 0)]))).collect()
    assert [r.language for r in none] == ["und"]
    kept = langid.accepted(docs(spark, data))
    assert kept.columns == docs(spark, []).columns and kept.filter("doc_id = 1001").count() == 0


def tongue(seed, letters, n, lang, first):
    """Rows of texts in a language made of ``letters``."""
    draw = random.Random(seed)
    lexicon = ["".join(draw.choice(letters) for _ in range(6)) for _ in range(60)]
    return [(first + i, " ".join(draw.choice(lexicon) for _ in range(20)), lang, f"s{i % 3}", 0) for i in range(n)]


def test_rare_language_among_many_rows(spark):
    data = tongue(1, "aeinrst", 12_000, "en", 0) + tongue(2, "uvwxyzk", 8, "nl", 50_000)
    got = {r.id.doc_id: r.language for r in langid.identify(langid.of_documents(docs(spark, data))).filter("id.doc_id >= 49900 or id.doc_id < 100").collect()}
    assert all(v == ("nl" if d >= 50_000 else "en") for d, v in got.items()) and len(got) == 108


def test_rare_languages_are_not_another_one(spark):
    """Languages of fewer rows than a model needs: their texts are of no language that is known."""
    data = tongue(1, "aeinrst", 3000, "en", 0) + tongue(2, "uvwxyzk", 2, "no", 5000) + tongue(2, "uvwxyzk", 1, None, 5100)
    got = {r.id.doc_id: r.language for r in langid.identify(langid.of_documents(docs(spark, data))).collect()}
    assert all(v == ("en" if d < 5000 else "und") for d, v in got.items()) and len(got) == 3003
    kept = langid.accepted(docs(spark, data)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(3000))


def test_hundreds_of_languages(spark):
    """Each of 300 languages, the rarest with one row in 2,000, keeps its own texts; some declare nothing."""
    data, codes = [], [a + b + c for a in "abcdefg" for b in "hijklmn" for c in "opqrstu"][:300]
    draw = random.Random(4)
    letters = [chr(0x400 + i) for i in range(64)]
    for k, code in enumerate(codes):
        own = draw.sample(letters, 9)
        data += tongue(k, own, 4 if k else 800, code, 10_000 * k)
        data += [(d, t, None, h, n) for d, t, _, h, n in tongue(k + 1000, own, 1, code, 10_000 * k + 5000)]
    rows_ = langid.of_documents(docs(spark, data).repartition(4))
    got = {r.id.doc_id: r.language for r in langid.identify(rows_).collect()}
    right = [v == codes[d // 10_000] for d, v in got.items() if d % 10_000 < 5000]
    assert len(got) == len(data) and sum(right) == len(right)


def plain_identify(data):
    """(language, posterior) of documents (id, text, lang, source), in plain loops."""
    def code(lang):
        m = re.match(r"([a-z]{2,3})(?![a-z])", (lang or "").strip(" ").lower())
        return m.group(1) if m else None

    def grams(text):
        low = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in b"  " + (text or "").encode() + b"  "]
        out = []
        for i in range(1, len(low) - 1):
            if low[i] != 32:
                x = low[i - 1] << 16 | low[i] << 8 | low[i + 1]
                for _ in range(2):
                    x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) % 2**64
                out.append((x ^ x >> 32) % langid.BUCKETS)
        return out

    seen = Counter(code(r[2]) for r in data if code(r[2]) not in (None, "und"))
    names = sorted(v for v, n in seen.items() if n >= langid.LEAST_ROWS)
    if any(n < langid.LEAST_ROWS for n in seen.values()):
        names.append("und")
    counts = {v: Counter() for v in names}
    for r in data:
        if code(r[2]) not in (None, "und"):
            counts[code(r[2]) if code(r[2]) in names else "und"].update(grams(r[1]))
    total = {v: sum(c.values()) + 0.5 * langid.BUCKETS for v, c in counts.items()}
    facts, votes, declared, host = [], Counter(), Counter(), Counter()
    for r in data:
        g = grams(r[1])
        ll = {v: sum(math.log((counts[v][b] + 0.5) / total[v]) for b in g) / math.sqrt(max(1, len(g))) for v in names}
        vote = max(names, key=lambda v: (ll[v], -names.index(v))) if len(g) >= langid.VOTE_LETTERS else None
        facts.append((ll, vote, len(g)))
        if vote:
            votes[vote] += 1
            declared[code(r[2]), vote] += 1
            host[r[3], vote] += 1
    all_ = sum(votes.values())
    share = {v: (votes[v] + 1) / (all_ + len(names)) for v in names}
    said = {d for d, _ in declared}
    out = []
    for r, (ll, vote, n) in zip(data, facts, strict=True):
        own = {v: float(v == vote) for v in names}
        # Documents have no suffix and no domain: all voting rows share these.
        def prior(have, weight, coarse):
            rest = {v: have[v] - own[v] for v in names}
            return {v: (rest[v] + weight * coarse[v]) / (sum(rest.values()) + weight) for v in names}

        p = prior({v: host[r[3], v] for v in names}, langid.HOST_ROWS, prior(votes if all_ else Counter(), langid.DOMAIN_ROWS, share))
        score = {}
        for v in names:
            score[v] = ll[v] + math.log(max(p[v], 1e-9))
            if code(r[2]) in said:
                score[v] += math.log((declared[code(r[2]), v] + 0.5) / (votes[v] + 10))
            if all_:
                score[v] += math.log((votes[v] + 0.5) / (votes[v] + 10))
        best = max(score, key=lambda v: (score[v], -names.index(v)))
        posterior = 1 / sum(math.exp(s - score[best]) for s in score.values())
        out.append((best if n >= 1 and posterior >= 0.5 else "und", posterior))
    return out


def test_language_against_brute_force(spark):
    data = tongue(1, "aeinrst", 40, "en", 0) + tongue(2, "aeouvwk", 25, "de-AT", 100) + tongue(3, "bcdfgae", 2, "cy", 200) + tongue(2, "aeouvwk", 3, "en", 300)
    data += [(400, None, "en", "s1", 0), (401, "1 2 3", None, None, 0), (402, "ans", "english", "s0", 0), (403, "Tears in rain", None, None, 0), (None, "eat tin", "und", "s1", 0)]
    want = plain_identify(data)
    got = sorted((r.id.doc_id if r.id.doc_id is not None else 10**6, r.language, r.posterior) for r in langid.identify(langid.of_documents(docs(spark, data))).collect())
    both = sorted((r[0] if r[0] is not None else 10**6, *w) for r, w in zip(data, want, strict=True))
    assert [g[:2] for g in got] == [b[:2] for b in both]
    assert all(abs(g[2] - b[2]) < 1e-4 for g, b in zip(got, both, strict=True))


def test_language_with_the_declaration_withheld(spark):
    """A fifth of the documents declare nothing and are in no trigram model."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    withheld = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.col("lang")))
    got = langid.identify(langid.of_documents(withheld)).select("id.doc_id", "language").join(d, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert got.count() > 100 and got.filter("language = lang").count() >= 0.98 * got.count()


# --- pipeline ----------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    from .data import plain_shingles, plain_words
    from .test_native import plain_targets
    from .test_neardup import brute

    data = {r.doc_id: tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    got = out.collect()
    accepted = {r.doc_id for r in langid.accepted(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    left = [v for k, v in data.items() if k in accepted]
    kept = {d for d, _, _, k in brute(left) if k}
    items = [plain_shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d in kept if not any(100 * len(plain_shingles(data[d][1]) & i) >= 75 * len(i) for i in items)}
    assert {r.doc_id for r in got} <= clean < kept
    sizes, taken = {}, {}
    for d in clean:
        sizes[data[d][3]] = sizes.get(data[d][3], 0) + len(plain_words(data[d][1]))
    want = plain_targets(sizes)
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + len(plain_words(r.text))
        assert (r.doc_id, r.text, r.lang, r.source, r.n_chars) == data[r.doc_id]
    longest = max(len(plain_words(data[d][1])) for d in clean)
    assert all(0 <= taken.get(s, 0) - want[s] + 0.5 <= longest + 1 for s in sizes)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert neardup.THRESHOLD == 75 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mix_sources", "shard"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, equal ids of unlike texts, rows without id, columns of internal names; an empty table."""
    import corpus_pipeline

    from .data import words

    draw = random.Random(21)
    good = [(i, words(draw, 60, 90), "en", f"s{i % 2}", 0) for i in range(40)]
    item = " ".join(f"item{i}" for i in range(12))
    data = good + good[:3] * 4 + [(5, words(draw, 60, 90), "en", "s1", 0), (None, words(draw, 60, 90), "en", "s0", 0), (None, None, None, None, None), (None, None, None, None, None)]
    data += [(77, f"{words(draw, 30, 90)} {item} {words(draw, 30, 90)}", "en", "s0", 0), (78, "", "en", "s0", 0), (79, good[0][1] + " tail", "en", "s0", 0)]
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = {"_row": 1, "_mark": "m", "_key": 2.5, "bucket": None, "shard": "own", "node": {"a": 1}, "size": [1, None], "mark": "x"}
    df = docs(spark, data)
    for name, v in odd.items():
        df = df.withColumn(name, F.lit(v) if not isinstance(v, (dict, list)) else F.create_map(F.lit("a"), F.lit(1)) if isinstance(v, dict) else F.array(F.lit(1), F.lit(None)))
    df = df.withColumn("bucket", F.lit(None).cast("string"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs(spark, []).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(tmp_path / "empty" / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *[c + "_before" if c == "shard" else c for c in odd], "shard", "slot"]
    got = {(r.doc_id, r.text) for r in out.collect()}
    want = {(d, t) for d, t, *_ in data if t and d not in (77, 79)}
    assert got <= want and sum(len(t.split()) for _, t in want - got) <= 0.6 * sum(len(t.split()) for _, t in want)
    assert {d for d, _ in got} >= {None} or len(got) > 20
    none = corpus_pipeline.run(spark, str(tmp_path / "empty"))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
