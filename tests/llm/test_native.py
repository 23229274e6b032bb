"""Decontamination, mixing, sharding, secrets and line dedup."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from glyphtrail.llm import common, decontaminate, linededup, mixing, secrets, sharding

from .data import LONG, docs, plain_shingles, plain_words, rows, words


# --- decontamination ---------------------------------------------------------------


def test_containment_against_brute_force(spark):
    draw = random.Random(2)
    items = [(i, words(draw, n)) for i, n in enumerate([5, 8, 20, 40, 60])] + [(10, None), (11, ""), (12, "Two words"), (13, "tok1"), (14, LONG[:3000])]
    data = rows()
    for i, t in items[:5]:
        w = t.split()
        for cut in (0, 1, len(w) // 3):
            data.append((500 + 10 * i + cut % 10, words(draw, 200) + " " + " ".join(w[cut:]).upper() + "\n" + words(draw, 50), None, None, 0))
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contaminated(docs(spark, data), spark.createDataFrame(items, "item_id long, text string")).collect()}
    best, bad = {}, set()
    for i, t in items:
        own = plain_shingles(t)
        for d, x, *_ in data:
            size = len(next(iter(own))) if own else 5
            w = plain_words(x)
            there = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            both = len(own & there)
            if own and 100 * both >= 75 * len(own):
                bad.add(x)
                best[d, i, len(own)] = (d, i, len(own), max(both, best.get((d, i, len(own)), (0, 0, 0, 0))[3]))
    assert got == set(best.values()) and len(got) > 8
    kept = decontaminate.clean(docs(spark, data), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r[:2] for r in data if r[1] not in bad)


def test_rows_of_one_id_stand_for_themselves(spark):
    item = "a b c d e f g h"
    one = spark.createDataFrame([(5, item), (5, "k l m n o p")], "item_id long, text string")
    data = [(1, "a b c d e f", None, None, 0), (1, "c d e f g h", None, None, 0), (2, f"x {item} y", None, None, 0), (2, "clean words that are of no item", None, None, 0)]
    data += [(3, "j k l m n o p " + item, None, None, 0)] * 2
    got = {tuple(r) for r in decontaminate.contaminated(docs(spark, data), one).collect()}
    assert got == {(2, 5, 4, 4), (3, 5, 4, 4), (3, 5, 2, 2)}
    df = docs(spark, data).withColumnsRenamed({"lang": "_mark", "source": "value", "n_chars": "level"})
    kept = decontaminate.clean(df, one)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((r[0], r[1]) for r in data[:2] + data[3:4])


def test_items_of_every_size_in_long_documents(spark):
    """Items of one word to hundreds, whole or with as much missing as may be."""
    draw = random.Random(12)
    items, data = [], []
    for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 80, 160, 320]):
        w = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(w)))
        whole = max(1, n - 4)
        lost = whole - -(-whole * 75 // 100)
        data.append((10 * i, words(draw, 3000) + " " + " ".join(w) + " " + words(draw, 1000), None, None, 0))
        data.append((10 * i + 1, words(draw, 500) + " " + " ".join(w[lost:] if n >= 5 else w) + " " + words(draw, 20), None, None, 0))
        if n >= 5:
            data.append((10 * i + 2, words(draw, 500) + " " + " ".join(w[lost + 1 :]) + " " + words(draw, 20), None, None, 0))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, data), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10 * i + k, i) for i in range(14) for k in (0, 1)}

def test_containment_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark), none).count() == 0
    assert decontaminate.contaminated(docs(spark, []), one).count() == 0


def test_items_without_id_are_found(spark):
    text = " ".join(f"item{i}" for i in range(12))
    items = spark.createDataFrame([(None, text), (1, "other words of an item that is nowhere")], "item_id long, text string")
    df = docs(spark, [(1, f"before {text} after", None, None, 0), (2, "a clean text of its own", None, None, 0)])
    assert [tuple(r) for r in decontaminate.contaminated(df, items).collect()] == [(1, None, 8, 8)]
    assert [r.doc_id for r in decontaminate.clean(df, items).collect()] == [2]


# --- mixing ------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    draw = random.Random(seed)
    data = rows(seed) + [(1000 + i, words(draw, 30), None, f"big{i % 2}" if i % 5 else "tiny", 0) for i in range(300)]
    df = docs(spark, data).withColumnRenamed("n_chars", "size")
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, _, s, _ in data:
        sizes[s] += len(plain_words(t))
    want = plain_targets(sizes)
    assert len(got) == len(data) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(plain_words(r[1]))) for r in data)
    again = mixing.mixed_documents(df)
    assert again.columns == df.columns and again.filter("text is null or text = ''").count() == 0


@pytest.mark.parametrize("run", [3, 10_000])
def test_mixed_rows(spark, run, monkeypatch):
    """Repeated rows, one id with unlike texts, rows without id and clashing names."""
    for module in (mixing, common):
        monkeypatch.setattr(module, "RUN", run)
    draw = random.Random(5)
    data = [(None, "one two three four five six seven eight nine ten", "fr", "a", 0)] * 12
    data += [(7, words(draw, 9), "en", "b", k) for k in range(30)] + [(8, "same text here", v, "b", 0) for v in ("en", "de")]
    for renamed in ({"lang": "_row", "n_chars": "_times"}, {"lang": "key", "n_chars": "copies"}):
        df = docs(spark, data).withColumnsRenamed(renamed)
        got = mixing.mixed_documents(df)
        assert got.columns == df.columns
        rows_ = got.collect()
        want = plain_targets(Counter({"a": 120, "b": 30 * 9 + 6}))
        assert set(map(tuple, rows_)) <= set(data)
        for s in "ab":
            taken = sum(len(plain_words(r.text)) for r in rows_ if r.source == s)
            assert 0 <= taken - want[s] + 0.5 <= 11
        one = Counter(map(tuple, rows_))
        assert all(v <= 3 * data.count(k) for k, v in one.items())
    taken = mixing.mix(docs(spark, data)).collect()
    assert len(taken) == len(data) and sum(r.taken for r in taken if r.source == "a") == round(want["a"])


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    got = mixing.mix(docs(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]


# --- sharding ----------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [64 << 20, 800])
def test_layout(spark, bucket_bytes):
    data = rows(4, 300) + [(7, "same", None, None, 0)] * 50
    df = docs(spark, data).withColumnsRenamed({"lang": "shard", "source": "bucket"})
    got = sharding.layout(sharding.digest(df), 6, bucket_bytes=bucket_bytes).collect()
    digest = lambda r: (r[0], 16 + len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(map(digest, data))
    slots = {}
    home = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        home.setdefault(r.doc_id, set()).add(r.shard)
        assert 0 <= r.shard < 6 and r.grown_shard in (r.shard, 6)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 6
    assert all(len(v) == 1 for v in home.values())
    assert sorted(map(str, got)) == sorted(map(str, sharding.layout(sharding.digest(df), 6, bucket_bytes=bucket_bytes).collect()))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None and r.shard == 0]
    assert order != sorted(order)


def test_shards_written(spark, tmp_path):
    data = rows(5, 100)
    sharding.write_shards(docs(spark, data), str(tmp_path / "s"), n_shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1]) for r in data)
    for s in range(3):
        part = spark.read.parquet(str(tmp_path / f"s/shard={s}")).collect()
        assert sorted(r.slot for r in part) == list(range(len(part)))
    assert sharding.layout(sharding.digest(docs(spark, []))).count() == 0


def test_sharded_rows_stay_what_they_were(spark, monkeypatch):
    """Rows of one id and text that differ elsewhere, clashing names, rows repeated more often than a run."""
    monkeypatch.setattr(sharding, "RUN", 5)
    monkeypatch.setattr(common, "RUN", 5)
    data = [(1, "same", "fr", "b", 0), (1, "same", "en", "a", 0), (None, None, None, None, None)] + [(2, "often", "en", "a", 0)] * 23
    names = [{"lang": "shard", "source": "slot", "n_chars": "bucket"}, {"lang": "_row", "source": "_mark", "n_chars": "size"}]
    for renamed in names:
        df = docs(spark, data).withColumnsRenamed(renamed)
        got = sharding.shard_documents(df, n_shards=3)
        before = [c + "_before" if c in ("shard", "slot") else c for c in df.columns]
        assert got.columns == [*before, "shard", "slot"]
        assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(data)


def plain_key_shard(i, n, seed=sharding.SEED):
    """The shard of an id by xxhash, draw by draw."""
    def chain(values):
        h = 42
        for v, size in values:
            h = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), h)
        return h - 2**64 if h >= 2**63 else h

    return max(j for j in range(n) if chain([(seed, 4), (j, 4), (i, 8)]) % (j + 1) == 0)


def test_law_by_brute_force(spark, tmp_path):
    data = [(i, f"text {i} é" * (i % 7), None, None, 0) for i in range(400)]
    docs(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.query(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got} == {
        i: (16 + len(t.encode()), zlib.crc32(t.encode()), "key", plain_key_shard(i, 40), plain_key_shard(i, 41)) for i, t, *_ in data
    }
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_even(spark):
    n = spark.range(20_000).select(sharding.shard_of(F.col("id"), 8).alias("s")).groupBy("s").count().collect()
    assert len(n) == 8 and all(abs(r["count"] - 2500) < 250 for r in n)


# --- secrets -----------------------------------------------------------------------

KINDS = [
    ("assign", re.compile(secrets.ASSIGN.replace("(?i:", "(?:"), re.I | re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def plain_base(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def secret_rows():
    draw = random.Random(8)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(n)) for n in (15, 16, 40)]
    key = "AKIA" + "".join(draw.choice("ABCDEFGH0123") for _ in range(16))
    texts = [
        None, "", f'password = "{hexes[2]}"', f"é𝄞 TOKEN:{hexes[1]} token={hexes[0]} {hexes[1]}", f"{key}{key} AKIA AKIA12 x{key}",
        f"secret: token: {hexes[2]}", "passwd=short", f"api_key='{hexes[1]}' apikey=={hexes[1]}", "\x01" + hexes[1] + "\x01", "Ghp_0123456789abcdefXYZ42 owner's",
        "a" * 20000 + " 0" + hexes[2],
    ]
    data = [(i, t, None, f"s{i}", 0) for i, t in enumerate(texts)] + [(2, texts[2], None, "s2", 0)]
    example = "EXAMPLE0123456789abcXYZ"
    return data + [(50 + i, f"see {example} here", None, f"o{i}", 0) for i in range(4)] + [(60, "only Lone0123456789abcXYZ99", None, None, 0), (None, "only Lone0123456789abcXYZ99", None, None, 0)]


def test_secrets(spark):
    data = secret_rows()
    got = secrets.find_secrets(docs(spark, data).withColumnRenamed("n_chars", "base")).collect()
    assert len(got) == len(data)
    want = {(r[0], r[1]): plain_base(r[1]) for r in data}
    for r in got:
        spans = [(x.kind, x.s, x.e) for x in sorted(r.base, key=lambda x: (x.s, ["assign", "access", "hex"].index(x.kind)))]
        assert spans in [v for (d, _), v in want.items() if d == r.doc_id]
    by = {r.doc_id: r for r in got}
    assert by[60].added and by[None].added and by[60].n_live == 1
    assert not by[50].added and by[50].n_example == 1
    assert not by[9].added and [x.kind for x in by[9].base] == ["hex"]  # a base span overlaps the opaque string


def test_widely_copied_values_of_one_owner(spark):
    """A value in many repositories of one owner is an example; copies of a text are one repository."""
    sample_, live = "SampleKey0123456789zyxwXY", "LiveKey9876543210zyxwvXY"
    data = [(i, f"text {i} says {sample_}", None, "hot", 0) for i in range(secrets.MAX_REPOSITORIES + 1)]
    data += [(100 + i, f"own text with {live} in it", None, "hot", 0) for i in range(60)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, data)).collect()}
    assert all(not got[i].added and got[i].n_example == 1 for i in range(secrets.MAX_REPOSITORIES + 1))
    assert all([x.value for x in got[100 + i].added] == [live] and got[100 + i].n_live == 1 for i in range(60))


def plain_added(data):
    """(id, text) -> spans of the kind ``owned``, in plain loops."""
    opaque = re.compile(secrets.OPAQUE)
    owners, texts, found = {}, {}, {}
    for d, t, _, o, _ in data:
        base = plain_base(t)
        own = [(m.group(), m.start(), m.end()) for m in opaque.finditer(t or "") if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
        found[d, t] = (base, own)
        values = {v for v, _, _ in own}
        for kind, pattern, group, least in KINDS:
            values |= {m.group(group) for m in pattern.finditer(t or "") if len(m.group(group)) >= least}
        for v in values:
            owners.setdefault(v, set()).add(o)
            texts.setdefault(v, set()).add(t)
    live = {v for v in owners if len(owners[v]) <= secrets.MAX_OWNERS and len(texts[v]) <= secrets.MAX_REPOSITORIES}
    return {k: sorted((s, e) for v, s, e in own if v in live and not any(s < be and bs < e for _, bs, be in base)) for k, (base, own) in found.items()}


def test_added_spans_against_brute_force(spark):
    draw = random.Random(3)
    alphabet = "abcdefGHIJ0123456789"
    values = ["".join(draw.choice(alphabet) for _ in range(draw.choice([20, 25, 40]))) for _ in range(30)]
    data = [(i, " ".join(draw.choice([*values, "word", "token: " + draw.choice(values)]) for _ in range(draw.choice([1, 5, 20]))), None, f"s{i % 4}" if i % 4 else None, 0) for i in range(60)]
    data += data[:5] + secret_rows()
    want = plain_added(data)
    got = secrets.find_secrets(docs(spark, data).withColumnsRenamed({"lang": "v", "n_chars": "live"})).collect()
    assert len(got) == len(data)
    for r in got:
        assert sorted((x.s, x.e) for x in r.added) in [v for (d, _), v in want.items() if d == r.doc_id]


def test_a_list_of_very_many_keys(spark):
    """10 MB of hex keys in one text; some 130 seconds would be quadratic work for a tenth of it."""
    draw = random.Random(2)
    keys = [f"{draw.getrandbits(160):040x}" for _ in range(250_000)]
    df = docs(spark, [(1, " ".join(keys), None, "a", 0)])
    began = time.perf_counter()
    got = secrets.find_secrets(df).select(F.size("hex").alias("n"), F.element_at("hex", -1)["e"].alias("last"), F.size("added").alias("added")).first()
    assert (got.n, got.last, got.added) == (250_000, 250_000 * 41 - 1, 0) and time.perf_counter() - began < 120


def test_secrets_query_columns(spark, tmp_path):
    data = secret_rows()
    docs(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    for r in secrets.query(spark, str(tmp_path)).collect():
        texts = {t for d, t, *_ in data if d == r.doc_id}
        plain = [",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(t)) for t in texts]
        assert r.base_sha256 in [hashlib.sha256(p.encode()).hexdigest() for p in plain]
        assert r.n_assign + r.n_access + r.n_hex <= len(r.spans.split(","))
    assert secrets.find_secrets(docs(spark, [])).count() == 0


# --- line dedup --------------------------------------------------------------------


def test_lines(spark):
    draw = random.Random(6)
    data = []
    for i in range(15):
        lines = [words(draw, 8), f"Posted by user{i} on 2024-01-{i + 1:02d} in forum", "All rights reserved here", "", f"The brown fox name{'abcdefghijklmno'[i]} jumps over it all again today"]
        data.append((i, "\n".join(lines), None, None, 0))
    data += [(90, data[3][1], None, None, 0)] * 2 + [(91, None, None, None, 0), (92, "", None, None, 0), (93, "\n\n", None, None, 0), (None, "All rights reserved here\nown line of mine", None, None, 0), (94, LONG, None, None, 0)]
    got = linededup.drop_lines(docs(spark, data).withColumnRenamed("n_chars", "leaf"), min_texts=10).collect()
    assert len(got) == len(data) and "leaf" in got[0].asDict()
    by = {r.doc_id: r for r in got}
    assert by[0].n_dropped == 0 and by[0].text == data[0][1]
    for i in range(1, 15):
        assert by[i].text.split("\n")[0] == data[i][1].split("\n")[0]
        assert by[i].n_lines == 5 and by[i].n_dropped == 3
    assert by[90].n_dropped == 3 and by[None].text == "own line of mine"
    assert (by[91].text, by[91].n_lines) == (None, 0) and by[92].text == "" and by[93].text == "\n\n" and by[94].text == LONG


def test_long_lines_of_one_token_and_clashing_names(spark):
    line, short = "条款" * 30, "Menu"
    data = [(i, f"{line}\n{short}\nown line {'abcdefghijkl'[i]} of it", "en", None, i) for i in range(12)]
    df = docs(spark, data).withColumnsRenamed({"lang": "n_lines", "source": "g_id", "n_chars": "drop"})
    got = linededup.drop_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines_before", "g_id", "drop", "n_lines", "n_dropped"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].text == data[0][1] and all(by[i].text == data[i][1].split("\n", 1)[1] and by[i].drop == i for i in range(1, 12))


def test_copies_alone_are_no_boilerplate(spark):
    text = "one two three four\nfive six seven eight"
    got = linededup.drop_lines(docs(spark, [(i, text, None, None, 0) for i in range(30)])).collect()
    assert all(r.text == text and r.n_dropped == 0 for r in got)
    assert linededup.drop_lines(docs(spark, [])).count() == 0


def test_copies_do_not_outvote_a_template(spark):
    names = [chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(30)]
    data = [(i, f"Posted in category {v} by admin", None, None, 0) for i, v in enumerate(names)]
    data += [(100 + i, "Posted in category offers for everyone\nits own line here", None, None, 0) for i in range(200)]
    by = {r.doc_id: r for r in linededup.drop_lines(docs(spark, data)).collect()}
    assert [by[i].n_dropped for i in range(30)] == [0] + [1] * 29
    assert all(by[100 + i].n_dropped == 0 for i in range(200))


def test_several_templates_in_a_leaf(spark):
    names = [chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(14)]
    forms = ["The site was made {} with great love here", "The site was shut {} for some repairs today", "The site was sold {} after many long years", "The site was seen {} near an old mill"]
    data = [(100 * k + i, f.format(v), None, None, 0) for k, f in enumerate(forms) for i, v in enumerate(names)]
    data += [(1000 + i, f"The site was {v} {v} {v} {v} {v} {v}", None, None, 0) for i, v in enumerate(names)]
    by = {r.doc_id: r for r in linededup.drop_lines(docs(spark, data)).collect()}
    for k in range(4):
        assert [by[100 * k + i].n_dropped for i in range(14)] == [0] + [1] * 13
    assert all(by[1000 + i].n_dropped == 0 for i in range(14))


def test_linededup_tokens_are_made_once_for_equal_sets_of_lines(spark):
    """Distinct texts a token, by a plain count; and a line in 300 texts isn't taken apart 300 times."""
    from pyspark.sql import functions as F

    tokens = {1: ["a", "b", "c"], 2: ["a", "b", "d"], 3: ["a", "x", "c"]}
    held = {t: [1] for t in range(300)} | {t: [1, 2] for t in range(300, 305)} | {305: [1, 2, 3], 306: [3]}
    rows = [(9, 3, k, t, tokens[k]) for t, ks in held.items() for k in ks]
    seen = spark.createDataFrame(rows, "node long, n int, line_key long, text_key long, tokens array<string>")
    kinds = seen.groupBy("node", "line_key").agg(F.first("tokens").alias("tokens"))
    got = {(r.pos, r.token): r.c for r in linededup.token_texts(seen, kinds).collect()}
    want = {(p, w): sum(any(tokens[k][p] == w for k in ks) for ks in held.values()) for p, w in {(p, w) for v in tokens.values() for p, w in enumerate(v)}}
    assert got == want
    taken = spark.sparkContext.accumulator(0)
    apart = F.udf(lambda x: taken.add(1) or x, "array<string>").asNondeterministic()
    linededup.token_texts(seen.drop("tokens"), kinds.withColumn("tokens", apart("tokens"))).collect()
    assert 0 < taken.value < 20
