"""Document fingerprints by randomised edit embedding.

All texts share one random walk: step j reads the character under the text's pointer,
writes it out, and moves the pointer on or not by a coin that belongs to (j, character).
After an edit the walks of two texts soon fall into step again, so few edits leave most
written symbols equal: edit distance becomes Hamming distance. Of a walk of up to 3 n
steps a shared sample is kept: a text of size class k (n <= 2^k) keeps the positions below
3 * 2^k whose hash has at least k - ``BASE`` trailing zero bits, so that classes share their
positions and a fingerprint has about 3 * 2^BASE symbols whatever the length. Likeness is the
share of equal symbols among common positions that at least one of two walks reached.

``near_classes`` takes ``WALKS`` such walks, each with coins of its own, since how soon two walks fall into
step again is chance. Bit-sampled bands of each walk's symbols put texts into buckets, by size class; a text is
also banded as one of the larger class that a tenth more characters reach. Texts of a bucket meet a centre of it, and what
these stars may miss meets in tiles, as for shingles (``neardup``). A pair is linked if it is verified on all symbols
of some walk: at least ``LEAST_LIKE`` of them are equal, where unrelated texts have some 15 percent. Classes are what links
lead to; each row is given its edit distance to the first text of its class. Bands are probable, not certain; the README has measured recall.

Cases: an empty table gives an empty result; a null text counts as empty and an empty one
has a fingerprint of pads; two fingerprints of pads are wholly alike; equal texts, in one row or
several, have equal fingerprints; ids that are equal are ordered by text, null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, row_key, table
from .components import components
from .neardup import star_pairs, tiles
from .textops import U64, mix

SEED = 23
BASE = 6
LEAST_CLASS = 5
#: Coins repeat after so many steps.
PERIOD = 8191
#: Symbols of the walks of one group of texts, steps times texts.
GROUP_CELLS = 8 << 20
#: Walks of ``near_classes``, bands of each, and their symbols, of which so many are no pads.
WALKS, BANDS, BAND_SYMBOLS, LEAST_SYMBOLS = 5, 12, 7, 4
LEAST_LIKE = 0.5

_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
_coins = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (PERIOD, 256), dtype=np.uint8)
_coins[:, 0] = 0
_samples: dict[int, np.ndarray] = {}


def size_class(n: int) -> int:
    return max(LEAST_CLASS, int(n - 1).bit_length() if n > 1 else 0)


def sample(k: int) -> np.ndarray:
    """Positions that a text of class k keeps, ascending."""
    if k not in _samples:
        j = np.arange(3 << k, dtype=U64)
        mask = U64((1 << max(0, k - BASE)) - 1)
        _samples[k] = np.flatnonzero((mix(j + U64(SEED << 20)) & mask) == 0)
    return _samples[k]


def symbols(text: str) -> np.ndarray:
    """Characters as 1 .. 255; 0 is the pad."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (((points * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)


def fingerprints(texts: list[str], walk: int = 0) -> list[np.ndarray]:
    """The kept symbols (0 .. 15, 0 the pad) of each text, walked in groups of like length; ``walk``
    numbers walks with different coins."""
    chars = [symbols(t) for t in texts]
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(chars[i]))
    at = 0
    while at < len(order):
        longest = max(1, len(chars[order[at]]))
        group = order[at : at + max(1, GROUP_CELLS // (3 * longest))]
        at += len(group)
        for i, kept in zip(group, _walk([chars[i] for i in group], walk * (PERIOD // 7)), strict=True):
            out[i] = kept
    return out


def _walk(chars: list[np.ndarray], shift: int = 0) -> list[np.ndarray]:
    """The walks of texts by falling length, one column each."""
    lengths = np.array([len(c) for c in chars], np.int64)
    steps = int(3 * lengths[0])
    # Each text is followed by a pad that no coin moves on from.
    flat = np.concatenate([np.append(c, np.uint8(0)) for c in chars])
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    wrote = np.zeros((steps, len(chars)), np.uint8)
    # Texts are by falling length, so those still walking at step j < 3 n are the first ones.
    walking = np.searchsorted(-3 * lengths, -np.arange(steps), "left")
    pointer = first.copy()
    for j in range(steps):
        at = pointer[: walking[j]]
        c = flat[at]
        wrote[j, : walking[j]] = c
        at += _coins[(j + shift) % PERIOD][c]
        if j & 63 == 63 and not c.any():
            break
    out = []
    for i, n in enumerate(lengths):
        at = sample(size_class(int(n)))
        kept = np.zeros(len(at), np.uint8)
        here = at[: np.searchsorted(at, 3 * n)]
        w = wrote[here, i]
        kept[: len(here)] = np.where(w > 0, w % 15 + 1, 0)
        out.append(kept)
    return out


def encode(n: int, kept: np.ndarray) -> str:
    """Two digits of size class, a colon, and a hex digit for each kept symbol (0: pad)."""
    return f"{size_class(n):02d}:" + _HEX[kept].tobytes().decode()


def decode(fingerprint: str) -> tuple[int, np.ndarray]:
    digits = np.frombuffer(fingerprint[3:].encode(), np.uint8)
    return int(fingerprint[:2]), np.where(digits >= 97, digits - 87, digits - 48).astype(np.uint8)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of equal symbols of two (class, kept symbols)."""
    if a[0] > b[0]:
        a, b = b, a
    x, y = a[1], b[1]
    if a[0] < b[0]:
        # The larger class keeps fewer of the smaller one's positions, and positions beyond it.
        far = sample(b[0])
        near = far[far < 3 << a[0]]
        x = np.concatenate([x[np.searchsorted(sample(a[0]), near)], np.zeros(len(far) - len(near), np.uint8)])
    used = (x > 0) | (y > 0)
    return float((x[used] == y[used]).mean()) if used.any() else 1.0


def edited(text: str, other: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``other``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + other[:quarter]


_DONE = pa.schema(
    [("kind", pa.string()), ("part", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
)
_DONE_SQL = "kind string, part long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
#: Characters and rows of texts that are worked on at once, and rows taken from Arrow at once.
PART_CHARS, PART_ROWS = 3 << 20, 8192
SLICE = 256


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield list(zip(*[part.column(c).to_pylist() for c in columns], strict=True))


def _compare(ids: list, texts: list[str], following: list[str]) -> list[tuple]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # Rows in sequence share texts: the next document of one row is the next row's own.
    distinct = {t: i for i, t in enumerate(dict.fromkeys([*texts, *changed, *following]))}
    kept = fingerprints(list(distinct))
    of = lambda t: (size_class(len(t)), kept[distinct[t]])
    return [
        ("done", None, d, len(t), hashlib.sha256(c.encode()).hexdigest(), encode(len(t), of(t)[1]), encode(len(c), of(c)[1]),
         likeness(of(t), of(c)), likeness(of(t), of(f)), None)
        for d, t, c, f in zip(ids, texts, changed, following, strict=True)
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DONE, strict=True)], schema=_DONE)


def _in_sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition against the row that follows; the first row's text
    is given out as ``head``, the last row, whose successor is elsewhere, as ``tail``."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    started, held = False, 0
    for rows in _rows(batches, "doc_id", "text"):
        for d, t in rows:
            t = t or ""
            if not started:
                started = True
                yield _batch([("head", part, d, None, None, None, None, None, None, t)])
            ids.append(d)
            texts.append(t)
            held += len(t)
            if len(texts) > 1 and (len(texts) >= PART_ROWS or held >= PART_CHARS):
                yield _batch(_compare(ids[:-1], texts[:-1], texts[1:]))
                ids, texts, held = ids[-1:], texts[-1:], len(t)
    if started:
        if len(texts) > 1:
            yield _batch(_compare(ids[:-1], texts[:-1], texts[1:]))
        yield _batch([("tail", part, ids[-1], None, None, None, None, None, None, texts[-1])])


def _last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _rows(batches, "doc_id", "text", "following"):
        yield _batch(_compare(*map(list, zip(*rows, strict=True))))


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The texts move once, into ranges of ids;
    only the first and last row of each range meet again, by the ranges' order."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key"), F.col("row")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row"))
    done = cut(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_in_sequence, _DONE_SQL)
    )
    # One row per range: these windows see ranges, not documents.
    heads = done.filter("kind = 'head'")
    follows = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    last = (
        done.filter("kind = 'tail'").select("part", "doc_id", "text")
        .join(follows, "part")
        .join(heads.select(F.col("part").alias("next_part"), F.col("text").alias("following")), "next_part")
        .select("doc_id", "text", "following")
        .mapInArrow(_last_rows, _DONE_SQL)
    )
    return done.filter("kind = 'done'").unionByName(last).drop("kind", "part", "text")


def _only_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _rows(batches, "doc_id", "text"):
        ids, texts = [d for d, _ in rows], [t or "" for _, t in rows]
        out = [encode(len(t), k) for t, k in zip(texts, fingerprints(texts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row."""
    return docs.select("doc_id", "text").mapInArrow(_only_fingerprint, "doc_id long, fingerprint string")


def widened(k: int, kept: np.ndarray, to: int) -> np.ndarray:
    """What texts of class ``k`` (rows of ``kept``) would keep as ones of the larger class ``to``."""
    if k == to:
        return kept
    far = sample(to)
    near = far[far < 3 << k]
    return np.concatenate([kept[..., np.searchsorted(sample(k), near)], np.zeros((*kept.shape[:-1], len(far) - len(near)), np.uint8)], axis=-1)


def pack(n: int, walks: list[np.ndarray]) -> bytes:
    """Length of a text, and its kept symbols of all walks."""
    return n.to_bytes(8, "little") + b"".join(w.tobytes() for w in walks)


def unpack(packed: bytes) -> tuple[int, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    return n, np.frombuffer(packed, np.uint8, offset=8).reshape(-1, len(sample(size_class(n))))


def _prints(walks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches, "doc_id", "text"):
            texts = [t or "" for _, t in rows]
            made = [fingerprints(texts, w) for w in range(walks)]
            sigs = [pack(len(t), [m[i] for m in made]) for i, t in enumerate(texts)]
            nodes = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() if t else None for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.string()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "node", "sig"])

    return run


def band_buckets(packed: bytes) -> np.ndarray:
    """The buckets of a text. Bands take symbols at the same places in every fingerprint of a class."""
    n, walks = unpack(packed)
    out = []
    for to in range(size_class(n), size_class(n + n // 10 + 1) + 1):
        kept = widened(size_class(n), walks, to)
        draw = np.random.Generator(np.random.PCG64(SEED + 1)).random((BANDS, BAND_SYMBOLS))
        picked = kept[:, (draw * kept.shape[1]).astype(np.int64)]  # walk, band, symbol
        key = np.arange(len(walks), dtype=U64)[:, None] * U64(1 << 16) + np.arange(BANDS, dtype=U64) + U64(to << 32)
        for k in range(BAND_SYMBOLS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + picked[..., k])
        out.append(key[(picked > 0).sum(axis=-1) >= LEAST_SYMBOLS])
    return np.concatenate(out)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_buckets(p) for p in batch.column("sig").to_pylist()]
        short = np.repeat(batch.column("short").to_numpy(zero_copy_only=False), [len(k) for k in keys])
        bucket = np.concatenate(keys) if keys else np.zeros(0, U64)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(short)], names=["bucket", "short"])


def best_likeness(a: bytes, b: bytes) -> float:
    """The greatest likeness of two texts over the walks."""
    (n, x), (m, y) = unpack(a), unpack(b)
    to = max(size_class(n), size_class(m))
    x, y = widened(size_class(n), x, to), widened(size_class(m), y, to)
    used = (x > 0) | (y > 0)
    return float((((x == y) & used).sum(axis=1) / np.maximum(1, used.sum(axis=1))).max())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [best_likeness(a, b) >= LEAST_LIKE for a, b in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tile_links(key, group):
    """Links between components of a meeting of tiles, at most one a pair of components."""
    names, sigs = group.column("node").to_pylist(), group.column("sig").to_pylist()
    number: dict[bytes, int] = {}
    comp = [number.setdefault(c, len(number)) for c in group.column("comp").to_pylist()]
    side = np.array(group.column("tile").to_pylist()) == key[1].as_py()
    alone = key[1].as_py() == key[2].as_py()
    up = list(range(len(number)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    at = [unpack(p) for p in sigs]
    classes = np.array([size_class(n) for n, _ in at])
    out = []
    for k in np.unique(classes):
        # All texts of class k and below, as ones of class k: in a pair the larger class is the common one.
        here = np.flatnonzero(classes <= k)
        kept = np.stack([widened(int(classes[i]), at[i][1], int(k)) for i in here])
        for p, i in enumerate(here):
            if not side[i]:
                continue
            # Pairs of two smaller classes come in a smaller class's turn.
            meets = ((classes[here] == k) | (classes[i] == k)) & (((here > i) & side[here]) if alone else ~side[here])
            rest = np.array([q for q in np.flatnonzero(meets) if comp[here[q]] != comp[i]], np.int64)
            if not len(rest):
                continue
            used = (kept[rest] > 0) | (kept[p] > 0)
            like = (((kept[rest] == kept[p]) & used).sum(axis=2) / np.maximum(1, used.sum(axis=2))).max(axis=1)
            for q in rest[like >= LEAST_LIKE]:
                j = here[q]
                if find(comp[i]) != find(comp[j]):
                    up[find(comp[i])] = find(comp[j])
                    out.append((names[i], names[j]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def near_classes(docs: DataFrame, walks: int = WALKS) -> DataFrame:
    """doc_id, class_id, class_size, edits of each row: class_id is the smallest id of the texts that links lead to (a row
    without id is told by ``row_key``), class_size its number of rows, ``edits`` the edit distance to the text of that id, if it is
    at most a tenth of the longer text and at least 16 are allowed. A row without text is in a class of its own."""
    named = docs.select(row_key().cast("string").alias("doc_id"), "text")
    rows = cut(named.mapInArrow(_prints(walks), "doc_id string, node binary, sig binary").withColumn("doc_id", F.col("doc_id").cast("long")))
    nodes = cut(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    stars = cut(star_pairs(nodes, _bands))
    n = stars.count()
    clusters = cut(components(stars, n), 2 * n)
    sig = nodes.select("node", "sig")
    met = stars.join(sig.toDF("a", "pa"), "a").join(sig.toDF("b", "pb"), "b").select("a", "b", "pa", "pb")
    comps = cut(components(cut(met.mapInArrow(_verify, "a binary, b binary")), n), 2 * n)
    more = cut(tiles(clusters, comps).join(sig, "node").groupBy("cluster", "x", "y").applyInArrow(_tile_links, "a binary, b binary"))
    if more.limit(1).count():
        comps = cut(components(comps.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), 3 * n), 2 * n)
    labelled = nodes.select("node", "rep").join(comps, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = cut(labelled.groupBy("label").agg(F.min_by(F.struct("rep", "node"), "rep").alias("first")))
    classes = labelled.join(first, "label").select(F.col("node").alias("c_node"), F.col("first.rep").alias("class_id"), F.col("first.node").alias("c_first"))
    out = cut(
        rows.select("doc_id", "node").join(classes, F.col("node") == F.col("c_node"), "left")
        .select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), "c_first")
    )
    # Only texts that are linked with another text are read again.
    apart = cut(out.filter("node <> c_first").select("node", "c_first").distinct())
    wanted = cut(apart.select("node").unionByName(apart.select(F.col("c_first").alias("node"))).distinct())
    texts = docs.filter("text <> ''").select(F.unhex(F.sha2("text", 256)).alias("node"), "text").join(wanted, "node", "left_semi")
    texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")))
    pairs = apart.join(texts, "node").join(texts.toDF("c_first", "other"), "c_first")
    most = F.greatest(F.lit(16), F.floor(F.greatest(F.length("text"), F.length("other")) / 10)).cast("int")
    edits = pairs.select(F.col("node").alias("e_node"), F.call_function("levenshtein", "text", "other", most).cast("long").alias("edits"))
    size = out.groupBy(F.col("class_id").alias("s_id")).agg(F.count(F.lit(1)).alias("class_size"))
    return (
        out.join(edits, F.col("node") == F.col("e_node"), "left").join(cut(size), F.col("class_id") == F.col("s_id"))
        .select("doc_id", "class_id", "class_size", F.when(F.col("node").eqNullSafe(F.col("c_first")), F.lit(0).cast("long")).when(F.col("edits") >= 0, F.col("edits")).alias("edits"))
    )


def classes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
