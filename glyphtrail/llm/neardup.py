"""MinHash near-deduplication with circulant permutations and exact verification.

1. Signatures. One hash (``mix``, a permutation of 64-bit values) scatters a document's
   shingles over a ring of ``RING`` places; one permutation of the ring, read from the
   shingle's place on, gives the values of all ``COORDS`` coordinates: coordinate k is
   the permutation shifted by k. Documents of equal shingle sets are one node from here on.
2. Banding. ``BANDS`` bands of ``ROWS`` coordinates; nodes with an equal band meet in a
   bucket. Each node is paired with one centre of each of its buckets (another for each
   band), so a bucket of m nodes gives m - 1 pairs, not m^2.
3. Verification of these pairs on full shingle sets, and components of the verified links.
4. What stars may miss: two nodes of a bucket whose common centre is unlike one of them.
   The unverified pairs' components (clusters) hold all nodes that may still be linked. In a
   cluster with several verified components, nodes meet in tiles of about ``TILE`` nodes, those
   of one large component in tiles of their own that never meet each other. A tile pair
   first compares signatures of a byte a coordinate; only nodes with a likely partner send their
   full sets, and links go out between components only, at most one per pair of components. So the cost
   falls as the stars succeed, and no task holds a whole cluster.

A pair at the least similarity, 0.75, shares a band with probability 1 - 5e-6, and no link
of a shared band is lost.

Cases: an empty table gives an empty result; a document with less than five words has its
whole word sequence as one shingle, one without words or text has none and is linked with
nothing; equal rows get equal results; a null id takes part in links but names no
component, unless all ids of a component are null, which is then null; a very long text is
hashed whole, in blocks of its own; further columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_above, cut, marked, small, table
from .components import components
from .textops import SHINGLE, U64, Words, blocks, mix, pieces, shared, texts_of

THRESHOLD = 75
ROWS, BANDS = 4, 32
COORDS = ROWS * BANDS
RING_BITS = 20
RING = 1 << RING_BITS
SEED = 3
#: Nodes of a tile, and the signature likeness from which a pair in a tile is checked in full:
#: over five standard deviations below the threshold.
TILE = 256
PROMISING = 0.55
_PART = 4096
#: Nodes of clusters are broadcast up to this many rows (of 24 bytes), to find their texts.
SMALL_NODES = 200_000

_ring: dict[int, np.ndarray] = {}


def ring(seed: int = SEED) -> np.ndarray:
    """Row p: the ``COORDS`` permuted values that follow place p round the ring."""
    if seed not in _ring:
        values = np.random.Generator(np.random.PCG64(seed)).permutation(RING).astype(np.uint32)
        _ring[seed] = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:COORDS]]), COORDS)
    return _ring[seed]


def signature(shingles: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The circulant MinHash of a non-empty set of shingle hashes."""
    places = (shingles >> U64(64 - RING_BITS)).astype(np.int64)
    window = ring(seed)
    out = window[places[:_PART]].min(axis=0)
    for at in range(_PART, len(places), _PART):
        np.minimum(out, window[places[at : at + _PART]].min(axis=0), out=out)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    turned = mix(shingles ^ U64(0x9E3779B97F4A7C15))
    return np.array([shingles.sum(dtype=U64), np.bitwise_xor.reduce(turned) + U64(len(shingles))], U64).tobytes()


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit bucket number for each band of each row of ``sigs``."""
    out = np.broadcast_to(np.arange(BANDS, dtype=U64), (len(sigs), BANDS))
    for r in range(ROWS):
        out = mix(out * U64(0x9E3779B97F4A7C15) + sigs[:, r::ROWS].astype(U64))
    return out.view(np.int64)


def _sign(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            nodes, sizes, sigs = [], [], []
            for _, part in blocks(texts_of(batch)):
                words = Words([p.lower() for p in part])
                for i in range(len(part)):
                    s = words.shingles(i, shingle)
                    sizes.append(len(s))
                    nodes.append(set_key(s) if len(s) else None)
                    sigs.append(signature(s, seed).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "node", "n_shingles", "sig"],
            )

    return run


def signed(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id (of any type), node, n_shingles, sig of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_sign(shingle, seed), f"doc_id {kind}, node binary, n_shingles long, sig binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, COORDS)
        short = np.repeat(batch.column("short").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(band_keys(sigs).ravel()), pa.array(short)], names=["bucket", "short"])


def star_pairs(nodes: DataFrame, bands=_bands) -> DataFrame:
    """a, b: each node with the centre of each bucket that it shares with others.
    ``bands`` makes (bucket, short) of (short, sig); buckets hold 64-bit short names; should
    two nodes share one, both are paired."""
    named = nodes.select("node", "sig", F.xxhash64("node").alias("short"))
    rows = named.select("short", "sig").mapInArrow(bands, "bucket long, short long")
    rank = F.xxhash64("bucket", "short")
    shared_ = (
        rows.groupBy("bucket").agg(F.min(rank).alias("low"), F.max(rank).alias("high")).filter(F.col("low") != F.col("high")).select("bucket", "low")
    )
    members = cut(rows.join(shared_, "bucket").select("bucket", "short", (rank == F.col("low")).alias("centre")))
    centres = members.filter("centre").select("bucket", F.col("short").alias("c"))
    pairs = members.filter("not centre").join(centres, "bucket").select("short", "c").distinct()
    full = named.select("node", "short")
    return (
        pairs.join(full.withColumnRenamed("node", "x"), "short")
        .join(full.select(F.col("node").alias("y"), F.col("short").alias("c")), "c")
        .filter(F.col("x") != F.col("y"))
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    )


def _set_of(shingle: int):
    """(node, text) to (node, shingles): rows of another node than the one asked for go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            wanted, nodes, sets = batch.column("node").to_pylist(), [], []
            for at, part in blocks(texts_of(batch)):
                words = Words([p.lower() for p in part])
                for i in range(len(part)):
                    s = words.shingles(i, shingle)
                    key = set_key(s) if len(s) else None
                    if key and wanted[at + i] in (None, key):
                        nodes.append(key)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, shingles of ``nodes`` (node, rep: the id of a document that has it). A node all
    of whose ids are null is found among the documents without id."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")
    known = texts.join(small(nodes.filter("rep is not null"), SMALL_NODES), "rep").select("node", "text")
    lost = docs.filter("doc_id is null").select(F.lit(None).cast("binary").alias("node"), "text")
    sets = known.unionByName(lost).mapInArrow(_set_of(shingle), "node binary, shingles binary")
    return sets.groupBy("node").agg(F.first("shingles").alias("shingles")).join(nodes.select("node"), "node", "left_semi")


def _verify(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = shared(a, b) if min(len(a), len(b)) * 100 >= threshold * max(len(a), len(b)) else 0
                keep.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(_verify(threshold), "a binary, b binary")


def _tile_links(threshold: int):
    def run(key, group):
        names, comps = group.column("node").to_pylist(), group.column("comp").to_pylist()
        number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([number[c] for c in comps])
        side = np.array(group.column("tile").to_pylist()) == key[1].as_py()
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
        sets = [np.frombuffer(s.as_buffer(), U64) for s in group.column("shingles").combine_chunks()]
        alone = key[1].as_py() == key[2].as_py()
        up = list(range(len(number)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a_out, b_out = [], []
        others = np.flatnonzero(side if alone else ~side)
        for i in np.flatnonzero(side):
            cand = others[others > i] if alone else others
            cand = cand[comp[cand] != comp[i]]
            if not len(cand):
                continue
            like = (sigs[cand] == sigs[i]).mean(axis=1)
            for j in cand[like >= PROMISING]:
                if find(comp[i]) != find(comp[j]):
                    both = shared(sets[i], sets[j])
                    if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                        up[find(comp[i])] = find(comp[j])
                        a_out.append(names[i])
                        b_out.append(names[j])
        return pa.table({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})

    return run


def tiles(clusters: DataFrame, comps: DataFrame, tile: int = TILE) -> DataFrame:
    """cluster, node, comp, tile, x, y: the meetings (x, y) of tiles of nodes of clusters that still have
    several verified components; ``tile`` is the side that a node is on."""
    member = clusters.select("node", F.col("label").alias("cluster")).join(
        comps.select("node", F.col("label").alias("comp")), "node", "left"
    ).withColumn("comp", F.coalesce("comp", "node"))
    sizes = member.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("size"))
    # Components of half a tile and more get tiles of their own; the others of a cluster share tiles.
    sizes = cut(sizes.withColumn("own", F.when(F.col("size") * 2 >= tile, F.col("comp"))))
    room = sizes.groupBy("cluster", "own").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("comps"))
    open_ = room.groupBy("cluster").agg(F.sum("comps").alias("comps")).filter("comps > 1").select("cluster")
    room = cut(room.join(open_, "cluster", "left_semi").withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")))
    places = room.select("cluster", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    places = places.groupBy("cluster").agg(F.collect_list(F.struct("own", "t")).alias("all"))
    name = lambda own, t: F.concat(F.coalesce(F.hex(own), F.lit("-")), F.lit("/"), t.cast("string"))
    return (
        member.join(sizes.select("cluster", "comp", "own"), ["cluster", "comp"])
        .join(room.select("cluster", F.col("own").alias("r_own"), "tiles"), "cluster")
        .filter(F.col("own").eqNullSafe(F.col("r_own")))
        .withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .join(places, "cluster")
        # Two tiles meet unless both belong to one large component.
        .withColumn("to", F.explode(F.filter("all", lambda x: x["own"].isNull() | ~x["own"].eqNullSafe(F.col("own")))))
        .withColumn("tile", name(F.col("own"), F.col("t")))
        .withColumn("meets", name(F.col("to.own"), F.col("to.t")))
        .select("cluster", "node", "comp", "tile", F.least("tile", "meets").alias("x"), F.greatest("tile", "meets").alias("y"))
    )


MEETING = "cluster binary, node binary, comp binary, tile string, x string, y string"


def _promising(key, group):
    """The nodes of a meeting whose short signatures are like one of another component."""
    n = group.num_rows
    sigs = np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint8).reshape(n, COORDS)
    number: dict[bytes, int] = {}
    comp = np.array([number.setdefault(c, len(number)) for c in group.column("comp").to_pylist()])
    side = np.array(group.column("tile").to_pylist()) == key[1].as_py()
    left = np.flatnonzero(side)
    right = left if key[1].as_py() == key[2].as_py() else np.flatnonzero(~side)
    keep = np.zeros(n, bool)
    for i in left:
        like = ((sigs[right] == sigs[i]).mean(axis=1) >= PROMISING) & (comp[right] != comp[i])
        if like.any():
            keep[i] = True
            keep[right[like]] = True
    return group.drop_columns(["short"]).filter(pa.array(keep))


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte of each coordinate: equal coordinates have equal bytes, others one in 256 times."""
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in sigs], pa.binary())], names=["node", "short"])


def remaining_links(nodes: DataFrame, clusters: DataFrame, comps: DataFrame, sets: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """a, b: links between verified components of one cluster that no star showed. Only a byte of each
    coordinate goes to every meeting; signatures and sets go to those nodes that have a likely partner there."""
    short = nodes.select("node", "sig").mapInArrow(_shorten, "node binary, short binary")
    likely = cut(tiles(clusters, comps, tile).join(short, "node").groupBy("cluster", "x", "y").applyInArrow(_promising, MEETING))
    full = likely.join(nodes.select("node", "sig"), "node").join(sets, "node")
    return full.groupBy("cluster", "x", "y").applyInArrow(_tile_links(threshold), "a binary, b binary")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = cut(signed(docs, shingle, seed))
    nodes = cut(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("sig").alias("sig")))
    stars = cut(star_pairs(nodes))
    n = stars.count()
    clusters = cut(components(stars, n), 2 * n)
    sets = cut(shingle_sets(docs, cut(clusters.select("node").join(nodes.select("node", "rep"), "node"), 2 * n), shingle))
    links = cut(verified(stars, sets, threshold))
    comps = cut(components(links, n), 2 * n)
    more = cut(remaining_links(nodes, clusters, comps, sets, threshold))
    if more.limit(1).count():
        comps = cut(components(comps.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), 3 * n), 2 * n)
    labelled = nodes.select("node", "rep").join(comps, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Written first, so that a hot component is split in the join.
    smallest = cut(labelled.groupBy("label").agg(F.min("rep").alias("component")))
    named = labelled.join(smallest, "label").select(F.col("node").alias("m_node"), "component")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return (
        rows.select("doc_id", "node", "n_shingles").join(named, F.col("node") == F.col("m_node"), "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def place(doc_id: Column, mark: Column) -> Column:
    """A name for a whole row that sorts as its id does: ids by size, then rows without id;
    rows of one id by their 128-bit mark."""
    digits = F.lpad((doc_id.cast("decimal(20,0)") + F.lit(Decimal(1 << 63))).cast("decimal(20,0)").cast("string"), 20, "0")
    part = lambda h: F.lpad(F.hex(mark[h]), 16, "0")
    return F.concat(F.coalesce(digits, F.lit("~")), F.lit(":"), part("h1"), part("h2"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest id; rows without id
    stand behind those with one, rows of one id are told apart by their content, and of
    rows equal in every column one stays."""
    rows = marked(docs).withColumn("_name", place(F.col("_row.doc_id"), F.col("_mark")))
    found = near_duplicates(rows.select(F.col("_name").alias("doc_id"), "_row.text"), **options)
    kept = cut(found.filter("kept").groupBy(F.col("doc_id").alias("_name")).agg(F.count(F.lit(1)).alias("n")))
    out = rows.join(kept.select("_name"), "_name", "left_semi")
    # Whole rows meet only where some are equal.
    return (out.dropDuplicates(["_name"]) if any_above(kept, "n", 1) else out).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_W = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ORACLE = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p:p + 4], ' '))) AS g FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {THRESHOLD} * (x.n + y.n - i)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
