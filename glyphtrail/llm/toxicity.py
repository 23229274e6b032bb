"""Toxicity scores: gradient-boosted trees over dense features, isotonic calibration.

The lexicon is learned: word beginnings (and whole words) that occur mostly in texts
labelled toxic, from one half of a bounded sample of labelled rows; the trees are fitted
on three tenths, with that lexicon's features, and calibrated on the last fifth, each class dealt evenly. Features of a text: densities and counts of
strong and weak lexicon hits, share of hits near a second-person word, rates of
capitals, punctuation, exclamation and obfuscated words, and length. Words are compared in lower case, look-alike digits
and signs counting as the letters they stand for.

At most ``MAX_ROWS`` labelled rows are fitted on, of texts of any length: words are counted and features worked
out on the executors, so that only keys and numbers reach the driver. Every whole text is scored.

Cases: an empty table gives an empty result; a null or empty text is scored with all
features 0; equal rows get equal scores; where a slice would have fewer than ``LEAST_IN_SLICE`` rows of a class, lexicon and trees are fitted on all rows and
their own probability is the score; with no labelled row, or one class only, every score is the share
of label 1 (one half without rows). Very long texts are read in blocks of their own; further columns do
not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import table
from .labelled import held_out, sample, slices
from .textops import U64, Spans, blocks, byte_class, byte_table, mix, pieces, texts_of

FOLDS, FOLD = 5, 0
MAX_ROWS = 9000
#: Slices of ten that lexicon, trees and calibration are fitted on, by their ends.
ENDS = (5, 8, 10)
#: Rows of each class that a slice needs.
LEAST_IN_SLICE = 5
SEED = 13
#: Byte lengths of the word beginnings that may enter the lexicon; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7, 8, 9, 10)
LEAST_TEXTS = 4
STRONG, WEAK = 0.9, 0.6
NEAR = 4
#: Second-person words of the languages at hand.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"

# Signs and digits that stand for letters.
_LOOKALIKE = {b"ABCDEFGHIJKLMNOPQRSTUVWXYZ": b"abcdefghijklmnopqrstuvwxyz", b"01345@$": b"oieasas"}
_TABLE = byte_table(_LOOKALIKE)
_LETTER = byte_class(b"01345@$")
_SIGN = byte_class(b"01345@$", letters=False, high=False)


def _keys(spans: Spans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the words that have a beginning of k bytes, and its key."""
    if not k:
        return np.arange(len(spans.start)), mix(spans.hash(spans.start, spans.end) + U64(1000))
    at = np.flatnonzero(spans.end - spans.start >= k)
    return at, mix(spans.hash(spans.start[at], length=k) + U64(k))


def count_keys(texts: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all beginnings, and how many toxic and other texts have each. Keys of different
    lengths do not coincide, since the length is in the hash."""
    keys_, toxic_, other_ = [], [], []
    for at, run in blocks(texts):
        spans = Spans(run, _TABLE, _LETTER)
        for k in BEGINNINGS:
            words, keys = _keys(spans, k)
            owner = np.searchsorted(spans.first, words, "right") - 1
            # Each key once a text.
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, place = np.unique(keys[new], return_inverse=True)
            label = y[at + owner[new]]
            toxic = np.bincount(place, label, len(keys))
            keys_.append(keys)
            toxic_.append(toxic)
            other_.append(np.bincount(place, minlength=len(keys)) - toxic)
    if not keys_:
        return np.zeros(0, U64), np.zeros(0), np.zeros(0)
    keys, place = np.unique(np.concatenate(keys_), return_inverse=True)
    total = lambda v: np.bincount(place, np.concatenate(v), len(keys))
    return keys, total(toxic_), total(other_)


def choose(keys: np.ndarray, toxic: np.ndarray, other: np.ndarray, ones: int, zeros: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of strong and of weak beginnings."""
    # Share of toxic texts if both labels were as common.
    share = (toxic / max(1, ones)) / np.maximum(1e-12, toxic / max(1, ones) + (other + 0.25) / max(1, zeros))
    strong = keys[(toxic >= LEAST_TEXTS) & (share >= STRONG) & (toxic >= 2 * other)]
    weak = keys[(toxic >= LEAST_TEXTS) & (share >= WEAK) & (toxic >= other / 4)]
    return np.sort(strong), np.sort(weak)


def _isin(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return known[at] == keys


_second_spans = Spans([w.encode() for w in SECOND_PERSON.split()], _TABLE, _LETTER)
_SECOND = np.unique(_keys(_second_spans, 0)[1])


def features(texts: list[bytes], strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """A row of dense features for each text."""
    out = []
    for _, run in blocks(texts):
        s = Spans(run, _TABLE, _LETTER)
        n = len(run)
        hit, soft = np.zeros(len(s.start), bool), np.zeros(len(s.start), bool)
        for k in BEGINNINGS:
            at, keys = _keys(s, k)
            hit[at] |= _isin(keys, strong)
            soft[at] |= _isin(keys, weak)
            if not k:
                second = _isin(keys, _SECOND)
        total = lambda flags: np.add.reduceat(np.concatenate([flags.astype(float), [0.0]]), s.first[:-1]) * (s.first[1:] > s.first[:-1])
        at = np.arange(len(second))
        counts = np.diff(s.first)
        seen = np.concatenate([[0], np.cumsum(second)])
        low, high = np.repeat(s.first[:-1], counts), np.repeat(s.first[1:], counts)
        near = seen[np.minimum(at + NEAR + 1, high)] > seen[np.maximum(at - NEAR, low)]
        words = np.maximum(1, s.first[1:] - s.first[:-1])
        chars = np.maximum(1, s.text_start[1:] - s.text_start[:-1] - 1)
        count = lambda members: s.per_text(np.flatnonzero(members[s.buf]))
        upper = np.zeros(256, bool)
        upper[65:91] = True
        signs = np.concatenate([[0], np.cumsum(_SIGN[s.buf])])
        inner = signs[s.end] - signs[s.start]
        obscured = (inner > 0) & (s.end - s.start - inner >= 2)
        hits, softs = total(hit), total(soft)
        out.append(
            np.stack(
                [
                    hits / words, np.log1p(hits), softs / words, np.log1p(softs), total(hit & near) / np.maximum(1, hits),
                    count(upper) / chars, count(byte_class(b".,;:?!*#$%&|-", False, False)) / chars, count(byte_class(b"!", False, False)) / chars,
                    total(obscured) / words, np.log1p(s.first[1:] - s.first[:-1]),
                ],
                axis=1,
            )[:n]
        )
    return np.concatenate(out) if out else np.zeros((0, 10))


def roles(y: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """Which rows lexicon, trees and calibration are fitted on: slices of each class, or all rows and
    none for the calibration where a slice would have too few of a class."""
    out = [(part >= low) & (part < high) for low, high in zip((0, *ENDS), ENDS, strict=False)]
    if all(min(y[p].sum(), (1 - y[p]).sum()) >= LEAST_IN_SLICE for p in out):
        return out
    whole = np.ones(len(y), bool)
    return [whole, whole, ~whole]


class Model:
    """Scores of texts by a constant, or by lexicon, trees and calibration."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def fitted(self, strong: np.ndarray, weak: np.ndarray, x: np.ndarray, y: np.ndarray, trees: np.ndarray, level: np.ndarray) -> Model:
        self.strong, self.weak = strong, weak
        self.trees = Boosted().fit(x[trees], y[trees])
        self.level = Isotonic().fit(self.trees.raw(x[level]), y[level]) if level.any() else None
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        raw = self.trees.raw(features(texts, self.strong, self.weak))
        return 1 / (1 + np.exp(-raw)) if self.level is None else self.level(raw)


def constant_of(y: np.ndarray) -> float | None:
    """The score of every text where the labels are of one class."""
    return None if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.5


def fit_texts(rows: list[tuple[bytes, int]]) -> Model:
    """A model of (text, label) rows at hand."""
    texts, y = [t for t, _ in rows], np.array([v for _, v in rows], float)
    if constant_of(y) is not None:
        return Model(constant_of(y))
    words, trees, level = roles(y, np.array(slices(y)))
    pick = [t for t, use in zip(texts, words, strict=True) if use]
    strong, weak = choose(*count_keys(pick, y[words]), int(y[words].sum()), int((1 - y[words]).sum()))
    return Model().fitted(strong, weak, features(texts, strong, weak), y, trees, level)


def score_texts(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of each row, by any model with ``score(list of bytes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            done = [model.score(part) for _, part in blocks(texts_of(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(done) if done else np.zeros(0), pa.float64())], names=["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        keys, toxic, other = count_keys(texts_of(batch), batch.column("y").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array(other.astype(np.int64))], names=["k", "toxic", "other"])


def _feature_batches(strong: np.ndarray, weak: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = features(texts_of(batch), strong, weak)
            rows = [r.tobytes() for r in np.ascontiguousarray(x)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("draw", "y", "slice")] + [pa.array(rows, pa.binary())], names=["draw", "y", "slice", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    rows = sample(docs, labels, label, FOLDS, FOLD, max_rows, SEED)
    # At most ``max_rows`` labels and slices.
    known = rows.select("y", "slice").toArrow()
    y, part = known["y"].to_numpy().astype(float), known["slice"].to_numpy()
    if constant_of(y) is not None:
        return Model(constant_of(y))
    words, _, level = roles(y, part)
    half = rows.filter(F.col("slice") < ENDS[0]) if level.any() else rows
    counts = (
        half.select("y", "text").mapInArrow(_count_batches, "k long, toxic long, other long")
        .groupBy("k").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .filter(F.col("toxic") >= LEAST_TEXTS).toArrow()
    )
    column = lambda c: counts[c].to_numpy()
    strong, weak = choose(column("k").view(U64), column("toxic").astype(float), column("other").astype(float), int(y[words].sum()), int((1 - y[words]).sum()))
    rest = rows.filter(F.col("slice") >= ENDS[0]) if level.any() else rows
    kind = rows.schema["draw"].dataType.simpleString()
    made = rest.mapInArrow(_feature_batches(strong, weak), f"draw {kind}, y int, slice int, x binary").orderBy("draw").select("y", "slice", "x").toArrow()
    x = np.frombuffer(b"".join(made["x"].to_pylist()), float).reshape(made.num_rows, -1)
    y, part = made["y"].to_numpy().astype(float), made["slice"].to_numpy()
    last = part >= ENDS[1] if level.any() else np.zeros(len(y), bool)
    return Model().fitted(strong, weak, x, y, ~last, last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
