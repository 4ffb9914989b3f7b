"""Quality classifier: supervised subword embeddings.

A text is a bag of words, pairs of words and character n-grams of 3 to 5 bytes inside a word and its blanks, each hashed to
a bucket with a learned vector; a second occurrence of a word in a row makes the pair "same again". The document is the
average of its vectors, a linear layer and a softmax give the classes, and stochastic gradient descent in numpy learns
both. Averaging and the layer are linear, so scoring needs one number for each bucket.

Training takes at most `sample` labelled texts, those with the least hash of their id: they come to the driver as bucket
counts, and everything else is scored where it lies. Equal texts of an id teach once.

Defined results: a text without words scores by the intercept alone; null labels and ids teach nothing; several labels of
one document all count; without labels of both classes every score is the share of label 1 (0.5 without any label);
repeated documents get one row each; an empty table gives no rows; other columns are kept by `keep`, else left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from houselights.llm.common import ArrowMap, utf8_rows

BITS = 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
SAMPLE = 2000
THRESHOLD = 0.3
FOLDS = 5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SAME = 0
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next text."""
    known = _powers[base]
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    _powers[base] = known
    return known[:n]


def _bucket(values: np.ndarray, kind: int) -> np.ndarray:
    values = (values ^ np.uint64(kind << 56)) * _MIX
    return ((values ^ (values >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int32)


def buckets(text: bytes | None) -> np.ndarray:
    """The buckets of all features of a text, with repeats."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int32)
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    data = raw.astype(np.uint64)
    blank = np.flatnonzero(raw == 32)
    out = []
    for n in GRAMS:
        if len(data) < n:
            continue
        value = data[:len(data) - n + 1].copy()
        for k in range(1, n):
            value |= data[k:len(data) - n + 1 + k] << np.uint64(8 * k)
        # No blank may stand inside, only at the ends.
        bad = np.zeros(len(data) + n, bool)
        for k in range(1, n - 1):
            bad[np.maximum(blank - k, 0)] = True
        bad[0] = raw[1:n - 1].min() == 32 if n > 2 else False
        out.append(_bucket(value[~bad[:len(value)]], n))
    start, end = blank[:-1] + 1, blank[1:]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * _power_table(_BASE, len(data)), dtype=np.uint64)])
    word = (sums[end] - sums[start]) * _power_table(_BASE_INVERSE, len(data))[start]
    out.append(_bucket(word, 1))
    pair = _bucket(word[:-1] * _MIX + word[1:], 2)
    pair[word[:-1] == word[1:]] = _SAME
    out.append(pair)
    return np.concatenate(out)


@dataclass
class Model:
    """logit(label 1) = intercept + the mean of `weight` over the text's buckets."""
    weight: np.ndarray
    intercept: float

    def score(self, text: bytes | None) -> float:
        found = buckets(text)
        logit = self.intercept + (float(self.weight[found].mean(dtype=np.float64)) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 4.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, counts, label) rows."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for *_, y in rows])
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for n in rng.permutation(len(rows)):
            ids, counts, label = rows[n]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[ids]
            logits = layer @ hidden + bias
            logits -= logits.max()
            error = np.exp(logits) / np.exp(logits).sum()
            error[label] -= 1
            back = layer.T @ error
            layer -= step * np.outer(error, hidden)
            bias -= step * np.float32(0.1) * error
            vectors[ids] -= step * share[:, None] * back
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fold(doc_id: Column) -> Column:
    """0 for the held-out fifth."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", **settings) -> Model:
    """The model learnt from at most `sample` labelled rows outside the held-out fold."""
    chosen = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("_label"))
              .where("doc_id is not null and _label in (0, 1)").where(fold(F.col("doc_id")) != 0)
              .orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(buckets(x), return_counts=True) for x in utf8_rows(batch.column(2))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.list_(pa.int32())),
                pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32())), batch.column(3)],
                ["doc_id", "label", "ids", "counts", "place"])

    # At most `sample` rows of two numbers are broadcast. A stored row may repeat and an id may have several texts: equal
    # ones count once, and no more than `sample` texts reach the driver.
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "_label", "text").distinct()
            .withColumn("_place", F.xxhash64("text"))
            .mapInArrow(run, "doc_id bigint, label int, ids array<int>, counts array<int>, place bigint")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "place", "label").limit(sample).toArrow())
    order = np.lexsort([np.array(rows[name], np.int64) for name in ("label", "place", "doc_id")])
    ids, counts, marks = rows["ids"].combine_chunks(), rows["counts"].combine_chunks(), rows["label"].to_pylist()
    return learn([(ids[int(n)].values.to_numpy(), counts[int(n)].values.to_numpy(), marks[n]) for n in order], **settings)


def _scores(model: Model) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(x) for x in utf8_rows(batch.column(1))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scores(model), "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The input rows that the model accepts, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(x) >= threshold for x in utf8_rows(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
