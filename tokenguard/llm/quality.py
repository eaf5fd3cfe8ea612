"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

n-grams are those of words (1, 2) and of word shapes (1, 2, 3); a shape tells case, length, the last character's class
and whether the word repeats the one before. Hashed indicators are multiplied by their log-count ratio between the
classes, rows are scaled to unit length, and dual coordinate descent fits the hinge loss. A third of the sample, left out
of a first fit, calibrates margins to probabilities. The model has a fixed number of buckets and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenguard.llm import textkit
from tokenguard.llm.common import bounded_batches, crc_mod, labelled, slices, table

BUCKETS = 1 << 18
SAMPLE_PER_LABEL = 3000  # labelled documents of each class that the model is fitted on, about
THRESHOLD = 0.3

CLASS = np.full(256, 3, np.uint64)  # of a byte: 0 letter, 1 digit, 2 ordinary mark, 3 other
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
CLASS[[*range(48, 58)]] = 1
CLASS[[ord(c) for c in ".,;:?'\")"]] = 2
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
LETTER = (CLASS == 0).astype(np.int64)


def shapes(data: np.ndarray, words: textkit.Words) -> np.ndarray:
    """A small code for each word's looks."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    ends = np.append(words.starts[1:], len(data))
    inside = ~textkit.SPACES[data]
    sums = lambda x: np.add.reduceat(x[data] * inside, words.starts)
    length = np.add.reduceat(inside.astype(np.int64), words.starts)
    upper, letters = sums(UPPER), sums(LETTER)
    # words end before the first space after their start
    last = CLASS[data[np.minimum(words.starts + length - 1, ends - 1)]]
    again = np.zeros(len(length), np.uint64)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    case = ((upper >= 2) & (upper == letters)).astype(np.uint64)
    size = np.digitize(length, (3, 7, 16)).astype(np.uint64)
    return ((again * np.uint64(2) + case) * np.uint64(4) + last) * np.uint64(4) + size


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the distinct n-grams of every row, sorted by row."""
    data, offsets = textkit.flat(column)
    words = textkit.Words(data, offsets)
    shape = shapes(data, words)
    found = [textkit.ngrams(words.hashes, words.offsets, n, 20 + n) for n in (1, 2)] + [textkit.ngrams(shape, words.offsets, n, 30 + n) for n in (1, 2, 3)]
    keys = np.unique(np.concatenate([r * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64) for h, r in found]))
    return keys // BUCKETS, keys % BUCKETS


def descend(rows: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, cost: float = 1.0, passes: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised hinge loss, by dual coordinate descent."""
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    order = np.random.default_rng(seed)
    norms = np.array([float(v @ v) + 1 for v in x])
    share = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * cost
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            r, v = rows[i], x[i]
            slope = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log-count ratio of each bucket between the classes."""
    p, q = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, z in zip(rows, y, strict=True) if z == s)]), minlength=BUCKETS) + smoothing for s in (1, -1))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def scaled(rows: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    return [v / max(np.sqrt(v @ v), 1e-12) for v in (ratio[r] for r in rows)]


def calibrate(margin: np.ndarray, y: np.ndarray, even: bool = False) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to label 1, by Newton's method with a weak prior. even: both labels
    weigh the same, however many there are of each."""
    t, beta = (y > 0).astype(float), np.array([2.0, 0.0])
    weight = np.where(t > 0, 0.5 * len(t) / max(1, t.sum()), 0.5 * len(t) / max(1, (1 - t).sum())) if even else np.ones(len(t))
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - t)) + 1e-2 * (beta - np.array([2.0, 0.0]))
        beta = beta - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad).clip(-2, 2)
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """The model of (doc_id, text, label): weights x ratios, bias, and the calibration's slope and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            row, bucket = features(batch.column(1))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bucket[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), batch.column(2)], ["doc_id", "buckets", "label"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sorted(sample.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(run, f"doc_id {kind}, buckets binary, label int").collect(), key=lambda r: (r["doc_id"], r["buckets"]))
    rows = [np.frombuffer(r["buckets"], "<i4").astype(np.int64) for r in found]
    y = np.array([1 if r["label"] else -1 for r in found], np.int64)
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        return np.zeros(BUCKETS), np.zeros(BUCKETS + 1), 1.0, 4.0 if (y > 0).any() else -4.0 if len(y) else 0.0
    part = np.arange(len(y)) % 3 == 0
    pick = lambda z: [r for r, k in zip(rows, z, strict=True) if k]
    if len(set(y[part].tolist())) == len(set(y[~part].tolist())) == 2:
        ratio = ratios(pick(~part), y[~part])
        w = descend(pick(~part), scaled(pick(~part), ratio), y[~part])
        slope, offset = calibrate(np.array([w[r] @ v + w[-1] for r, v in zip(pick(part), scaled(pick(part), ratio), strict=True)]), y[part])
    else:
        slope, offset = 2.0, 0.0
    ratio = ratios(rows, y)
    return ratio, descend(rows, scaled(rows, ratio), y), slope, offset


def score(df: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score) for each row of (doc_id, text); null and blank texts get the score of a text without n-grams.

    Repeated rows are scored each, alike; a row without a doc_id keeps its null. Texts are taken whole, however long. Other
    columns, whatever their names, are left out; an empty table gives an empty result. Equal margins give equal scores."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w, slope, offset = shared.value
        for batch in slices(batches, "text", 1 << 18):
            row, bucket = features(batch.column(1))
            v, n = ratio[bucket], batch.num_rows
            length = np.sqrt(np.bincount(row, v * v, n))
            margin = np.bincount(row, v * w[bucket], n) / np.maximum(length, 1e-12) + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30))))], ["doc_id", "score"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(labelled(docs, labels.where(crc_mod("doc_id", 5) != 0), "quality", SAMPLE_PER_LABEL))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
