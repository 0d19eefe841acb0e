"""Quality by ordinal regression: a cumulative-link model with shared hashed-text weights and ordered thresholds.

P(grade <= k) = 1 / (1 + exp(w.x - t_k)) with one weight vector w for all grades and thresholds t_0 < t_1 < ...
Features are hashed byte n-grams of the text as it is (case and punctuation kept) and a few hashed shape tokens
(length, share of distinct words, of letters, of capitals). The model is fitted in numpy on a bounded sample of
graded documents (``PER_GRADE`` of each grade, ``SAMPLE`` together); every value that a rating has is a grade, whole
number or not. The thresholds stay ordered because their gaps are exponentials.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.common import arrow_map, table
from millrace.llm.features import byte_counts, dense_chunks, held_out, sample_per_class

ORDERS = (2, 3)
BUCKETS = 1 << 12
#: Shape tokens: this many kinds, each in this many steps.
SHAPES, STEPS = 5, 16
#: Bounds of the training sample: documents of a grade, documents of all grades together, and documents that every
#: grade has at least, however many grades there are.
PER_GRADE, SAMPLE, LEAST = 600, 6000, 10

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class QualityModel:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than grades, increasing

    def tails(self, x: np.ndarray) -> np.ndarray:
        """(rows x thresholds) probabilities of a grade above each threshold."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds, -40, 40)))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x features): square roots of n-gram shares, and one-hot shape steps."""
    counts = byte_counts(data, offsets, ORDERS, BUCKETS)
    grams = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    texts, size = len(offsets) - 1, np.diff(offsets)
    hashed, _, _, bounds = tokens.words(data, offsets)
    words = np.diff(bounds)
    owner = np.repeat(np.arange(texts), words)
    order = np.lexsort((hashed, owner))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=texts)
    inside = np.concatenate(([0], np.cumsum(_LETTER[data])))
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    letters, capitals = np.diff(inside[offsets]), np.diff(upper[offsets])
    share = lambda a, b: np.clip(a / np.maximum(b, 1) * STEPS, 0, STEPS - 1).astype(int)
    steps = [
        np.clip(np.log2(1 + words), 0, STEPS - 1).astype(int),
        share(distinct, words),
        share(letters, size),
        share(capitals, letters),
        np.clip(letters / np.maximum(words, 1), 0, STEPS - 1).astype(int),
    ]
    shape = np.zeros((texts, SHAPES * STEPS), np.float32)
    for k, s in enumerate(steps):
        shape[np.arange(texts), k * STEPS + s] = 0.5
    return np.hstack((grams, shape)).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, grades: list[float], epochs: int = 40, seed: int = 3, ridge: float = 1e-5) -> QualityModel:
    """Fit by scaled stochastic gradient steps on the likelihood of grade numbers ``y`` (0 .. grades - 1), grades weighted equally."""
    k = len(grades)
    if k < 2:
        return QualityModel(grades, np.zeros(x.shape[1]), np.zeros(0))
    rng = np.random.default_rng(seed)
    w, first, gaps = np.zeros(x.shape[1]), 0.0, np.zeros(k - 2)
    seen, seen_t = np.full(x.shape[1], 1e-4), np.full(k - 1, 1e-2)
    balance = len(y) / k / np.maximum(np.bincount(y, minlength=k), 1)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            z = np.clip(t[None, :] - (x[at] @ w)[:, None], -30, 30)
            below = np.column_stack((np.zeros(len(at)), 1 / (1 + np.exp(-z)), np.ones(len(at))))
            slope = below * (1 - below)
            own, rows = y[at], np.arange(len(at))
            p = np.maximum(below[rows, own + 1] - below[rows, own], 1e-9)
            scale = balance[own] / len(at) / p
            # d(-log p)/dz of the upper and the lower threshold of each row's grade
            by_t = np.zeros((len(at), k + 1))
            by_t[rows, own + 1] -= scale * slope[rows, own + 1]
            by_t[rows, own] += scale * slope[rows, own]
            grad_w = -by_t.sum(1) @ x[at] + ridge * w
            cut = by_t[:, 1:k].sum(0)
            grad_t = np.concatenate(([cut.sum()], np.cumsum(cut[::-1])[::-1][1:] * np.exp(gaps)))
            seen += grad_w**2
            seen_t += grad_t**2
            w -= 0.3 * grad_w / np.sqrt(seen)
            move = 0.3 * grad_t / np.sqrt(seen_t)
            first, gaps = first - move[0], gaps - move[1:]
    return QualityModel(grades, w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in dense_chunks(batch.column(2)):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), batch.column(1).slice(at, len(x)), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["doc_id", "grade", "x"])


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "quality", per_grade: int = PER_GRADE, sample: int = SAMPLE) -> QualityModel | None:
    """Model from graded documents outside the held-out fold; None if there are none.

    Of every grade at most ``per_grade`` documents are used, and no more than its share of ``sample`` (but
    ``LEAST``), picked by a hash of their ids. Null ids and ratings that are null or no number are left out. Of
    several ratings of a document the highest counts; rows of ``docs`` that repeat an id are learned from each.
    """
    known = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade_col).cast("double").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & ~F.isnan("grade") & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    per_grade = max(LEAST, min(per_grade, sample // max(1, known.select("grade").distinct().count())))
    picked = sample_per_class(known, "grade", per_grade).select("doc_id", "grade")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = arrow_map(texts.join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text"), _sample, "doc_id long, grade double, x binary").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    grades = sorted(set(rows["grade"].to_pylist()))
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"].to_pylist()]).astype(np.float32)
    return train(x, np.searchsorted(grades, rows["grade"].to_numpy()), grades)


def _predict(batches: Iterator[pa.RecordBatch], model: QualityModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        expected, tail = np.full(n, np.nan), np.full(n, np.nan)
        if model is not None:
            grades = np.array(model.grades, float)
            for at, data, offsets in dense_chunks(batch.column(1)):
                tails = model.tails(features(data, offsets))
                to = at + len(tails)
                expected[at:to] = grades[0] + tails @ np.diff(grades)
                # the upper half of the grades
                tail[at:to] = tails[:, (len(grades) - 1) // 2] if len(grades) > 1 else 1.0
        none = np.isnan(expected)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, mask=none), pa.array(tail, mask=none)], ["doc_id", "expected_grade", "tail"])


def grade(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tail (probability of the upper half of the grades), selected (tail >= 0.5).

    Only the text decides, all of it, however long; null counts as empty, and empty texts are graded by their shape.
    Without a model (no ratings) grade and tail are null and nothing is selected. With one grade only, every text has it.
    Repeated rows are graded each; null ids stay null; other columns are not read. An empty table gives an empty
    result. One map over the rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    graded = arrow_map(texts, lambda it: _predict(it, shared.value), "doc_id long, expected_grade double, tail double")
    return graded.withColumn("selected", F.coalesce(F.col("tail") >= 0.5, F.lit(False)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    graded = grade(docs, fit(docs, table(spark, sf_dir, "labels")))
    return graded.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail", "selected")
