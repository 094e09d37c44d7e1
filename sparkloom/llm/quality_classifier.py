"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are the ordered levels 0, 1, .. of a rating. All levels share the weights of hashed text features (log counts
of words and of word shapes, scaled to unit length, and a few measures of layout); ordered thresholds split the scale,
P(grade > k) = logistic(weights . text - threshold[k]). From these come the expected grade and the tail probability
P(grade >= GOOD) that selection uses.

Fitted on at most SAMPLE_ROWS labelled training rows, chosen by a hash of the key. A null or empty text has only its
bias and layout features. With fewer than two grades in the training rows every text gets that grade (0 if none).
Repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import slices
from .shared import ready
from .toxicity import lower_words

SAMPLE_ROWS, DIMENSIONS, LAYOUT = 4_000, 1 << 12, 8
RIDGE, STEPS, RATE = 1e-3, 300, 0.1
GOOD, SELECT = 1, 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the features of each text that aren't 0."""
    texts = pc.fill_null(texts, "")
    index, hashes, counts = lower_words(texts)
    text = np.repeat(np.arange(len(counts)), counts)
    code = text * DIMENSIONS + (hashes[index] % DIMENSIONS)
    cells, n = np.unique(code, return_counts=True)
    row, col, value = cells // DIMENSIONS, cells % DIMENSIONS, np.log1p(n)
    value = value / np.sqrt(np.maximum(np.bincount(row, value**2, minlength=len(texts)), 1e-9))[row]
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)

    def share(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / chars

    distinct = np.bincount(np.unique(text * np.int64(1 << 32) + index) >> 32, minlength=len(texts)) if len(text) else np.zeros(len(texts))
    layout = [np.log1p(counts) / 5, distinct / np.maximum(counts, 1), 5 * share(r"[^\w\s]"), 5 * share(r"[0-9]"), 10 * share(r"[#*$%&|<>]"), 5 * share(r"\n"), 5 * share(r"[A-Z]"), np.minimum(chars / np.maximum(counts, 1), 20) / 10]
    rows = np.arange(len(texts))
    at = [np.full(len(texts), DIMENSIONS + k) for k in range(LAYOUT)]
    return np.concatenate([row, *[rows] * LAYOUT]), np.concatenate([col, *at]), np.concatenate([value, *layout])


class Cumulative:
    def __init__(self, levels: int):
        self.weights = np.zeros(DIMENSIONS + LAYOUT)
        self.first, self.gaps = 0.0, np.zeros(max(0, levels - 2))

    @property
    def thresholds(self) -> np.ndarray:
        """Ordered, as each is the one before plus a positive gap."""
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def above(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        lean = np.bincount(row, value * self.weights[col], minlength=size)
        return 1 / (1 + np.exp(-np.clip(lean[:, None] - self.thresholds[None, :], -30, 30)))

    def fit(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray) -> None:
        """Adam steps on the mean log-likelihood of the grades' probabilities, differences of neighbouring tails."""
        size, k = len(grade), len(self.gaps) + 1
        state = [np.zeros(len(self.weights) + k) for _ in (0, 1)]
        at = np.arange(size)
        for step in range(1, STEPS + 1):
            tail = np.concatenate([np.ones((size, 1)), self.above(row, col, value, size), np.zeros((size, 1))], axis=1)
            upper, lower = tail[at, grade], tail[at, grade + 1]
            p = np.maximum(upper - lower, 1e-9)
            d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
            slope = (d_upper - d_lower) / size
            g_weights = np.bincount(col, value * slope[row], minlength=len(self.weights)) - RIDGE * self.weights
            g_cut = np.zeros(k + 2)
            np.add.at(g_cut, grade, -d_upper / size)
            np.add.at(g_cut, grade + 1, d_lower / size)
            g_cut = g_cut[1:-1]
            later = np.cumsum(g_cut[::-1])[::-1]
            gradient = np.concatenate([g_weights, [later[0]], later[1:] * np.exp(self.gaps)])
            state[0] = 0.9 * state[0] + 0.1 * gradient
            state[1] = 0.999 * state[1] + 0.001 * gradient**2
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
            self.weights += move[: len(self.weights)]
            self.first += move[len(self.weights)]
            self.gaps += move[len(self.weights) + 1 :]


def learn(docs: DataFrame, ratings: DataFrame, training: Column, key: str = "doc_id", text: str = "text", grade: str = "grade") -> dict:
    ready(docs.sparkSession)
    marks = ratings.filter(training & F.col(grade).isNotNull()).groupBy(key).agg(F.max(grade).cast("int").alias("grade"))
    drawn = marks.orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).select(F.col(key).alias("key"), "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=256, size=4 << 20):
            row, col, value = features(b["text"])
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(1, b.num_rows))
            both = [pa.array([x.tolist() for x in np.split(v[order], cut)]) for v in (col.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([b["grade"], both[0].cast(pa.list_(pa.int32())), both[1].cast(pa.list_(pa.float32()))], names=["grade", "col", "value"])

    # the sample is bounded, so its keys can go to every task
    named = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = named.join(F.broadcast(drawn), "key").select("text", "grade")
    found = rows.mapInArrow(run, "grade int, col array<int>, value array<float>").toArrow()
    grades = found["grade"].to_numpy().astype(np.int64)
    if len(set(grades.tolist())) < 2:
        return {"only": int(grades[0]) if len(grades) else 0}
    model = Cumulative(int(grades.max()) + 1)
    size = pc.list_value_length(found["col"]).to_numpy()
    flat = [pc.list_flatten(found[c]).to_numpy() for c in ("col", "value")]
    model.fit(np.repeat(np.arange(len(size)), size), flat[0], flat[1].astype(float), grades)
    return {"model": model}


def grade(docs: DataFrame, fitted: dict, key: str = "doc_id", text: str = "text", good: int = GOOD, select: float = SELECT) -> DataFrame:
    """(key, expected_grade, tail_prob, selected): a row for each row of docs."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = held.value
        for b in slices(batches, rows=512, size=4 << 20):
            if "only" in given:
                tail = np.full((b.num_rows, 1), float(given["only"] >= good))
                expected = np.full(b.num_rows, float(given["only"]))
                at = 0
            else:
                tail = given["model"].above(*features(b["text"]), b.num_rows)
                expected, at = tail.sum(axis=1), min(good, tail.shape[1]) - 1
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(expected), pa.array(tail[:, at])], names=["key", "expected_grade", "tail_prob"])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    out = out.mapInArrow(run, "key long, expected_grade double, tail_prob double").withColumn("selected", F.col("tail_prob") >= select)
    return out.withColumnRenamed("key", key)
