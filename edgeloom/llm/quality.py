"""Quality: ordinal regression with cumulative links on graded ratings.

A text's features are hashed: each word, the shape of each word (letters, digits and punctuation in runs), and whether a
word repeats the one before it. Their weights are shared by all grades; ordered thresholds cut the text's mean weight f
into grades: P(grade > k) = sigmoid(f - threshold k). That gives the expected grade and the tail probability of the upper
grades, by which documents are selected.

Fitted on a bounded sample of rated rows (ROWS at most, counted where their texts are: only counts come to the driver,
65536 a text at most) whose crc32(doc_id as text) mod 5 is not 0. Null ratings and ratings of missing documents are not
used; rows that repeat count once in the sample. A text without words has f = 0 and, like any text, gets its
probabilities from the thresholds. With fewer than two grades in the sample nothing is rejected: the tail probability is
1. A row without an id is not held out. An empty table gives no rows; all other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordbags

ROWS, BITS, STEPS, RATE, DECAY, SCALE = 4000, 16, 150, 0.05, 1e-4, 8.0
REPEAT = 0  # bucket of "repeats the word before"
RUNS = [(re.compile(p), c) for p, c in ((r"[A-ZÀ-ÖØ-Þ]{2,}", "A"), (r"[^\W\d_]+", "a"), (r"\d+", "0"))]


def shape(word: str) -> str:
    """For example: a for lower-case words, A!! for shouted ones with marks."""
    marks = {"A": "\x01", "a": "\x02", "0": "\x03"}
    for p, c in RUNS:
        word = p.sub(marks[c], word)
    return word[:12]


def buckets(words: list[str]) -> np.ndarray:
    """(n, 2): the buckets of each word and of its shape; bucket 0 is kept for repeats."""
    out = []
    for kind, items in (("w", [w.lower() for w in words]), ("s", [shape(w) for w in words])):
        code = [kind + x for x in items]
        size = np.array([len(x) for x in code])
        points = np.frombuffer("".join(code).encode("utf-32-le"), "<u4").astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(len(points)) - np.repeat(start, size)
        spread = wordbags.mix(points + (place.astype(np.uint64) << np.uint64(32)) + np.uint64(1))
        h = wordbags.mix(np.add.reduceat(spread, start)) if len(size) else np.empty(0, np.uint64)
        out.append((h % np.uint64((1 << BITS) - 1)).astype(np.int64) + 1)
    return np.stack(out, axis=1)


@dataclass
class Model:
    """weight: shared; thresholds: ascending, one less than the grades."""

    weight: np.ndarray
    thresholds: np.ndarray
    grades: list[int] = field(default_factory=lambda: [0, 1])

    def values(self, words: list[str]) -> np.ndarray:
        return self.weight[buckets(words)].sum(axis=1)[:, None] if words else np.empty((0, 1))

    def f(self, rows: np.ndarray, values: np.ndarray) -> float:
        """rows: the words' rows in the table (equal words, equal rows)."""
        if not len(rows):
            return 0.0
        return SCALE * float(values[rows, 0].sum() + self.weight[REPEAT] * (rows[1:] == rows[:-1]).sum()) / len(rows)

    def probabilities(self, f: float) -> np.ndarray:
        """P(grade above each threshold)."""
        return 1 / (1 + np.exp(-np.clip(f - self.thresholds, -30, 30)))


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A text's features: buckets (ascending) and mean counts."""
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    of, ids = buckets(list(index)), np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    k, n = np.unique(np.concatenate([of[ids].ravel(), np.zeros((ids[1:] == ids[:-1]).sum(), np.int64)]), return_counts=True)
    return k, SCALE * n / len(words)


def gradient(f: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood, by each text's f and by theta (the first threshold, and logs of the gaps)."""
    n, t = len(f), cuts(theta)
    # P(grade k) = P(above k - 1) - P(above k)
    above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(f[:, None] - t, -30, 30))), np.zeros((n, 1))], axis=1)
    upper, lower = above[np.arange(n), y], above[np.arange(n), y + 1]
    p = np.maximum(upper - lower, 1e-9)
    d_up, d_low = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_cut = np.bincount(np.clip(y - 1, 0, None), np.where(y > 0, d_up, 0), len(t)) / n - np.bincount(np.clip(y, None, len(t) - 1), np.where(y < len(t), d_low, 0), len(t)) / n
    tail = np.cumsum(by_cut[::-1])[::-1]
    return -(d_up - d_low) / n, np.concatenate([tail[:1], tail[1:] * np.exp(theta[1:])])


def cuts(theta: np.ndarray) -> np.ndarray:
    return np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])


def fit(texts: list[str], grades: list[int]) -> Model | None:
    return fit_bags([bag(t.split()) for t in texts], grades)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], grades: list[int]) -> Model | None:
    """Maximum likelihood with L2 decay by Adam; the thresholds stay ordered as a first one and logs of the gaps."""
    levels = sorted(set(grades))
    if len(levels) < 2:
        return None
    row = np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags])
    col, val = np.concatenate([k for k, _ in bags]), np.concatenate([v for _, v in bags])
    n, y = len(bags), np.searchsorted(levels, grades)
    above = np.array([(y > k).mean() for k in range(len(levels) - 1)])
    start = -np.log(above / (1 - above))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    weight = np.zeros(1 << BITS)
    moments = [[np.zeros_like(weight), np.zeros_like(weight)], [np.zeros_like(theta), np.zeros_like(theta)]]
    for step in range(1, STEPS + 1):
        grad_f, grad_t = gradient(np.bincount(row, val * weight[col], n), y, theta)
        grads = [np.bincount(col, val * grad_f[row], 1 << BITS) + DECAY * weight, grad_t]
        for (m, v), x, g in zip(moments, (weight, theta), grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weight, cuts(theta), [int(x) for x in levels])


def learn(spark: SparkSession, docs: DataFrame, ratings: DataFrame, grade: str = "quality", rows: int = ROWS) -> Model | None:
    """The sample's ratings are bounded, so they are broadcast to the documents; these aren't shuffled."""
    known = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & (common.crc_mod("doc_id", 5) != 0))
    chosen = F.broadcast(wordbags.sample(known, rows))
    found = wordbags.sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", "grade", "text"), rows).filter("text is not null")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        bags = [bag(t.split()) for t in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k.astype("<i4").tobytes() for k, _ in bags], pa.binary()), pa.array([v.astype("<f8").tobytes() for _, v in bags], pa.binary())], names=["doc_id", "grade", "bucket", "value"])

    counted = sorted(common.map_arrow(found, f, "doc_id long, grade int, bucket binary, value binary").collect())
    return fit_bags([(np.frombuffer(r["bucket"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f8")) for r in counted], [r["grade"] for r in counted])


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with two more columns: expected_grade (null without a model) and tail_probability (of all grades but the lowest). No shuffle."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), docs.columns.index(text_col)
    schema = ", ".join([*(f"{n} {t}" for n, t in plain.dtypes), "expected double, tail double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m and wordbags.WordTable(m.values)
        for b in batches:
            expected, tail = [None] * b.num_rows, [1.0] * b.num_rows
            if m:
                for i, r in enumerate(table.rows([(t or "").split() for t in b.column(at).to_pylist()])):
                    p = m.probabilities(m.f(r, table.values))
                    expected[i] = float(m.grades[0] + (np.diff(m.grades) * p).sum())
                    tail[i] = float(p[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=[*names, "expected", "tail"])

    return common.stream_arrow(plain, f, schema).toDF(*docs.columns, "expected_grade", "tail_probability")


#: Documents with at least this probability of a grade above the lowest are kept.
KEEP_FROM = 0.5


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), learn(spark, docs, common.table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id", 5, 0), "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP_FROM).alias("kept")
    )
