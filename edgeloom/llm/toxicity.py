"""Toxicity: embeddings of words' character n-grams, averaged and fed to a linear softmax; both are trained together in numpy.

The average is taken over windows of WINDOW words (overlapping by half), and a text's log-odds are the mean of its TOP
most toxic windows, so a few words count as much in a long text as in a short one, and one doubtful word less than
several. Unseen misspellings share n-grams, and so vectors, with the words they come from; training adds windows with one
changed character in their telling word.

Fitted on a bounded sample of labelled rows (ROWS toxic ones and four times as many clean ones at most, their texts
whole) whose crc32(doc_id as text) mod 5 is not 0. The score is calibrated on a fifth of that sample, which training
doesn't see. Null and empty texts have score 0. Labels that are null, or of documents that don't exist, are not used; a
document with several labels is used with each; rows that repeat count once in the sample. If either class is missing,
every score is 0. A row without an id is not held out. An empty table gives no rows; all other columns stay.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordbags

ROWS = 800
WINDOW, TOP, LOW, HIGH, BITS, DIM = 4, 3, 3, 5, 16, 8
EPOCHS, BATCH, RATE, SEED = 5, 512, 0.05, 7
#: From where on a word or its beginning (of so many characters) tells toxic texts (log of the ratio of its document frequencies, times the root of the toxic ones).
TELLING, STEMS = 10.0, (4, 5, 6, 7)


def split(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Model:
    """weight: the log-odds that each n-gram's embedding gives through the softmax; scale, shift: from a window's log-odds to the score."""

    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def values(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its n-grams' log-odds, and their number."""
        b, w = wordbags.grams(wordbags.bare(words), LOW, HIGH, BITS)
        return np.stack([np.bincount(w, self.weight[b], len(words)), np.bincount(w, minlength=len(words))], axis=1)

    def log_odds(self, rows: np.ndarray) -> float:
        """Mean of the most toxic windows; rows: sums and numbers of the text's words."""
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(rows, axis=0)])
        first = np.arange(0, max(1, len(rows) - WINDOW // 2), WINDOW // 2)
        part = total[np.minimum(first + WINDOW, len(rows))] - total[first]
        odds = part[:, 0] / np.maximum(part[:, 1], 1)
        return float(np.partition(odds, len(odds) - TOP)[-TOP:].mean() if len(odds) > TOP else odds.mean()) + self.bias

    def score(self, log_odds: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * (log_odds - self.shift), -30, 30))))


def windows(words: list[str]) -> list[list[str]]:
    return [words[i : i + WINDOW] for i in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2)]


def changed(word: str, rng: random.Random) -> str:
    """The word with a character dropped, doubled, swapped or replaced."""
    if len(word) < 4:
        return word
    i, how = rng.randrange(1, len(word) - 1), rng.randrange(4)
    if how == 0:
        return word[:i] + word[i + 1 :]
    if how == 1:
        return word[:i] + word[i] + word[i:]
    if how == 2:
        return word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]
    return word[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz0134@$*") + word[i + 1 :]


def stems(word: str) -> list[str]:
    """The word, and its beginnings, by which compounds are told."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def examples(toxic: list[list[str]], clean: list[list[str]], rng: random.Random) -> tuple[list[list[str]], list[int]]:
    """Training windows: of toxic texts those with the most telling words (by document frequencies of words and their beginnings), of clean ones random ones.

    A toxic text without a telling word (its label may be wrong) gives none.
    """
    seen = [Counter(k for d in part for k in {k for w in set(wordbags.bare(d)) for k in stems(w)}) for part in (clean, toxic)]
    telling = {k: (np.log((n + 0.5) / (len(toxic) + 1)) - np.log((seen[0][k] + 0.5) / (len(clean) + 1))) * np.sqrt(n) for k, n in seen[1].items()}
    best = [sorted(((max((max(telling[s] for s in stems(b)), k) for k, b in enumerate(wordbags.bare(w))), w) for w in windows(words)), key=lambda x: -x[0][0])[:4] for words in toxic]
    out, label = [], []
    for scored in best:
        for (value, k), w in scored:
            if value > TELLING:
                out += [w, [*w[:k], changed(w[k], rng), *w[k + 1 :]], [*w[:k], changed(w[k], rng), *w[k + 1 :]]]
                label += [1, 1, 1]
    for words in clean:
        own = windows(words)
        for w in rng.sample(own, min(4, len(own))):
            k = rng.randrange(len(w))
            out += [w, [*w[:k], changed(w[k], rng), *w[k + 1 :]], [w[k]] * len(w)]
            label += [0, 0, 0]
    return out, label


def hardest(model: Model, clean: list[list[str]]) -> list[list[str]]:
    """Of each clean text the two windows that look most toxic."""
    table, out = wordbags.WordTable(model.values), []
    for words in clean:
        (r,) = table.rows([words])
        odds = [(model.log_odds(table.values[r[i : i + WINDOW]]), i) for i in range(0, max(1, len(r) - WINDOW // 2), WINDOW // 2)]
        out += [words[i : i + WINDOW] for _, i in sorted(odds, reverse=True)[:2]]
    return out


def train(texts: list[list[str]], labels: list[int], seed: int = SEED) -> tuple[np.ndarray, float]:
    """Embeddings and softmax by Adam on mini-batches; gives each n-gram's log-odds, and the bias."""
    rng, labels = np.random.default_rng(seed), np.array(labels)
    distinct = list({w for t in texts for w in t})
    index = {w: i for i, w in enumerate(distinct)}
    bucket, owner = wordbags.grams(wordbags.bare(distinct), LOW, HIGH, BITS)
    order = np.argsort(owner, kind="stable")
    bucket, size = bucket[order], np.bincount(owner, minlength=len(distinct))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    bags = []
    for t in texts:
        w = np.array([index[x] for x in t], np.int64)
        n = size[w]
        bags.append(bucket[np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    table = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    params = [table, soft, bias]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    balance = len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(bags))
        for i in range(0, len(shuffled), BATCH):
            part = shuffled[i : i + BATCH]
            n = np.array([len(bags[k]) for k in part])
            part, n = part[n > 0], n[n > 0]
            if not len(part):
                continue
            flat, owner = np.concatenate([bags[k] for k in part]), np.repeat(np.arange(len(part)), n)
            mean = np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= (balance[labels[part]] / len(part))[:, None]
            back = (p @ soft.T / n[:, None]).astype(np.float32)
            grad = np.stack([np.bincount(flat, back[owner, d], 1 << BITS) for d in range(DIM)], axis=1)
            step += 1
            for (m, v), x, g in zip(moment, params, (grad, mean.T @ p, p.sum(axis=0)), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """Trains on four fifths, calibrates on the rest: the threshold between the classes with the fewest errors (a clean text lost counts four times), wide margins first."""
    rng, words = random.Random(SEED), [split(t) for t in texts]
    held = [i % 5 == 4 for i in range(len(words))] if len(words) >= 50 else [False] * len(words)
    parts = [[w for w, y, h in zip(words, labels, held, strict=True) if y == k and not h and w] for k in (0, 1)]
    if not all(parts):
        return None
    given, marks = examples(parts[1], parts[0], rng)
    more = hardest(Model(*train(given, marks)), parts[0])
    model = Model(*train(given + more, marks + [0] * len(more)))
    table = wordbags.WordTable(model.values)
    test = [i for i in range(len(words)) if words[i] and (held[i] or not any(held))]
    odds = np.array([model.log_odds(table.values[r]) for i in test for r in table.rows([words[i]])])
    y = np.array([labels[i] for i in test])
    if y.min() == y.max():
        return model
    cuts = np.sort(odds)
    middle, gap = (cuts[1:] + cuts[:-1]) / 2, cuts[1:] - cuts[:-1]
    wrong = np.array([((odds[y == 1] < c).mean() + 4 * (odds[y == 0] >= c).mean()) for c in middle])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    model.shift = float(middle[best[np.argmax(gap[best])]])
    model.scale = 4 / max(float(np.abs(odds - model.shift).mean()), 1e-6)
    return model


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model | None:
    """The sample's labels are bounded, so they are broadcast to the documents; these aren't shuffled."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (common.crc_mod("doc_id", 5) != 0))
    parts = [wordbags.sample(known.filter(F.col("toxic") == k), n) for k, n in ((0, 4 * rows), (1, rows))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    found = wordbags.sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id"), 5 * rows).filter("text is not null").collect()
    found.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    return fit([r["text"] for r in found], [r["toxic"] for r in found]) if found else None


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with one more column, toxicity (0 to 1). No shuffle; all other columns stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"{n} {t}" for n, t in plain.dtypes), "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m and wordbags.WordTable(m.values)
        for b in batches:
            texts = [split(t or "") for t in b.column(at).to_pylist()]
            out = [0.0] * len(texts)
            if m:
                for i, r in enumerate(table.rows(texts)):
                    if len(r):
                        out[i] = m.score(m.log_odds(table.values[r]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*names, "score"])

    return common.stream_arrow(plain, f, schema).toDF(*docs.columns, "toxicity")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = learn(spark, docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id", 5, 0), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
