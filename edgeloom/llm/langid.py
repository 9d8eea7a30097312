"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of 1 to 3 characters of <word> are hashed. TF is an n-gram's share of all in the text; IDF comes from document
frequencies over all rows that may be learned from, counted in a distributed pass. The regression is trained by
follow-the-regularised-leader with L1 and L2 penalties (most weights stay exactly 0) on a bounded sample (ROWS, counted
where their texts are: only counts come to the driver, 65536 a text at most), and its temperature is calibrated on a
fifth of that sample, which training doesn't see.

Only rows with text and lang whose crc32(doc_id as text) mod 4 is not 2 are learned from; a row without an id is not held
out. Rows that repeat count once in the sample. Null texts and texts without letters are `und` with score 0, as is
everything if there is nothing to learn from. Ties go to the first language by name. An empty table gives no rows; all
other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordbags

ROWS, LOW, HIGH, BITS = 3000, 1, 3, 16
ALPHA, BETA, L1, L2, EPOCHS, SCALE, SEED = 0.3, 1.0, 0.02, 0.1, 3, 10.0, 11
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def split(text: str) -> list[str]:
    return text.lower().split()


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.coalesce(common.crc_mod("doc_id", 4), F.lit(0)) != 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each bucket's n-grams occur, and the number of rows. Each task sends at most one row a bucket; what comes back has a fixed size."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(1 << BITS, np.int64), 0
        index: dict[str, int] = {}
        start, flat = np.zeros(1, np.int64), np.empty(0, np.int64)
        for b in batches:
            texts = [set(split(t)) for t in b.column(0).to_pylist()]
            if len(index) > 200_000 or len(flat) > 8 << 20:
                index, start, flat = {}, np.zeros(1, np.int64), np.empty(0, np.int64)
            new = list(set().union(*texts).difference(index))
            bucket, owner = wordbags.grams(new, LOW, HIGH, BITS)
            order = np.argsort(owner, kind="stable")
            size = np.bincount(owner, minlength=len(new))
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            flat, start = np.concatenate([flat, bucket[order]]), np.concatenate([start, start[-1] + np.cumsum(size)])
            for words in texts:
                rows += 1
                if words:
                    w = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    n = start[w + 1] - start[w]
                    seen = np.zeros(1 << BITS, bool)
                    seen[flat[np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
                    count += seen
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(count[used], rows), pa.int64())], names=["bucket", "n"])

    counted = common.stream_arrow(docs.select("text"), f, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, rows = np.zeros(1 << BITS, np.int64), 0
    for r in counted:
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, rows


@dataclass
class Model:
    weight: np.ndarray  # (buckets, languages), IDF included
    bias: np.ndarray
    languages: list[str]
    temperature: float = 1.0

    def values(self, words: list[str]) -> np.ndarray:
        """For each word the sums of its n-grams' weights, and their number."""
        b, w = wordbags.grams(words, LOW, HIGH, BITS)
        return np.stack([*(np.bincount(w, self.weight[b, k], len(words)) for k in range(len(self.languages))), np.bincount(w, minlength=len(words))], axis=1)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        total = rows.sum(axis=0)
        return SCALE * total[:-1] / max(total[-1], 1) + self.bias

    def predict(self, rows: np.ndarray) -> tuple[str, float]:
        z = self.logits(rows) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def ftrl(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets, classes) and biases, one text at a time; bags: buckets and values of each text."""
    z, n, bias, rng = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes)), np.zeros(classes), np.random.default_rng(SEED)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            k, x = bags[i]
            w = weights(z[k], n[k])
            logit = x @ w + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA * w
            n[k] += g * g
            bias -= 0.01 * p
    return weights(z, n), bias


def counted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (ascending) of a text's n-grams, and their numbers."""
    index: dict[str, int] = {}
    for w in words:
        index[w] = index.get(w, 0) + 1
    bucket, owner = wordbags.grams(list(index), LOW, HIGH, BITS)
    n = np.bincount(bucket, np.array(list(index.values()), np.int64)[owner] if len(owner) else None, 1 << BITS).astype(np.int64)
    found = np.flatnonzero(n)
    return found, n[found]


def fit(texts: list[str], langs: list[str], frequency: np.ndarray, rows: int) -> Model | None:
    return fit_counts([counted(split(t)) for t in texts], langs, frequency, rows)


def fit_counts(texts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], frequency: np.ndarray, rows: int) -> Model | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    bags, y = [], []
    for (b, n), lang in zip(texts, langs, strict=True):
        if len(b):
            bags.append((b, SCALE * n / n.sum() * idf[b]))
            y.append(languages.index(lang))
    if not bags:
        return None
    y = np.array(y)
    held = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    weight, bias = ftrl([b for b, h in zip(bags, held, strict=True) if not h], y[~held], len(languages))
    model = Model(weight * idf[:, None], bias, languages)
    test = np.flatnonzero(held) if held.any() else np.arange(len(bags))
    logits = np.array([bags[i][1] @ weight[bags[i][0]] + bias for i in test])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(test)), y[test]]).mean())

    model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    return model


def learn(docs: DataFrame, rows: int = ROWS) -> Model | None:
    """docs: doc_id, text, lang."""
    rows_of = learnable(docs.select("doc_id", "text", "lang"))
    frequency, n = document_frequencies(rows_of)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        bags = [counted(split(t)) for t in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k.astype("<i4").tobytes() for k, _ in bags], pa.binary()), pa.array([c.astype("<i8").tobytes() for _, c in bags], pa.binary())], names=["id", "lang", "bucket", "n"])

    sampled = wordbags.sample(rows_of, rows).select(F.col("doc_id").cast("string").alias("id"), "lang", "text")
    found = sorted(common.map_arrow(sampled, f, "id string, lang string, bucket binary, n binary").collect(), key=lambda r: (r["id"] or "", r["lang"], r["bucket"], r["n"]))
    return fit_counts([(np.frombuffer(r["bucket"], "<i4").astype(np.int64), np.frombuffer(r["n"], "<i8")) for r in found], [r["lang"] for r in found], frequency, n)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with two more columns: lang_pred and lang_score. No shuffle; all other columns stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), docs.columns.index(text_col)
    schema = ", ".join([*(f"{n} {t}" for n, t in plain.dtypes), "lang string, score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m and wordbags.WordTable(m.values)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if m:
                for i, r in enumerate(table.rows([split(t) for t in texts])):
                    if LETTER.search(texts[i]):
                        lang[i], score[i] = m.predict(table.values[r])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang", "score"])

    return common.stream_arrow(plain, f, schema).toDF(*docs.columns, "lang_pred", "lang_score")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), learn(docs))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id", 4, 2), "lang_pred", F.col("lang_score").alias("score"))
