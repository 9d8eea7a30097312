"""Bags of words and character n-grams for the linear models: hashing in numpy, and a bounded table of what each word contributes.

The models are linear in a text's average feature, so a word's contribution is the same wherever it stands; it is
computed once, and a text costs one look-up a word.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = ".,;:!?\"'()[]{}<>|*%&$#-_/\\«»“”„…"


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(words: list[str], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams (low to high characters) of <word>, and which word each is from."""
    text = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    buckets, owners = [], []
    for n in range(low, high + 1):
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : len(code) - n + 1 + j]
        inside = of[: len(h)] == of[n - 1 :]
        buckets.append((mix(h[inside]) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(of[: len(h)][inside])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


class WordTable:
    """Rows of floats for words, made by values(words) when a word is new; starts again when it holds `kept` words or `chars` characters of them."""

    def __init__(self, values: Callable[[list[str]], np.ndarray], kept: int = 300_000, chars: int = 8 << 20):
        self.make, self.kept, self.chars, self.index, self.held = values, kept, chars, {}, 0
        self.values = np.empty((0, 0))

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words the rows of self.values. They hold until the next call."""
        if len(self.index) > self.kept or self.held > self.chars:
            self.index, self.values, self.held = {}, np.empty((0, 0)), 0
        missing: set[str] = set()
        for words in texts:
            missing.update(set(words).difference(self.index))
        if missing or not len(self.values):
            new = list(missing)
            made = np.concatenate([self.make(new[i : i + 20_000]) for i in range(0, max(len(new), 1), 20_000)])
            n = len(self.index)
            if n + len(made) > len(self.values):
                grown = np.zeros((max(2 * len(self.values), n + len(made)), made.shape[1]), made.dtype)
                if n:
                    grown[:n] = self.values[:n]
                self.values = grown
            self.values[n : n + len(made)] = made
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            self.held += sum(map(len, new))
        get = self.index.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]


def bare(words: list[str]) -> list[str]:
    """Words without punctuation at their ends (those of punctuation alone stay)."""
    return [w.strip(EDGES) or w for w in words]


def sample(df: DataFrame, rows: int) -> DataFrame:
    """At most `rows` of df's distinct rows (all, if it has no more), chosen by a hash of the whole row.

    What comes back may be broadcast or collected. Rows that repeat count once, also where they are a large part of df.
    """
    n, h = df.count(), F.xxhash64(*df.columns)
    if n > rows:
        share = (rows + 6 * math.sqrt(rows)) / n
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    return df.distinct().orderBy(h, *df.columns).limit(rows)
