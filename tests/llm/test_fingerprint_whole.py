"""Likeness of long texts against the exact generalised Jaccard similarity."""

import random

import numpy as np
import pytest

from edgeloom.llm import fingerprint


def exact(a, b):
    a, b = (dict(zip(*(x.tolist() for x in fingerprint.terms(t)), strict=True)) for t in (a, b))
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)


def english(rng, n, names):
    """Words by Zipf's law, and many names that come once."""
    common = [f"w{int(1.0 / (rng.random() ** 1.1 + 1e-4))}" for _ in range(n)]
    return " ".join(w if rng.random() < 0.6 else f"{names}{rng.randrange(10 * n)}" for w in common).encode()


@pytest.mark.parametrize("n", [300, 20_000, 200_000])
def test_likeness_of_long_texts(n):
    off = []
    for k in range(4 if n > 100_000 else 12):
        rng = random.Random(k)
        a, b = english(rng, n, "x"), english(rng, n, "y")
        off.append(fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) - exact(a, b))
    assert abs(np.mean(off)) < 4 * 0.5 / np.sqrt(fingerprint.SAMPLES * len(off)), off


def test_draws_are_as_named_and_least_wins():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**63, 3000, np.uint64))
    w = np.where(rng.random(3000) < 0.5, 1, rng.integers(1, 40, 3000))
    rows, cols = (x.ravel() for x in np.mgrid[:3000, : fingerprint.SAMPLES])
    a, t = (x.reshape(3000, -1) for x in fingerprint.weighted(h[rows], w[rows], cols))
    assert abs(np.mean(a * w[:, None]) - 1) < 0.02  # a is Exp(w)
    at = a.argmin(axis=0)
    want = fingerprint.mix(h[at] + t[at, np.arange(fingerprint.SAMPLES)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)
    assert (fingerprint.sample(h, w) == want).all()
    share = np.bincount(at[w[at] > 20], minlength=1).sum() / len(at)
    assert abs(share - w[w > 20].sum() / w.sum()) < 0.2
