"""Document fingerprints by consistent weighted sampling.

A document's weighted terms are its words and pairs of adjacent words (ASCII lower case, split at ASCII white space),
weighted by their counts. Words over 64 bytes (texts without blanks) also give all their runs of 8 bytes, so that an
inserted or dropped character changes few terms. For each of SAMPLES samples every term draws r and c from
Gamma(2, 1) and b from U(0, 1), all functions of the term alone: t = floor(ln w / r + b), y = exp(r (t - b)),
a = c / (y exp(r)); the term with the least a is the sample, together with its t. Two documents share a sample with a
probability equal to their generalised Jaccard similarity. A fingerprint holds 16 bits of each sample.

Terms draw from a hash of the term and the sample: three draws of Exp(1), e1, e2, e3, give c = e1 + e2, r = ln(c / e1) + e3
and b = 1 - ln(c / e1) / r, which are distributed as above and independent. At weight 1, t is 0 and a is e1, so that terms
of weight 1 are compared by their hash alone; others draw all three only where a bound on a is below the least so far. Of
equal a the smaller hash wins. A document without words has the fingerprint of the empty text. Null text counts as empty;
null ids come first, and rows that repeat an id follow each other by their deflated text. An empty table has no rows, and
of one row the next document is itself. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLES, SEED = 96, 20240501
LONG, BLOCK = 64, 1 << 10

_rng = np.random.Generator(np.random.PCG64(SEED))
#: Odd factors of a hash's halves for each of three draws and each sample.
LOW, HIGH = _rng.integers(0, 2**31, (2, 3, SAMPLES), np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
SALT = _rng.integers(0, 2**32, (3, SAMPLES), np.uint64).astype(np.uint32)


def scrambled(x: np.ndarray) -> np.ndarray:
    """In place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def hashed(h: np.ndarray, draw: int) -> np.ndarray:
    """(SAMPLES, terms) 32-bit values."""
    x = LOW[draw][:, None] * h.astype(np.uint32)
    x += HIGH[draw][:, None] * (h >> np.uint64(32)).astype(np.uint32)
    x += SALT[draw][:, None]
    return scrambled(x)


def hashed_at(h: np.ndarray, column: np.ndarray, draw: int) -> np.ndarray:
    """The values of single terms and samples."""
    return scrambled(LOW[draw][column] * h.astype(np.uint32) + HIGH[draw][column] * (h >> np.uint64(32)).astype(np.uint32) + SALT[draw][column])


def exponential(x: np.ndarray) -> np.ndarray:
    """Exp(1), ascending with x."""
    return -np.log1p(-(x + 0.5) * 2.0**-32)


def weighted(h: np.ndarray, w: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and t of single terms and samples."""
    e1, e2, e3 = exponential(hashed_at(h, column, 0)), exponential(hashed_at(h, column, 1)), -np.log((hashed_at(h, column, 2) + 0.5) * 2.0**-32)
    q = np.log1p(e2 / e1)
    r = q + e3
    t = np.floor(np.log(w) / r + (1 - q / r))
    t[w == 1] = 0
    return e1 * np.exp(-r * t), t.astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms (ascending) and their weights."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ np.uint64(0x5851F42D4C957F2D)))
    runs = [mix(np.lib.stride_tricks.sliding_window_view(np.frombuffer(w, np.uint8), 8).copy().view("<u8").ravel() ^ np.uint64(0xD6E8FEB86659FD93)) for w in words if len(w) > LONG]
    return np.unique(np.concatenate([h, pairs, *runs]), return_counts=True)


def sample(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """16 bits of each sample. Terms are taken in blocks, so that long texts need no more memory."""
    if not len(hashes):
        return np.zeros(SAMPLES, np.uint16)
    best, term, step = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
    samples = np.arange(SAMPLES)
    once = hashes[weights == 1]
    for i in range(0, len(once), BLOCK):
        h = once[i : i + BLOCK]
        x = hashed(h, 0)
        at = x.argmin(axis=1)  # the first of equal ones, which has the smaller hash
        a = exponential(x[samples, at])
        won = a < best
        best[won], term[won] = a[won], h[at[won]]
    many = weights > 1
    hashes, weights = hashes[many], weights[many]
    for i in range(0, len(hashes), BLOCK):
        h, w = hashes[i : i + BLOCK], weights[i : i + BLOCK]
        x = hashed(h, 0)
        bound = np.minimum(best, exponential(x.min(axis=1)))  # a is e1 at most
        least = (x * np.float32(2.0**-32)) * (hashed(h, 2) * np.float32(2.0**-32))  # a is e1 exp(-e3) / w at least, and e1 its uniform number
        least /= w.astype(np.float32)
        cols, rows = np.nonzero(least <= (bound * 1.0001).astype(np.float32)[:, None])
        a, t = weighted(h[rows], w[rows], cols)
        order = np.lexsort((rows, a, cols))
        first = order[np.flatnonzero(np.diff(cols[order], prepend=-1))]
        c, a, h, t = cols[first], a[first], h[rows[first]], t[first]
        won = (a < best[c]) | ((a == best[c]) & (h < term[c]))
        best[c[won]], term[c[won]], step[c[won]] = a[won], h[won], t[won]
    return (mix(term + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)).astype(np.uint16)


def fingerprint(text: bytes) -> np.ndarray:
    return sample(*terms(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: estimates the generalised Jaccard similarity."""
    return float((a == b).mean())


def to_text(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row. No shuffle."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(fingerprint(x)) for x in b.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

    return common.map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), common.utf8(text_col)), f, "id long, fingerprint string").withColumnRenamed("id", id_col)


def edit(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_following(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt by ranges of doc_id, (bucket, ahead, doc_id, z): z is the deflated text, and in each bucket the rows with ahead are those that
    follow its last row (the first ids of the next bucket; in the last bucket, those of the whole table).

    The borders are ids of the table (approximate quantiles, `buckets` of them at most), so the first id of a bucket is its border.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    found = docs.select(key.alias("k")).agg(F.min("k").alias("low"), F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("cut")).first()
    low = found["low"] if found["low"] is not None else 0
    cuts = np.array(sorted({x for x in found["cut"] or [] if x > low}), np.int64)
    names = ["bucket", "ahead", "doc_id", "z", "k"]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        k = b.column(0).to_numpy()
        bucket = np.searchsorted(cuts, k, side="right")
        first = np.flatnonzero((bucket > 0) & (cuts[np.maximum(bucket - 1, 0)] == k)) if len(cuts) else np.empty(0, np.int64)
        lowest = np.flatnonzero(k == low)
        take = pa.array(np.concatenate([np.arange(len(k)), first, lowest]))
        z, ids = common.pack_text(b.column(2)), b.column(1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([bucket, bucket[first] - 1, np.full(len(lowest), len(cuts))]), pa.int32()),
                pa.array(np.concatenate([np.zeros(len(k), bool), np.ones(len(first) + len(lowest), bool)])),
                ids.take(take), z.take(take), pa.array(k).take(take),
            ],
            names=names,
        )

    dealt = common.map_arrow(docs.select(key.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text")), f, "bucket int, ahead boolean, doc_id long, z binary, k long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", "k", "z").select("bucket", "ahead", "doc_id", "z")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness; rows with one id follow each other by their deflated text.

    One shuffle of deflated texts by ranges of doc_id; every task then streams its rows and holds two at a time.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = None  # (bucket, doc_id, text, its fingerprint)

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            for bucket, ahead, doc_id, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ahead and (held is None or held[0] != bucket):
                    continue  # only the first of the rows ahead follows
                raw = zlib.decompress(z)
                text, own = raw.decode(), fingerprint(raw)
                if held is not None and held[0] == bucket:
                    _, before, its, mark = held
                    edited = edit(its, text).encode()
                    changed = fingerprint(edited)
                    rows.append((before, len(its), hashlib.sha256(edited).hexdigest(), to_text(mark), to_text(changed), likeness(mark, changed), likeness(mark, own)))
                    if len(rows) >= 1024:
                        yield batch()
                        rows.clear()
                held = None if ahead else (bucket, doc_id, text, own)
        if rows:
            yield batch()

    return common.stream_arrow(with_following(docs, 4 * n), f, SCHEMA)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(common.table(spark, sf_dir, "documents"))
