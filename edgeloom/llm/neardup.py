"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Each document's set of distinct 5-word shingles (64-bit hashes) gets a 128-bit key and a packed signature: the low 8
   bits of 192 minima (as many as the bands take). Documents with equal sets form a class; from here on a class is one node, however many copies it has.
2. Candidates: at 0.85 32 bands of 6 minima (6 bytes of the packed signature), at 0.80 40 bands of 5. A pair right at the
   limit shares no band with probability 3e-7 at most. Buckets are split into blocks of bounded size, so no task ever
   holds a whole hot bucket. In a group of rows, similarities are estimated from bit counts of the packed signatures and
   corrected for chance collisions; a pair goes on if the estimate may belong to a link (5 standard deviations below),
   and only in the first band it shares.
3. Links are confirmed on the full sets, rebuilt from the texts. Groups emit a spanning forest of their links, not all pairs.
4. Two phases. The first compares within blocks only, so its rows grow with the members. Its links are joined to
   components. The second takes the buckets of several blocks that still hold different components: the members of the
   bucket's largest component stay in blocks, the others meet every block, and only pairs of different components in
   different blocks are compared. A large group of near copies is one component by then and isn't paired with itself;
   members that stay different from all others are compared, block by block.
5. Components by contraction on tables in the shared folder: every node takes the smallest node among its neighbours (and
   that one's), edges are rewritten by it, and those within a component vanish, so no finished star is read again.

Null and empty texts have an empty set and are linked with nothing: component_id = doc_id. Rows that repeat a doc_id are
nodes of their own (of the class of their text). Null ids stay null, and so does component_id where no member has an id.
An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, PERCENT = 5, 85
BITS = 8
#: Chance that a pair at the limit shares no band; the most minima of a signature (counts of equal ones have 8 bits).
MISS, MOST = 3e-7, 248
#: A block's weight: rows, long documents counting for more; a group is a block, or two.
BLOCK, WEIGH = 128, 1000
#: Texts are looked up by id; documents whose id falls in none of so many buckets with a wanted id are passed over first.
ID_BUCKETS = 1 << 20
SIGMAS, SEED = 5.0, 99
#: Stands for null where texts are looked up by id; a key tells such rows apart.
NO_ID = -(2**63)

_rng = np.random.Generator(np.random.PCG64(SEED))
MULTIPLY = (_rng.integers(0, 2**32, (MOST, 1), np.uint64) | np.uint64(1)).astype(np.uint32)
FLIP = _rng.integers(0, 2**32, (MOST, 1), np.uint64).astype(np.uint32)
ORDER = _rng.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


class Bands(NamedTuple):
    count: int
    rows: int

    @property
    def minima(self) -> int:
        return self.count * self.rows


@lru_cache(maxsize=128)
def banding(percent: int) -> Bands:
    """As many minima a band as MISS leaves with 200 minima in all (else with MOST); minima fill whole 64-bit words."""
    s = min(percent, 85) / 100
    for most in (200, MOST):
        for rows in range(6, 0, -1):
            count = math.ceil(math.log(MISS) / math.log1p(-(s**rows)))
            while count * rows % 8:
                count += 1
            if count * rows <= most:
                return Bands(count, rows)
    raise ValueError(f"similarities of {percent} % are too low to find")


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words the whole sequence is one."""
    split = text.lower().split()  # of bytes: A-Z, and the white space of the contract
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ h[j : len(h) - n + 1 + j]) * ORDER[j]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray, minima: int) -> bytes:
    """The low bits of each minimum, one byte each."""
    best = np.full(minima, 2**32 - 1, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(best, ((short[i : i + 2048] ^ FLIP[:minima]) * MULTIPLY[:minima]).min(axis=1), out=best)
    return ((best * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def key_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes agree, by bit counts; a, b: (..., minima / 8) unsigned 64-bit words."""
    x = a ^ b
    x |= x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(0x0101010101010101)
    return 8 * x.shape[-1] - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def similarity(equal: np.ndarray, minima: int) -> np.ndarray:
    """Corrected for minima that differ but share their low bits."""
    chance = 2.0**-BITS
    return (equal / minima - chance) / (1 - chance)


def least_equal(percent: int) -> float:
    """Pairs with fewer equal bytes can't be links (to SIGMAS standard deviations)."""
    p, minima = percent / 100 + (1 - percent / 100) * 2.0**-BITS, banding(percent).minima
    return minima * p - SIGMAS * np.sqrt(minima * p * (1 - p))


def candidate_pairs(sig: np.ndarray, n: np.ndarray, apart: list[np.ndarray], band: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a group that may be links, share no earlier band and differ in each of `apart`, and their equal bytes."""
    packed, bands, least = sig.view(np.uint64), sig.reshape(len(sig), *banding(percent)), least_equal(percent)
    found: list[tuple] = []
    step = max(1, 65536 // len(sig))
    for i in range(0, len(sig), step):
        same = equal_bytes(packed[i : i + step, None, :], packed[None, :, :])
        ok = same >= least
        ok &= np.arange(len(sig))[None, :] > np.arange(i, min(i + step, len(sig)))[:, None]
        small, large = np.minimum(n[i : i + step, None], n), np.maximum(n[i : i + step, None], n)
        ok &= 100 * small >= percent * large
        for x in apart:
            ok &= x[i : i + step, None] != x
        a, b = np.nonzero(ok)
        if len(a):
            first = (bands[a + i] == bands[b]).all(axis=2).argmax(axis=1) == band
            found.append(((a + i)[first], b[first], same[a, b][first]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def digest() -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))


def signed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, key, sig, digest) of each row; key and sig are null for empty sets."""
    minima = banding(percent).minima

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([key_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s, minima) if len(s) else None for s in sets], pa.binary()), b.column(2)],
            names=["doc_id", "n", "key", "sig", "digest"],
        )

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text"), digest().alias("digest")), f, "doc_id long, n long, key binary, sig binary, digest long")


def node_of(rep: Column, key: Column) -> Column:
    """Binary that orders as (rep, key), null reps last: the smallest node of a component has its smallest doc_id."""
    place = F.lpad(F.hex(rep.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.unhex(F.when(rep.isNull(), "01").otherwise(F.concat(F.lit("00"), place))), key)


def weight() -> Column:
    return F.greatest(F.lit(1.0), F.col("n") / WEIGH)


def blocks(weight: Column, members: Column) -> Column:
    return F.least(F.ceil(weight / BLOCK), members).cast("int")


def members(classes: DataFrame, percent: int, scratch: common.Scratch) -> DataFrame:
    """(bucket, band, blocks, block, n, node): the buckets with several classes. Sizes are written before they are joined,
    so that a hot bucket's rows can be split; both sides are shuffled at every size, so that a small run shows what a large one costs."""
    count, width = banding(percent)
    spread = classes.select("node", "n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("band"), "sig")
    spread = spread.select("node", "n", "band", F.xxhash64("band", F.substring("sig", F.col("band") * width + 1, F.lit(width))).alias("bucket"))
    several = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum(weight()).alias("weight")).filter("members > 1")
    several = scratch.keep(several.select("bucket", blocks(F.col("weight"), F.col("members")).alias("blocks")), "several")
    rows = spread.join(several.hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    return scratch.keep(rows.select("bucket", "band", "blocks", "block", "n", "node"), "members")


def within_blocks(rows: DataFrame) -> DataFrame:
    """Groups of the first phase: every block."""
    return rows.select("bucket", F.col("block").alias("i"), F.col("block").alias("j"), "band", F.col("block").alias("part"), "block", "n", "node", F.col("node").alias("comp"))


def across_blocks(rows: DataFrame, roots: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Groups of the second phase, pairs of parts (i, j) of buckets that hold different components: parts of the largest component follow the others."""
    several = rows.filter("blocks > 1").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    several = scratch.keep(several.select("bucket", "band", "block", "n", "node", "comp"), "across")
    sizes = several.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum(weight()).alias("w"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("w", "c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("c"), F.sum("w").alias("w")).filter("comps > 1")
    others, own = blocks(F.col("w") - F.col("main.w"), F.col("c") - F.col("main.c")), blocks(F.col("main.w"), F.col("main.c"))
    mixed = scratch.keep(sizes.select("bucket", F.col("main.comp").alias("main"), F.greatest(F.lit(1), others).alias("others"), own.alias("own")), "mixed")
    rows, at = several.join(mixed, "bucket"), F.xxhash64("bucket", "node")
    rows = rows.withColumn("part", F.when(F.col("comp") == F.col("main"), F.col("others") + F.pmod(at, F.col("own"))).otherwise(F.pmod(at, F.col("others"))).cast("int"))
    last = F.when(F.col("comp") == F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("own")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "band", "part", "block", "n", "node", "comp")


def possible(rows: DataFrame, percent: int) -> DataFrame:
    """(bucket, i, j, at, node, comp, partners): members of each group with pairs that may be links; a partner is its place and the pair's equal bytes.

    rows: bucket, i, j, band, part, block, n, node, comp, sig. Pairs of one component have no need of a link; pairs of one
    block have met in the first phase, where each node is a component of its own.
    """
    schema = "bucket long, i int, j int, at int, node binary, comp binary, partners array<int>"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "i", "j", "at", "node", "comp", "partners"])

        for bucket, i, j, band, part, block, n, node, comp, sig in common.groups(batches, 3):
            if len(node) < 2:
                continue
            apart = []
            if comp != node:
                number: dict[bytes, int] = {}
                apart = [np.array([number.setdefault(c, len(number)) for c in comp]), np.array(block)]
                if len(number) < 2:
                    continue
            if i[0] != j[0]:
                apart.append(np.array(part))
            packed = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
            a, b, same = candidate_pairs(packed, np.array(n), apart, band[0], percent)
            if not len(a):
                continue
            partners: dict[int, list[int]] = {int(x): [] for x in np.concatenate([a, b])}
            place = {x: k for k, x in enumerate(sorted(partners))}
            for x, y, s in zip(a.tolist(), b.tolist(), same.tolist(), strict=True):
                partners[x].append(place[y] << 8 | s)
            out += [(bucket[0], i[0], j[0], place[x], node[x], comp[x], p) for x, p in sorted(partners.items())]
            if len(out) >= 4096:
                yield batch()
                out.clear()
        if out:
            yield batch()

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return common.stream_arrow(dealt, f, schema)


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components, a < b: of each group a spanning forest. pairs: bucket, i, j, at, node, comp, partners, z (deflated text)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])

        for _, _, _, at, _, comp, partners, z in common.groups(batches, 3):
            sets: dict[int, np.ndarray] = {}

            def of(k: int, sets: dict = sets, z: list = z) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(zlib.decompress(z[k]))
                return sets[k]

            place = {p: k for k, p in enumerate(at)}
            pairs = sorted(((p & 255, k, place[p >> 8]) for k, ps in enumerate(partners) for p in ps), reverse=True)
            up = {c: c for c in comp}

            def root(x: bytes, up: dict = up) -> bytes:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for _, x, y in pairs:
                rx, ry = root(comp[x]), root(comp[y])
                if rx == ry:
                    continue  # linked already, by confirmed links
                a, b = of(x), of(y)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    up[max(rx, ry)] = min(rx, ry)
                    out.append((min(comp[x], comp[y]), max(comp[x], comp[y])))
            if len(out) >= 4096:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return common.stream_arrow(pairs.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "at"), f, "a binary, b binary")


def components(links: DataFrame, scratch: common.Scratch, name: str = "edges") -> DataFrame:
    """(node, root) of every node that isn't the smallest of its component, which is root. links: a, b.

    Each round reads only edges between different contracted nodes. All joins are of written tables, so that Spark can
    split the rows of a hub; minima are taken before the shuffle and after it.
    """
    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), f"{name}-0")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(moves)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), f"{name}-least-{k}")
        up = scratch.keep(least.select("node", F.col("up").alias("mid")).join(least.select(F.col("node").alias("mid"), F.col("up").alias("root")), "mid").select("node", "root"), f"{name}-up-{k}")
        ends = edges.join(up.withColumnRenamed("node", "a"), "a").select(F.col("root").alias("x"), "b").join(up.withColumnRenamed("node", "b"), "b").select("x", F.col("root").alias("y")).filter("x != y")
        edges = scratch.keep(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}", f"{name}-least-{k}")
        moves.append(up.filter("node != root"))
    if not moves:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    roots = moves.pop()
    while moves:
        # a node that moved may stand for others in a later round; both ways end at the same root
        earlier = moves.pop().withColumnRenamed("root", "mid").join(roots.select(F.col("node").alias("mid"), F.col("root").alias("end")), "mid", "left")
        roots = scratch.keep(earlier.select("node", F.coalesce("end", "mid").alias("root")).unionByName(roots).distinct(), f"{name}-roots-{len(moves)}")
    return roots


def deflated_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(node, z): the text of each node, looked up by the id of its class; a class is known by its key, as ids may repeat.

    Before texts move they are held against the wanted ids' buckets, of which there are ID_BUCKETS at most.
    """
    wanted = scratch.keep(nodes.distinct().join(classes.select("node", "rep"), "node").select(F.coalesce("rep", F.lit(NO_ID)).alias("id")).distinct(), name)
    bucket = F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), common.utf8("text")).withColumn("bucket", bucket)
    texts = texts.join(F.broadcast(wanted.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi").select("id", "text").join(wanted, "id", "left_semi")

    def deflated(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = [key_of(s) if len(s := shingles(x)) else None for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), common.pack_text(b.column(1))], names=["key", "z"])

    z = common.map_arrow(texts, deflated, "key binary, z binary").filter("key is not null").groupBy("key").agg(F.first("z").alias("z"))
    return z.join(classes.select("key", "node"), "key").select("node", "z")


def linked(docs: DataFrame, classes: DataFrame, groups: DataFrame, percent: int, scratch: common.Scratch, name: str) -> DataFrame:
    """(node, root) of the components that the groups' links make of their components."""
    pairs = scratch.keep(possible(groups.join(classes.select("node", "sig"), "node").select("bucket", "i", "j", "band", "part", "block", "n", "node", "comp", "sig"), percent), f"{name}-pairs")
    if pairs.isEmpty():
        return pairs.select("node", F.col("comp").alias("root"))
    z = deflated_texts(docs, classes, pairs.select("node"), scratch, f"{name}-wanted")
    links = confirmed(pairs.join(z, "node").select("bucket", "i", "j", "at", "node", "comp", "partners", "z"), percent)
    roots = components(links, scratch, f"{name}-edges")
    scratch.drop(f"{name}-pairs")
    return roots


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, digest) of each row, linking documents with 100 * intersection >= percent * union."""
    scratch = common.Scratch(docs.sparkSession, "neardup")
    rows = scratch.keep(signed(docs, percent), "rows")
    reps = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.keep(reps.select("key", "rep", node_of(F.col("rep"), F.col("key")).alias("node"), "n", "sig"), "classes")
    bucketed = members(classes, percent, scratch)
    roots = linked(docs, classes, within_blocks(bucketed), percent, scratch, "within")
    if not bucketed.filter("blocks > 1").isEmpty():
        later = linked(docs, classes, across_blocks(bucketed, roots, scratch), percent, scratch, "across")
        # components of the first phase that went into others; a component of one node is that node
        moved = roots.withColumnRenamed("root", "mid").join(later.select(F.col("node").alias("mid"), F.col("root").alias("end")), "mid", "left")
        roots = moved.select("node", F.coalesce("end", "mid").alias("root")).unionByName(later)

    of_rep = classes.select("node", F.col("rep").alias("root_rep"))
    joined = roots.join(of_rep.withColumnRenamed("node", "root"), "root").select("node", "root_rep")
    final = scratch.keep(classes.select("key", "node", "rep").join(joined, "node", "left").select("key", F.coalesce("root_rep", "rep").alias("component_id")), "components")
    filled = rows.filter("n > 0").select("doc_id", "n", "key", "digest").join(final, "key").select("doc_id", "n", "component_id", "digest")
    empty = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "digest")
    out = filled.unionByName(empty)
    out = scratch.keep(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "digest"), "result")
    scratch.drop_but("result")
    return out


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest doc_id, with all its columns.

    Rows that repeat both id and text are one document. Documents without words all stay. Of rows without an id only
    those go that repeat a text or are linked to a document with an id. Whole rows move once: what stays is decided on
    ids and digests, and both the join with them and the removal of repeated rows need the same partitioning.
    """
    own = ["own_null", "own_id", "own_digest"]

    def marked(doc_id: Column, text: Column) -> list[Column]:
        return [x.alias(n) for x, n in zip((doc_id.isNull(), F.coalesce(doc_id.cast("long"), F.lit(NO_ID)), text), own, strict=True)]

    kept = near_duplicates(docs, percent).filter("kept").select(*marked(F.col("doc_id"), F.col("digest"))).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)), *marked(F.col("doc_id"), digest()))
    return rows.dropDuplicates(own).join(kept.hint("merge"), own, "left_semi").select(*names).toDF(*docs.columns)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("digest")
