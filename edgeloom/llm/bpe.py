"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token the unique last token of its encoding is stored. The tokens that end there come from an
automaton over the vocabulary, longest first; one is right if the prefix before it is empty, or if that prefix's last
token and it are a compatible pair, that is, BPE would not have merged across their border. Back-pointers give the ids.

All new pre-tokens of an Arrow batch advance together, one byte at a time, as numpy vectors: the work is linear in the
bytes, whatever the length of a pre-token. Ids of short pre-tokens are kept in a bounded table.

Which characters are letters and numbers is asked of the tokenizers library itself, once a worker: versions of Unicode differ.

Null texts count as empty: no ids, empty decoded text. Repeated rows give repeated results; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: White space as Unicode has it (not Python's, which adds U+001C to U+001F).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same borders, more coarsely: no pre-token crosses from one chunk to the next.
CHUNK = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
ENDS_OPEN = re.compile(rf"[{WS}]\Z")
#: Bounds of the table of kept pre-tokens: how many, and how many characters each.
KEPT, KEPT_LENGTH = 300_000, 48


def _between(points: np.ndarray) -> str:
    """The inside of a pattern's [...] for ascending code points."""
    starts = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[starts], points[np.append(starts[1:], len(points)) - 1], strict=True))


def borders(path: str) -> tuple[re.Pattern, re.Pattern]:
    """The pattern that cuts pre-tokens, and one of a single run of letters. All code points go through the library's
    splitter in one string, where each run of one class is a piece; what follows a letter (a digit) in one piece is a letter (a number)."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    space = re.compile(f"[{WS}]")
    points = np.array([c for c in range(33, 0x110000) if not (0xD800 <= c < 0xE000 or space.match(chr(c)))])
    text = "".join(map(chr, points.tolist()))
    runs = [(i, j, text[i]) for _, (i, j) in split(text)]
    letters, numbers = (_between(np.concatenate([points[i:j] for i, j, c in runs if len(split(before + c)) == 1])) for before in "a1")
    cut = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{WS}{letters}{numbers}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
    return re.compile(cut), re.compile(f" ?[{letters}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        byte_of = {c: i for i, c in enumerate(chars)}
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # inner numbers: 0..255 are the bytes, 256 + rank the merges; they order the merges as BPE does
        inner = {c: i for i, c in enumerate(chars)} | {a + b: 256 + r for r, (a, b) in enumerate(merges)}
        if len(inner) != 256 + len(merges):
            raise ValueError("two merges give one token; its split would not be unique")
        n = len(inner)
        text = [None] * n
        for t, i in inner.items():
            text[i] = bytes(byte_of[c] for c in t)
        self.out_id = np.fromiter((vocab[t] for t in sorted(inner, key=inner.get)), np.uint32, n)
        self.length = np.fromiter(map(len, text), np.int32, n)
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        for r, (a, b) in enumerate(merges):
            self.left[256 + r], self.right[256 + r] = inner[a], inner[b]
        self._pairs(n)
        self._automaton(text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        piece = [b""] * size
        for t, i in vocab.items():
            piece[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            piece[i] = t.encode()
        self.piece_len = np.fromiter(map(len, piece), np.int64, size)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.pool = np.frombuffer(b"".join(piece), np.uint8)
        self.split, self.word = borders(path)
        self.kept: dict[str, bytes] = {}
        self.passing: list[str] = []  # what is in the table for this batch alone

    def _pairs(self, n: int) -> None:
        """An open-addressed table from a pair of tokens to the token that merges them."""
        self.bits = 18
        while (1 << self.bits) < 3 * n:
            self.bits += 1
        keys = (self.left[256:].astype(np.uint64) << np.uint64(32)) | self.right[256:].astype(np.uint64)
        self.slots, self.merged = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, 2**31 - 1, np.int64)
        todo, value, at = keys, np.arange(256, n), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slots[at] == 2**64 - 1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            self.slots[at[take]], self.merged[at[take]] = todo[take], value[take]
            todo, value, at = todo[~take], value[~take], (at[~take] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b merge into, or a number above all."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._slot(key)
        found = self.slots[at]
        out = np.where(found == key, self.merged[at], 2**31 - 1)
        open_ = np.flatnonzero((found != key) & (found != 2**64 - 1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found != 2**64 - 1)]
        return out

    def _automaton(self, text: list[bytes]) -> None:
        """Suffix automaton of the vocabulary: for each state and byte the next state; for each state its longest token."""
        child: list[dict[int, int]] = [{}]
        token = [-1]
        for i, t in enumerate(text):
            s = 0
            for b in t:
                k = child[s].get(b)
                if k is None:
                    k = child[s][b] = len(child)
                    child.append({})
                    token.append(-1)
                s = k
            token[s] = i
        step = np.zeros((len(child), 256), np.int32)
        fail, longest = np.zeros(len(child), np.int32), np.array(token, np.int32)
        self.shorter = np.full(len(text), -1, np.int32)
        level = [0]
        while level:
            below = []
            for s in level:
                if s:
                    step[s] = step[fail[s]]
                for b, k in child[s].items():
                    fail[k] = step[fail[s], b] if s else 0
                for b, k in child[s].items():
                    step[s, b] = k
                    below.append(k)
            for k in below:
                if token[k] >= 0:
                    self.shorter[token[k]] = longest[fail[k]]
                else:
                    longest[k] = longest[fail[k]]
            level = below
        self.step, self.longest = step, longest

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of adjacent tokens as it is: undo merges from the latest, look for an earlier one across."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 2**31 - 2, np.int64)
        while len(live):
            bad = self._merge(a, b) < limit
            ok[live[bad]] = False
            go = ~bad
            live, a, b, limit = live[go], a[go], b[go], limit[go]
            first = a > b
            la, lb = self.right[a], self.left[b]
            # undo the later merge; if that one is a byte, the other; if both are, the pair stands
            use_a = np.where(first, la != a, (lb == b) & (la != a))
            use_b = ~use_a & (lb != b)
            limit = np.where(use_a, a, np.where(use_b, b + 1, limit))
            a, b = np.where(use_a, la, a), np.where(use_b, lb, b)
            go = use_a | use_b
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def encode_pretokens(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token (little-endian unsigned 32-bit), all advanced together; groups of about a million bytes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        group = np.concatenate([[0], np.cumsum(size[order])])[:-1] >> 20
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(words)]
        out = [b""] * len(words)
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = order[i:j].tolist()
            ids, ends = self._encode(b"".join([words[k] for k in part]), size[order[i:j]])
            at = 0
            for k, end in zip(part, ends, strict=True):
                out[k] = ids[at:end]
                at = end
        return out

    def _encode(self, data: bytes, size: np.ndarray) -> tuple[bytes, list[int]]:
        """data: the words one after another, longest first. All ids, and where each word's ids end (in bytes)."""
        data, start = np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]])
        last, state = np.zeros(len(data), np.int32), np.zeros(len(size), np.int32)
        alive = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), side="right")
        for e, n in enumerate(alive.tolist()):
            at = start[:n] + e
            state = self.step[state[:n], data[at]]
            todo, token = np.arange(n), self.longest[state]
            while len(todo):
                back = at[todo] - self.length[token]
                good = back < start[todo]
                inner = np.flatnonzero(~good)
                if len(inner):
                    good[inner] = self.compatible(last[back[inner]], token[inner])
                last[at[todo[good]]] = token[good]
                todo, token = todo[~good], self.shorter[token[~good]]
        # back-pointers: mark the ends of the tokens, all words at a time
        mark, end = np.zeros(len(data), bool), (start + size - 1)[size > 0]
        begin = start[size > 0]
        while len(end):
            mark[end] = True
            end = end - self.length[last[end]]
            go = end >= begin
            end, begin = end[go], begin[go]
        ends = np.concatenate([[0], np.cumsum(mark)])[start + size] * 4
        return self.out_id[last[mark]].astype("<u4").tobytes(), ends.tolist()

    def _fill(self, chunks: set[str]) -> None:
        """Encodes chunks that aren't kept yet."""
        single = [c for c in chunks if self.word.fullmatch(c)]
        mixed = list(chunks.difference(single))
        pieces = [self.split.findall(c) for c in mixed]
        flat = list({p for ps in pieces for p in ps}.difference(self.kept).difference(single))
        self.kept.update(zip(words := single + flat, self.encode_pretokens([p.encode() for p in words]), strict=True))
        get = self.kept.__getitem__
        for c, ps in zip(mixed, pieces, strict=True):
            self.kept[c] = b"".join(map(get, ps))
        self.passing += [c for c in words + mixed if len(c) > KEPT_LENGTH]

    def _lookup(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        rows = []
        missing: set[str] = set()
        for t in texts:
            first, *rest = t.split(" ")
            row = [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
            rows.append(row)
            missing.update(set(row).difference(self.kept))
        # a chunk that ends in white space depends on what follows: such texts are cut by the pattern (and chunks like that aren't kept)
        open_ = {c for c in missing if ENDS_OPEN.search(c)}
        if open_:
            missing.clear()
            for i, row in enumerate(rows):
                if not open_.isdisjoint(row):
                    rows[i] = CHUNK.findall(texts[i])
                missing.update(set(rows[i]).difference(self.kept))
        self.passing += [c for c in missing if ENDS_OPEN.search(c)]  # white space alone, cut by the pattern
        self._fill(missing)
        get = self.kept.__getitem__
        out = [b"".join(map(get, row)) for row in rows]
        for c in self.passing:
            self.kept.pop(c, None)
        self.passing.clear()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        if not self.special_split or not any("<|" in t for t in texts):
            return self._lookup(texts)
        split = [self.special_split.split(t) for t in texts]
        plain = iter(self._lookup([p for parts in split for p in parts[::2]]))
        return [b"".join([np.uint32(self.special[p]).tobytes() if k % 2 else next(plain) for k, p in enumerate(parts)]) for parts in split]

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The decoded text in UTF-8; bytes that aren't UTF-8 become U+FFFD, as the library has it."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        size = self.piece_len[ids]
        to = np.cumsum(size)
        at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(self.piece_start[ids] - (to - size), size)
        out = self.pool[at].tobytes()
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return out.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder a Python worker and vocabulary."""
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row's whole text. No shuffle: rows stay where they are read."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, "<u4") for x in load(path).encode_batch([x.decode() for x in b.column(1).to_pylist()])]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["id", "ids"])

    out = common.map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), common.utf8(text_col)), f, "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row's ids; null ids decode to the empty text."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [load(path).decode(np.array(x or [], np.uint32)).decode() for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["id", "text"])

    out = common.map_arrow(encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")), f, "id long, text string")
    return out.withColumnRenamed("id", id_col)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        ids = bpe.encode_batch([x.decode() for x in b.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text")), f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"), default_path())
