"""Vector bin packing of token sequences.

Each bin (a training sequence) has limits on tokens, on segments (pieces of examples) and on loss-bearing tokens. The
bin that is open takes, among the examples of a pool that fit as a whole, the one whose demand has the largest dot
product with the room that is left. If none fits, the largest example is cut to fill the bin. A bin that can't be
filled keeps as many tokens as the largest power of two in it, and the rest goes back to the pool, so no padding is
needed. Every partition is packed by itself: there is no shuffle, and the pool bounds what a task holds.

Of documents every token bears loss but the end token, which nothing is predicted from. Null text counts as empty (its
end token alone); repeated ids and rows are packed as rows of their own; texts of any length are taken whole; an empty
table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END, POOL = 2, 512
#: The table of kept words starts again beyond so many words or characters of them.
KEPT, KEPT_CHARS = 800_000, 16 << 20
#: Python's split() takes U+001C to U+001F as white space, the vocabulary's pattern doesn't; special tokens may hold anything.
BY_LIBRARY = re.compile("[\x01\x1c-\x1f]|<\\|")
#: New words go through the library together; this character, a token of its own, stands between them.
SEPARATOR = " \x01 "
#: Up to here lower-casing works letter by letter and nothing is composed.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
CLOSING = re.compile(r"[.,;:!?](?<=[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff].)(?=\s|\Z)")


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 32
    loss: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("each limit must be 1 at least")


class WordIds:
    """Ids of whole texts for a vocabulary whose pre-tokens never hold white space; ids of frequent words are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        (self.separator,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.kept: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _words(text: str) -> list[str]:
        """Pieces whose ids don't depend on their neighbours. Lower case and a space before closing punctuation change no id."""
        if not BEYOND_LATIN.search(text):
            text = text.lower()
        return CLOSING.sub(r" \g<0>", text).split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.kept) > KEPT or self.held > KEPT_CHARS:
            self.kept.clear()
            self.held = 0
        rows = [None if BY_LIBRARY.search(t) else self._words(t) for t in texts]
        missing: set[str] = set()
        for row in rows:
            if row:
                missing.update(set(row).difference(self.kept))
        new = list(missing)
        self.held += sum(map(len, new))
        for i in range(0, len(new), 1024):
            part = new[i : i + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([SEPARATOR.join(part)], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == self.separator)).tolist(), 4 * len(ids)]
            at = 0
            for w, end in zip(part, ends, strict=True):
                self.kept[w] = data[at:end]
                at = end + 4
        get = self.kept.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") if row is None else np.frombuffer(b"".join(map(get, row)), "<u4") for t, row in zip(texts, rows, strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Packs a stream of examples. add() and finish() give sequences: lists of (key, ids, start, stop, total).

    An item is (key, ids, start, stop, loss_from, loss_to); of its tokens those from loss_from to before loss_to bear loss.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.items: list[tuple | None] = [None] * (2 * POOL + limits.segments)
        self.tokens, self.loss = np.zeros(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        self.free = list(range(len(self.items)))[::-1]

    def add(self, key, ids: np.ndarray, loss_from: int = 0, loss_to: int | None = None) -> Iterator[list[tuple]]:
        lim, start, loss_to = self.limits, 0, len(ids) if loss_to is None else min(loss_to, len(ids))
        while len(ids) - start >= lim.tokens and (stop := start + self._room(start, loss_from, loss_to, lim.tokens, lim.loss)) - start == lim.tokens:
            yield [(key, ids, start, stop, len(ids))]  # a whole sequence
            start = stop
        if len(ids) > start:
            self._put((key, ids, start, len(ids), loss_from, loss_to))
        while len(self.items) - len(self.free) >= POOL:
            yield self._bin()

    def finish(self) -> Iterator[list[tuple]]:
        while len(self.free) < len(self.items):
            yield self._bin()

    @staticmethod
    def _room(start: int, loss_from: int, loss_to: int, tokens: int, loss: int) -> int:
        """How many tokens from start on stay within the limits."""
        if loss_to - max(start, loss_from) <= loss:
            return tokens
        return min(tokens, max(loss_from - start, 0) + loss)

    @staticmethod
    def _bearing(item: tuple) -> int:
        return max(0, min(item[3], item[5]) - max(item[2], item[4]))

    def _put(self, item: tuple) -> None:
        k = self.free.pop()
        self.items[k] = item
        self.tokens[k] = item[3] - item[2]
        self.loss[k] = self._bearing(item)

    def _take(self, k: int) -> tuple:
        item, self.items[k], self.tokens[k], self.loss[k] = self.items[k], None, 0, 0
        self.free.append(k)
        return item

    def _bin(self) -> list[tuple]:
        lim = self.limits
        tokens, segments, loss, pieces = lim.tokens, lim.segments, lim.loss, []
        while tokens and segments and len(self.free) < len(self.items):
            fit = (self.tokens > 0) & (self.tokens <= tokens) & (self.loss <= loss)
            if fit.any():
                score = self.tokens * (tokens / lim.tokens**2) + segments / lim.segments**2 + self.loss * (loss / lim.loss**2)
                pieces.append(piece := self._take(int(np.argmax(np.where(fit, score, -1)))))
            else:
                k = int(np.argmax(self.tokens))
                key, ids, start, stop, *span = self.items[k]
                n = self._room(start, *span, tokens, loss)
                if n <= 0:
                    break
                self._take(k)
                pieces.append(piece := (key, ids, start, start + n, *span))
                self._put((key, ids, start + n, stop, *span))
            tokens -= piece[3] - piece[2]
            loss -= self._bearing(piece)
            segments -= 1
        total = lim.tokens - tokens
        over = total - (total if total == lim.tokens else 1 << (total.bit_length() - 1))
        while over:
            key, ids, start, stop, *span = pieces.pop()
            n = min(over, stop - start)
            self._put((key, ids, stop - n, stop, *span))
            if stop - n > start:
                pieces.append((key, ids, start, stop - n, *span))
            over -= n
        return [(key, ids, start, stop, len(ids)) for key, ids, start, stop, *_ in pieces]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _rows(sequences: Iterator[list[tuple]], with_ids: bool) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for pieces in sequences:
        offset = 0
        for key, ids, start, stop, total in pieces:
            part = ids[start:stop]
            out.append((key, start, stop - start, zlib.crc32(part.astype("<u4").tobytes()), total, number, offset, *[part.astype(np.int32)] * with_ids))
            offset += stop - start
        number += 1
        if len(out) >= 2048:
            yield batch()
            out.clear()
    if out:
        yield batch()


def pack_examples(examples: DataFrame, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """Packs rows (doc_id, ids array<int>, optional loss_from int: tokens from there on bear loss; null: all). Null or empty ids: nothing to pack."""
    loss = F.coalesce(F.col("loss_from").cast("int"), F.lit(0)) if "loss_from" in examples.columns else F.lit(0)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits)

        def sequences() -> Iterator[list[tuple]]:
            for b in batches:
                for key, ids, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield from packer.add(key, np.array(ids or [], np.int64).astype("<u4"), at)
            yield from packer.finish()

        yield from _rows(sequences(), with_ids)

    return common.stream_arrow(examples.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"), loss.alias("loss_from")), f, SCHEMA + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """Tokenizes and packs whole texts, each followed by the end token, which bears no loss."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits)

        def sequences() -> Iterator[list[tuple]]:
            for b in batches:
                words = load(path)
                for key, ids in zip(b.column(0).to_pylist(), words.encode([x.decode() for x in b.column(1).to_pylist()]), strict=True):
                    yield from packer.add(key, np.append(ids, np.uint32(END)), 0, len(ids))
            yield from packer.finish()

        yield from _rows(sequences(), with_ids)

    return common.stream_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text")), f, SCHEMA + ", ids array<int>" * with_ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), default_path())
