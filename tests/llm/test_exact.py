"""Operators with exact results, against the libraries or brute force."""

import hashlib
import io
import math
import random
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest
import xxhash
from fixtures import ROWS, frame
from pyspark.sql import functions as F

from edgeloom.llm import bpe, common, fingerprint, media, neardup, packing, warc


def documents(sf_dir):
    return oracle.duck(sf_dir).sql("SELECT doc_id, text FROM documents").fetchall()


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def same_rows(got, want):
    key = lambda r: repr(r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


# 1
def bpe_row(t, doc_id, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_as_the_library(spark, sf_dir):
    t = library(bpe.default_path())
    out = bpe.op1_bpe(spark, sf_dir).collect()
    same_rows(out, [bpe_row(t, *r) for r in documents(sf_dir)])
    edge = bpe.digest(frame(spark), bpe.default_path())
    assert edge.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    same_rows(edge.collect(), [bpe_row(t, r[0], r[1]) for r in ROWS])
    assert bpe.digest(frame(spark, []), bpe.default_path()).collect() == []


def test_bpe_random_bytes_and_round_trip(spark):
    t, own, rng = library(bpe.default_path()), bpe.load(bpe.default_path()), random.Random(3)
    alphabet = "aaabcde  \n\t'sré123.,!🙂　 \x1c\x85ﬁ語"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids).decode() == text
    both = bpe.decode(bpe.encode(frame(spark), bpe.default_path()), bpe.default_path())
    same_rows(both.collect(), [(r[0], r[1] or "") for r in ROWS])


def test_bpe_every_character():
    """Every code point of the planes that hold letters, beside a letter, an apostrophe, a blank and a digit."""
    t, own = library(bpe.default_path()), bpe.load(bpe.default_path())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or c % 211 == 0)]
    for k in range(0, len(points), 16384):
        texts = [x for c in points[k : k + 16384] for x in (f"{chr(c)}'s", f"x{chr(c)} {chr(c)}7")]
        for text, ids, ref in zip(texts, own.encode_batch(texts), t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert ids == np.array(ref.ids, "<u4").tobytes(), repr(text)


def test_bpe_keeps_no_long_words():
    own = bpe.load(bpe.default_path())
    own.encode_batch(["y" * 5000 + " z! " + "1" * 999, " \n" * 90])
    assert max(map(len, own.kept)) <= bpe.KEPT_LENGTH


# 2
def test_warc_query(spark, sf_dir):
    assert oracle.rows_of(warc.op2_warc(spark, sf_dir)) == oracle.rows_duck(oracle.duck(sf_dir), warc.ORACLE)


def test_warc_round_trip(spark):
    big = "<p>ü" * 30_000
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c", "x" * 999), (4, "http://d", "x" * 999), (5, None, None), (6, "u", ""), (7, "u", "y" * 1000), (7, "u", "y" * 1000), (None, "n", "y" * 1000), (8, "a\r\nb: c", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("origin", F.lit(1)).repartition(3)
    scratch = common.Scratch(spark, "test")
    warc.write(pages, f"{scratch.root}/a", scratch)
    got = warc.read(spark, f"{scratch.root}/a").collect()
    assert all(r["problem"] is None for r in got)
    target = {big: 2, "y" * 1000: 7}
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = target.get(html)
        revisit = to is not None and page_id != to
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    same_rows([tuple(r)[:5] for r in got], want)
    assert all(r["payload"] == (next(x[2] for x in rows if x[0] == r["page_id"]) or "").encode() for r in got if r["record_type"] == "response" and r["page_id"])
    same_rows([tuple(r)[:5] for r in warc.read(spark, f"{scratch.root}/a", with_payload=False).collect()], want)


def test_warc_segments_that_do_not_fit():
    records = warc.page_records("urn:page:1", 1, "u", b"z" * 100_000, None)
    assert len(records) > 3
    whole = b"".join(b for r in records for _, b in warc.parse(r + b"\r\n"))
    assert warc.unchunked(whole.partition(b"\r\n\r\n")[2]) == b"z" * 100_000
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(records[0][:-40]))


def test_warc_problems_are_reported(spark):
    records = warc.page_records("urn:page:1", 1, "u", b"z" * 100_000, None)
    other = warc.page_records("urn:page:2", 2, "u", b"q" * 50, None)[0].replace(b"qqqq", b"qqrq")
    scratch = common.Scratch(spark, "test")
    df = spark.createDataFrame([(r.decode(),) for r in [*records[:2], *records[3:], other]], "value string")
    df.write.option("lineSep", "\r\n").option("compression", "gzip").text(f"{scratch.root}/bad")
    got = {r["page_id"]: r["problem"] for r in warc.read(spark, f"{scratch.root}/bad").collect()}
    assert got[1].startswith("segments") and got[2] == "the digest differs"


def test_warc_empty_table_and_very_large_pages(spark):
    schema = "page_id long, url string, html string"
    scratch = common.Scratch(spark, "test")
    warc.write(spark.createDataFrame([], schema), f"{scratch.root}/none", scratch)
    assert warc.read(spark, f"{scratch.root}/none").collect() == []
    large = "".join(f"<p>{i} äöü" for i in range(700_000))
    warc.write(spark.createDataFrame([(1, "u", large), (2, "u", "y" * 2000), (3, None, large)], schema), f"{scratch.root}/large", scratch)
    got = {r["page_id"]: r for r in warc.read(spark, f"{scratch.root}/large").collect()}
    assert bytes(got[3]["payload"]) == large.encode() and got[3]["payload_bytes"] == len(large.encode()) > 8 << 20
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 3 and all(r["problem"] is None for r in got.values())


def test_warc_revisits_refer_to_records_that_exist(spark):
    rows = [(7, "u", "y" * 1000), (7, "u", "y" * 1000), (7, "v", "z" * 1000), (3, "u", "y" * 1000), (None, None, "z" * 1000)]
    scratch = common.Scratch(spark, "test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"{scratch.root}/a", scratch)
    files = spark.read.format("binaryFile").load(f"{scratch.root}/a").select("content").collect()
    records = [x for f in files for x, _ in warc.parse(warc.gunzip(bytes(f["content"])))]
    names = [x["warc-record-id"] for x in records]
    assert len(set(names)) == len(names) == len(rows)
    referred = [x["warc-refers-to"] for x in records if x["warc-type"] == "revisit"]
    assert len(referred) == 2 and set(referred) <= set(names)


def test_warc_damaged_archives(spark, tmp_path):
    """A cut archive, one that isn't gzip and one with a bad header give a problem each; what is before it, and other archives, are read."""
    import gzip

    make = lambda i, n: b"".join(r + b"\r\n" for r in warc.page_records(f"urn:page:{i}:0", i, "u", b"%d" % i * n, None))
    good = make(1, 5000) + make(2, 10)
    (tmp_path / "a.gz").write_bytes(gzip.compress(good))
    whole = gzip.compress(make(3, 10) + make(4, 60_000), 0)
    (tmp_path / "b.gz").write_bytes(whole[: len(whole) - 9000])
    (tmp_path / "c.gz").write_bytes(b"not an archive")
    (tmp_path / "d.gz").write_bytes(gzip.compress(make(5, 10) + make(6, 10).replace(b"Content-Length", b"Content-Size")))
    for with_payload in (True, False):
        got = warc.read(spark, f"file://{tmp_path}", with_payload).collect()
        assert {r["page_id"] for r in got if r["problem"] is None} == {1, 2, 3, 5}
        assert sorted(r["uri"][-4:] for r in got if r["record_type"] == warc.DAMAGED and r["problem"]) == ["b.gz", "c.gz", "d.gz"]


# 4
def media_row(doc_id, text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    return doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def plain_feature(payload: bytes) -> tuple[int, list, np.ndarray]:
    """Frames, spans and mean bands by upsampling with zeros, filtering and dropping samples; loops over frames."""
    up, down = 3, 4
    assert media.RATE_IN * up == media.RATE_OUT * down
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    full = media.polyphase(up, down).astype(np.float64).T.ravel()
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    y = np.convolve(stuffed, full)[: len(stuffed) : down]
    size = max(media.FRAME, -(-len(y) // media.HOP) * media.HOP)
    y = np.concatenate([y, np.zeros(size - len(y))])
    window, bank = media.filterbank(media.RATE_OUT)
    mel, energy = [], []
    for i in range(0, len(y) - media.FRAME + 1, media.HOP):
        frame = y[i : i + media.FRAME]
        mel.append(np.log(np.abs(np.fft.rfft(frame * window)) ** 2 @ bank + 1e-6))
        energy.append(10 * np.log10((frame**2).mean() + 1e-9))
    mean, spread, spans, start = np.mean(energy), np.std(energy), [], None
    for i, e in enumerate(energy):
        if start is None and e >= mean + 0.5 * spread:
            start = i
        elif start is not None and e < mean - 0.25 * spread:
            spans.append((start, i))
            start = None
    if start is not None:
        spans.append((start, len(energy)))
    return len(mel), spans, np.array(mel)


def test_media(spark, sf_dir):
    out = media.op4_media(spark, sf_dir).collect()
    texts = dict(documents(sf_dir))
    same_rows([tuple(r)[:5] for r in out], [media_row(*r) for r in texts.items()])
    checked = 0
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.wav(payload)
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (media.RATE_IN, 1, 1, payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        tensors = pa.ipc.open_stream(r["tensors"]).read_all()
        n, spans, mel = plain_feature(payload)
        assert r["n_frames"] == n and r["feature"].startswith(f"frames={n};segments={tensors.num_rows};")
        got = [(round(a * media.RATE_OUT / media.HOP), round(b * media.RATE_OUT / media.HOP)) for a, b in zip(tensors["start_s"].to_pylist(), tensors["end_s"].to_pylist(), strict=True)]
        means = [float(x) for x in r["feature"].split("mel=")[1].split(";")[0].split(",")]
        assert np.allclose(means, mel.mean(axis=0), atol=0.02)
        if got == spans:  # a frame right at a threshold may fall on either side
            checked += 1
            shares = [[mel[a + (b - a) * k // 8 : max(a + (b - a) * (k + 1) // 8, a + (b - a) * k // 8 + 1)].mean(axis=0) for k in range(8)] for a, b in spans]
            values = tensors["log_mel"].combine_chunks()
            assert values.type.shape == list(media.SHAPE)
            assert not spans or np.allclose(values.to_numpy_ndarray(), np.array(shares), atol=0.02)
    assert checked >= 0.95 * len(out)


def test_media_edges(spark):
    out = media.digest(media.store(frame(spark))).collect()
    same_rows([tuple(r)[:5] for r in out], [media_row(r[0], r[1]) for r in ROWS])
    assert len({tuple(r)[1:] for r in out if r["doc_id"] == 7}) == 1
    assert media.digest(media.store(frame(spark, []))).collect() == []
    found = {r["doc_id"]: r for r in media.features(media.store(frame(spark))).collect()}
    assert found[4]["n_frames"] == found[5]["n_frames"] == 1 and found[1]["n_frames"] == next(r["n_frames"] for r in out if r["doc_id"] == 1)
    assert [bytes(found[i]["tensors"]) for i in (1, 8)] == [bytes(next(r["tensors"] for r in out if r["doc_id"] == i)) for i in (1, 8)]


def test_resampling_as_upsampled_filtered_and_decimated():
    rng = np.random.default_rng(5)
    for up, down, n in ((3, 4, 1000), (1, 2, 501), (5, 3, 7), (2, 3, 1), (160, 147, 400)):
        x, full = rng.normal(size=n).astype(np.float32), media.polyphase(up, down).T.ravel()
        stuffed = np.zeros(n * up)
        stuffed[::up] = x
        got = media.resample(x, up, down, np.zeros(media.TAPS - 1, np.float32))
        assert np.allclose(got, np.convolve(stuffed, full)[: n * up : down], atol=1e-4)


def test_media_in_blocks_as_at_once(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 64 * 300, np.uint8).tobytes()
    mel, energy = media.log_mel(data)
    monkeypatch.setattr(media, "BLOCK", 4096)
    blocks = media.log_mel(data)
    assert np.allclose(mel, blocks[0], atol=1e-3) and np.allclose(energy, blocks[1], atol=1e-3)
    rate, samples = media.read_wav(media.wav(b"abc"))
    assert (rate, samples) == (media.RATE_IN, b"abc")


def test_media_tone_lands_in_its_band_and_segment(spark):
    import pyarrow as pa

    t = np.arange(16_000)
    tone = np.where((t > 6000) & (t < 11_000), 100 * np.sin(2 * np.pi * 1000 * t / 16_000), 0) + 128
    mel, energy = media.log_mel(tone.astype(np.uint8).tobytes())
    spans = media.segments(energy)
    assert len(spans) == 1
    start, end = spans[0] * media.HOP / media.RATE_OUT
    assert abs(start - 6000 / 16_000) < 0.05 and abs(end - 11_000 / 16_000) < 0.05
    centres = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 60 / 700), 2595 * np.log10(1 + media.RATE_OUT / 2 / 700), media.MELS + 2)[1:-1] / 2595) - 1)
    assert abs(centres[mel[(spans[0][0] + spans[0][1]) // 2].argmax()] - 1000) < 150
    stored = spark.createDataFrame([(1, bytearray(media.wav(tone.astype(np.uint8).tobytes()))), (2, None)], "doc_id long, media binary")
    row = {r["doc_id"]: r for r in media.features(stored).collect()}
    assert len(row[1]["segments"]) == 1 and len(row[1]["segments"][0]["log_mel"]) == np.prod(media.SHAPE) and row[2]["n_frames"] == 0
    table = pa.ipc.open_stream(row[1]["tensors"]).read_all()
    assert table.column("log_mel").type == pa.fixed_shape_tensor(pa.float32(), list(media.SHAPE))


# 8
def check_packing(rows, texts):
    """texts: (doc_id, ids) of each row."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc_id, ids in texts:
        want[doc_id].append(ids)
    assert pieces.keys() == want.keys()
    padding = used = 0
    for doc_id, ps in pieces.items():
        if len(want[doc_id]) > 1:
            assert sum(p["length"] for p in ps) == sum(map(len, want[doc_id]))
            continue
        (ids,), at = want[doc_id], 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and len(ps) <= packing.Limits().segments
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        used += at
    assert padding <= 0.01 * used


def test_packing(spark, sf_dir):
    t = library(packing.default_path())
    with_end = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, packing.END]
    check_packing(packing.op8_packing(spark, sf_dir).collect(), [(i, with_end(x)) for i, x in documents(sf_dir)])
    edge = packing.pack_documents(frame(spark), packing.default_path()).collect()
    check_packing(edge, [(r[0], with_end(r[1])) for r in ROWS])
    assert packing.pack_documents(frame(spark, []), packing.default_path()).collect() == []


def test_packing_keeps_all_limits(spark):
    rng, limits = random.Random(2), packing.Limits(tokens=128, segments=4, loss=60)
    examples = [(i, [rng.randrange(900) for _ in range(n)], rng.randrange(n + 1)) for i, n in enumerate(rng.choice([1, 5, 40, 130, 700]) for _ in range(150))]
    packer, found = packing.Packer(limits), []
    for key, ids, at in examples:
        found += packer.add((key, at), np.array(ids, "<u4"), at)
    found += packer.finish()
    covered = defaultdict(list)
    for seq in found:
        assert sum(e - s for _, _, s, e, _ in seq) <= 128 and len(seq) <= 4
        assert sum(max(0, e - max(s, key[1])) for key, _, s, e, _ in seq) <= 60
        for key, _, s, e, _ in seq:
            covered[key[0]].append((s, e))
    for key, ids, _ in examples:
        spans = sorted(covered[key])
        assert spans[0][0] == 0 and spans[-1][1] == len(ids) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def plain_packing(examples, limits, pool):
    """The rule by plain loops over slots: (key, start, stop) lists of each sequence."""
    slots: dict[int, tuple] = {}
    free = list(range(2 * pool + limits.segments))[::-1]
    out = []
    size = lambda it: it[2] - it[1]
    bearing = lambda it: sum(1 for p in range(it[1], it[2]) if it[3] <= p < it[4])

    def put(it):
        slots[free.pop()] = it

    def take(k):
        free.append(k)
        return slots.pop(k)

    def longest(it, tokens, loss):
        """The longest beginning of an item within the limits."""
        n = 0
        while n < size(it) and n < tokens and bearing((*it[:2], it[1] + n + 1, *it[3:])) <= loss:
            n += 1
        return n

    def one_bin():
        tokens, segments, loss, pieces = limits.tokens, limits.segments, limits.loss, []
        while tokens and segments and slots:
            fit = [k for k, it in sorted(slots.items()) if size(it) <= tokens and bearing(it) <= loss]
            if fit:
                score = lambda k: size(slots[k]) * (tokens / limits.tokens**2) + segments / limits.segments**2 + bearing(slots[k]) * (loss / limits.loss**2)
                best = max(map(score, fit))
                piece = take(next(k for k in fit if score(k) == best))
            else:
                k = min(slots, key=lambda k: (-size(slots[k]), k))
                n = longest(slots[k], tokens, loss)
                if not n:
                    break
                it = take(k)
                piece = (*it[:2], it[1] + n, *it[3:])
                put((it[0], it[1] + n, *it[2:]))
            pieces.append(piece)
            tokens, segments, loss = tokens - size(piece), segments - 1, loss - bearing(piece)
        total = sum(map(size, pieces))
        over = total - (total if total == limits.tokens else 2 ** int(math.log2(total)))
        while over:
            it = pieces.pop()
            n = min(over, size(it))
            put((it[0], it[2] - n, *it[2:]))
            if size(it) > n:
                pieces.append((*it[:2], it[2] - n, *it[3:]))
            over -= n
        out.append([it[:3] for it in pieces])

    for key, n, a, b in examples:
        start = 0
        while n - start >= limits.tokens and longest((key, start, n, a, b), limits.tokens, limits.loss) == limits.tokens:
            out.append([(key, start, start + limits.tokens)])
            start += limits.tokens
        if n > start:
            put((key, start, n, a, b))
        while len(slots) >= pool:
            one_bin()
    while slots:
        one_bin()
    return out


@pytest.mark.parametrize("limits", [packing.Limits(128, 4, 60), packing.Limits(64, 3, 64), packing.Limits(100, 50, 1)])
def test_packing_chooses_as_plain_loops(monkeypatch, limits):
    monkeypatch.setattr(packing, "POOL", 12)
    rng = random.Random(7)
    examples = []
    for i in range(120):
        n = rng.choice([1, 3, 17, 40, 63, 64, 130, 300])
        examples.append((i, n, rng.randrange(n + 1), rng.choice([n, n - 1])))
    packer, got = packing.Packer(limits), []
    for key, n, a, b in examples:
        got += packer.add(key, np.zeros(n, "<u4"), a, b)
    got += packer.finish()
    assert [[x[:1] + x[2:4] for x in seq] for seq in got] == plain_packing(examples, limits, 12)


def test_packing_of_examples(spark):
    """Instruction data: loss from a place on; nulls, empty ids, repeated rows, clashing names, an empty table."""
    rng = random.Random(3)
    rows = [(i % 70, [rng.randrange(500) for _ in range(rng.choice([1, 9, 200, 900]))], rng.choice([None, 0, 5, 100]), "b") for i in range(150)]
    rows += [(None, [1, 2, 3], 1, "b"), (5, None, 0, "b"), (6, [], None, None)] + [(7, [4] * 50, 25, "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss_from int, sequence_id string").repartition(3)
    limits = packing.Limits(512, 5, 300)
    out = packing.pack_examples(df, limits, with_ids=True).collect()
    check = defaultdict(list)
    for r in out:
        check[r["sequence_id"]].append(r)
    for pieces in check.values():
        pieces.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in pieces)
        assert len(pieces) <= 5 and (total == 512 or total & (total - 1) == 0 and total < 512)
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
    tokens = lambda rs: Counter((i, x) for i, xs in rs for x in xs)
    assert tokens((r["doc_id"], r["ids"]) for r in out) == tokens((r[0], r[1] or []) for r in rows)
    assert packing.pack_examples(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        packing.Limits(loss=0)


# 9
def plain_terms(text: bytes) -> dict:
    """Term hashes and weights, one at a time."""
    mask = 2**64 - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    words = [xxhash.xxh3_64_intdigest(w) for w in text.lower().split()]
    found = words + [mix((a * 0x9E3779B97F4A7C15 + (b ^ 0x5851F42D4C957F2D)) & mask) for a, b in zip(words, words[1:], strict=False)]
    for w in text.lower().split():
        if len(w) > fingerprint.LONG:
            found += [mix(int.from_bytes(w[i : i + 8], "little") ^ 0xD6E8FEB86659FD93) for i in range(len(w) - 7)]
    return Counter(found)


def plain_fingerprint(text: bytes) -> list[int]:
    """Every term's draws for every sample in plain floats; the least a wins, of equal ones the smaller hash."""
    mask, low32 = 2**64 - 1, 2**32 - 1
    terms, out = sorted(plain_terms(text).items()), []

    def uniform(x, draw, s):
        v = (int(fingerprint.LOW[draw][s]) * (x & low32) + int(fingerprint.HIGH[draw][s]) * (x >> 32) + int(fingerprint.SALT[draw][s])) & low32
        v ^= v >> 16
        v = v * 0x7FEB352D & low32
        v ^= v >> 15
        return (v * 0x846CA68B & low32) + 0.5

    for s in range(fingerprint.SAMPLES):
        best = None
        for x, w in terms:
            e1, e2 = (-math.log1p(-uniform(x, d, s) / 2**32) for d in (0, 1))
            e3 = -math.log(uniform(x, 2, s) / 2**32)
            c, r = e1 + e2, math.log((e1 + e2) / e1) + e3
            b = 1 - math.log(c / e1) / r
            t = math.floor(math.log(w) / r + b) if w > 1 else 0
            y = math.exp(r * (t - b))
            a = c / (y * math.exp(r))
            if best is None or a < best[0]:
                best = a, x, t
        if best is None:
            out.append(0)
            continue
        h = (best[1] + best[2] * 0x9E3779B97F4A7C15) & mask
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        out.append((h ^ h >> 31) & 0xFFFF)
    return out


def test_fingerprint_matches_plain_sampling():
    rng = random.Random(12)
    many = " ".join(f"w{int(200 * rng.random() ** 3)}" for _ in range(900)).encode()
    for text in (b"", b"a", b"a b a b a c " * 9, b"the cat sat on the mat " * 3 + b"z" * 200, bytes(rng.choice(b"abcdefgh") for _ in range(300)), many):
        assert fingerprint.fingerprint(text).tolist() == plain_fingerprint(text)


def test_fingerprint_of_texts_without_blanks():
    text = "".join(chr(0x4E00 + random.Random(k).randrange(3000)) for k in range(800))
    near = fingerprint.likeness(*(fingerprint.fingerprint(t.encode()) for t in (text, text[:40] + text[41:])))
    far = fingerprint.likeness(*(fingerprint.fingerprint(t.encode()) for t in (text, text[::-1])))
    assert near > 0.9 and far < 0.1


def test_fingerprint_estimates_weighted_jaccard():
    rng = random.Random(4)
    words = [f"w{rng.randrange(300)}" for _ in range(3000)]
    off = []
    for share in (0.0, 0.1, 0.3, 0.6):
        other = [w if rng.random() > share else f"v{rng.randrange(300)}" for w in words]
        a, b = (dict(zip(*(x.tolist() for x in fingerprint.terms(" ".join(t).encode())), strict=True)) for t in (words, other))
        exact = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        off.append(abs(fingerprint.likeness(fingerprint.fingerprint(" ".join(words).encode()), fingerprint.fingerprint(" ".join(other).encode())) - exact))
    assert off[0] == 0 and max(off) < 0.2


def check_fingerprints(rows, texts):
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        own, other, edited = (fingerprint.fingerprint(x.encode()) for x in (text, following, text[: len(text) - n] + following[:n]))
        same = [sum(a == b for a, b in zip(own.tolist(), x.tolist(), strict=True)) / fingerprint.SAMPLES for x in (edited, other)]
        want[doc_id] = (len(text), hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest(), fingerprint.to_text(own), fingerprint.to_text(edited), *same)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_chars"], r["fingerprint"]) == (want[r["doc_id"]][0], want[r["doc_id"]][2])
        if sum(t[0] == r["doc_id"] for t in texts) == 1 and sum(t[0] == r["doc_id"] for t in texts):
            assert (r["edited_sha256"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) == (want[r["doc_id"]][1], *want[r["doc_id"]][3:]), r["doc_id"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_fingerprint_query(spark, sf_dir):
    check_fingerprints(fingerprint.op9_fingerprint(spark, sf_dir).collect(), documents(sf_dir))


def test_fingerprint_edges(spark):
    texts = [(r[0], r[1]) for r in ROWS]
    check_fingerprints(fingerprint.compare_edited(frame(spark)).collect(), texts)
    one = fingerprint.compare_edited(frame(spark, ROWS[:1])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.compare_edited(frame(spark, [])).collect() == []


# 10
def brute_components(texts):
    """(doc_id, n, component) of each row, by all pairs."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [shingles(t) for _, t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(texts, sets, strict=True))]


def check_neardup(out, texts):
    want = [(*r, r[0] == r[2]) for r in brute_components(texts)]
    same_rows([tuple(r)[:4] for r in out], want)


def test_neardup_query(spark, sf_dir):
    check_neardup(neardup.op10_neardup(spark, sf_dir).collect(), documents(sf_dir))


def test_neardup_edges(spark):
    check_neardup(neardup.near_duplicates(frame(spark)).collect(), [(r[0], r[1]) for r in ROWS])
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_neardup_of_hot_groups_and_borders(spark, monkeypatch):
    """Many near copies in one bucket (several blocks), chains, and pairs right at the limit."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng, texts = random.Random(6), []
    base = [f"b{i}" for i in range(200)]
    for i in range(120):  # one large group of near copies
        w = list(base)
        w[rng.randrange(200)] = f"n{i}"
        texts.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(300)]
    for i in range(120, 150):  # each is linked with the next, the ends aren't
        texts.append((i, " ".join(chain)))
        for _ in range(2):
            chain[rng.randrange(300)] = f"d{rng.random()}"
    for i in range(150, 190):  # n shingles shared of m: around 85 %
        n = 40 + i
        texts.append((i, " ".join(f"e{i // 2}_{k}" for k in range(n + (4 + (n * 3) // 17 + i % 3 - 1) * (i % 2)))))
    texts += [(200 + i, " ".join(f"r{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    check_neardup(neardup.near_duplicates(df).collect(), texts)


def test_deduplicate_keeps_whole_rows(spark):
    kept = neardup.deduplicate(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12] and ids.count(None) == 1
