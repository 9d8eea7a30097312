"""Near-duplicates at the pipeline's limit, and rows without an id, against all pairs."""

import random

import corpus_pipeline

from edgeloom.llm import common, neardup


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(texts, percent):
    """A number for each text's component."""
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if of[i] != of[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    return of


def near_limit(rng, n_pairs, low, high):
    """Pairs of texts with similarities spread from low to high."""
    texts = []
    for k in range(n_pairs):
        n = rng.randrange(100, 400)
        words = [f"p{k}_{i}" for i in range(n)]
        share = low + (high - low) * k / n_pairs
        texts += [" ".join(words), " ".join(words[: round((n - 4) * share) + 4])]
    return texts


def test_pipeline_links_from_80_percent(spark):
    texts = near_limit(random.Random(5), 150, 0.77, 0.87)
    of = groups(texts, 80)
    assert sum(of[i] == of[i + 1] for i in range(0, 300, 2)) > sum(a == b for a, b in zip(*[iter(groups(texts, 85))] * 2, strict=True))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [min(j for j in range(300) if of[j] == of[i]) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 80).collect()}
    assert [got[i] for i in range(300)] == want
    kept = {r["doc_id"] for r in corpus_pipeline.distinct(spark, df, "").collect()}
    assert kept == set(want)


def test_chance_of_a_miss():
    for percent in (50, 70, 80, 85, 95):
        count, rows = neardup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** count <= 3e-7
    assert neardup.banding(85) == (32, 6)


def test_near_copies_without_an_id(spark):
    base = [f"b{i}" for i in range(200)]
    copy = lambda i: " ".join([*base[:i], "new", *base[i + 1 :]])
    alone = [f"a{i}" for i in range(100)]
    rows = [(5, copy(0)), (None, copy(199)), (7, copy(198)), (None, copy(197)), (2**63 - 1, " ".join(f"m{i}" for i in range(99))), (None, " ".join(f"m{i}" for i in range(100))), (None, " ".join(alone)), (None, " ".join(alone[:-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 5, True), (None, 5, False), (7, 5, False), (None, 5, False), (2**63 - 1, 2**63 - 1, True), (None, 2**63 - 1, False), (None, None, True), (None, None, True)], key=repr)
    assert {r["doc_id"] for r in neardup.deduplicate(df).collect()} == {5, 2**63 - 1, None}


def test_components_of_any_graph(spark):
    """Random graphs, a path whose nodes alternate between small and large, and a hub, against union by hand."""
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    path = [x for pair in zip(range(300, 340), range(379, 339, -1), strict=True) for x in pair]
    edges += list(zip(path, path[1:], strict=False)) + [(500, 400 + i) for i in range(60)] + [(7, 7)]
    of = list(range(501))
    for a, b in edges:
        x, y = of[a], of[b]
        of = [min(x, y) if r in (x, y) else r for r in of]
    name = lambda i: bytes([i >> 8, i & 255])
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    got = [(bytes(r["node"]), bytes(r["root"])) for r in neardup.components(df, common.Scratch(spark, "graph")).collect()]
    assert sorted(got) == [(name(i), name(r)) for i, r in enumerate(of) if i != r]
    assert neardup.components(df.limit(0), common.Scratch(spark, "graph")).count() == 0
