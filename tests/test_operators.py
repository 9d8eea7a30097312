"""Time-series and graph operators against plain Python, and streams."""

import random

from pyspark.sql import functions as F

from edgeloom.operators import graph, ranks, timeseries
from edgeloom.session import Session
from edgeloom.streaming import ingest


def series(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(1000), i, rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, at long, id long, v double")


def test_previous_over_chunks(spark):
    rows, df = series(spark)
    want = {}
    for k in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            want[r[2]] = last
            last = r[3]
    for chunks in (1, 7, 5000):
        got = {r["id"]: r["prev_v"] for r in timeseries.previous(df, ["k"], "at", ["v"], ["id"], chunks=chunks).collect()}
        assert got == want
    assert timeseries.previous(df.limit(0), ["k"], "at", ["v"]).collect() == []


def test_integral(spark):
    rows, df = series(spark, 60)
    got = {r["k"]: r["s"] for r in timeseries.integral(df.filter("k is not null"), ["k"], "at", "v", "s", ["id"], chunks=5).collect()}
    for k in ("hot", "b"):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        assert abs(got[k] - sum((b[1] - a[1]) * b[3] for a, b in zip(own, own[1:], strict=False))) < 1e-6


def test_as_of(spark):
    rows, df = series(spark, 300)
    left, right = [r for r in rows if r[2] % 3 == 0 and r[0]], [r for r in rows if r[2] % 3 and r[0]]
    want = {r[2]: max(((x[1], x[3]) for x in right if x[0] == r[0] and x[1] <= r[1]), default=(None, None))[1] for r in left}
    for chunks in (1, 40):
        out = timeseries.as_of(df.filter("id % 3 = 0 and k is not null"), df.filter("id % 3 > 0 and k is not null").select("k", "at", F.col("v").alias("w")), ["k"], "at", "at", ["w"], chunks=chunks)
        assert {r["id"]: r["w"] for r in out.collect()} == want


def test_buckets_and_top(spark):
    _, df = series(spark)
    assert {r["bucket"] for r in timeseries.buckets(df, "at", 100).collect()} == set(range(0, 1000, 100))
    assert timeseries.top(df, "k", F.count(F.lit(1)), 1).first()["k"] == "hot"


def test_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "a")], "origin string, destin string")
    out = graph.reach(e, spark.createDataFrame([("a",)], "v string"), 5)
    assert {(r[0], r[1]) for r in out.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    v = spark.createDataFrame([("b", 1)], "k string, size int")
    assert graph.with_vertex(e, v, "destin", "k", "left").filter("size = 1").count() == 1


def test_stream_into_table(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/base")
    s.execute("create scope st; use st; create type dev (id uint pk, name text); create edge m (origin dev origin, destin dev destin, stamp time stamp, t float)")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text("1;2;2024-01-01;0.5\n1;2;bad;1\n")
    ingest.load_stream(s, str(tmp_path / "in"), "m", f"file://{tmp_path}/ck").awaitTermination()
    (tmp_path / "in/2.csv").write_text("2;1;2024-01-02T00:00:00.000000001;1.5\n")
    ingest.load_stream(s, str(tmp_path / "in"), "m", f"file://{tmp_path}/ck").awaitTermination()
    assert sorted(s.execute("select origin, nano(stamp), t from m")) == [(1, 0, 0.5), (2, 1, 1.5)]


def test_windows_over_a_stream(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = ingest.windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", ["event_type"], {"n": F.count(F.lit(1))})
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()


def test_chunks_are_even_with_outliers(spark):
    """Outlying stamps, a key of that text and a NULL key; most rows within one second."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "\x00null", ""]), rng.randrange(10**9), i) for i in range(3000)] + [("a", -(2**62), 3000), ("a", 2**62, 3001)]
    df = spark.createDataFrame(rows, "k string, at long, id long")
    sizes = [r["count"] for r in timeseries._chunked(df, "at", None, 64).groupBy("__chunk").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 150
    got = {r["id"]: r["prev_id"] for r in timeseries.previous(df, ["k"], "at", ["id"], ["id"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((at, i) for x, at, i in rows if x == k)
        want |= {b[1]: a[1] if a else None for a, b in zip([None, *own], own, strict=False)}
    assert got == want


def test_medians_and_modes_of_hot_groups(spark):
    """Even and odd groups, ties, NULL keys and values, a group without values, one value only."""
    rng = random.Random(11)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([None, *range(-20, 20), 1e300, -1e300]), i) for i in range(2001)] + [("none", None, 1), ("one", 3.5, 1)]
    df = spark.createDataFrame([(k, None if v is None else float(v), i) for k, v, i in rows], "k string, v double, i int")
    want = {k: sorted(float(v) for x, v, _ in rows if x == k and v is not None) for k in {r[0] for r in rows}}
    got = {r[0]: r[1] for r in ranks.median(df, ["k"], "v", "m", 16).collect()}
    assert got == {k: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for k, v in want.items() if v}
    got = {r[0]: r[1] for r in ranks.mode(df, ["k"], "v", "m").collect()}
    assert got == {k: min(v, key=lambda x: (-v.count(x), x)) for k, v in want.items() if v}
    assert ranks.median(df.filter("v is null"), ["k"], "v", "m").collect() == []
    s = Session(spark)
    s.register("t", df, {"k": "k", "v": "v", "i": "i"})
    out = {r["k"]: (r["m"], r["d"], r["n"]) for r in s.sql("select k, median(v) as m, mode(i) as d, count(*) as n from t group by k").collect()}
    assert out["none"] == (None, 1, 1) and out["one"] == (3.5, 1, 1) and len(out) == len(want)
    assert s.sql("select median(v) as m from t where 1 = 0").collect()[0][0] is None
