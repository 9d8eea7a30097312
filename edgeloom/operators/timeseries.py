"""Time series of each key: previous values, differences, integrals, buckets, as-of joins.

A key may hold a third of all rows, so nothing here sorts a whole key in one task. Rows are cut into chunks at quantiles
of the ordering value; a window runs over (key, chunk), and what a chunk needs from those before it, its predecessor's last row,
comes from a table with one row for each key and chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.typed import div

#: So many chunks hold about as many rows each; only rows with one and the same ordering value can't be parted.
CHUNKS = 256


def place(at: Column, cuts: list[float], first: int = 0) -> Column:
    """How many of the ascending cuts are at most `at`, by halving."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    return F.when(at < F.lit(cuts[k]), place(at, cuts[:k], first)).otherwise(place(at, cuts[k + 1 :], first + k + 1))


def _chunked(df: DataFrame, order: str, width: int | None, chunks: int) -> DataFrame:
    """df with __chunk, ascending with `order`; NULL comes first. Without a width the borders are quantiles of the values, so outlying ones take nothing from the rest."""
    at = F.col(order)
    if width is not None:
        return df.withColumn("__chunk", F.floor(at / width).cast("long"))
    found = df.agg(F.percentile_approx(order, [i / chunks for i in range(1, chunks)], 20 * chunks)).first()[0]
    cuts = sorted(set(found or []))
    return df.withColumn("__chunk", F.when(at.isNull(), F.lit(-1)).otherwise(place(at, cuts)).cast("long"))


def previous(df: DataFrame, keys: list[str], order: str, values: list[str], ties: list[str] = (), width: int | None = None, chunks: int = CHUNKS) -> DataFrame:
    """df with prev_<v> of each of `values`: that of the row before in the order of `order` (numbers), then `ties`, within the keys (NULL for the first). NULL keys are a key."""
    cut = _chunked(df, order, width, chunks)
    by = [x for i, k in enumerate(keys) for x in (F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__g{i}"), F.col(k).isNull().alias(f"__n{i}"))]
    cut = cut.select("*", *by)
    g = [f"__{x}{i}" for i in range(len(keys)) for x in "gn"]
    here = Window.partitionBy(*g, "__chunk").orderBy(F.col(order).asc_nulls_first(), *ties)
    rows = cut.withColumns({f"prev_{v}": F.lag(v).over(here) for v in values} | {"__n": F.row_number().over(here)})
    last = F.max(F.struct(F.col(order).alias("__at"), *(F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)), *(F.col(v).alias(f"__v{i}") for i, v in enumerate(values))))
    ends = cut.groupBy(*g, "__chunk").agg(last.alias("__last"))
    back = Window.partitionBy(*g).orderBy(F.col("__chunk").asc_nulls_first())
    ends = ends.select(*g, "__chunk", F.lag("__last").over(back).alias("__last")).filter("__last is not null").withColumn("__n", F.lit(1))
    joined = rows.alias("r").join(
        ends.alias("e"), [F.col(f"r.{x}") == F.col(f"e.{x}") for x in g] + [F.col("r.__chunk").eqNullSafe(F.col("e.__chunk")), F.col("r.__n") == F.col("e.__n")], "left"
    )
    filled = {v: F.when(F.col("r.__n") == 1, F.col(f"e.__last.__v{i}")).otherwise(F.col(f"r.prev_{v}")) for i, v in enumerate(values)}
    return joined.select(*(F.col(f"r.`{c}`").alias(c) for c in df.columns), *(c.alias(f"prev_{v}") for v, c in filled.items()))


def differences(df: DataFrame, keys: list[str], order: str, value: str, ties: list[str] = (), name: str = "diff", **how) -> DataFrame:
    """df with value - previous value."""
    out = previous(df, keys, order, [value], ties, **how)
    return out.withColumn(name, F.col(value) - F.col(f"prev_{value}")).drop(f"prev_{value}")


def integral(df: DataFrame, keys: list[str], x: str, y: str, name: str = "integral", ties: list[str] = (), **how) -> DataFrame:
    """For each key the sum of (x - previous x) * y in the order of x; a key with one row has 0."""
    rows = previous(df, keys, x, [x], ties, **how)
    out = rows.groupBy(*keys).agg(F.coalesce(F.sum((F.col(x) - F.col(f"prev_{x}")) * F.col(y)), F.lit(0.0)).alias(name))
    return out.select(*keys, name)


def buckets(df: DataFrame, stamp: str, width_ns: int, name: str = "bucket") -> DataFrame:
    """df with the start of the bucket of a time in nanoseconds."""
    return df.withColumn(name, F.col(stamp) - F.pmod(F.col(stamp), F.lit(width_ns)))


def top(df: DataFrame, key: str, measure, n: int, name: str = "measure") -> DataFrame:
    """The n keys with the largest aggregate, ties by key. Spark keeps n rows a task."""
    return df.groupBy(key).agg(measure.alias(name)).orderBy(F.col(name).desc(), F.col(key)).limit(n)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], width: int | None = None, chunks: int = CHUNKS) -> DataFrame:
    """left with those `values` of right's last row at or before it, of the same keys; NULL if there is none. Ties in right: the largest values.

    One union, then as in previous(): windows over (key, chunk), and one row a chunk for what comes from before.
    """
    a = left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("__r"))
    b = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*values).alias("__r"))
    cut = _chunked(a.unionByName(b), "__at", width, chunks)
    here = Window.partitionBy(*keys, "__chunk").orderBy("__at", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("__r", F.last("__r", True).over(here)).filter("__side = 1")
    ends = cut.filter("__side = 0").groupBy(*keys, "__chunk").agg(F.max(F.struct("__at", "__r")).alias("__e"))
    marks = cut.select(*keys, "__chunk").distinct().join(ends, [*keys, "__chunk"], "left")
    back = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*keys, "__chunk", F.last("__e.__r", True).over(back).alias("__before"))
    out = rows.join(marks, [*keys, "__chunk"], "left").withColumn("__r", F.coalesce("__r", "__before"))
    return out.select("__l.*", *(F.col(f"__r.`{v}`").alias(v) for v in values))
