"""Following edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import own_dir


def with_vertex(edge: DataFrame, vertex: DataFrame, on: str, pk: str, how: str = "inner") -> DataFrame:
    """An edge joined with the vertices at one of its ends. Spark broadcasts the vertices only if they are below its size threshold."""
    clash = set(edge.columns)
    renamed = vertex.select(*(F.col(c).alias(f"{on}_{c}" if c in clash else c) for c in vertex.columns if c != pk), F.col(pk).alias("__pk"))
    return edge.join(renamed, F.col(on) == F.col("__pk"), how).drop("__pk")


def reach(edge: DataFrame, start: DataFrame, hops: int, origin: str = "origin", destin: str = "destin") -> DataFrame:
    """(vertex, hops) of all vertices that at most `hops` edges lead to from `start` (its first column), with the fewest hops.

    One shuffle join a hop; each frontier is written to the shared folder and read back, so lineage and lost executors
    cost no earlier hop.
    """
    spark, base = edge.sparkSession, own_dir(edge.sparkSession, "reach")
    links = edge.select(F.col(origin).alias("a"), F.col(destin).alias("b")).filter("a is not null and b is not null").distinct()
    seen = start.select(F.col(start.columns[0]).alias("vertex"), F.lit(0).alias("hops")).distinct()
    front = seen
    for k in range(1, hops + 1):
        new = front.join(links, F.col("vertex") == F.col("a")).select(F.col("b").alias("vertex")).distinct()
        front = new.join(seen.select("vertex"), "vertex", "left_anti").withColumn("hops", F.lit(k))
        front.write.parquet(f"{base}/{k}")
        front = spark.read.schema(front.schema).parquet(f"{base}/{k}")
        seen = seen.unionByName(front)
    return seen
