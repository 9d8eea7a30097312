"""Shared pieces: reading tables, Arrow batches of bounded size, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of one Arrow batch sent to a Python worker; long texts hit the byte bound first.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table through Spark (the path may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches, so that a Python worker holds a few MB of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies f to each Arrow batch of df."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def stream_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """As map_arrow, but f sees the whole partition as a stream of batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def utf8(column: str):
    """The text's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all tasks run in this process (local tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and (set_by_user := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        where = set_by_user.get()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


class Scratch:
    """Tables written under the shared folder. Reading one back cuts the lineage, and lost executors lose nothing of it.

    drop() removes a table as soon as nothing needs it; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def drop_but(self, *names: str) -> None:
        """Removes all tables but these."""
        for found in self._fs.listStatus(self._path(self.root)):
            if found.getPath().getName() not in names:
                self._fs.delete(found.getPath(), True)


def pack_text(b: pa.Array) -> pa.Array:
    """Deflates each value, so that a shuffle of whole texts moves about a third of the bytes."""
    return pa.array([None if x is None else zlib.compress(x, 1) for x in b.to_pylist()], pa.binary())


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n (JVM side)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def held_out(column: str, n: int, rest: int):
    """Whether a row is kept from learning; a row without an id isn't."""
    return F.coalesce(crc_mod(column, n) == rest, F.lit(False)).alias("held_out")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Runs of equal values in the first `keys` columns, each as lists of its columns."""
    held: list[list] | None = None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        heads = list(zip(*columns[:keys], strict=True))
        cut = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
        for i, j in zip(cut, cut[1:], strict=False):
            part = [c[i:j] for c in columns]
            if held is not None and all(h[0] == p[0] for h, p in zip(held[:keys], part[:keys], strict=True)):
                for h, p in zip(held, part, strict=True):
                    h.extend(p)
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held
