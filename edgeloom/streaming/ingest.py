"""Structured Streaming: folders of delimited text into a table, and windows over stamped edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import Session
from ..sources import loader, tables


def load_stream(session: Session, folder: str, name: str, checkpoint: str, columns: list[str] | None = None, sep: str = ";", errors_to: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Appends each new file of the folder to the table, batch by batch; fields in `columns`' order, no header.

    A batch is written to a folder named by its number and its files are then moved to the table. A batch that runs again
    after a failure moves what isn't moved yet, or does nothing if its mark is there, so no row comes twice. Keys of types
    are checked against the table; rows that repeat one go to the errors with those that can't be read. trigger: as of
    writeStream.trigger (default: what is there now, then stop).
    """
    table = session._current().table(name)
    columns = columns or [p.name for p in table.properties]
    lines = session.spark.readStream.schema("value string").text(folder)

    def batch(df: DataFrame, number: int) -> None:
        mark = f"{checkpoint}/loaded/{number}"
        if session.files.exists(mark):
            return
        aside, typed = f"{checkpoint}/batch-{number}", f"{checkpoint}/typed-{number}"
        if not session.files.exists(f"{aside}/_SUCCESS"):
            rows = loader.typed(df.select("value", F.lit(1).cast("bigint").alias("line")), table, columns, 0, sep)
            if table.pk:
                pk = table.pk.name
                there = tables.read(session.files, session._base, table).select(F.col(pk).alias("__there")).distinct()
                first = F.row_number().over(Window.partitionBy(pk, F.col("__reason").isNull(), F.when(F.col("__reason").isNotNull(), F.monotonically_increasing_id())).orderBy("__text"))
                rows = rows.withColumn("__n", first).join(there, F.col(pk) == F.col("__there"), "left")
                again = F.col("__reason").isNull() & (F.col("__there").isNotNull() | (F.col("__n") > 1))
                rows = rows.withColumn("__reason", F.when(again, F.lit(f"duplicate key in {pk}")).otherwise(F.col("__reason"))).drop("__there", "__n")
            rows.write.mode("overwrite").parquet(typed)
            rows = session.spark.read.schema(rows.schema).parquet(typed)
            if errors_to:
                rows.filter("__reason is not null").select(F.concat_ws(": ", "__reason", "__text").alias("value")).write.mode("overwrite").text(f"{errors_to}/batch-{number}")
            tables.append(session.files, session._base, session._current(), table, rows.filter("__reason is null"), "overwrite", aside)
        session.files.move_files(aside, tables.path(session._base, table))
        session.files.write(mark, "")
        session.files.remove(aside)
        session.files.remove(typed)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, stamp: str, length: str, late: str, keys: list[str], aggregates: dict[str, Column], slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows over event time; rows later than `late` are left out."""
    w = F.window(stamp, length, slide) if slide else F.window(stamp, length)
    out = stream.withWatermark(stamp, late).groupBy(w.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sessions(stream: DataFrame, stamp: str, gap: str, late: str, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Windows that end after a gap without rows."""
    out = stream.withWatermark(stamp, late).groupBy(F.session_window(stamp, gap).alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)
