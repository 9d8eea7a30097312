"""Bulk loading of delimited text: typed, with rejected rows reported by line number."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from . import tables
from .catalog import Catalog, Files, Table

#: Values of this many bytes or more are rejected.
TOO_LONG = 1023
TIME = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,9})?)?$"


@dataclass
class Report:
    """Rows that went in, rows rejected, microseconds."""

    affected: int
    errors: int
    runtime: int


def parse_time(text: Column) -> Column:
    """Nanoseconds of a date or a date and time, NULL for anything else."""
    whole = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(F.substring(text, 1, 19))
    seconds = F.unix_seconds(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    part = F.rpad(F.coalesce(F.nullif(F.regexp_extract(text, r"\.(\d{1,9})$", 1), F.lit("")), F.lit("0")), 9, "0").cast("bigint")
    return F.when(text.rlike(TIME), seconds * F.lit(1_000_000_000) + part)


def unescaped(text: Column) -> Column:
    """Backslash escapes of a field; the double backslash is kept apart meanwhile."""
    out = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\'", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def converted(text: Column, kind: str) -> Column:
    """A field's text as its kind; NULL if it isn't one."""
    if kind == "text":
        return unescaped(text)
    if kind == "time":
        return F.coalesce(parse_time(text), F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint")))
    if kind == "float":
        return text.try_cast("double")
    if kind == "bool":
        return text.try_cast("boolean")
    if kind == "uint":
        return F.when(text.rlike(r"^\+?\d+$"), text.try_cast("bigint"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def numbered(lines: DataFrame) -> DataFrame:
    """value, line (from 1). The numbers of lines in the input splits are summed up and joined; the table has a row a split."""
    lines = lines.select("value", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    before = F.sum("count").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = lines.groupBy("pid").count().select("pid", F.coalesce(before, F.lit(0)).alias("start"))
    return lines.join(starts, "pid").select("value", (F.col("k") + F.col("start") + 1).alias("line"))


def typed(lines: DataFrame, table: Table, columns: list[str], skip: int, sep: str) -> DataFrame:
    """The table's columns, __line, __text, and __reason (NULL for good rows)."""
    parts = F.from_csv(F.col("value"), F.lit(", ".join(f"f{i} string" for i in range(len(columns) + 1))), {"sep": sep, "nullValue": "\x00", "emptyValue": "", "escape": "\x00"})
    rows = lines.filter((F.col("line") > skip) & (F.trim("value") != "")).select(F.col("value").alias("__text"), F.col("line").alias("__line"), parts.alias("f"))
    rows = rows.select("__text", "__line", *(F.when(F.col(f"f.f{i}") == "", None).otherwise(F.col(f"f.f{i}")).alias(f"f{i}") for i in range(len(columns) + 1)))
    reason, values = F.when(F.col(f"f{len(columns)}").isNotNull(), F.lit("too many fields")), {}
    for i, name in enumerate(columns):
        p, text = table.find(name), F.col(f"f{i}")
        values[name] = converted(text, p.kind).alias(name)
        must = p.pk or p.origin or p.destin or (p.stamp and table.edge)
        reason = reason.when(F.octet_length(text) >= TOO_LONG, F.lit(f"{name} is too long")).when(text.isNotNull() & converted(text, p.kind).isNull(), F.lit(f"{name} is not a {p.kind}"))
        if must:
            reason = reason.when(text.isNull(), F.lit(f"{name} is missing"))
    missing = [F.lit(None).cast(p_type).alias(n) for n, p_type in ((f.name, f.dataType) for f in table.schema.fields) if n not in columns]
    return rows.select("__text", "__line", *values.values(), *missing, reason.alias("__reason"))


def load(files: Files, base: str, catalog: Catalog, table: Table, source: str, header: str | None, errors_to: str | None = None, sep: str = ";") -> Report:
    began = time.time()
    if not files.exists(source):
        raise errors.BadPathError(source)
    lines = numbered(files.spark.read.text(source))
    columns, skip = [p.name for p in table.properties], 0
    if header:
        skip = 1
        first = files.spark.read.text(source).first()
        if header == "use" and first:
            columns = [c.strip().strip('"') for c in first[0].split(sep)]
            for c in columns:
                table.find(c)
    rows = typed(lines, table, columns, skip, sep)
    for p in table.properties:
        if p.name not in columns and (p.pk or p.origin or p.destin or (p.stamp and table.edge)):
            raise errors.LoaderError(f"{p.name} is not in the file")
    if table.pk:  # unique in the file (the first line counts) and in the table
        pk = table.pk.name
        good = F.col("__reason").isNull()
        order = Window.partitionBy(F.when(good, F.col(pk)), F.when(~good, F.col("__line"))).orderBy("__line")
        rows = rows.withColumn("__reason", F.when(good & (F.row_number().over(order) > 1), F.lit(f"duplicate key in {pk}")).otherwise(F.col("__reason")))
        there = tables.read(files, base, table).select(F.col(pk).alias("__there")).distinct()
        rows = rows.join(there, F.col(pk) == F.col("__there"), "left")
        rows = rows.withColumn("__reason", F.when(F.col("__reason").isNull() & F.col("__there").isNotNull(), F.lit(f"duplicate key in {pk}")).otherwise(F.col("__reason"))).drop("__there")
    # one pass over the text for good and bad rows: typed rows are written once, and read back for both
    aside = f"{base}/_load-{int(began * 1e6)}"
    try:
        rows.write.parquet(aside)
        done = files.spark.read.schema(rows.schema).parquet(aside)
        counts = done.agg(F.count(F.when(F.col("__reason").isNull(), 1)), F.count("__reason")).first()
        tables.append(files, base, catalog, table, done.filter("__reason is null"))
        if errors_to:
            done.filter("__reason is not null").select(F.concat_ws(": ", F.concat(F.lit("line "), F.col("__line").cast("string")), "__reason", "__text").alias("value")).write.mode("overwrite").text(errors_to)
    finally:
        files.remove(aside)
    return Report(counts[0], counts[1], int((time.time() - began) * 1e6))


