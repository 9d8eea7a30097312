"""Stored tables: Parquet, clustered by key; stamped edges in a folder for each period, so that a time range reads only its periods."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors, types
from ..functions.typed import div
from ..plans import ast
from ..plans.planner import Relation
from .catalog import Catalog, Files, Table

PERIOD_NS = 28 * types.DAY
PERIOD = "_period"
# fixed values: names of storage options' compressions and of Parquet's
CODECS = {"zstd": "zstd", "lz4": "lz4", "snappy": "snappy", "gzip": "gzip", "none": "uncompressed", "": "uncompressed"}


def period(stamp: Column) -> Column:
    return div(stamp - F.pmod(stamp, F.lit(PERIOD_NS)), F.lit(PERIOD_NS))


def path(base: str, table: Table) -> str:
    return f"{base}/{table.name}"


def read(files: Files, base: str, table: Table) -> DataFrame:
    """The stored rows; for stamped edges also their period."""
    schema = table.schema
    if table.edge and table.stamp:
        schema = T.StructType([*schema.fields, T.StructField(PERIOD, T.LongType())])
    if not files.exists(path(base, table)):
        return files.spark.createDataFrame([], schema)
    return files.spark.read.schema(schema).parquet(path(base, table))


def append(files: Files, base: str, catalog: Catalog, table: Table, rows: DataFrame, mode: str = "append", to: str | None = None) -> None:
    """Clusters rows as queries want them. Rebalancing splits a hot period among tasks and fills small ones."""
    options = catalog.storages.get(table.storage or "", {})
    rows = rows.select(*(p.name for p in table.properties))
    by = [p.name for p in table.properties if p.origin or p.destin or p.pk]
    writer_by: list[str] = []
    if table.edge and table.stamp:
        rows = rows.withColumn(PERIOD, period(F.col(table.stamp.name))).hint("rebalance", PERIOD)
        writer_by = [PERIOD]
    rows = rows.sortWithinPartitions(*writer_by, *by)
    writer = rows.write.mode(mode).option("compression", CODECS.get(str(options.get("compression", "zstd")).lower(), "zstd"))
    if options.get("largesize"):
        writer = writer.option("maxRecordsPerFile", max(10_000, int(options["largesize"]) // 64))
    (writer.partitionBy(*writer_by) if writer_by else writer).parquet(to or path(base, table))


def replace(files: Files, base: str, catalog: Catalog, table: Table, rows: DataFrame) -> None:
    """Copy on write: the new rows are written aside, then take the table's place."""
    aside = f"{base}/_new-{table.name}-{uuid.uuid4().hex[:8]}"
    append(files, base, catalog, table, rows, "overwrite", aside)
    old = f"{aside}-old"
    if files.exists(path(base, table)):
        files.rename(path(base, table), old)
    files.rename(aside, path(base, table))
    files.remove(old)


def replace_periods(files: Files, base: str, catalog: Catalog, table: Table, gone: list[int], rows: DataFrame, rewritten: list[int]) -> None:
    """Copy on write, for some periods of a stamped edge only: folders of `gone` are removed, those of `rewritten` get these rows instead."""
    target = path(base, table)
    aside = f"{base}/_new-{table.name}-{uuid.uuid4().hex[:8]}"
    if rewritten:
        append(files, base, catalog, table, rows, "overwrite", aside)
    for k in [*gone, *rewritten]:
        folder = f"{PERIOD}={k}"
        files.rename(f"{target}/{folder}", f"{aside}-old-{k}")
        if k in rewritten:
            files.rename(f"{aside}/{folder}", f"{target}/{folder}")
        files.remove(f"{aside}-old-{k}")
    files.remove(aside)


def bounds(e, stamp: str) -> tuple[int, int]:
    """Least and greatest stamp that a condition can let through."""
    low, high = types.DAWN, types.DUSK
    if isinstance(e, ast.Bin) and e.op == "and":
        for side in (e.a, e.b):
            x, y = bounds(side, stamp)
            low, high = max(low, x), min(high, y)
    elif isinstance(e, ast.Bin) and e.op == "or":
        (a, b), (x, y) = bounds(e.a, stamp), bounds(e.b, stamp)
        return min(a, x), max(b, y)
    elif isinstance(e, ast.Bin) and e.op in ("=", "<", ">", "<=", ">="):
        op, a, b = e.op, e.a, e.b
        if isinstance(b, ast.Field):
            op, a, b = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), b, a
        if isinstance(a, ast.Field) and a.name == stamp and isinstance(b, ast.Lit):
            ns = types.parse_time(b.value) if isinstance(b.value, str) else b.value if isinstance(b.value, int) and not isinstance(b.value, bool) else None
            if ns is not None:
                if op in ("=", ">", ">="):
                    low = ns
                if op in ("=", "<", "<="):
                    high = ns
    return low, high


def relation(files: Files, base: str, table: Table) -> Relation:
    df = read(files, base, table)
    fields = {p.name: p.kind for p in table.properties}

    def prune(q: ast.Select) -> Column | None:
        low, high = bounds(q.where, table.stamp.name) if q.where is not None else (types.DAWN, types.DUSK)
        if low > types.DAWN or high < types.DUSK:
            return F.col(PERIOD).between(low // PERIOD_NS, high // PERIOD_NS)
        return None

    return Relation(df, fields, prune if table.edge and table.stamp else None, table.pk.name if table.pk else None)


def checked(catalog: Catalog, table: Table, fields: list[str] | None, values: list) -> dict:
    """One row for an insert; names the fields that an edge must have or must not have."""
    names = fields or [p.name for p in table.properties]
    if len(names) != len(values) or len(set(names)) != len(names):
        raise errors.InvalidError(f"{len(names)} fields, {len(values)} values" if len(names) != len(values) else "a field occurs twice")
    row = {p.name: None for p in table.properties}
    for n, v in zip(names, values, strict=True):
        row[n] = types.stored(v, table.find(n).kind, n)
    for p in table.properties:
        if row[p.name] is None and (p.pk or p.origin or p.destin or p.stamp and table.edge):
            raise errors.InvalidError(f"{p.name} is missing in {table.name}")
    return row
