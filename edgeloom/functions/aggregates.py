"""Aggregates by name. All but median and mode combine partial results before the shuffle in constant space; a median or mode
that is an item of a query of its own is planned apart (operators/ranks.py), and comes here only within other expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import errors
from .typed import Typed, numbers, plain

# fixed values: names that stand for another aggregate
ALIASES = {"average": "avg", "product": "prod"}
NAMES = {"count", "sum", "prod", "product", "max", "min", "spread", "avg", "average", "median", "stddev", "mode", "integral"}


def aggregate(name: str, x: Typed | None, distinct: bool = False, empty_zero: bool = False) -> Typed:
    """x: the argument (None for *). count counts rows whatever its argument is; the other aggregates pass over NULL."""
    name = ALIASES.get(name, name)
    if name == "count":
        return Typed(F.count_distinct(x.col) if distinct else F.count(F.lit(1)), "uint")
    if x is None or distinct:
        raise errors.FunctionError(f"{name} takes an expression")
    if name == "mode":
        return Typed(F.mode(x.col, True), x.kind, F.mode(x.ts, True) if x.ts is not None else None)
    if name in ("min", "max") and x.kind in ("time", "text"):
        f = F.min if name == "min" else F.max
        return Typed(f(x.col), x.kind, f(x.ts) if x.ts is not None else None)
    kind = numbers(x, what=name)
    v = plain(x, kind)
    if name == "sum":
        return Typed(F.sum(v), kind)
    if name == "prod":
        return Typed(F.product(v.cast("double")) if kind == "float" else F.product(v.cast("double")).try_cast("bigint"), kind)
    if name in ("min", "max"):
        return Typed((F.min if name == "min" else F.max)(v), kind)
    if name == "spread":
        return Typed(F.max(v) - F.min(v), "int" if kind == "time" else kind)

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0)) if empty_zero else c

    if name == "avg":
        return Typed(zero(F.avg(v)), "float")
    if name == "median":
        return Typed(zero(F.median(v.cast("double"))), "float")
    if name == "stddev":
        return Typed(F.coalesce(F.stddev_samp(v.cast("double")), F.lit(0.0)), "float")
    raise errors.UnknownSymbolError(f"no aggregate {name}")
