"""A Spark column with its logical kind. Everything here is built from Spark's own functions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import errors, types

NUMBERS = ("float", "int", "uint", "time")
OPEN = object()


@dataclass(frozen=True)
class Typed:
    """ts: the timestamp_ntz that a time comes from; const: the value of a literal."""

    col: Column
    kind: str
    ts: Column | None = None
    const: Any = OPEN


def ns_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def from_ntz(ts: Column) -> Typed:
    return Typed(ns_of(ts), "time", ts)


def literal(value) -> Typed:
    if value is None:
        return Typed(F.lit(None), "nothing", const=None)
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool", const=value)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), "int" if value < 0 else "uint", const=value)
    if isinstance(value, float):
        return Typed(F.lit(value), "float", const=value)
    return Typed(F.lit(value), "text", const=value)


def as_time(x: Typed) -> Typed:
    """Text literals that are dates become times; whole numbers are nanoseconds."""
    if x.kind == "text" and isinstance(x.const, str) and (ns := types.parse_time(x.const)) is not None:
        return Typed(F.lit(ns).cast("bigint"), "time", const=ns)
    if x.kind in ("int", "uint"):
        return Typed(x.col, "time", const=x.const)
    return x


def div(a: Column, b: Column) -> Column:
    """Whole quotient towards zero."""
    return F.call_function("div", a, b)


def micros(x: Typed) -> Column:
    """Microseconds since the epoch, rounded down."""
    return F.unix_micros(x.ts.cast("timestamp")) if x.ts is not None else div(x.col - F.pmod(x.col, F.lit(1000)), F.lit(1000))


def timestamp(x: Typed) -> Column:
    return x.ts if x.ts is not None else F.timestamp_micros(micros(x)).cast("timestamp_ntz")


def common_kind(a: str, b: str) -> str | None:
    """Of two operands; None if they have none."""
    if "nothing" in (a, b):
        return b if a == "nothing" else a
    if a == b:
        return a
    if a in NUMBERS and b in NUMBERS:
        return next(k for k in ("float", "time", "int", "uint") if k in (a, b))
    return None


def plain(x: Typed, kind: str) -> Column:
    """x as a column of this kind."""
    if x.kind == "nothing":
        return F.lit(None).cast(types.STORED[kind])
    return x.col.cast("double") if kind == "float" and x.kind != "float" else x.col


def numbers(*xs: Typed, what: str) -> str:
    kind = "nothing"
    for x in xs:
        kind = common_kind(kind, x.kind) if x.kind in (*NUMBERS, "nothing") else None
        if kind is None:
            raise errors.TypeMismatchError(f"{what} takes numbers, not {x.kind}")
    return kind if kind != "nothing" else "int"


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    a, b = (as_time(x) if x.kind == "text" else x for x in (a, b))
    kind = numbers(a, b, what=op)
    if op == "^":
        return Typed(F.pow(plain(a, "float"), plain(b, "float")), "float")
    x, y = plain(a, kind), plain(b, kind)
    if kind == "time" and (op in "*/%" or a.kind == b.kind):
        kind = "int"
    if op == "+":
        return Typed(x + y, kind)
    if op == "-":
        return Typed(x - y, "int" if kind == "uint" else kind)
    if op == "*":
        return Typed(x * y, kind)
    if op == "/":
        return Typed(F.try_divide(x, y), kind) if kind == "float" else Typed(F.when(y != 0, div(x, y)), kind)
    if kind == "float":
        raise errors.TypeMismatchError("% takes whole numbers")
    return Typed(F.when(y == 0, F.lit(0).cast("bigint") + x * 0).otherwise(x % y), kind)


def compare(op: str, a: Typed, b: Typed) -> Typed:
    if "time" in (a.kind, b.kind):
        a, b = as_time(a), as_time(b)
    kind = common_kind(a.kind, b.kind)
    if kind is None:
        raise errors.TypeMismatchError(f"types in comparison differ: {a.kind} and {b.kind}")
    if kind in ("text", "bool") and op not in ("=", "!=", "<>"):
        raise errors.TypeMismatchError(f"{op} is not for {kind}")
    if kind == "nothing":
        return Typed(F.lit(None).cast("boolean"), "bool")
    x, y = plain(a, kind), plain(b, kind)
    if a.ts is not None and b.ts is not None:
        x, y = a.ts, b.ts
    elif kind == "time":  # literals are turned to timestamps, so that the filter reaches the scan
        for own, other, swap in ((a, b, False), (b, a, True)):
            if own.ts is not None and isinstance(other.const, int) and other.const % 1000 == 0:
                at = F.lit(types.to_datetime(other.const).replace(tzinfo=None))
                x, y = (at, own.ts) if swap else (own.ts, at)
    return Typed({"=": x == y, "!=": x != y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "bool")


def boolean(x: Typed, what: str) -> Column:
    if x.kind == "nothing":
        return F.lit(None).cast("boolean")
    if x.kind != "bool":
        raise errors.TypeMismatchError(f"{what} is not boolean")
    return x.col


def is_in(a: Typed, values: list[Typed]) -> Typed:
    if a.kind == "time":
        values = [as_time(v) for v in values]
    kind = a.kind
    for v in values:
        if (kind := common_kind(kind, v.kind)) is None:
            raise errors.TypeMismatchError(f"types in list differ: {a.kind} and {v.kind}")
    if a.ts is not None and all(isinstance(v.const, int) and v.const % 1000 == 0 for v in values):
        return Typed(a.ts.isin([types.to_datetime(v.const).replace(tzinfo=None) for v in values]), "bool")
    if all(v.const is not OPEN for v in values):
        return Typed(plain(a, kind).isin([float(v.const) if kind == "float" and v.const is not None else v.const for v in values]), "bool")
    found = F.lit(False)
    for v in values:
        found = found | (plain(a, kind) == plain(v, kind))
    return Typed(found, "bool")


def widened(xs: list[Typed], what: str) -> tuple[str, list[Column], list[Column] | None]:
    """One kind for all branches; also their timestamps, if all have them."""
    if any(x.kind == "time" for x in xs):
        xs = [as_time(x) if x.kind == "text" else x for x in xs]
    kind = "nothing"
    for x in xs:
        if (kind := common_kind(kind, x.kind)) is None:
            raise errors.TypeMismatchError(f"branches of {what} differ in type")
    if kind == "nothing":
        return kind, [x.col for x in xs], None
    ts = [x.ts if x.ts is not None else F.lit(None).cast("timestamp_ntz") for x in xs] if all(x.ts is not None or x.kind == "nothing" for x in xs) and kind == "time" else None
    return kind, [plain(x, kind) for x in xs], ts


def case(whens: list[tuple[Typed, Typed]], other: Typed) -> Typed:
    kind, values, ts = widened([v for _, v in whens] + [other], "CASE")

    def build(cols: list[Column]) -> Column:
        out = None
        for (c, _), v in zip(whens, cols, strict=False):
            out = F.when(boolean(c, "WHEN"), v) if out is None else out.when(boolean(c, "WHEN"), v)
        return out.otherwise(cols[-1])

    return Typed(build(values), kind, build(ts) if ts else None)


def coalesce(xs: list[Typed]) -> Typed:
    kind, values, ts = widened(xs, "COALESCE")
    return Typed(F.coalesce(*values), kind, F.coalesce(*ts) if ts else None)
