"""Logical types, and time as nanoseconds.

Kinds: text, time, float, int, uint, bool, and nothing (the kind of a bare NULL). A time is stored as nanoseconds since the
epoch (bigint) in our own tables; tables from elsewhere may hold timestamp_ntz (microseconds).
"""

from __future__ import annotations

import calendar
import re
import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import types as T

from . import errors

KINDS = {"text": "text", "longtext": "text", "date": "time", "time": "time", "float": "float", "int": "int", "integer": "int", "uint": "uint", "uinteger": "uint", "bool": "bool"}
STORED = {"text": T.StringType(), "time": T.LongType(), "float": T.DoubleType(), "int": T.LongType(), "uint": T.LongType(), "bool": T.BooleanType()}
DAWN, DUSK, EPOCH = -(2**63), 2**63 - 1, 0
#: Durations in nanoseconds.
NANO, MICRO, MILLI, SECOND = 1, 10**3, 10**6, 10**9
MINUTE, HOUR, DAY, WEEK = 60 * SECOND, 3600 * SECOND, 86400 * SECOND, 7 * 86400 * SECOND
TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?)?")


def kind_of(dtype: T.DataType) -> str:
    """The kind of a column that isn't ours."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "time"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    return "bool" if isinstance(dtype, T.BooleanType) else "text"


def parse_time(text: str) -> int | None:
    """Nanoseconds of a date or a date and time (UTC); None if the text is neither."""
    m = TIME.fullmatch(text)
    if not m:
        return None
    y, mo, d, h, mi, s = (int(x or 0) for x in m.groups()[:6])
    if not (1 <= mo <= 12 and 1 <= d <= calendar.monthrange(max(y, 1), mo)[1] and h < 24 and mi < 60 and s <= 60):
        return None
    ns = calendar.timegm((y, mo, d, h, mi, s)) * SECOND + int((m[7] or "").ljust(9, "0") or 0)
    return ns if DAWN <= ns <= DUSK else None


def format_time(ns: int) -> str:
    """As parse_time reads it; a fraction (nine digits) only where there is one."""
    s, frac = divmod(ns, SECOND)
    at = datetime(1970, 1, 1) + timedelta(seconds=s)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{frac:09d}" if frac else "")


def to_ns(value: datetime) -> int:
    """A datetime without zone counts as UTC."""
    value = value if value.tzinfo else value.replace(tzinfo=UTC)
    d = value - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * SECOND + d.microseconds * MICRO


def to_datetime(ns: int) -> datetime:
    """UTC, cut to microseconds."""
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=ns // MICRO)


def now() -> int:
    return time.time_ns()


def round_time(ns: int, unit: int) -> int:
    """The start of the unit that ns is in."""
    return ns - ns % unit


def stored(value, kind: str, name: str):
    """A Python value as an insert into a field of this kind takes it. int goes to float and time, uint (not negative) to all three, text to time."""
    if value is None:
        return None
    if kind == "time":
        if isinstance(value, str):
            value = parse_time(value)
        elif isinstance(value, datetime):
            value = to_ns(value)
    ok = {"text": isinstance(value, str), "float": isinstance(value, (int, float)) and not isinstance(value, bool), "bool": isinstance(value, bool)}.get(kind, isinstance(value, int) and not isinstance(value, bool))
    if not ok or kind == "uint" and value < 0 or kind in ("int", "uint", "time") and not DAWN <= value <= DUSK:
        raise errors.TypeMismatchError(f"{value!r} is not a {kind} for {name}")
    return float(value) if kind == "float" else value
