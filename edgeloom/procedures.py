"""Procedures that come with the engine: session.register_module("own", procedures), then CREATE PROCEDURE own.<name>(...) LANGUAGE python. Each gets the session first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import errors, types
from .operators import timeseries


def groupbuy(session, edge: str, value: str, destin) -> DataFrame:
    """For each origin of the edges to one destination: count, sum, average, least, greatest, spread of a field."""
    r = session.table(edge).filter(F.col("destin") == F.lit(destin))
    v = F.col(value)
    return r.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("spread"))


def revenue(session, edge: str, value: str, day: int, n: int = 3) -> DataFrame:
    """The n origins with the largest sum of a field on the day of a time (nanoseconds)."""
    first = types.round_time(day, types.DAY)
    q = f"select origin, sum({value}) as revenue from {edge} where stamp >= {first} and stamp < {first + types.DAY} group by origin order by revenue desc, origin limit {n}"
    return session.sql(q)


def gettimeseries(session, edge: str, value: str, origin) -> DataFrame:
    """(stamp, value) of one origin in the order of time."""
    return session.table(edge).filter(F.col("origin") == F.lit(origin)).select("stamp", F.col(value).alias("value")).orderBy("stamp", "value")


def differences(session, edge: str, value: str, ties: str) -> DataFrame:
    """(origin, ties, diff): each value less the one before of the same origin."""
    rows = session.table(edge).select("origin", ties, F.unix_micros(F.col("stamp").cast("timestamp")).alias("at"), F.col(value).alias("value"))
    return timeseries.differences(rows, ["origin"], "at", "value", [ties]).select("origin", ties, "diff")


def nextid(session, name: str) -> int:
    """The next of a scope's numbers of this name, from 1 on; unique over sessions, as the number is kept beside the tables under a lock."""
    if not name.isidentifier():
        raise errors.BadNameError(name)
    path, lock = f"{session._base}/_number-{name}", f"number_{name}"
    session.execute(f"create lock {lock} if not exists")
    with session.with_lock(lock):
        n = int(session.files.read(path)) + 1 if session.files.exists(path) else 1
        session.files.write(path, str(n))
    return n
