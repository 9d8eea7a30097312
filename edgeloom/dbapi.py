"""PEP 249 over a session. Parameters are written as literals, quoted; fields that are times come as datetimes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession

from . import errors, types
from .session import Session

apilevel, threadsafety, paramstyle = "2.0", 1, "format"


class Warning(Exception):  # noqa: A001
    pass


class Error(Exception):
    pass


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


# the library's errors by class here; the rest are DatabaseError
KINDS = {2: DataError, 9: NotSupportedError, 27: IntegrityError, 28: IntegrityError, 60: ProgrammingError, 73: ProgrammingError, 78: ProgrammingError, 36: OperationalError, 75: OperationalError}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime):
        return str(types.to_ns(value))
    if isinstance(value, float):
        return format(value, "f") if "e" in repr(value) else repr(value)
    if isinstance(value, int):
        return str(value)
    text = str(value)
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f"'{text}'"


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.result, self.format = connection, None, "tuple"
        self.description, self.rowcount = None, -1

    def execute(self, operation: str, parameters=None) -> Cursor:
        text = operation % tuple(map(literal, parameters)) if parameters is not None else operation
        try:
            self.result = self.connection.session.execute(text)
        except errors.EngineError as e:
            raise KINDS.get(e.code, DatabaseError)(str(e)) from e
        df, report = self.result.df, self.result.report
        self._times = [types.kind_of(f.dataType) == "time" for f in df.schema.fields] if df is not None else []
        self.description = [(f.name, types.kind_of(f.dataType), None, None, None, None, True) for f in df.schema.fields] if df is not None else None
        self.rowcount = report.affected if report else -1
        return self

    def executemany(self, operation: str, seq_of_parameters) -> None:
        raise NotSupportedError("executemany")

    def setRowFormat(self, name: str) -> None:  # noqa: N802
        if name not in ("tuple", "list", "dict"):
            raise InterfaceError(f"no row format {name}")
        self.format = name

    def _row(self, row: tuple):
        values = [types.to_datetime(v) if t and v is not None else v for v, t in zip(row, self._times or [False] * len(row), strict=True)]
        if self.format == "dict":
            return dict(zip([d[0] for d in self.description], values, strict=True))
        return list(values) if self.format == "list" else tuple(values)

    def fetchmany(self, size: int | None = None) -> list:
        if self.result is None:
            raise InterfaceError("nothing was executed")
        return [self._row(r) for r in self.result.fetch(size or self.arraysize)]

    def fetchone(self):
        got = self.fetchmany(1)
        return got[0] if got else None

    def fetchall(self) -> list:
        out = []
        while got := self.fetchmany(10_000):
            out += got
        return out

    def __iter__(self):
        while (row := self.fetchone()) is not None:
            yield row

    def setinputsizes(self, sizes) -> None:
        pass

    def setoutputsize(self, size, column=None) -> None:
        pass

    def close(self) -> None:
        if self.result is not None:
            self.result.release()
        self.result = None


class Connection:
    def __init__(self, session: Session):
        self.session = session

    def cursor(self) -> Cursor:
        if self.session.closed:
            raise InterfaceError("the connection is closed")
        return Cursor(self)

    def commit(self) -> None:
        """Writes rows that wait; there are no transactions."""
        self.session.flush()

    def rollback(self) -> None:
        """There are no transactions."""

    def close(self) -> None:
        self.session.close()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def connect(spark: SparkSession, base: str, scope: str | None = None, **options) -> Connection:
    try:
        return Connection(Session(spark, base, scope, **options))
    except errors.EngineError as e:
        raise OperationalError(str(e)) from e
