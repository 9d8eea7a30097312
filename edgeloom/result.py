"""What statements give: a status, a report, a row or a cursor."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame

from . import errors, types
from .sources.loader import Report


def client(value: Any) -> Any:
    """As clients get it: times in nanoseconds."""
    return types.to_ns(value) if isinstance(value, datetime) else value


class Result:
    """kind: status, report, row or cursor. Iterating gives tuples; df is the DataFrame behind a cursor."""

    def __init__(self, kind: str, df: DataFrame | None = None, report: Report | None = None, value: Any = None):
        self.kind, self.df, self.report, self.value, self.id = kind, df, report, value, 0
        self.columns: list[str] = df.columns if df is not None else []
        self._rows: Iterator | None = None
        self._current: tuple | None = None
        self.eof = False

    def ok(self) -> bool:
        return True

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.next_row()) is not None:
            yield row

    def next_row(self) -> tuple | None:
        got = self.fetch(1)
        self._current = got[0] if got else None
        return self._current

    def fetch(self, n: int) -> list[tuple]:
        """The next n rows at most. Partitions come to the driver one at a time."""
        if self._rows is None:
            self._rows = iter([self.value] if self.df is None and self.kind == "row" else self.df.toLocalIterator() if self.df is not None else [])
        got = [tuple(map(client, r)) for r in islice(self._rows, n)]
        self.eof = len(got) < n
        return got

    def field(self, k: int) -> Any:
        if self._current is None:
            raise errors.EofError("no row")
        return self._current[k]

    def count(self) -> int:
        return len(self.columns)

    def one_row(self) -> tuple:
        row = self.next_row()
        if row is None:
            raise errors.EofError("no row")
        return row

    def one_value(self) -> Any:
        return self.one_row()[0]

    def to_pandas(self, limit: int | None = None):
        return (self.df if limit is None else self.df.limit(limit)).toPandas()

    def release(self) -> None:
        self._rows, self.eof = iter([]), True
