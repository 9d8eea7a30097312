"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Field:
    name: str
    of: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False
    distinct: bool = False


@dataclass(frozen=True)
class Bin:
    op: str
    a: Any
    b: Any


@dataclass(frozen=True)
class Un:
    """not, just, or -."""

    op: str
    a: Any


@dataclass(frozen=True)
class In:
    a: Any
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class InQuery:
    a: Any
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    query: Select


@dataclass(frozen=True)
class Scalar:
    """A query of one column and at most one row, as a value."""

    query: Select


@dataclass(frozen=True)
class IsNull:
    a: Any
    negated: bool


@dataclass(frozen=True)
class Case:
    whens: tuple
    other: Any


@dataclass(frozen=True)
class Item:
    """Of a projection: an expression (None: *) and its name."""

    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    table: str
    on: str
    how: str
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple
    table: str | None = None
    alias: str | None = None
    joins: tuple = ()
    where: Any = None
    group: tuple = ()
    having: Any = None
    order: tuple = ()
    limit: int | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Statement:
    """Everything that isn't a query. what: two words, such as 'create type'."""

    what: str
    name: str = ""
    args: dict = field(default_factory=dict)
