"""From a query's syntax tree to a DataFrame. Catalyst does the rest: pushdown, pruning, folding, join strategy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors, types
from ..functions import aggregates, scalar, typed
from ..functions.typed import Typed
from ..operators import ranks, timeseries
from . import ast


@dataclass
class Relation:
    """A table as queries see it. fields: name -> kind; physical timestamps are known by their Spark type. keys: origin and destin of an edge, or the PK."""

    df: DataFrame
    fields: dict[str, str]
    prune: Callable[[ast.Select], Column | None] | None = None
    pk: str | None = None


class Scope:
    """Names that an expression may use."""

    def __init__(self, relations: list[tuple[str | None, Relation]]):
        self.relations = relations

    def field(self, f: ast.Field) -> Typed:
        found = [(k, r) for k, (alias, r) in enumerate(self.relations) if f.name in r.fields and f.of in (None, alias)]
        if f.of is not None and not any(a == f.of for a, _ in self.relations):
            raise errors.NoSuchTableError(f.of)
        if not found:
            raise errors.KeyNotFoundError(f"no field {f.name}")
        if len(found) > 1 and f.of is None:
            raise errors.BadNameError(f"{f.name} is in more than one table")
        k, r = found[0]
        col = F.col(f"t{k}.`{f.name}`")
        kind = r.fields[f.name]
        dtype = r.df.schema[f.name].dataType
        if kind == "time" and dtype.typeName() in ("timestamp_ntz", "timestamp", "date"):
            return typed.from_ntz(col.cast("timestamp_ntz") if dtype.typeName() != "timestamp_ntz" else col)
        if kind == "int" or kind == "uint":
            return Typed(col if dtype.typeName() == "long" else col.cast("bigint"), kind)
        return Typed(col if dtype == types.STORED[kind] else col.cast(types.STORED[kind]), kind)

    def all(self) -> list[tuple[str, Typed]]:
        return [(n, self.field(ast.Field(n, alias))) for alias, r in self.relations for n in r.fields]


def has_aggregate(e) -> bool:
    if isinstance(e, ast.Call):
        return e.name in aggregates.NAMES or any(map(has_aggregate, e.args))
    return any(map(has_aggregate, children(e)))


def children(e) -> list:
    if isinstance(e, ast.Bin):
        return [e.a, e.b]
    if isinstance(e, (ast.Un, ast.IsNull)):
        return [e.a]
    if isinstance(e, ast.In):
        return [e.a, *e.values]
    if isinstance(e, ast.InQuery):
        return [e.a]
    if isinstance(e, ast.Case):
        return [x for w in e.whens for x in w] + [e.other]
    return list(e.args) if isinstance(e, ast.Call) else []


class Compiler:
    """given: trees whose value is known already (group keys). bare: what a field outside of aggregates and keys becomes.
    subquery: plans a query within an expression."""

    def __init__(self, scope: Scope, given: dict | None = None, bare: Callable[[Typed], Typed] | None = None, empty_zero: bool = False, subquery: Callable[[ast.Select], DataFrame] | None = None):
        self.scope, self.given, self.bare, self.empty_zero, self.subquery = scope, given or {}, bare, empty_zero, subquery

    def __call__(self, e) -> Typed:
        if e in self.given:
            return self.given[e]
        if isinstance(e, ast.Lit):
            return typed.literal(e.value)
        if isinstance(e, ast.Field):
            x = self.scope.field(e)
            return self.bare(x) if self.bare else x
        if isinstance(e, ast.Un):
            x = self(e.a)
            if e.op == "-":
                return typed.arithmetic("-", typed.literal(0.0 if x.kind == "float" else 0), x)
            c = typed.boolean(x, e.op.upper())
            return Typed(~c if e.op == "not" else c, "bool")
        if isinstance(e, ast.Bin):
            a, b = self(e.a), self(e.b)
            if e.op in ("and", "or"):
                x, y = typed.boolean(a, e.op.upper()), typed.boolean(b, e.op.upper())
                return Typed(x & y if e.op == "and" else x | y, "bool")
            return typed.arithmetic(e.op, a, b) if e.op in "+-*/%^" else typed.compare(e.op, a, b)
        if isinstance(e, ast.In):
            x = typed.is_in(self(e.a), [self(v) for v in e.values])
            return Typed(~x.col, "bool") if e.negated else x
        if isinstance(e, (ast.InQuery, ast.Exists, ast.Scalar)):
            return self._query(e)
        if isinstance(e, ast.IsNull):
            x = self(e.a)
            c = x.ts if x.ts is not None else x.col
            return Typed(c.isNotNull() if e.negated else c.isNull(), "bool")
        if isinstance(e, ast.Case):
            return typed.case([(self(c), self(v)) for c, v in e.whens], self(e.other))
        if e.name in aggregates.NAMES:
            if not self.bare:
                raise errors.InvalidError(f"{e.name} is not allowed here")
            inner = Compiler(self.scope)
            if any(map(has_aggregate, e.args)):
                raise errors.InvalidError("an aggregate within an aggregate")
            if e.name == "integral":
                return self._integral(e, inner)
            if len(e.args) > 1:
                raise errors.FunctionError(f"{e.name} takes one argument")
            return aggregates.aggregate(e.name, inner(e.args[0]) if e.args else None, e.distinct, self.empty_zero)
        return scalar.call(e.name, [self(a) for a in e.args])

    def _query(self, e: ast.InQuery | ast.Exists | ast.Scalar) -> Typed:
        """Spark plans these as semi, anti and single-row joins, with SQL's rules for NULL."""
        if self.subquery is None:
            raise errors.NotSupportedError("a query within this expression")
        df = self.subquery(e.query)
        if isinstance(e, ast.Exists):
            return Typed(df.exists(), "bool")
        if len(df.columns) != 1:
            raise errors.InvalidError("a query within an expression has one column")
        dtype = df.schema[0].dataType
        kind, clock = types.kind_of(dtype), dtype.typeName() in ("timestamp_ntz", "timestamp", "date")
        if isinstance(e, ast.Scalar):
            return typed.from_ntz(df.scalar().cast("timestamp_ntz")) if clock else Typed(df.scalar(), kind)
        x = self(e.a)
        if x.kind == "text" and kind == "time":
            x = typed.as_time(x)
        if (common := typed.common_kind(x.kind, kind)) is None:
            raise errors.TypeMismatchError(f"types differ: {x.kind} and {kind}")
        values = typed.ns_of(F.col(df.columns[0]).cast("timestamp_ntz")) if clock else F.col(df.columns[0]).cast(types.STORED[common])
        found = typed.plain(x, common).isin(df.select(values.alias("v")))
        return Typed(~found if e.negated else found, "bool")

    def _integral(self, e: ast.Call, inner: Compiler) -> Typed:
        raise errors.NotSupportedError("integral(x, y) stands alone in a query of its keys")


def output(x: Typed) -> Column:
    """As a result column: a time that comes from a timestamp stays one; a text literal that is a date is a time."""
    if x.ts is not None:
        return x.ts
    return typed.as_time(x).col if x.kind == "text" and x.const is not typed.OPEN else x.col


def sort_key(c: Column, desc: bool) -> Column:
    """NULLs sort below everything."""
    return c.desc_nulls_last() if desc else c.asc_nulls_first()


def names(items: list[ast.Item]) -> list[str]:
    out: list[str] = []
    for i, item in enumerate(items):
        e = item.expr
        name = item.alias or (e.name if isinstance(e, ast.Field) else f"{e.name}" if isinstance(e, ast.Call) else f"col{i + 1}")
        out.append(name if name not in out else f"{name}_{i + 1}")
    return out


def plan(spark: SparkSession, q: ast.Select, relation: Callable[[str], Relation], strict: bool = False, empty_zero: bool = False) -> DataFrame:
    if q.table is None:
        if any(i.expr is None or has_aggregate(i.expr) for i in q.items):
            raise errors.InvalidError("only constants and functions without FROM")
        compile_ = Compiler(Scope([]))
        return spark.range(1).select(*(output(compile_(i.expr)).alias(n) for i, n in zip(q.items, names(list(q.items)), strict=True)))

    base = relation(q.table)
    relations: list[tuple[str | None, Relation]] = [(q.alias or q.table, base)]
    df = base.df.alias("t0")
    pruned = base.prune(q) if base.prune else None
    if pruned is not None:
        df = df.filter(pruned)
    for k, j in enumerate(q.joins, 1):
        other = relation(j.table)
        if j.on not in base.fields or other.pk is None:
            raise errors.InvalidError(f"{q.table} JOIN {j.table} ON {j.on}: an edge and a type are needed")
        relations.append((j.alias or j.table, other))
        df = df.join(other.df.alias(f"t{k}"), F.col(f"t0.`{j.on}`") == F.col(f"t{k}.`{other.pk}`"), j.how)
    scope = Scope(relations)
    rows = Compiler(scope, subquery=lambda inner: plan(spark, inner, relation, strict, empty_zero))
    if q.where is not None:
        if has_aggregate(q.where):
            raise errors.InvalidError("aggregates are not allowed in WHERE")
        df = df.filter(typed.boolean(rows(q.where), "WHERE"))

    items = [i for item in q.items for i in ([ast.Item(ast.Field(n, alias), n) for alias, r in relations for n in r.fields] if item.expr is None else [item])]
    labels = names(items)
    by_label = {ast.Field(n): i.expr for n, i in zip(labels, items, strict=True) if i.alias}

    def named(e):
        """What a name that isn't a field stands for."""
        return e if isinstance(e, ast.Field) and any(e.name in r.fields for _, r in relations) else by_label.get(e, e)

    terms = [(named(e), desc) for e, desc in q.order]
    aggregated = bool(q.group) or any(has_aggregate(i.expr) for i in items)

    if not aggregated:
        if q.having is not None:
            raise errors.InvalidError("HAVING needs groups")
        if q.distinct:
            df = df.select(*(output(rows(i.expr)).alias(n) for i, n in zip(items, labels, strict=True))).distinct()
            shown = [i.expr for i in items]
            if any(e not in shown for e, _ in terms):
                raise errors.InvalidError("with DISTINCT, the order is by what is selected")
            if terms:
                df = df.orderBy(*(sort_key(F.col(f"`{labels[shown.index(e)]}`"), d) for e, d in terms))
        else:
            if terms:
                df = df.orderBy(*(sort_key(output(rows(e)), d) for e, d in terms))
            df = df.select(*(output(rows(i.expr)).alias(n) for i, n in zip(items, labels, strict=True)))
        return df if q.limit is None else df.limit(q.limit)

    if len(items) - len(q.group) == 1 and isinstance(items[-1].expr, ast.Call) and items[-1].expr.name == "integral":
        df = integral(df, q, items, labels, rows)
        if terms:
            df = df.orderBy(*(sort_key(F.col(f"`{labels[[i.expr for i in items].index(e)]}`"), d) for e, d in terms))
        return df
    check_groups(q, items, strict)
    trees = [named(e) for e in q.group]
    keys = [rows(e) for e in trees]
    given = {}
    for i, (tree, key) in enumerate(zip(trees, keys, strict=True)):
        col = F.col(f"__k{i}")
        given[tree] = typed.from_ntz(col) if key.ts is not None else Typed(col, key.kind)
        if isinstance(tree, ast.Field):  # also by its other spelling
            given |= {ast.Field(tree.name, a): given[tree] for a, r in relations if tree.name in r.fields and tree.of in (None, a)} | {ast.Field(tree.name): given[tree]}
    if q.group:
        df = df.withColumns({f"__k{i}": output(k) for i, k in enumerate(keys)})

    def bare(x: Typed) -> Typed:
        if q.group:
            raise errors.InvalidError("a field that is neither a key nor in an aggregate")
        return Typed(F.first(x.col, True), x.kind, F.first(x.ts, True) if x.ts is not None else None)

    over = Compiler(scope, given, bare, empty_zero)
    apart = {i: item.expr for i, item in enumerate(items) if isinstance(item.expr, ast.Call) and item.expr.name in ("median", "mode") and len(item.expr.args) == 1 and not item.expr.distinct and not any(map(has_aggregate, item.expr.args))}
    outs = {f"__o{i}": output(over(item.expr)) for i, item in enumerate(items) if i not in apart}
    outs |= {f"__s{i}": output(over(e)) for i, (e, _) in enumerate(terms)}
    if q.having is not None:
        outs["__h"] = typed.boolean(over(q.having), "HAVING")
    if q.group and not any(has_aggregate(x) for x in [*(i.expr for i in items), *(e for e, _ in terms), q.having]):
        df = df.select(*(f"__k{i}" for i in range(len(keys)))).distinct().select(*(c.alias(n) for n, c in outs.items()))
    elif apart:
        df = with_ranks(df, [f"__k{i}" for i in range(len(keys))], outs, {f"__o{i}": (e.name, rows(e.args[0])) for i, e in apart.items()}, empty_zero)
    else:
        df = df.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(*(c.alias(n) for n, c in outs.items()))
    if q.having is not None:
        df = df.filter("__h")
    if terms:
        df = df.orderBy(*(sort_key(F.col(f"__s{i}"), d) for i, (_, d) in enumerate(terms)))
    df = df.select(*(F.col(f"__o{i}").alias(n) for i, n in enumerate(labels)))
    return df if q.limit is None else df.limit(q.limit)


def with_ranks(df: DataFrame, keys: list[str], outs: dict[str, Column], apart: dict[str, tuple[str, Typed]], empty_zero: bool) -> DataFrame:
    """Groups whose medians and modes are found apart, each in its own passes, and joined by the keys."""
    out = df.groupBy(*keys).agg(*(c.alias(n) for n, c in outs.items()), F.count(F.lit(1)).alias("__rows"))
    for name, (what, x) in apart.items():
        kind = x.kind if what == "mode" else typed.numbers(x, what=what)
        value = output(x) if what == "mode" else typed.plain(x, kind).cast("double")
        side = (ranks.mode if what == "mode" else ranks.median)(df.select(*keys, value.alias("__v")), keys, "__v", name)
        if not keys:  # at most one row
            out = out.select("*", side.select(name).scalar().alias(name))
        else:
            side = side.select(name, *(F.col(k).alias(f"__side{k}") for k in keys))
            out = out.join(side, [F.col(k).eqNullSafe(F.col(f"__side{k}")) for k in keys], "left").drop(*(f"__side{k}" for k in keys))
        if what == "median" and empty_zero:
            out = out.withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def check_groups(q: ast.Select, items: list[ast.Item], strict: bool) -> None:
    """Strictly, a projection is the keys in their order, then expressions with aggregates."""
    if not strict or not q.group:
        return
    trees = [i.expr for i in items]
    keys = list(q.group)
    if trees[: len(keys)] != keys or not all(map(has_aggregate, trees[len(keys) :])):
        raise errors.InvalidError("the projection must be the keys in their order, then aggregates")


def integral(df: DataFrame, q: ast.Select, items: list[ast.Item], labels: list[str], rows: Compiler) -> DataFrame:
    """integral(x, y): the sum of (x - previous x) * y in the order of x, for each group."""
    x, y = (rows(a) for a in items[-1].expr.args)
    keys = [output(rows(e)).alias(n) for e, n in zip([i.expr for i in items[:-1]], labels, strict=False)]
    cut = df.select(*keys, F.monotonically_increasing_id().alias("__tie"), x.col.alias("__x"), y.col.cast("double").alias("__y"))
    return timeseries.integral(cut, labels[:-1], "__x", "__y", labels[-1])
