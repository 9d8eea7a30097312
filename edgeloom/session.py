"""A session: statements in, results out."""

from __future__ import annotations

import importlib
import itertools
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import errors, locks, types
from .functions import typed
from .plans import ast, parser
from .plans.planner import Compiler, Relation, Scope, plan
from .result import Result
from .sources import loader, tables
from .sources.catalog import Catalog, Files
from .sources.loader import Report

#: Single-row inserts wait for so many of their kind, or for the next statement that reads the table.
PENDING = 10_000
_numbers = itertools.count(1)


class Session:
    """base: the folder of all scopes. strict: projections of grouped queries must be the keys, then aggregates. empty_zero: averages of nothing are 0."""

    def __init__(self, spark: SparkSession, base: str | None = None, scope: str | None = None, strict: bool = False, empty_zero: bool = False):
        self.spark, self.strict, self.empty_zero = spark, strict, empty_zero
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.number, self.closed = next(_numbers), False
        self.files = Files(spark, base) if base else None
        self.catalog: Catalog | None = None
        self.external: dict[str, Relation | Callable[[], Relation]] = {}
        self.pending: dict[str, list[dict]] = {}
        self.known: dict[str, set] = {}
        self.looked: dict[str, tuple[set, set]] = {}  # keys that were looked for, and those found
        self.cursors: dict[int, Result] = {}
        self.modules: dict[str, Any] = {}
        self.state: dict[str, Any] = {}
        self._cursor = itertools.count(1)
        self._guard = threading.RLock()
        if scope:
            self.execute(f"use {scope}")

    # plumbing
    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if not self.closed:
            self.flush()
            locks.PROCESS.give_all(self.number)
            self.cursors.clear()
            self.closed = True

    def _scope_path(self, name: str) -> str:
        if self.files is None:
            raise errors.NoResourceError("the session has no base folder")
        return f"{self.files.base}/{name}"

    def _current(self) -> Catalog:
        if self.catalog is None:
            raise errors.NoSuchScopeError("no scope in use")
        return self.catalog

    @property
    def _base(self) -> str:
        return self._scope_path(self._current().name)

    def _save(self) -> None:
        self.files.write(f"{self._base}/catalog.json", self._current().to_json())

    def _lock_name(self, name: str) -> str:
        return f"{self._base}/{name}"

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], fields: dict[str, str], pk: str | None = None) -> None:
        """A table from elsewhere (or what reads it when it is needed): fields maps its names here to its columns."""

        def made() -> Relation:
            out = (df() if callable(df) else df).select(*(F.col(c).alias(n) for n, c in fields.items()))
            return Relation(out, {n: types.kind_of(out.schema[n].dataType) for n in fields}, None, pk)

        self.external[name] = made

    def relation(self, name: str) -> Relation:
        if name in self.external:
            if not isinstance(self.external[name], Relation):
                self.external[name] = self.external[name]()
            return self.external[name]
        self.flush(name)
        return tables.relation(self.files, self._base, self._current().table(name))

    def table(self, name: str) -> DataFrame:
        """A table as a DataFrame, its columns in declared order."""
        r = self.relation(name)
        return r.df.select(*r.fields)

    # statements
    def parse(self, sql: str) -> list:
        return parser.parse(sql)

    def sql(self, text: str) -> DataFrame:
        """One query, as a DataFrame."""
        (q,) = parser.parse(text)
        if not isinstance(q, ast.Select):
            raise errors.InvalidError("not a query")
        return self._plan(q)

    def _plan(self, q: ast.Select) -> DataFrame:
        return plan(self.spark, q, self.relation, self.strict, self.empty_zero)

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def execute(self, text: str) -> Result:
        """All statements of a script; the last one's result."""
        out, statements = Result("status"), parser.parse(text)
        for k, s in enumerate(statements):
            with self._guard:
                if s.__class__ is ast.Statement and s.what == "insert" and not (k and statements[k - 1].__class__ is ast.Statement and statements[k - 1].what == "insert"):
                    self._look_up(list(itertools.takewhile(lambda x: isinstance(x, ast.Statement) and x.what == "insert", statements[k:])))
                out = self._run(s)
        return out

    def _look_up(self, inserts: list[ast.Statement]) -> None:
        """Looks for the keys of several inserts in one job a table."""
        self.looked.clear()
        c, keys = self._current(), {}
        for s in inserts:
            table = c.tables.get(s.name)
            names = s.args["fields"] or ([p.name for p in table.properties] if table else [])
            if table and table.pk and table.pk.name in names and len(names) == len(s.args["values"]):
                keys.setdefault(s.name, []).append(s.args["values"][names.index(table.pk.name)])
        for name, asked in keys.items():
            values = {e.value for e in asked if isinstance(e, ast.Lit) and e.value is not None}
            if len(values) > 1:
                pk = c.table(name).pk
                same = [v for v in values if isinstance(v, str) == (pk.kind == "text") and not isinstance(v, (bool, float))]
                stored = tables.read(self.files, self._base, c.table(name))
                self.looked[name] = (set(same), {r[0] for r in stored.filter(F.col(pk.name).isin(same)).select(pk.name).collect()})

    def one_row(self, text: str) -> tuple:
        return self.execute(text).one_row()

    def one_value(self, text: str) -> Any:
        return self.execute(text).one_value()

    def _run(self, s) -> Result:
        if isinstance(s, ast.Select):
            r = Result("row" if s.table is None else "cursor", self._plan(s))
            r.id = next(self._cursor)
            self.cursors[r.id] = r
            return r
        out = getattr(self, "_do_" + s.what.replace(" ", "_"))(s)
        return out if isinstance(out, Result) else Result("status")

    # scopes
    def _do_create_scope(self, s: ast.Statement) -> None:
        path = self._scope_path(s.name)
        if self.files.exists(f"{path}/catalog.json"):
            if s.args.get("quiet"):
                return
            raise errors.CatalogError(f"{s.name} exists")
        self.files.make(path)
        self.files.write(f"{path}/catalog.json", Catalog(s.name).to_json())

    def _do_drop_scope(self, s: ast.Statement) -> None:
        path = self._scope_path(s.name)
        if not self.files.exists(f"{path}/catalog.json"):
            if s.args.get("quiet"):
                return
            raise errors.NoSuchScopeError(s.name)
        self.files.remove(path)
        if self.catalog and self.catalog.name == s.name:
            self.catalog = None
            self.pending.clear()

    def _do_use(self, s: ast.Statement) -> None:
        if self.catalog:
            self.flush()
        path = f"{self._scope_path(s.name)}/catalog.json"
        if not self.files.exists(path):
            raise errors.NoSuchScopeError(s.name)
        self.catalog = Catalog.from_json(self.files.read(path))
        self.known.clear()

    # definitions
    def _define(self, s: ast.Statement, edge: bool) -> None:
        c = self._current()
        if s.args.get("quiet") and s.name in c.tables:
            return
        c.define(s.name, edge, s.args["fields"], s.args.get("storage"))
        self._save()

    def _do_create_type(self, s: ast.Statement) -> None:
        self._define(s, False)

    def _do_create_edge(self, s: ast.Statement) -> None:
        self._define(s, True)

    def _drop(self, s: ast.Statement, where: dict) -> bool:
        if s.name not in where:
            if s.args.get("quiet"):
                return False
            raise errors.KeyNotFoundError(s.name)
        del where[s.name]
        self._save()
        return True

    def _drop_table(self, s: ast.Statement, edge: bool) -> None:
        c = self._current()
        if s.name in c.tables and c.tables[s.name].edge != edge:
            raise errors.KeyNotFoundError(f"{s.name} is {'a type' if edge else 'an edge'}")
        self.pending.pop(s.name, None)
        self.known.pop(s.name, None)
        c.indexes = {n: i for n, i in c.indexes.items() if i["on"] != s.name}
        if self._drop(s, c.tables):
            self.files.remove(f"{self._base}/{s.name}")

    def _do_drop_type(self, s: ast.Statement) -> None:
        if any(s.name in (p.origin, p.destin) for t in self._current().tables.values() for p in t.properties):
            raise errors.InvalidError(f"an edge refers to {s.name}")
        self._drop_table(s, False)

    def _do_drop_edge(self, s: ast.Statement) -> None:
        self._drop_table(s, True)

    def _do_create_index(self, s: ast.Statement) -> None:
        """Indexes are names only: statistics and clustering of the files serve searches."""
        c = self._current()
        if s.name in c.indexes:
            if s.args.get("quiet"):
                return
            raise errors.DuplicateNameError(s.name)
        for f in s.args["fields"]:
            c.table(s.args["on"]).find(f)
        c.indexes[s.name] = {"on": s.args["on"], "fields": s.args["fields"], "size": s.args["size"]}
        self._save()

    def _do_drop_index(self, s: ast.Statement) -> None:
        self._drop(s, self._current().indexes)

    def _do_create_storage(self, s: ast.Statement) -> None:
        c = self._current()
        if s.name in c.storages:
            if s.args.get("quiet"):
                return
            raise errors.DuplicateNameError(s.name)
        c.storages[s.name] = s.args["options"]
        self._save()

    def _do_drop_storage(self, s: ast.Statement) -> None:
        if any(t.storage == s.name for t in self._current().tables.values()):
            raise errors.InvalidError(f"{s.name} is in use")
        self._drop(s, self._current().storages)

    def _do_show(self, s: ast.Statement) -> Result:
        c = self._current()
        what = {"vertices": "types", "procs": "procedures", "storages": "stores", "indices": "indexes"}.get(s.name, s.name)
        found = {"types": [n for n, t in c.tables.items() if not t.edge], "edges": [n for n, t in c.tables.items() if t.edge], "procedures": list(c.procedures), "stores": list(c.storages), "locks": c.locks, "indexes": list(c.indexes)}
        if what not in found:
            raise errors.InvalidError(f"SHOW {s.name}")
        return Result("cursor", self.spark.createDataFrame([(x,) for x in sorted(found[what])], "name string"))

    def _do_describe(self, s: ast.Statement) -> Result:
        if s.name in self.external:
            rows = list(self.relation(s.name).fields.items())
        elif s.name in self._current().procedures:
            rows = [(p["name"], types.KINDS[p["type"].lower()]) for p in self._current().procedures[s.name]["params"]]
        else:
            rows = [(p.name, p.origin or p.destin or p.kind) for p in self._current().table(s.name).properties]
        return Result("cursor", self.spark.createDataFrame(rows, "name string, type string"))

    # rows in
    def _value(self, e) -> Any:
        """A constant expression's value, as an insert or a call takes it."""
        if isinstance(e, ast.Lit):
            return e.value
        x = Compiler(Scope([]))(e)
        row = self.spark.range(1).select(x.col.alias("v")).first()
        return row["v"]

    def _do_insert(self, s: ast.Statement) -> Result:
        began = time.time()
        self.insert(s.name, s.args["fields"], [self._value(e) for e in s.args["values"]])
        return Result("report", report=Report(1, 0, int((time.time() - began) * 1e6)))

    def insert(self, name: str, fields: list[str] | None, values: list) -> None:
        """One row; it waits with others until the table is read."""
        table = self._current().table(name)
        row = tables.checked(self._current(), table, fields, values)
        waiting = self.pending.setdefault(name, [])
        if table.pk:
            pk, key = table.pk.name, row[table.pk.name]
            known = self.known.setdefault(name, set())
            stored = tables.read(self.files, self._base, table)
            asked, there = self.looked.get(name, (set(), set()))
            if key in known or (key in there if key in asked else stored.filter(F.col(pk) == F.lit(key)).limit(1).count()):
                raise errors.DuplicateKeyError(f"{key} in {name}")
            if table.pk.inc:
                most = max(known, default=None) if known else stored.agg(F.max(pk)).first()[0]
                if most is not None and key <= most:
                    raise errors.InvalidError(f"{pk} must be above {most}")
            known.add(key)
        waiting.append(row)
        if len(waiting) >= PENDING:
            self.flush(name)

    def flush(self, name: str | None = None) -> None:
        """Writes waiting rows."""
        for n in [name] if name else list(self.pending):
            if rows := self.pending.pop(n, None):
                table = self._current().table(n)
                df = self.spark.createDataFrame([tuple(r[p.name] for p in table.properties) for r in rows], table.schema)
                tables.append(self.files, self._base, self._current(), table, df.coalesce(1))
                self.known.pop(n, None)
                self.looked.pop(n, None)

    def _do_insert_select(self, s: ast.Statement) -> Result:
        began = time.time()
        table = self._current().table(s.name)
        n = self.append(s.name, self._plan(s.args["query"]).toDF(*(s.args["fields"] or [p.name for p in table.properties])))
        return Result("report", report=Report(n, 0, int((time.time() - began) * 1e6)))

    def append(self, name: str, df: DataFrame) -> int:
        """All rows of df or none: a missing key, a key that repeats, or one that is there refuses them."""
        self.flush(name)
        table = self._current().table(name)
        cols = [(typed.ns_of(F.col(p.name)) if p.kind == "time" and types.kind_of(df.schema[p.name].dataType) == "time" else F.col(p.name)).cast(table.schema[p.name].dataType).alias(p.name) if p.name in df.columns else F.lit(None).cast(table.schema[p.name].dataType).alias(p.name) for p in table.properties]
        rows = df.select(*cols)
        must = [p.name for p in table.properties if p.pk or p.origin or p.destin or (p.stamp and table.edge)]
        checks = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col(m).isNull(), 1)).alias(f"null_{m}") for m in must)).first()
        for m in must:
            if checks[f"null_{m}"]:
                raise errors.InvalidError(f"{m} is missing in {name}")
        if table.pk:
            pk = table.pk.name
            both = rows.select(pk).unionAll(tables.read(self.files, self._base, table).select(pk))
            if (twice := both.groupBy(pk).count().filter("count > 1").limit(1).collect()):
                raise errors.DuplicateKeyError(f"{twice[0][0]} in {name}")
        tables.append(self.files, self._base, self._current(), table, rows)
        return checks["n"]

    def dump(self, query: str, path: str, form: str = "csv", sep: str = ";") -> None:
        """A query's rows as files that LOAD (csv) or load_json takes, or as Parquet. Times are written with nanoseconds."""
        df = self.sql(query)
        columns = [F.unix_micros(F.col(f.name).cast("timestamp")) * 1000 if f.dataType.typeName() in ("timestamp_ntz", "timestamp", "date") else F.col(f.name) for f in df.schema]
        if form == "csv":
            escaped = [F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")) if f.dataType.typeName() == "string" else c for c, f in zip(columns, df.schema, strict=True)]
            df.select(F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit("")) for c in escaped))).write.text(path)
        else:
            df.select(*(c.alias(n) for c, n in zip(columns, df.columns, strict=True))).write.format(form).save(path)

    def load_json(self, path: str, name: str) -> int:
        """Appends files of JSON lines; fields by name. Rows that aren't right refuse them all, as with any append."""
        table = self._current().table(name)
        return self.append(name, self.spark.read.schema(table.schema).json(path))

    def _do_load(self, s: ast.Statement) -> Result:
        self.flush(s.name)
        table = self._current().table(s.name)
        return Result("report", report=loader.load(self.files, self._base, self._current(), table, s.args["path"], s.args["header"], s.args["errors"]))

    # rows changed: copy on write
    def _changed(self, s: ast.Statement, change: Callable[[DataFrame, Any], DataFrame]) -> Result:
        began = time.time()
        self.flush(s.name)
        table = self._current().table(s.name)
        r = tables.relation(self.files, self._base, table)
        compile_ = Compiler(Scope([(s.name, r)]))
        where = F.lit(True) if s.args["where"] is None else F.coalesce(typed.boolean(compile_(s.args["where"]), "WHERE"), F.lit(False))
        df = r.df.alias("t0")
        if table.edge and table.stamp and table.stamp.name not in [n for n, _ in s.args.get("set", [])]:
            n = self._changed_periods(s, table, df, where, lambda part: change(part, (where, compile_, table)))
        elif n := df.filter(where).count():
            tables.replace(self.files, self._base, self._current(), table, change(df, (where, compile_, table)))
        return Result("report", report=Report(n, 0, int((time.time() - began) * 1e6)))

    def _changed_periods(self, s: ast.Statement, table: Any, df: DataFrame, where: Any, change: Callable[[DataFrame], DataFrame]) -> int:
        """Only the periods that hold matching rows are touched; those of which all rows go lose their folder. One row a period comes to the driver."""
        low, high = tables.bounds(s.args["where"], table.stamp.name) if s.args["where"] is not None else (types.DAWN, types.DUSK)
        inside = df.filter(F.col(tables.PERIOD).between(low // tables.PERIOD_NS, high // tables.PERIOD_NS))
        found = inside.groupBy(tables.PERIOD).agg(F.count_if(where).alias("n"), F.count(F.lit(1)).alias("all")).filter("n > 0").collect()
        gone = [r[0] for r in found if s.what != "update" and r["n"] == r["all"]]
        rest = [r[0] for r in found if r[0] not in gone]
        tables.replace_periods(self.files, self._base, self._current(), table, gone, change(df.filter(F.col(tables.PERIOD).isin(rest))), rest)
        return sum(r["n"] for r in found)

    def _do_delete(self, s: ast.Statement) -> Result:
        return self._changed(s, lambda df, c: df.filter(~c[0]))

    _do_drop_period = _do_delete

    def _do_update(self, s: ast.Statement) -> Result:
        def change(df: DataFrame, c: tuple) -> DataFrame:
            where, compile_, table = c
            new = {}
            for name, e in s.args["set"]:
                p = table.find(name)
                if p.pk:
                    raise errors.InvalidError(f"{name} is the primary key")
                x = compile_(e)
                x = typed.as_time(x) if p.kind == "time" else x
                if typed.common_kind(p.kind, x.kind) != p.kind:
                    raise errors.TypeMismatchError(f"{name} is {p.kind}, not {x.kind}")
                new[name] = typed.plain(x, p.kind)
            return df.select(*(F.when(where, new[p.name]).otherwise(F.col(p.name)).alias(p.name) if p.name in new else F.col(p.name) for p in table.properties))

        return self._changed(s, change)

    # procedures
    def register_module(self, name: str, module: Any) -> None:
        """Something with functions as attributes; else modules are imported by name."""
        self.modules[name] = module

    def _do_create_procedure(self, s: ast.Statement) -> None:
        c = self._current()
        if s.args["language"] != "python":
            raise errors.NotSupportedError(f"procedures in {s.args['language']}")
        if s.name in c.procedures:
            raise errors.DuplicateNameError(s.name)
        c.procedures[s.name] = {"module": s.args["module"], "params": s.args["params"], "language": "python"}
        self._save()

    def _do_drop_procedure(self, s: ast.Statement) -> None:
        self._drop(s, self._current().procedures)

    def _do_exec(self, s: ast.Statement) -> Result:
        """The function gets this session and the arguments. A DataFrame or Result is a cursor; other values are a row."""
        c = self._current()
        if s.name not in c.procedures:
            raise errors.KeyNotFoundError(s.name)
        p, values = c.procedures[s.name], [self._value(e) for e in s.args["values"]]
        if len(values) != len(p["params"]):
            raise errors.InvalidError(f"{s.name} takes {len(p['params'])} arguments, not {len(values)}")
        values = [types.stored(v, types.KINDS[q["type"].lower()], q["name"]) for v, q in zip(values, p["params"], strict=True)]
        module = self.modules.get(p["module"])
        try:
            f = getattr(module if module is not None else importlib.import_module(p["module"]), s.name)
        except (ImportError, AttributeError) as e:
            raise errors.ProcedureError(f"{p['module']}.{s.name}: {e}") from e
        out = f(self, *values)
        if isinstance(out, Result):
            return out
        if isinstance(out, DataFrame):
            r = Result("cursor", out)
            r.id = next(self._cursor)
            self.cursors[r.id] = r
            return r
        return Result("status") if out is None else Result("row", value=tuple(out) if isinstance(out, (tuple, list, Row)) else (out,))

    def cached(self, name: str, args: tuple, make: Callable[[], DataFrame], valid: Callable[[], bool] = lambda: True) -> DataFrame:
        """A result kept for the session by name and arguments, as long as it is valid."""
        key = f"cache:{name}:{args!r}"
        if key in self.state and valid():
            return self.state[key]
        if key in self.state:
            self.state.pop(key).unpersist()
        self.state[key] = make().cache()
        return self.state[key]

    # locks
    def _do_create_lock(self, s: ast.Statement) -> None:
        c = self._current()
        if s.name in c.locks:
            if s.args.get("quiet"):
                return
            raise errors.DuplicateNameError(s.name)
        c.locks.append(s.name)
        self._save()

    def _do_drop_lock(self, s: ast.Statement) -> None:
        c = self._current()
        if s.name not in c.locks:
            if s.args.get("quiet"):
                return
            raise errors.KeyNotFoundError(s.name)
        c.locks.remove(s.name)
        self._save()

    def _lock_of(self, name: str) -> str:
        c = self._current()
        if name not in c.locks and name not in Catalog.from_json(self.files.read(f"{self._base}/catalog.json")).locks:
            raise errors.KeyNotFoundError(name)
        return self._lock_name(name)

    def _do_lock(self, s: ast.Statement) -> None:
        locks.PROCESS.take(self._lock_of(s.name), self.number, s.args["mode"], s.args["timeout"])

    def _do_unlock(self, s: ast.Statement) -> None:
        locks.PROCESS.give(self._lock_of(s.name), self.number)

    @contextmanager
    def with_lock(self, name: str, mode: str = "writing", timeout_ms: int | None = None):
        locks.PROCESS.take(key := self._lock_of(name), self.number, mode, timeout_ms)
        try:
            yield
        finally:
            locks.PROCESS.give(key, self.number)

    # cursors
    def _do_fetch(self, s: ast.Statement) -> Result:
        if s.args["id"] not in self.cursors:
            raise errors.NotFoundError(f"no cursor {s.args['id']}")
        return self.cursors[s.args["id"]]

    def _do_close(self, s: ast.Statement) -> None:
        if s.args["id"] not in self.cursors:
            raise errors.NotFoundError(f"no cursor {s.args['id']}")
        self.cursors.pop(s.args["id"]).release()

    def edge(self, name: str) -> Query:
        return Query(self, name)

    vertex = edge


class Query:
    """The same queries without SQL text: session.edge("buys").where("quantity > 1").group("origin").select("origin", "spread(price) as s")."""

    def __init__(self, session: Session, table: str, **parts):
        self.session, self.name, self.parts = session, table, parts

    def _with(self, **more) -> Query:
        return Query(self.session, self.name, **(self.parts | more))

    def where(self, condition: str) -> Query:
        before = self.parts.get("where")
        return self._with(where=f"({before}) and ({condition})" if before else condition)

    def group(self, *keys: str) -> Query:
        return self._with(group=keys)

    def order(self, *terms: str) -> Query:
        return self._with(order=terms)

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def sql(self, *items: str) -> str:
        p = self.parts
        text = f"select {', '.join(items) or '*'} from {self.name}"
        text += f" where {p['where']}" if "where" in p else ""
        text += f" group by {', '.join(p['group'])}" if "group" in p else ""
        text += f" order by {', '.join(p['order'])}" if "order" in p else ""
        return text + (f" limit {p['limit']}" if "limit" in p else "")

    def select(self, *items: str) -> DataFrame:
        return self.session.sql(self.sql(*items))
