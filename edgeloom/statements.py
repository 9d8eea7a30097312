"""The registered queries on stored tables: each makes a scope in the shared folder from the driver's tables, runs statements, and returns rows, with DuckDB's SQL for the same rows."""

from __future__ import annotations

import contextlib
import io
import types as pytypes
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli, dbapi, errors, procedures, types
from .queries import TABLES
from .session import Session
from .sources.shared import own_dir
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ACTS = """
create type person (person_key uint pk);
create type kind (kind_name text pk);
create edge did (origin person origin, destin kind destin, stamp time stamp, id uint, value float);
"""
NATIONS = "create type land (land_key uint pk, land_name text, area uint);"


def query(sql: str) -> Callable:
    """Registers a function of (session, spark, sf_dir) under its name, with DuckDB's SQL."""

    def register(f: Callable[[Session, SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(scope(spark, sf_dir), spark, sf_dir)

        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = run, sql
        return f

    return register


def scope(spark: SparkSession, sf_dir: str, name: str = "shop") -> Session:
    """A session in a new scope, with the driver's tables beside it."""
    s = Session(spark, own_dir(spark, "scope"))
    s.execute(f"create scope {name}; use {name}")
    for table, (file, fields, pk) in TABLES.items():
        s.register(table, lambda file=file: spark.read.parquet(f"{sf_dir}/{file}.parquet"), fields, pk)
    return s


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def text(*fields: str | Column, sep: str = ";") -> Column:
    """A line of delimited text; NULL is an empty field."""
    return F.concat_ws(sep, *(F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit("")) for f in fields)).alias("value")


def written(s: Session, df: DataFrame, name: str) -> str:
    path = f"{s.files.base}/{name}"
    df.write.text(path)
    return path


def acts_file(s: Session, spark: SparkSession, sf_dir: str) -> str:
    """All events as lines."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return written(s, spark.read.parquet(f"{sf_dir}/events.parquet").select(text("user_id", "event_type", stamp, "event_id", "value")), "acts.csv")


def loaded(s: Session, spark: SparkSession, sf_dir: str, options: str = "") -> Session:
    s.execute(ACTS)
    s.execute(f"load '{acts_file(s, spark, sf_dir)}' into did {options}")
    return s


def refusals(s: Session, spark: SparkSession, scripts: list[str]) -> DataFrame:
    """(script, error): the kind of error that each script meets, none if it runs."""
    out = []
    for script in scripts:
        try:
            s.execute(script)
            out.append((script, None))
        except errors.EngineError as e:
            out.append((script, type(e).__name__.removesuffix("_")))
    return rows(spark, out, "script string, error string")


def literal(pairs: list[tuple[str, str | None]]) -> str:
    quoted = lambda x: "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs) + ") AS t(script, error)"


def refused(name: str, before: str, pairs: list[tuple[str, str | None]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = scope(spark, sf_dir)
        s.execute(before)
        return refusals(s, spark, [a for a, _ in pairs])

    QUERIES[name], ORACLE_SQL[name] = run, literal(pairs)


# loading
@query("SELECT user_id AS origin, event_type AS destin, epoch_ns(ts) AS ns, event_id AS id, value FROM events")
def stored_load(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(s, spark, sf_dir).sql("select origin, destin, stamp + 0 as ns, id, value from did")


@query("SELECT count(*) AS affected, 0::BIGINT AS errors FROM events")
def stored_load_report(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.execute(ACTS)
    r = s.execute(f"load '{acts_file(s, spark, sf_dir)}' into did as edge").report
    return rows(spark, [(r.affected, r.errors)], "affected long, errors long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS land_key, n_name AS land_name, CAST(n_regionkey AS BIGINT) AS area FROM nation")
def stored_load_use_header(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header's fields come in another order than the type's."""
    s.execute(NATIONS)
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").select(text("n_name", "n_regionkey", "n_nationkey"))
    path = written(s, rows(spark, [("land_name;area;land_key",)], "value string").unionByName(lines).coalesce(1), "nation.csv")
    s.execute(f"load '{path}' into land use header")
    return s.sql("select land_key, land_name, area from land")


@query("SELECT CAST(n_nationkey AS BIGINT) AS land_key, n_name AS land_name, CAST(n_regionkey AS BIGINT) AS area FROM nation")
def stored_load_ignore_header(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.execute(NATIONS)
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").select(text("n_nationkey", "n_name", "n_regionkey"))
    path = written(s, rows(spark, [("a;b;c",)], "value string").unionByName(lines).coalesce(1), "nation.csv")
    s.execute(f"load '{path}' into land ignore header as vertex")
    return s.sql("select land_key, land_name, area from land")


@query("""SELECT 'stored' AS what, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 7 <> 0 UNION ALL
SELECT 'reported', count(*) FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0 UNION ALL
SELECT 'not a uint', count(*) FROM customer WHERE c_custkey % 10 = 0 UNION ALL
SELECT 'missing', count(*) FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 10 <> 0""")
def stored_load_errors(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a bad or a missing key go to the errors file, by their reason."""
    s.execute("create type buyer (buyer_key uint pk, buyer_name text)")
    key = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_custkey").cast("string"))
    path = written(s, spark.read.parquet(f"{sf_dir}/customer.parquet").select(text(key, "c_name")), "customer.csv")
    r = s.execute(f"load '{path}' into buyer set errors = '{s.files.base}/errors'").report
    bad = spark.read.text(f"{s.files.base}/errors").agg(F.count_if(F.col("value").contains("buyer_key is not a uint")), F.count_if(F.col("value").contains("buyer_key is missing"))).first()
    return rows(spark, [("stored", s.one_value("select count(*) from buyer")), ("reported", r.errors), ("not a uint", bad[0]), ("missing", bad[1])], "what string, n long")


@query("""SELECT o_custkey AS holder_key FROM orders GROUP BY 1""")
def stored_load_duplicates(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a key counts, in one file and over several loads."""
    s.execute("create type holder (holder_key uint pk)")
    path = written(s, spark.read.parquet(f"{sf_dir}/orders.parquet").select(text("o_custkey")), "orders.csv")
    s.execute(f"load '{path}' into holder")
    again = s.execute(f"load '{path}' into holder").report
    return s.sql("select holder_key from holder") if again.affected == 0 else s.sql("select holder_key + 0 as holder_key from holder where 1 = 0")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS k, s_name || chr(10) || '\\' || '''' AS t, 0.0 - s_acctbal AS f, CAST(0 - s_nationkey AS BIGINT) AS i, s_nationkey % 2 = 0 AS b, make_timestamp_ns(1526624590123456789) IS NOT NULL AS known, 123456789::BIGINT AS n FROM supplier""")
def stored_load_kinds(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of field, escapes in text, and an empty field that is NULL."""
    s.execute("create type item (k uint pk, t text, f float, i int, b bool, at time, nothing text)")
    lines = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(text("s_suppkey", F.concat(F.col("s_name"), F.lit("\\n\\\\\\'")), (0 - F.col("s_acctbal")), (0 - F.col("s_nationkey")), (F.col("s_nationkey") % 2 == 0), F.lit("2018-05-18T06:23:10.123456789"), F.lit("")))
    s.execute(f"load '{written(s, lines, 'supplier.csv')}' into item")
    return s.sql("select k, t, f, i, b, at is not null as known, nano(at) as n from item where nothing is null")


@query("SELECT user_id AS origin, event_type AS destin, epoch_ns(ts) AS ns, event_id AS id, value FROM events")
def dump_and_load(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's rows written as text, and loaded."""
    s.execute(ACTS)
    s.dump("select origin, destin, stamp, id, value from acts", f"{s.files.base}/dump")
    s.execute(f"load '{s.files.base}/dump' into did")
    return s.sql("select origin, destin, stamp + 0 as ns, id, value from did")


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer")
def dump_and_load_json(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.execute("create type copy (k uint pk, name text, balance float)")
    s.dump("select client_key as k, client_name as name, balance from client", f"{s.files.base}/dump", "json")
    s.load_json(f"{s.files.base}/dump", "copy")
    return s.sql("select k, name, balance from copy")


# reading
@query("SELECT event_id AS id FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-12'")
def stored_period(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time range, which reads the folders of its periods only."""
    return loaded(s, spark, sf_dir).sql("select id from did where stamp >= '2024-01-10' and stamp < '2024-01-12'")


@query("SELECT event_type AS destin, count(*) AS n, round(sum(value), 4) AS v, max(event_id) AS m FROM events GROUP BY 1")
def stored_group(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(s, spark, sf_dir).sql("select destin, count(*) as n, round(sum(value), 4) as v, max(id) as m from did group by destin")


@query("SELECT event_id AS id, value FROM events WHERE user_id = 3 AND event_type = 'click'")
def stored_index(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by an index's fields."""
    s.execute(ACTS + "create index by_person on did (origin, destin)")
    s.execute(f"load '{acts_file(s, spark, sf_dir)}' into did")
    return s.sql("select id, value from did where origin = 3 and destin = 'click'")


@query("SELECT event_id AS id, value FROM events WHERE value > 50")
def stored_storage(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.execute("create storage tight set compression = 'gzip', largesize = 1000000")
    s.execute(ACTS.replace("value float);", "value float) storage = tight;"))
    s.execute(f"load '{acts_file(s, spark, sf_dir)}' into did")
    return s.sql("select id, value from did where value > 50")


# rows in, changed and out
@query("SELECT CAST(n_nationkey AS BIGINT) AS land_key, n_name AS land_name, CAST(n_regionkey AS BIGINT) AS area FROM nation")
def insert_rows(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One INSERT for each of the 25 nations; the rows that wait are read with the stored ones."""
    s.execute(NATIONS)
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():
        name = r["n_name"].replace("\\", "\\\\").replace("'", "\\'")
        s.execute(f"insert into land (land_key, land_name, area) values ({r['n_nationkey']}, '{name}', {r['n_regionkey']})")
    return s.sql("select land_key, land_name, area from land")


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 0")
def insert_select(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.execute("create type copy (k uint pk, name text, balance float)")
    s.execute("insert into copy (k, name, balance) select client_key, client_name, balance from client where balance > 0")
    return s.sql("select k, name, balance from copy")


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' THEN value * 2 ELSE value END AS value, event_type AS destin FROM events")
def update_rows(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded(s, spark, sf_dir).execute("update did set value = value * 2 where destin = 'click'")
    return s.sql("select id, value, destin from did")


@query("SELECT event_id AS id FROM events WHERE NOT (value < 20 OR user_id = 3)")
def delete_rows(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded(s, spark, sf_dir).execute("delete from did where value < 20 or origin = 3")
    return s.sql("select id from did")


@query("SELECT event_id AS id, epoch_ns(ts) AS ns FROM events WHERE NOT (ts >= '2024-01-05' AND ts < '2024-02-20')")
def drop_period(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded(s, spark, sf_dir).execute("drop period on did where stamp >= '2024-01-05' and stamp < '2024-02-20'")
    return s.sql("select id, stamp + 0 as ns from did")


refused("insert_constraints", NATIONS + "insert into land values (1, 'a', 1)", [
    ("insert into land values (2, 'b', 1)", None),
    ("insert into land values (1, 'c', 1)", "DuplicateKeyError"),
    ("insert into land values (2, 'c', 1)", "DuplicateKeyError"),
    ("insert into land (land_name) values ('x')", "InvalidError"),
    ("insert into land (land_key) values (-1)", "TypeMismatchError"),
    ("insert into land (land_key, land_name) values (9, 5)", "TypeMismatchError"),
    ("insert into land (land_key, nothing) values (9, 5)", "KeyNotFoundError"),
    ("insert into land (land_key, land_key) values (9, 5)", "InvalidError"),
])
refused("insert_edge_constraints", ACTS, [
    ("insert into did values (1, 'click', '2024-01-01', 1, 0.5)", None),
    ("insert into did (origin, destin, stamp) values (1, 'click', 5)", None),
    ("insert into did (destin, stamp) values ('click', 1)", "InvalidError"),
    ("insert into did (origin, stamp) values (7, 1)", "InvalidError"),
    ("insert into did (origin, destin) values (7, 'click')", "InvalidError"),
    ("insert into did (origin, destin, stamp) values (7, 1, 1)", "TypeMismatchError"),
])
refused("define_rules", NATIONS + "create edge goes (origin land origin, destin land destin)", [
    ("create type land (x uint pk)", "DuplicateKeyError"),
    ("create type land (x uint pk) if not exists", None),
    ("create edge land (o land origin, d land destin)", "DuplicateKeyError"),
    ("create type nopk (x uint)", "InvalidError"),
    ("create type twopk (x uint pk, y uint pk)", "InvalidError"),
    ("create type twice (x uint pk, x text)", "DuplicateKeyError"),
    ("create edge noorigin (d land destin)", "InvalidError"),
    ("create edge nodestin (o land origin)", "InvalidError"),
    ("drop type land", "InvalidError"),
    ("drop edge land", "KeyNotFoundError"),
    ("drop edge goes", None),
    ("drop type land", None),
    ("drop type land", "KeyNotFoundError"),
    ("drop type land if exists", None),
])
refused("define_scopes", "create scope other", [
    ("create scope other", "CatalogError"),
    ("create scope other if not exists", None),
    ("use other", None),
    ("use nowhere", "NoSuchScopeError"),
    ("drop scope other", None),
    ("use other", "NoSuchScopeError"),
    ("drop scope other", "NoSuchScopeError"),
    ("drop scope other if exists", None),
])
refused("define_indexes_and_storages", NATIONS + "create storage tight set compression = 'zstd'; create edge goes (origin land origin, destin land destin, stamp time stamp) storage = tight", [
    ("create index i on goes (origin, destin)", None),
    ("create index i on goes (origin)", "DuplicateNameError"),
    ("create index j on goes (nothing)", "KeyNotFoundError"),
    ("drop index i", None),
    ("drop index i", "KeyNotFoundError"),
    ("create storage tight set compression = 'lz4'", "DuplicateNameError"),
    ("drop storage tight", "InvalidError"),
    ("drop edge goes; drop storage tight", None),
    ("create edge goes (origin land origin, destin land destin) storage = tight", "KeyNotFoundError"),
])
refused("text_order_is_refused", "use shop", [
    ("select 1 from client where client_name < 'a'", "TypeMismatchError"),
    ("select 1 from client where client_name = 'a'", None),
])
refused("locks_are_held", "create lock l", [
    ("create lock l", "DuplicateNameError"),
    ("lock l for reading", None),
    ("lock l", "SelfLockError"),
    ("unlock l", None),
    ("unlock l", "NotHolderError"),
    ("lock nothing", "KeyNotFoundError"),
    ("lock l for writing set timeout = 10", None),
    ("unlock l; drop lock l", None),
    ("lock l", "KeyNotFoundError"),
])


@query(literal([("select count(*), origin from did group by origin", "InvalidError"), ("select origin, count(*) from did group by origin", None)]))
def group_strict(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.execute(ACTS)
    return refusals(Session(spark, s.files.base, "shop", strict=True), spark, ["select count(*), origin from did group by origin", "select origin, count(*) from did group by origin"])


@query(literal([("l", "Timeout"), ("freed", None)]))
def locks_between_sessions(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session waits for another's lock only so long; what a session holds is freed when it ends."""
    s.execute("create lock l; lock l")
    other, out = Session(spark, s.files.base, "shop"), []
    for name in ("l", "freed"):
        try:
            other.execute("lock l set timeout = 10")
            out.append((name, None))
        except errors.TimeoutError_:
            out.append((name, "Timeout"))
        s.close()
    other.close()
    return rows(spark, out, "script string, error string")


# catalog
@query("SELECT * FROM (VALUES ('types', 'kind'), ('types', 'person'), ('edges', 'did'), ('indexes', 'i'), ('storages', 'tight'), ('procedures', 'f'), ('locks', 'l')) AS t(what, name)")
def show_all(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.execute(ACTS + "create index i on did (origin); create storage tight set compression = 'zstd'; create procedure m.f(x uint) language python; create lock l")
    return rows(spark, [(what, r[0]) for what in ("types", "edges", "indexes", "storages", "procedures", "locks") for r in s.execute(f"show {what}")], "what string, name string")


@query("SELECT * FROM (VALUES ('origin', 'person'), ('destin', 'kind'), ('stamp', 'time'), ('id', 'uint'), ('value', 'float')) AS t(name, type)")
def describe_edge(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.execute(ACTS)
    return rows(spark, list(s.execute("describe did")), "name string, type string")


# procedures
def _procedures(s: Session) -> None:
    def buyers(session: Session, kind: str) -> DataFrame:
        return session.sql(f"select origin, count(*) as n, round(spread(value), 9) as s from did where destin = '{kind}' group by origin")

    def twice(session: Session, kind: str) -> DataFrame:
        """Runs another procedure and works on its result."""
        return session.execute(f"exec buyers('{kind}')").df.select("origin", (F.col("n") * 2).alias("n"))

    def fib(session: Session) -> int:
        a, b = session.state.get("fib", (0, 1))
        session.state["fib"] = (b, a + b)
        return a

    def above(session: Session, least: float) -> tuple[int, float]:
        """Goes through a cursor's rows."""
        n, total = 0, 0.0
        for (value,) in session.execute("select value from did where origin = 3"):
            if value > least:
                n, total = n + 1, total + value
        return n, round(total, 6)

    s.register_module("procs", pytypes.SimpleNamespace(buyers=buyers, twice=twice, fib=fib, above=above))
    s.execute("create procedure procs.buyers(k text) language python; create procedure procs.twice(k text) language python; create procedure procs.fib() language python; create procedure procs.above(x float) language python")


@query("SELECT user_id AS origin, count(*) AS n, round(max(value) - min(value), 9) AS s FROM events WHERE event_type = 'click' GROUP BY 1")
def exec_query(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    _procedures(loaded(s, spark, sf_dir))
    return s.execute("exec buyers('click')").df


@query("SELECT user_id AS origin, count(*) * 2 AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def exec_nested(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    _procedures(loaded(s, spark, sf_dir))
    return s.execute("exec twice('click')").df


@query("SELECT count(*) AS n, round(coalesce(sum(value), 0), 6) AS total FROM events WHERE user_id = 3 AND value > 10")
def exec_rows(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    _procedures(loaded(s, spark, sf_dir))
    return rows(spark, [s.execute("exec above(10.0)").one_row()], "n long, total double")


@query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 1), (2, 1), (3, 2), (4, 3), (5, 5)) AS t(i, v)")
def exec_state(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    _procedures(s)
    return rows(spark, [(i, s.execute("execute fib()").one_value()) for i in range(6)], "i long, v long")


@query(literal([("exec fib(1)", "InvalidError"), ("exec buyers(1)", "TypeMismatchError"), ("exec nothing()", "KeyNotFoundError"), ("create procedure m.g() language lua", "NotSupportedError"), ("drop procedure fib", None), ("exec fib()", "KeyNotFoundError")]))
def exec_refused(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    _procedures(s)
    return refusals(s, spark, ["exec fib(1)", "exec buyers(1)", "exec nothing()", "create procedure m.g() language lua", "drop procedure fib", "exec fib()"])


@query("SELECT user_id AS origin, count(*) AS n, round(sum(value), 4) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(max(value) - min(value), 9) AS spread FROM events WHERE event_type = 'view' GROUP BY 1")
def exec_groupbuy(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure that comes with the engine."""
    s.register_module("own", procedures)
    s.execute("create procedure own.groupbuy(edge text, field text, destin text) language python")
    out = s.execute("exec groupbuy('acts', 'value', 'view')").df
    return out.select("origin", "n", F.round("sum", 4).alias("sum"), F.round("avg", 6).alias("avg"), "min", "max", F.round("spread", 9).alias("spread"))


@query("SELECT epoch_ns(ts) AS ns, value FROM events WHERE user_id = 3")
def exec_gettimeseries(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.register_module("own", procedures)
    s.execute("create procedure own.gettimeseries(edge text, field text, origin uint) language python")
    return s.execute("exec gettimeseries('acts', 'value', 3)").df.select((F.unix_micros(F.col("stamp").cast("timestamp")) * 1000).alias("ns"), "value")


@query("SELECT user_id AS origin, round(sum(value), 4) AS revenue FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-06' GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 3")
def exec_revenue(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.register_module("own", procedures)
    s.execute("create procedure own.revenue(edge text, field text, day time) language python")
    return s.execute("exec revenue('acts', 'value', '2024-01-05T13:00:00')").df.select("origin", F.round("revenue", 4).alias("revenue"))


@query("SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT), (2, 2), (3, 1), (4, 3)) AS t(i, v)")
def exec_nextid(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of their own for each name, also from another session."""
    other = Session(spark, s.files.base, "shop")
    return rows(spark, [(i, procedures.nextid(x, name)) for i, (x, name) in enumerate([(s, "a"), (other, "a"), (s, "b"), (s, "a")], 1)], "i long, v long")


# cursors, clients
@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
def cursor_fetch(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's cursor is fetched from by its number, some rows at a time, until its end."""
    r, out = s.execute("select nation_key as k, nation_name as name from nation order by k"), []
    while not r.eof:
        out += s.execute(f"fetch {r.id}").fetch(7)
    s.execute(f"close {r.id}")
    return rows(spark, [tuple(x) for x in out], "k long, name string")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation WHERE n_regionkey = 2")
def client_dbapi(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    s.execute(NATIONS)
    s.execute("insert into land select nation_key, nation_name, region from nation")
    with dbapi.connect(spark, s.files.base, "shop") as c:
        cur = c.cursor()
        cur.execute("select land_key as k, land_name as name from land where area = %s", (2,))
        return rows(spark, [tuple(x) for x in cur.fetchall()], "k long, name string")


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region")
def client_pandas(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(s.execute("select region_key as k, region_name as name from region").to_pandas(), "k long, name string")


@query("SELECT count(*) AS n, CAST(sum(l) AS BIGINT) AS v FROM (SELECT length(n_name) AS l FROM nation)")
def script_comments(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, upper case, several statements."""
    return s.execute("-- one\nCREATE TYPE t (k UINT PK); /* two\n lines */ SELECT COUNT(*) AS n, SUM(LENGTH(nation_name)) AS v FROM nation;").df


# streams
@query("SELECT user_id AS origin, event_type AS destin, epoch_ns(ts) AS ns, event_id AS id, value FROM events")
def stream_load(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of lines, loaded by a stream that takes what is there."""
    s.execute(ACTS)
    path = acts_file(s, spark, sf_dir)
    q = ingest.load_stream(s, path, "did", f"{s.files.base}/_stream")
    q.awaitTermination()
    return s.sql("select origin, destin, stamp + 0 as ns, id, value from did")


def _streamed(s: Session, spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    events = f"{sf_dir}/events.parquet"
    at = events.rpartition("/")
    source = spark.readStream.schema(spark.read.parquet(events).schema).option("pathGlobFilter", at[2]).parquet(at[0])
    source = source.withColumn("at", F.col("ts").cast("timestamp"))
    out, to = make(source), f"{s.files.base}/out"
    q = out.writeStream.format("parquet").option("path", to).option("checkpointLocation", f"{s.files.base}/_stream").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(to)


@query("WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS destin, count(*) AS n FROM events GROUP BY 1, 2) SELECT epoch_us(start) AS start, destin, n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_windows(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over event time; a window comes out once the watermark is past its end."""
    out = _streamed(s, spark, sf_dir, lambda d: ingest.windowed(d, "at", "1 hour", "10 minutes", ["event_type"], {"n": F.count(F.lit(1))}))
    return out.select(F.unix_micros("start").alias("start"), F.col("event_type").alias("destin"), "n")


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS stop, count(*) AS n FROM g GROUP BY user_id, k)
SELECT user_id AS origin, epoch_us(start) AS start, n FROM w WHERE stop <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end an hour after their last event."""
    out = _streamed(s, spark, sf_dir, lambda d: ingest.sessions(d, "at", "1 hour", "10 minutes", ["user_id"], {"n": F.count(F.lit(1))}))
    return out.select(F.col("user_id").alias("origin"), F.unix_micros("start").alias("start"), "n")


# the rest
@query("SELECT true AS later, true AS named")
def now_and_version(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.sql("select now() > '2020-01-01' as later, length(version()) > 0 as named")


@query("SELECT event_id AS id, CAST((year(ts) + 99) // 100 AS BIGINT) AS c, CAST(event_id AS VARCHAR) AS t FROM events")
def century_and_text(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.sql("select id, century(stamp) as c, totext(id) as t from acts")


@query("SELECT 'Bad' AS what, count(*) AS n FROM region WHERE false UNION ALL SELECT 'rows', count(*) FROM region")
def command_line(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script run from the command line prints its rows."""
    s.execute("create type area (k uint pk, name text)")
    s.execute("insert into area select region_key, region_name from region")
    s.close()
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        cli.run(spark, s.files.base, "use shop; select k, name from area")
    return rows(spark, [("Bad", 0), ("rows", sum(";" in x for x in shown.getvalue().splitlines()))], "what string, n long")


@query("SELECT * FROM (VALUES ('time', true), ('round', true), ('bad', true)) AS t(what, ok)")
def host_time(s: Session, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The helpers for times on the host."""
    ns = types.parse_time("2018-10-28T12:13:14.000000001")
    return rows(spark, [("time", types.parse_time(types.format_time(ns)) == ns), ("round", types.round_time(ns, types.HOUR) == types.parse_time("2018-10-28T12:00:00")), ("bad", types.parse_time("2018-02-30") is None)], "what string, ok boolean")
