"""Statements on stored tables: definitions, inserts, loads, constraints, procedures, locks, cursors, DB-API."""

import random
import types as pytypes

import oracle
import pytest

from edgeloom import dbapi, errors, types
from edgeloom.plans import parser
from edgeloom.session import Session

DDL = """
create scope retail; use retail;
create type client (client_key uint pk, client_name text, birthdate time);
create type product (prod_desc text, prod_key uint pk, prod_cat uint, prod_price float);
create type store (store_name text pk, city text);
create storage fast set compression = 'zstd', largesize = 1000000;
create edge buys (origin client origin, destin product destin, stamp time stamp, quantity uint, price float) storage = fast;
create stamped edge visits (origin client origin, destin store destin, stamp time stamp, quantity uint);
create edge likes (origin client origin, destin product destin);
"""


@pytest.fixture(scope="module")
def s(spark, tmp_path_factory):
    s = Session(spark, f"file://{tmp_path_factory.mktemp('base')}")
    s.execute(DDL)
    yield s
    s.close()


def test_definitions(s):
    assert [r[0] for r in s.execute("show types")] == ["client", "product", "store"]
    assert [r[0] for r in s.execute("show edges")] == ["buys", "likes", "visits"]
    assert list(s.execute("describe buys")) == [("origin", "client"), ("destin", "product"), ("stamp", "time"), ("quantity", "uint"), ("price", "float")]
    assert [r[0] for r in s.execute("show storages")] == ["fast"]
    s.execute("create index i on buys (origin, destin); drop index i; create type client (x uint pk) if not exists")
    for bad, error in (
        ("create type client (x uint pk)", errors.DuplicateKeyError),
        ("create edge client (o client origin, d client destin)", errors.DuplicateKeyError),
        ("create type nopk (x uint)", errors.InvalidError),
        ("create edge noorigin (d client destin)", errors.InvalidError),
        ("create edge nodestin (o client origin)", errors.InvalidError),
        ("create type twice (x uint pk, x text)", errors.DuplicateKeyError),
        ("drop type nothing", errors.KeyNotFoundError),
        ("drop type client", errors.InvalidError),
        ("drop edge client", errors.KeyNotFoundError),
        ("use nowhere", errors.NoSuchScopeError),
        ("select x from nothing", errors.NoSuchTableError),
        ("select * from client where", errors.ParserError),
    ):
        with pytest.raises(error):
            s.execute(bad)
    s.execute("drop type nothing if exists")


def test_insert_and_constraints(s):
    s.execute("insert into client (client_key, client_name) values (0, 'zero'); insert into client values (1, 'it\\'s\\n\\\\', '1971-05-18T06:23:10.123456789')")
    assert s.one_row("select client_name, birthdate, nano(birthdate) from client where client_key = 1") == ("it's\n\\", types.parse_time("1971-05-18T06:23:10.123456789"), 123456789)
    assert s.one_row("select birthdate from client where client_key = 0") == (None,)
    s.execute("insert into buys (origin, destin, stamp, quantity, price) values (1, 7, '2018-10-28', 2, 1.5)")
    s.execute("insert into likes (origin, destin) values (1, 7); insert into visits (origin, destin, stamp) values (1, 'A', 5)")
    for bad, error in (
        ("insert into client (client_key) values (0)", errors.DuplicateKeyError),
        ("insert into client (client_key) values (1)", errors.DuplicateKeyError),
        ("insert into client (client_name) values ('x')", errors.InvalidError),
        ("insert into client (client_key) values (-1)", errors.TypeMismatchError),
        ("insert into client (client_key, client_name) values (9, 5)", errors.TypeMismatchError),
        ("insert into client (client_key, nothing) values (9, 5)", errors.KeyNotFoundError),
        ("insert into buys (destin, stamp) values (7, 1)", errors.InvalidError),
        ("insert into buys (origin, stamp) values (7, 1)", errors.InvalidError),
        ("insert into buys (origin, destin) values (7, 1)", errors.InvalidError),
        ("insert into likes (origin, destin, stamp) values (7, 1, 1)", errors.KeyNotFoundError),
        ("insert into visits (origin, destin, stamp) values (7, 1, 1)", errors.TypeMismatchError),
    ):
        with pytest.raises(error):
            s.execute(bad)
    assert s.one_value("select count(*) from buys where stamp = '2018-10-28'") == 1
    assert s.one_value("select count(*) from buys where stamp < '2018-10-28'") == 0


def test_load(s, tmp_path):
    (tmp_path / "p.csv").write_text("prod_key;prod_desc;prod_price\n1;a\\\\b\\nc;2.5\n2;;\n2;again;1\nx;bad;1\n;none;1\n3;" + "y" * 1100 + ";1\n4;ok;no\n5;ok;5;6\n")
    r = s.execute(f"load '{tmp_path}/p.csv' into product use header set errors = '{tmp_path}/err'").report
    assert (r.affected, r.errors) == (2, 6)
    assert sorted(s.execute("select prod_key, prod_desc, prod_price, prod_cat from product")) == [(1, "a\\b\nc", 2.5, None), (2, None, None, None)]
    lines = sorted(x for f in (tmp_path / "err").glob("part*") for x in f.read_text().splitlines())
    assert [x.split(":")[0] for x in lines] == [f"line {n}" for n in (4, 5, 6, 7, 8, 9)]
    r = s.execute(f"load '{tmp_path}/p.csv' into product use header").report
    assert (r.affected, r.errors) == (0, 8)
    with pytest.raises(errors.KeyNotFoundError):
        (tmp_path / "q.csv").write_text("prod_key;nothing\n1;2\n")
        s.execute(f"load '{tmp_path}/q.csv' into product use header")
    with pytest.raises(errors.BadPathError):
        s.execute(f"load '{tmp_path}/none.csv' into product")


def test_load_edges_prunes_periods(s, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(5), rng.randrange(9), f"2018-{m:02d}-{d:02d}T00:00:00.{k:09d}", rng.randrange(1, 9), rng.random()) for m in range(1, 13) for d in (1, 15) for k in range(20)]
    (tmp_path / "b.csv").write_text("ignored\n" + "".join(";".join(map(str, r)) + "\n" for r in rows))
    assert s.execute(f"load '{tmp_path}/b.csv' into buys ignore header").report.affected == len(rows)
    q = "select origin, count(*) as n, sum(quantity) as q from buys where stamp >= '2018-03-01' and stamp < '2018-03-02' and destin != 7 group by origin"
    inside = [r for r in rows if r[2] < "2018-03-02" and r[2] >= "2018-03-01" and r[1] != 7]
    assert sorted(s.execute(q)) == sorted((o, sum(r[0] == o for r in inside), sum(r[3] for r in inside if r[0] == o)) for o in {r[0] for r in inside})
    assert "_period" in s.explain(q).split("PartitionFilters")[1].split("\n")[0]
    n = s.one_value("select count(*) from buys")
    assert s.execute("delete from buys where stamp < '2018-02-01'").report.affected == 40
    assert s.one_value("select count(*) from buys") == n - 40
    assert s.execute("drop period on buys where stamp >= '2018-12-01'").report.affected == 40
    assert s.execute("update buys set quantity = 100, price = price * 2 where origin = 3").report.affected == s.one_value("select count(*) from buys where quantity = 100")


def test_insert_select_and_empty_tables(s):
    s.execute("create type copy (k uint pk, name text)")
    assert list(s.execute("select * from copy")) == []
    assert s.one_row("select count(*), sum(k), max(name) from copy") == (0, None, None)
    assert s.execute("insert into copy select client_key, client_name from client").report.affected == 2
    with pytest.raises(errors.DuplicateKeyError):
        s.execute("insert into copy select client_key, client_name from client")
    s.execute("drop type copy")


def test_strict_groups(s):
    strict = Session(s.spark, s.files.base, "retail", strict=True)
    with pytest.raises(errors.InvalidError):
        strict.execute("select count(*), origin from buys group by origin")
    with pytest.raises(errors.InvalidError):
        s.execute("select price, count(*) from buys group by origin")
    assert s.one_value("select price from buys limit 1") is not None
    strict.close()


@pytest.mark.parametrize("bad", ["client_name < 'a'", "client_key", "client_name = 1", "birthdate = 'x'", "client_key + 1", "sum(client_key) > 1", "not client_key", "client_name + 1 > 2", "client_key in (1, 'a')"])
def test_type_errors(s, bad):
    with pytest.raises(errors.EngineError):
        s.execute(f"select 1 from client where {bad}")


def test_text_that_looks_like_a_date_is_text_beside_text(s):
    assert s.one_value("select count(*) from client where client_name = '2018-01-01'") == 0


def test_constants(s):
    assert s.one_row("select 3*2^1/2, 3*2+1, 3*(2-1), (3*2)^2, 5/2, -7 % 3, 1/0, 1%0, 1.0/0.0") == (3.0, 7, 3, 36.0, 2, -1, None, 0, None)
    assert s.one_row("select year('2016-01-03'), wday('2016-01-03'), yday('2016-01-03'), milli('1971-05-18T06:23:10.123456789'), micro('1971-05-18T06:23:10.123456789'), nano('1971-05-18T06:23:10.123456789')") == (2016, 0, 2, 123, 123456, 123456789)
    assert s.one_value("select '1971-05-18T06:23:10.123456000'") == types.parse_time("1971-05-18T06:23:10.123456")
    assert s.one_row("select null or true, false and null, coal(null, 2), log(0), version()")[:3] == (True, False, 2)
    assert abs(s.one_value("select now()") - types.now()) < 60 * types.SECOND
    assert s.one_row("select toint(3.9), toint(-3.9), touint(-1), tofloat(2), totime('1970-01-02')") == (3, -3, None, 2.0, types.DAY)
    with pytest.raises(errors.UnknownSymbolError):
        s.execute("select nothing(1)")
    with pytest.raises(errors.FunctionError):
        s.execute("select sin()")
    with pytest.raises(errors.InvalidEscapeError):
        s.execute("select 'a\\q'")


def test_comments_case_and_fetch(s):
    r = s.execute("-- one\nSELECT client_key /* two\n lines */ FROM client ORDER BY client_key;")
    assert s.execute(f"fetch {r.id}").fetch(1) == [(0,)]
    assert r.fetch(5) == [(1,)] and r.eof
    s.execute(f"close {r.id}")
    with pytest.raises(errors.NotFoundError):
        s.execute(f"fetch {r.id}")


def test_procedures(s):
    def groupbuy(session, product):
        return session.sql(f"select origin, count(*) as n, sum(quantity) as q, spread(price) as s from buys where destin = {product} group by origin")

    def fib(session):
        a, b = session.state.get("fib", (0, 1))
        session.state["fib"] = (b, a + b)
        return a

    s.register_module("procs", pytypes.SimpleNamespace(groupbuy=groupbuy, fib=fib))
    s.execute("create procedure procs.groupbuy(p uint) language python; create procedure procs.fib() language python")
    assert len(list(s.execute("exec groupbuy(3)"))) > 0
    assert [s.execute("execute fib()").one_value() for _ in range(6)] == [0, 1, 1, 2, 3, 5]
    assert sorted(r[0] for r in s.execute("show procedures")) == ["fib", "groupbuy"]
    assert list(s.execute("describe groupbuy")) == [("p", "uint")]
    for bad, error in (("exec groupbuy()", errors.InvalidError), ("exec groupbuy('a')", errors.TypeMismatchError), ("exec nothing()", errors.KeyNotFoundError), ("create procedure m.f() language lua", errors.NotSupportedError)):
        with pytest.raises(error):
            s.execute(bad)
    s.execute("drop procedure fib")


def test_locks(s):
    s.execute("create lock l")
    other = Session(s.spark, s.files.base, "retail")
    s.execute("lock l for reading; ")
    other.execute("lock l for reading set timeout = 0; unlock l")
    with pytest.raises(errors.TimeoutError_):
        other.execute("lock l set timeout = 10")
    with pytest.raises(errors.SelfLockError):
        s.execute("lock l")
    with pytest.raises(errors.NotHolderError):
        other.execute("unlock l")
    s.execute("unlock l")
    other.execute("lock l for writing")
    other.close()  # gives its locks back
    with s.with_lock("l", timeout_ms=0):
        pass
    with pytest.raises(errors.KeyNotFoundError):
        s.execute("lock nothing")
    s.execute("drop lock l")


def test_dbapi(s):
    with dbapi.connect(s.spark, s.files.base, "retail") as c:
        cur = c.cursor()
        cur.execute("insert into store (store_name, city) values (%s, %s)", ("x'; drop type store", None))
        c.commit()
        cur.execute("select store_name as name, city from store where store_name = %s", ("x'; drop type store",))
        assert [d[0] for d in cur.description] == ["name", "city"]
        cur.setRowFormat("dict")
        assert cur.fetchall() == [{"name": "x'; drop type store", "city": None}]
        with pytest.raises(dbapi.ProgrammingError):
            cur.execute("selec 1")
        with pytest.raises(dbapi.NotSupportedError):
            cur.executemany("select 1", [])


def test_session_survives_reopening(s):
    other = Session(s.spark, s.files.base, "retail")
    assert other.one_value("select count(*) from client") == 2
    assert other.edge("buys").where("origin = 3").group("origin").select("origin", "count(*) as n").count() == 1
    other.close()


def test_time_round_trip():
    for t in ("1677-09-22", "1970-01-01T00:00:00", "2018-10-28T12:13:14.000000001", "2262-04-10T01:02:03.999999999"):
        ns = types.parse_time(t)
        assert types.parse_time(types.format_time(ns)) == ns
    assert types.parse_time("2018-13-01") is None and types.parse_time("2018-02-30") is None
    assert types.round_time(types.parse_time("2018-10-28T12:13:14"), types.HOUR) == types.parse_time("2018-10-28T12:00:00")


def test_precedence():
    from edgeloom.plans.ast import Bin, Field, In, IsNull, Lit, Un

    where = lambda t: parser.parse(f"select 1 from t where {t}")[0].where
    assert where("a = 1 or b = 2 and not c = 3") == Bin("or", Bin("=", Field("a"), Lit(1)), Bin("and", Bin("=", Field("b"), Lit(2)), Un("not", Bin("=", Field("c"), Lit(3)))))
    assert where("a-1 = 2^3^2") == Bin("=", Bin("-", Field("a"), Lit(1)), Bin("^", Bin("^", Lit(2), Lit(3)), Lit(2)))
    assert where("a = b is null") == IsNull(Bin("=", Field("a"), Field("b")), False)
    assert where("a + 1 in (2, -3)") == In(Bin("+", Field("a"), Lit(1)), (Lit(2), Lit(-3)))


def test_random_conditions(spark, sf_dir):
    """Random AND/OR/NOT over comparisons, against DuckDB."""
    from edgeloom import queries

    rng, con, session = random.Random(5), oracle.duck(sf_dir), queries.session(spark, sf_dir)

    def condition(depth: int) -> tuple[str, str]:
        if depth == 0 or rng.random() < 0.2:
            a, b = rng.choice([("origin", "user_id"), ("value", "value"), ("hour(stamp)", "hour(ts)")])
            op, v = rng.choice(["=", "!=", "<", ">", "<=", ">="]), rng.randrange(0, 40)
            return (f"{a} in ({v}, {v + 3})", f"{b} IN ({v}, {v + 3})") if rng.random() < 0.2 else (f"{a} {op} {v}", f"{b} {op} {v}")
        (a, b), (x, y) = condition(depth - 1), condition(depth - 1)
        op = rng.choice(["and", "or"])
        return (f"not ({a} {op} {x})", f"NOT ({b} {op} {y})") if rng.random() < 0.2 else (f"({a} {op} {x})", f"({b} {op} {y})")

    for _ in range(12):
        ours, theirs = condition(3)
        assert session.sql(f"select count(*) as n from acts where {ours}").first()[0] == con.sql(f"SELECT count(*) FROM events WHERE {theirs}").fetchall()[0][0], ours


def test_changes_touch_only_their_periods(spark, tmp_path):
    """Folders of untouched periods keep their files; a wholly deleted period has none; an update of the stamp moves rows."""
    with Session(spark, f"file://{tmp_path}") as s:
        s.execute("create scope a; use a; create type p (k uint pk); create edge e (origin p origin, destin p destin, stamp time stamp, n int)")
        s.append("e", spark.range(400).selectExpr("id as origin", f"id % 7 as destin", f"id * {types.DAY} as stamp", "id as n"))
        files = lambda: {f.parent.name: f.name for f in (tmp_path / "a" / "e").rglob("*.parquet")}
        before = files()
        assert s.execute(f"delete from e where stamp < {28 * types.DAY}").report.affected == 28
        assert "_period=0" not in files() and {k: v for k, v in before.items() if k != "_period=0"} == files()
        assert s.execute("update e set n = 0 where origin = 100").report.affected == 1
        assert sum(before[k] != v for k, v in files().items()) == 1 and s.one_value("select n from e where origin = 100") == 0
        assert s.execute(f"update e set stamp = {types.DAY} where origin = 399").report.affected == 1
        assert s.one_value(f"select count(*) from e where stamp < {28 * types.DAY}") == 1
        assert s.one_value("select count(*) from e") == 372


def test_many_inserts_look_keys_up_once(spark, tmp_path):
    with Session(spark, f"file://{tmp_path}") as s:
        s.execute("create scope a; use a; create type p (k uint pk, t text)")
        s.execute("".join(f"insert into p values ({i}, 'x');" for i in range(30)))
        s.flush()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
        spark.sparkContext.setJobGroup("inserts", "inserts")
        s.execute("".join(f"insert into p values ({i}, 'x');" for i in range(40, 70)))
        assert len(jobs("inserts")) <= 2
        spark.sparkContext.setJobGroup(None, None)
        for bad in ("insert into p values (5, 'x')", "insert into p values (80, 'x'); insert into p values (5, 'x')", "insert into p values (81, 'x'); insert into p values (81, 'y')"):
            with pytest.raises(errors.DuplicateKeyError):
                s.execute(bad)
        assert s.one_value("select count(*) from p") == 62


def test_a_stream_batch_that_runs_again(spark, tmp_path, monkeypatch):
    """A failure after the files were moved, before the mark: the batch adds nothing the second time. Repeated keys are reported."""
    from edgeloom.sources.catalog import Files
    from edgeloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1;2;5;a\n2;3;6;b\nbad;4;7;c\n")
    (tmp_path / "keys").mkdir()
    (tmp_path / "keys" / "a.csv").write_text("1;x\n2;y\n1;z\nbad;w\n")
    with Session(spark, f"file://{tmp_path}/base") as s:
        s.execute("create scope a; use a; create type p (k uint pk, value text); create edge e (origin p origin, destin p destin, stamp time stamp, line text)")
        start = lambda folder, name: ingest.load_stream(s, f"file://{tmp_path}/{folder}", name, f"file://{tmp_path}/c{name}", errors_to=f"file://{tmp_path}/err{name}").awaitTermination()
        write = Files.write

        def failing(self, path, text):
            if "/loaded/" in path:
                raise OSError("gone")
            write(self, path, text)

        monkeypatch.setattr(Files, "write", failing)
        with pytest.raises(Exception, match="gone"):
            start("in", "e")
        monkeypatch.setattr(Files, "write", write)
        assert s.one_value("select count(*) from e") == 2
        start("in", "e")
        assert sorted(s.execute("select origin, destin, line from e")) == [(1, 2, "a"), (2, 3, "b")]
        start("keys", "p")
        assert len(list(s.execute("select k, value from p"))) == 2
        assert sorted(x.split(":")[0] for f in (tmp_path / "errp").rglob("part*") for x in f.read_text().splitlines()) == ["duplicate key in k", "k is not a uint"]
