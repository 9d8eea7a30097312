"""Every registered query of the engine against DuckDB."""

import oracle
import pytest

from edgeloom import queries, statements


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.duck(sf_dir)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    assert oracle.rows_of(queries.QUERIES[name](spark, sf_dir)) == oracle.rows_duck(con, queries.ORACLE_SQL[name])


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", list(statements.QUERIES))
def test_statements(spark, sf_dir, con, name):
    out = statements.QUERIES[name](spark, sf_dir)
    assert oracle.rows_of(out) == oracle.rows_duck(con, statements.ORACLE_SQL[name])
    rel = con.sql(statements.ORACLE_SQL[name])
    assert {c: KINDS[t] for c, t in out.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))


def test_types(spark, sf_dir, con):
    kinds = {"int64": "BIGINT", "int32": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "bool": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    kinds |= {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}
    wrong = {}
    for name, f in queries.QUERIES.items():
        ours = {c: kinds[t] for c, t in f(spark, sf_dir).dtypes}
        rel = con.sql(queries.ORACLE_SQL[name])
        theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
        if ours != theirs:
            wrong[name] = (ours, theirs)
    assert not wrong
