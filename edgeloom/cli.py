"""python -m edgeloom.cli --base DIR [--use SCOPE] [-f script.sql | -c "statement"]: rows are printed with ; between fields."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import errors
from .plans import parser
from .session import Session


def shown(value) -> str:
    return "NULL" if value is None else str(value)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--base", required=True)
    p.add_argument("--use")
    p.add_argument("-f", "--file")
    p.add_argument("-c", "--command")
    p.add_argument("--parse", action="store_true", help="print the syntax trees only")
    p.add_argument("--explain", action="store_true", help="print plans of queries")
    a = p.parse_args(argv)
    text = a.command if a.command else open(a.file, encoding="utf-8").read() if a.file else sys.stdin.read()
    if a.parse:
        for s in parser.parse(text):
            print(s)
        return 0
    spark = SparkSession.builder.getOrCreate()
    try:
        if a.explain:
            with Session(spark, a.base, a.use) as session:
                print(session.explain(text.strip().rstrip(";")))
        else:
            run(spark, a.base, text, a.use)
    except errors.EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def run(spark: SparkSession, base: str, text: str, scope: str | None = None) -> None:
    """Prints each statement's report or rows."""
    with Session(spark, base, scope) as session:
        for s in parser.parse(text):
            r = session._run(s)
            if r.report:
                print(f"{r.report.affected} rows, {r.report.errors} errors, {r.report.runtime} us")
            for row in r:
                print(";".join(map(shown, row)))


if __name__ == "__main__":
    sys.exit(main())
