"""Awkward documents: nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

LONG = " ".join(f"wort{i % 977} é{i % 13}," for i in range(60_000))
BASE = " ".join(f"alpha{i}" for i in range(120))
ROWS = [
    (1, BASE, "en", 10),
    (2, BASE + " omega", "en", None),
    (3, BASE.upper(), None, 3),
    (4, None, "de", 4),
    (5, "", None, 5),
    (6, " \t\n ", "fr", 6),
    (7, LONG, "de", 7),
    (7, LONG, "de", 7),
    (8, "one two three", "es", 8),
    (9, "One  two\tTHREE", "es", 9),
    (10, "x" * 300_000, None, 10),
    (None, "kein id und 12.34 <|endoftext|>   \x1c ź 🙂🙂", "de", None),
    (11, "tab\there  　 non-breaking  double  ", "en", 1),
    (12, "12.34.56.78 and +1 (555) 123-4567 and a.b@c.de", "en", 1),
]
SCHEMA = "doc_id long, text string, lang string, score int"


def frame(spark, rows=None):
    """Extra columns: `score` and `bucket`, `key`, `c0`, names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumn("bucket", F.lit("b")).withColumn("key", F.lit(None).cast("string")).withColumn("c0", F.lit(3)).repartition(3)
