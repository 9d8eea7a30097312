"""The corpus pipeline on small tables."""

import corpus_pipeline
from fixtures import ROWS, frame

from edgeloom.llm import common, neardup

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = common.table(spark, DATA, "documents")
    scratch, before, columns = common.Scratch(spark, "test"), docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    pieces = scratch.keep(corpus_pipeline.packed(spark, docs, DATA), "pieces")
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert neardup.near_duplicates(docs).filter("not kept").count() <= 2  # pseudonyms may make a few texts alike
    assert corpus_pipeline.run(spark, DATA).count() == pieces.count()


def test_stages_take_awkward_rows(spark):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, frame(spark, []), DATA).count() == 0
    assert corpus_pipeline.distinct(spark, docs, DATA).count() < len(ROWS)


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    """Whole runs: awkward rows with labels for some; no labels; no documents."""
    from pyspark.sql import functions as F

    docs, labels = frame(spark), spark.createDataFrame([(1, 1, 0), (8, 0, 1), (11, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for name, d, k in (("both", docs, labels), ("unlabelled", docs, labels.limit(0)), ("none", docs.limit(0), labels)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        k.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    for name in ("both", "unlabelled"):
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    ids = {r[0] for r in pieces.select("doc_id").distinct().collect()}
    assert {1, 4, 5, 6, 7, 8, 10, 11, 12, None} == ids  # without labels only the copies go
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
