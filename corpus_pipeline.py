"""The training corpus: five stages over whole documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents. None collects documents but for the bounded samples that the
two classifiers are fitted on.

Null and empty texts: not toxic (score 0); in the quality stage they get the probability of a text without words; they are
no copies of each other; pseudonyms leave them as they are; packed, they are their end token alone. Null ids: such rows
are kept or rejected by their text, and by the neardup stage only if they repeat a text or are linked to a document with
an id. Rows that repeat id and text become one in the neardup stage. Nulls in other columns, and further columns, stay.
Texts are taken whole, whatever their length. Without labels nothing is rejected by the classifiers; an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import common, neardup, packing, pii, quality, toxicity

#: Percent of similarity from which the corpus keeps one document only; op10's contract has its own.
NEAR = 80


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5."""
    model = toxicity.learn(spark, docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.filter(F.col("toxicity") < 0.5).drop("toxicity")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely to be rated above the lowest grade."""
    model = quality.learn(spark, docs, common.table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.filter(F.col("tail_probability") >= quality.KEEP_FROM).drop("tail_probability", "expected_grade")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (word shingles with a similarity of 0.8 or more)."""
    return neardup.deduplicate(docs, NEAR)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(docs).drop("replaced")
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row for each piece."""
    return packing.pack_documents(docs, packing.default_path())


STAGES = [("toxicity", not_toxic), ("quality", good), ("neardup", distinct), ("pii", private), ("packing", packed)]

#: SQL can't express the fitted models, tokenization or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
