"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, language_id, mixing, ngram_jaccard, queries, substring_dedup
from graphloom.llm.shared import Tables


#: The columns that stages read; any others are carried along under names that clash with nothing.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[c if c in KNOWN else f"other{k}" for k, c in enumerate(docs.columns)])


def _named(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from those of ``_plain``."""
    return out.select(*_plain(docs).columns).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known; those that the classifier rejects go.  The model learns from all labelled rows' bounded sample.

    Null and empty texts and texts without a letter are rejected; rows that repeat fare alike, an empty table gives an empty
    one, nulls in other columns stay.  Columns may have any name, here and in every stage.
    """
    plain = _plain(docs)
    model = language_id.fit(docs.select("text", "lang"))
    return _named(language_id.identify(plain, model, keep=plain.columns).where("not rejected"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: that of the least doc_id, null last.

    Rows count as documents of their own, also where they share a doc_id or have none, and of rows that repeat one stays;
    those without words, null texts among them, are no duplicates of others.  An empty table gives an empty one.
    """
    # written, as row numbers may differ when they are counted again
    rows = Tables(spark).write(_plain(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = ngram_jaccard.jaccard_join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    least = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m"))
    return _named(rows.join(least.select("m._row"), "_row", "left_semi"), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut sentences covered by a non-first repeated run; documents that lose all their words go.

    Null and empty texts stay as they are; ties and repeated rows are as in ``substring_dedup.dedup``, so rows that repeat are
    cut alike; an empty table gives an empty one.
    """
    cut = substring_dedup.dedup(_plain(docs))
    return _named(_counted(cut.where((F.size("removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, once per pass of the mix: all of them once, and half as many words again by weight.

    Texts without words aren't taken; nulls, ties, repeated rows and empty tables are as in ``mixing.take``.
    """
    return _named(_counted(mixing.take(_plain(docs), base=1)), docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of its ids and of what they decode to.

    One row a row: null texts have no ids, a null doc_id stays, rows that repeat repeat, an empty table gives an empty one.
    """
    ranks, pattern = queries.vocabulary()
    return bpe.encode(docs, ranks, pattern, emit="digest")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: SQL can't express the classifier, so run() is tested against brute force and invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            tables.drop(f"stage-{STAGES[k - 1][0]}")
    return docs
