"""From raw documents to token ids, in stages that are each written and read again.

Every stage works on all documents the one before kept.  All but the last return the
columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from offerloom.llm import bpe, decontaminate, fuzzy_lines, jaccard, langid
from offerloom.session import configure, cut_lineage, fresh_path

LEAST_SCORE = 0.5  # below this the language is not clear enough to keep a document


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or between languages go, and labels become what was found."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near-equal lines that stand elsewhere; a document of which no word is left goes.  Null texts stay."""
    left = fuzzy_lines.dedup_lines(docs)
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return (left.where(~(blank & (F.col("n_removed") > 0)))
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-grams of similarity 0.8 or more: that with the least id, null last.

    Rows are told apart by a written number, so of repeated rows, of rows that share an id and of
    rows without one, one stays as well.  Null and blank texts are linked with nothing and stay.
    """
    rows = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    linked = jaccard.link(rows, percent=80, size=5, key="__row", keep=("__row", "doc_id"))
    top = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("top")
    kept = linked.groupBy("component_id").agg(top).select(F.col("top.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exactly or with some edits; null texts hold none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left; decoding gives the text's bytes again.  A null text has no ids."""
    return bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source")).drop("decoded")


STAGES = [("language", language), ("lines", lines), ("near copies", near_copies), ("benchmark", benchmark), ("tokens", encode)]
# The stages learn, hash at random and search by edits: SQL cannot express them; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
