"""Counts over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .search import live


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def filled_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in all, and rows with a value in each column, in one pass."""
    return df.agg(F.count("*").alias("total_rows"), *[F.count(c).alias(f"{c}_filled") for c in columns])


def change_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows_seen"), F.count_if(F.col("_changed")).alias("rows_changed"))


def live_sources(df: DataFrame, as_of) -> DataFrame:
    return live(df, as_of).select("source").distinct()
