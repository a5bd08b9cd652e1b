"""The combined run: expire, merge the sources, dedupe, expire, write the ledger."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.dates import lenient_stamp
from ..model import DEFAULT_BOOK, SourceBook, SourceSpec
from ..operators import dedupe, enrich, ledger, merge
from ..session import cut_lineage
from ..sources import snapshots

CHECK = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("checked_at", T.TimestampType()), T.StructField("count", T.LongType()),
    T.StructField("error", T.StringType()),
])


@dataclass(frozen=True)
class SourceJob:
    """A source and the function that plans its item table from landed data."""

    spec: SourceSpec
    items: Callable[[SparkSession], DataFrame]


def gather(spark: SparkSession, jobs: list[SourceJob]) -> tuple[list[tuple[DataFrame, SourceSpec]], dict[str, str]]:
    """Run each source's extraction by itself; one that fails leaves the others alone."""
    done, failures = [], {}
    for job in jobs:
        try:
            done.append((cut_lineage(job.items(spark), job.spec.name), job.spec))
        except Exception as problem:  # noqa: BLE001 - any failure is that source's own
            failures[job.spec.name] = str(problem).strip().split("\n")[0] or type(problem).__name__
    return done, failures


def run(spark: SparkSession, root: str, jobs: list[SourceJob], as_of, now, order: list | None = None,
        book: SourceBook = DEFAULT_BOOK, pages: DataFrame | None = None) -> DataFrame:
    """One whole run over the catalogue under ``root``; returns its source checks.

    ``pages`` are landed detail pages of source 1: rows of the last hours that still show
    only their summary are enriched from them after the merge.
    """
    base = snapshots.read_snapshot(spark, f"{root}/offers")
    base = merge.mark_expired(base, as_of, now).drop("_changed")
    done, failures = gather(spark, jobs)
    merged = cut_lineage(merge.upsert_all(base, done, as_of, now, order), "merged") if done else base
    counts = {}
    if done:
        prefix = merged.where(F.col("_action") != "keep").groupBy("source").agg(F.count("*").alias("n"))
        by_name = {r["source"]: r["n"] for r in prefix.collect()}  # one row per source
        counts = {spec.name: sum(by_name.get(n, 0) for n in spec.stored_names) for _, spec in done}
        merged = merged.drop("_action")
        if pages is not None:
            merged = enrich.enrich_from_pages(merged, pages, as_of, now=now).drop("_outcome")
    single = dedupe.mark_duplicates(merged, as_of, now, book).drop("_changed")
    final = merge.mark_expired(single, as_of, now).drop("_changed")
    snapshots.write_snapshot(final, f"{root}/offers")

    checks = spark.createDataFrame(
        [(name, "success", now, counts[name], None) for name in counts]
        + [(name, "failed", now, None, text) for name, text in failures.items()], CHECK)
    metadata = snapshots.read_metadata(spark, f"{root}/ledger")
    previous = metadata.where(F.col("key").startswith(ledger.fv.SOURCE_STATUS_PREFIX)).select(
        ledger.read_state(F.col("value"), ledger.SOURCE_STATE).alias("s")).select(
        "s.source", "s.status", lenient_stamp(F.col("s.checked_at")).alias("checked_at"),
        lenient_stamp(F.col("s.last_successful_at")).alias("last_successful_at"), "s.count", "s.error")
    states = ledger.source_states(checks, previous)
    rows = ledger.state_rows(states).unionByName(ledger.run_rows(ledger.run_state(checks)))
    for items, spec in done:
        if spec.notes_check:
            found = items.agg(F.countDistinct("id").alias("non_duplicate_records"), F.lit(now).cast("timestamp").alias("checked_at"))
            rows = rows.unionByName(ledger.check_rows(found))
    snapshots.write_metadata(merge.upsert_metadata(metadata, rows), f"{root}/ledger")
    return checks
