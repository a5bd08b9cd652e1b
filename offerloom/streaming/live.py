"""The repeated batch as a stream: landed files in, catalogue snapshots out.

Triggers are ``availableNow``: every run takes what has landed since the last one
and ends.  The checkpoint holds the stream's place; sinks are catalogues in buckets or snapshot folders.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import SourceSpec
from ..operators import merge
from ..sources import buckets
from ..sources.snapshots import write_snapshot


def landed_stream(spark: SparkSession, path: str, schema, form: str = "parquet", only: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_to_end(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_stream(items: DataFrame, root: str, checkpoint: str, spec: SourceSpec, as_of, now, order: list | None = None) -> None:
    """Merge every micro-batch into the buckets of its ids in the catalogue under ``root``.

    A batch's epoch is committed with its rows, so a batch repeated after a failure is
    skipped.  A micro-batch is no full crawl, so nothing goes stale.  Only a source
    that purges its closed rows reads more than the buckets of the batch.
    """
    def merge_batch(batch: DataFrame, epoch: int) -> None:
        merged = lambda base, rows: merge.upsert(base, rows, _no_sweep(spec), as_of, now, order).drop("_action")
        buckets.change(batch.sparkSession, root, batch, merged, epoch=(checkpoint, epoch), everywhere=spec.purge_closed)

    run_to_end(items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge_batch))


def _no_sweep(spec: SourceSpec) -> SourceSpec:
    return replace(spec, marks_stale=False)


def first_seen_stream(rows: DataFrame, key: str, time: str, lateness: str, path: str, checkpoint: str) -> None:
    """First row per key within the watermark, appended to a table."""
    first = rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
    run_to_end(first.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
               .outputMode("append"))


def health_stream(checks: DataFrame, root: str, checkpoint: str, schema) -> None:
    """Latest state per source with the last success carried in the stream's state."""
    states = checks.groupBy("source").agg(
        F.max_by("status", F.struct("checked_at", "check_id")).alias("status"),
        F.max("checked_at").alias("checked_at"),
        F.max(F.when(F.col("status") == "success", F.col("checked_at"))).alias("last_successful_at"),
        F.count("*").alias("checks"))

    def store(batch: DataFrame, _epoch: int) -> None:
        write_snapshot(batch.select(*schema.fieldNames()), root, partition_by=None)

    run_to_end(states.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(store))
