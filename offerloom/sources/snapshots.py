"""Catalogue snapshots in a folder.

A change writes a whole new version; readers take the newest version whose write
was committed.  A failed write leaves the old version in place, so there is
nothing to roll back, and no file is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import CATALOGUE, METADATA

_PREFIX = "version="


def _versions(spark: SparkSession, root: str, committed: bool = True) -> list[int]:
    """Committed versions, by the marker the file committer leaves."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith(_PREFIX)]
    if not committed:
        return sorted(int(p.getName()[len(_PREFIX):]) for p in names)
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name[len(_PREFIX):]) for name in done)


def write_snapshot(df: DataFrame, root: str, partition_by: str | None = "status") -> int:
    """Write the next version and return its number.  ``df`` may read an older one."""
    # The folder of a write that failed keeps its number; the next write takes another.
    version = max(_versions(df.sparkSession, root, committed=False), default=0) + 1
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{root}/{_PREFIX}{version:09d}")
    return version


def read_snapshot(spark: SparkSession, root: str, schema=CATALOGUE, version: int | None = None) -> DataFrame:
    """Newest committed version, or a given one; an empty table when there is none."""
    known = _versions(spark, root)
    if version is None:
        if not known:
            return spark.createDataFrame([], schema)
        version = known[-1]
    read = spark.read.schema(schema).parquet(f"{root}/{_PREFIX}{version:09d}")
    return read.select(*schema.fieldNames())


def write_metadata(df: DataFrame, root: str) -> int:
    return write_snapshot(df, root, partition_by=None)


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    return read_snapshot(spark, root, METADATA)
