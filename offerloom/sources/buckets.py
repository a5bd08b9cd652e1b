"""A catalogue in buckets of ids: a change rewrites only the buckets it touches.

``data/<generation>/bucket=<n>/`` holds rows, ``manifest/<version>.json`` says which
generation each bucket is read from.  A change reads the touched buckets of the newest
manifest, writes them as a new generation, and commits by moving a manifest to the next
version's name, which fails if another writer was first; the change is then made again on
that one's version.  Files are never changed, so a reader keeps what its manifest names.

A manifest also holds the last epoch of each stream, in the same commit as its rows, so
a micro-batch that is repeated after a failure is not merged twice.  Only the manifest
(a line per bucket) and the numbers of touched buckets come to the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import CATALOGUE
from ..session import cut_lineage, forget

BUCKETS = 64
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    parts: dict[str, str] = field(default_factory=dict)  # bucket number to generation
    epochs: dict[str, int] = field(default_factory=dict)

    def paths(self, root: str, only: set[int] | None = None) -> list[str]:
        return [f"{root}/data/{g}/bucket={b}" for b, g in sorted(self.parts.items()) if only is None or int(b) in only]


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def newest(spark: SparkSession, root: str) -> Manifest:
    folder, fs = _files(spark, f"{root}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    versions = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
    if not versions:
        return Manifest()
    (row,) = spark.read.text(f"{root}/manifest/{versions[-1]}", wholetext=True).collect()
    return Manifest(**json.loads(row.value))


def commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Make ``manifest`` the newest version, or raise ``Conflict``."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    folder, fs = _files(spark, f"{root}/manifest")
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest.__dict__).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{manifest.version:09d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), plain)
    except Exception as problem:  # noqa: BLE001 - told apart by what lies there
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(f"version {manifest.version}") from problem
        raise


def read(spark: SparkSession, root: str, schema=CATALOGUE, manifest: Manifest | None = None, only: set[int] | None = None) -> DataFrame:
    """The rows of the newest version, or of a given one; of some buckets with ``only``."""
    paths = (manifest or newest(spark, root)).paths(root, only)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def change(spark: SparkSession, root: str, rows: DataFrame, rebuild: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id",
           schema=CATALOGUE, epoch: tuple[str, int] | None = None, everywhere: bool = False) -> Manifest:
    """Commit ``rebuild(old rows, rows)`` for the buckets of ``rows``, or for all with ``everywhere``.

    ``epoch`` is a stream's name and number; one that is not after the last is skipped,
    before its rows are worked out.  Rows that are a written table of ``cut_lineage`` are not written again.
    """
    written = None
    for _ in range(TRIES):
        held = newest(spark, root)
        if epoch and held.epochs.get(epoch[0], -1) >= epoch[1]:
            break
        if written is None:
            written = rows if hasattr(rows, "cut_path") else cut_lineage(rows, "change")
        touched = set(range(held.buckets)) if everywhere else {r[0] for r in written.select(bucket_of(key, held.buckets)).distinct().collect()}
        made = rebuild(read(spark, root, schema, held, touched), written).select(*schema.fieldNames()).withColumn("bucket", bucket_of(key, held.buckets))
        generation = uuid.uuid4().hex
        made.repartition("bucket", (F.xxhash64(key, F.lit(1)) % 4)).write.partitionBy("bucket").parquet(f"{root}/data/{generation}")
        folder, fs = _files(spark, f"{root}/data/{generation}")
        filled = {s.getPath().getName().split("=")[1] for s in fs.listStatus(folder) if "=" in s.getPath().getName()}
        parts = {b: g for b, g in held.parts.items() if int(b) not in touched} | {b: generation for b in filled}
        held = Manifest(held.version + 1, held.buckets, parts, held.epochs | ({epoch[0]: epoch[1]} if epoch else {}))
        try:
            commit(spark, root, held)
            break
        except Conflict:
            continue
    else:
        raise Conflict(f"{TRIES} other writers were faster")
    if written is not None and written is not rows:
        forget(written)
    return held


def replaced(old: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Old rows with those of the same key replaced by ``rows``, and new ones added."""
    return old.join(rows.select(key), key, "left_anti").unionByName(rows.select(*old.columns))


def without(old: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return old.join(rows.select(key), key, "left_anti")
