"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        stem = os.path.join(tempfile.mkdtemp(prefix="offerloom-"), os.path.basename(package))
        context.addPyFile(shutil.make_archive(stem, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session someone else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    _ship_package(spark)
    return spark


def local_session(cores: str = "8", app: str = "offerloom", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    options = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        # Call-site capture costs several driver round trips per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **SETTINGS,
        **extra,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    named = tempfile.mkdtemp(prefix="offerloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan that has fewer splits than there are cores out to all of them.

    For tables in one small file ahead of work that is heavy on the processor.  A
    table of many files has splits enough and is left as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def by_shuffle(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is never sent through the driver to all executors.

    The planner goes by the size of files, where columns that repeat take next to nothing.
    """
    return side.hint("merge")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/offerloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Unlike ``checkpoint()`` this runs the plan a single time, keeps the data
    columnar, and gives the planner true sizes for what follows.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.cut_path = path
    return written


def forget(*cuts: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more, and let Spark drop spent shuffle files.

    Shuffle files go when the driver's collector finds that no plan refers to them; on
    a driver with much memory that may be long after the step that wrote them.
    """
    for cut in cuts:
        context = cut.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(cut.cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    session = SparkSession.getActiveSession()
    if session is not None:
        session.sparkContext._jvm.System.gc()
