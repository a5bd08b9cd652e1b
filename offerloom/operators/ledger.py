"""Health of the runs: what each source did last, and what that adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed_values as fv
from ..functions.dates import lenient_stamp, shown_stamp

RUN_STATES = ("success", "partial_success", "failed")

SOURCE_STATE = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("checked_at", T.StringType()), T.StructField("last_successful_at", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("error", T.StringType()),
])
RUN_STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("checked_at", T.StringType())])
CHECK_STATE = T.StructType([
    T.StructField("checked_at", T.StringType()), T.StructField("non_duplicate_records", T.LongType())])


def iso(stamp: Column) -> Column:
    """UTC time stamp as ISO text."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def source_states(checks: DataFrame, previous: DataFrame | None = None, tie: str | None = None) -> DataFrame:
    """Latest state per source, with the time of the last success carried along.

    ``checks``: source, status, checked_at, count, error.  One grouped pass with
    map-side combine, so a source with most of the rows is no hot spot.
    """
    order = F.struct("checked_at", *([tie] if tie else []))
    grouped = checks.groupBy("source").agg(
        F.max_by(F.struct("status", "checked_at", "count", "error"), order).alias("last"),
        F.max(F.when(F.col("status") == "success", F.col("checked_at"))).alias("last_successful_at"))
    now = grouped.select("source", "last.*", "last_successful_at")
    if previous is None:
        return now.select("source", "status", "checked_at", "last_successful_at", "count", "error")
    old = previous.select("source", *[F.col(c).alias(f"_{c}") for c in ("status", "checked_at", "last_successful_at", "count", "error")])
    ran = F.col("status").isNotNull()
    return now.join(old, "source", "full_outer").select(
        "source", F.coalesce("status", "_status").alias("status"),
        F.coalesce("checked_at", "_checked_at").alias("checked_at"),
        F.coalesce("last_successful_at", "_last_successful_at").alias("last_successful_at"),
        F.when(ran, F.col("count")).otherwise(F.col("_count")).alias("count"),
        F.when(ran, F.col("error")).otherwise(F.col("_error")).alias("error"))


def run_state(states: DataFrame, *by: str) -> DataFrame:
    """failed when all failed, partial_success when some did, else success; one row per group of ``by``."""
    failed = F.count_if(F.col("status") == "failed")
    counts = states.groupBy(*by).agg(
        failed.alias("failed"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count("*").alias("sources"),
        F.max("checked_at").alias("checked_at"))
    return counts.select(
        *by, F.when((F.col("failed") == F.col("sources")) & (F.col("sources") > 0), "failed")
        .when(F.col("failed") > 0, "partial_success").otherwise("success").alias("status"),
        "failed", "succeeded", "sources", "checked_at")


def last_success(runs: DataFrame) -> DataFrame:
    """Time of the last run that succeeded in full."""
    return runs.agg(F.max(F.when(F.col("status") == "success", F.col("checked_at"))).alias("last_successful_at"))


def state_rows(states: DataFrame) -> DataFrame:
    """Source states as metadata rows; absent count and error leave no field behind."""
    value = F.to_json(F.struct(
        "source", "status", iso(F.col("checked_at")).alias("checked_at"),
        iso(F.col("last_successful_at")).alias("last_successful_at"), "count",
        F.nullif(F.col("error"), F.lit("")).alias("error")))
    return states.select(F.concat(F.lit(fv.SOURCE_STATUS_PREFIX), F.col("source")).alias("key"), value.alias("value"))


def run_rows(run: DataFrame) -> DataFrame:
    """Run state as metadata rows, with the success stamp only after a full success."""
    state = run.select(F.lit(fv.LAST_RUN_KEY).alias("key"),
                       F.to_json(F.struct("status", iso(F.col("checked_at")).alias("checked_at"))).alias("value"))
    stamp = run.where(F.col("status") == "success").select(
        F.lit(fv.LAST_SUCCESS_KEY).alias("key"), iso(F.col("checked_at")).alias("value"))
    return state.unionByName(stamp)


def metadata_value(metadata: DataFrame, key: str) -> DataFrame:
    return metadata.where(F.col("key") == key)


def read_state(value: Column, schema: T.StructType) -> Column:
    """JSON object by schema; anything else gives a struct of nulls."""
    return F.from_json(value, schema)


def check_rows(found: DataFrame) -> DataFrame:
    """The check of the broker source as a metadata row; ``found`` has checked_at and non_duplicate_records."""
    value = F.to_json(F.struct(iso(F.col("checked_at")).alias("checked_at"), F.col("non_duplicate_records").cast("bigint").alias("non_duplicate_records")))
    return found.select(F.lit(fv.BROKER_CHECK_KEY).alias("key"), value.alias("value"))


def check_note(metadata: DataFrame) -> DataFrame:
    """Note for a check that went well and found nothing of its own."""
    state = read_state(F.col("value"), CHECK_STATE)
    valid = lenient_stamp(state["checked_at"]).isNotNull() & (state["non_duplicate_records"] == 0)
    return metadata_value(metadata, fv.BROKER_CHECK_KEY).select(F.when(valid, F.lit(fv.ZERO_RESULT_TEXT)).alias("note"))


def health_sources(spark: SparkSession, sources=fv.HEALTH_SOURCES) -> DataFrame:
    rows = [(s, label, i) for i, (s, label) in enumerate(sources)]
    return spark.createDataFrame(rows, "source string, label string, position int")


def source_health(metadata: DataFrame, sources=fv.HEALTH_SOURCES) -> DataFrame:
    """One row per known source, unknown when it has left no state."""
    known = health_sources(metadata.sparkSession, sources)
    prefix = fv.SOURCE_STATUS_PREFIX
    states = metadata.where(F.col("key").startswith(prefix)).select(
        F.substring(F.col("key"), len(prefix) + 1, 2**30).alias("source"), read_state(F.col("value"), SOURCE_STATE).alias("s"))
    return known.join(states, "source", "left").select(
        "position", "source", "label", F.coalesce("s.status", F.lit("unknown")).alias("status"), "s.count",
        shown_stamp(lenient_stamp(F.col("s.checked_at"))).alias("checked_at"),
        shown_stamp(lenient_stamp(F.col("s.last_successful_at"))).alias("last_successful_at"),
        F.col("s.error").alias("error")).orderBy("position")


def health(metadata: DataFrame, today, sources=fv.HEALTH_SOURCES) -> DataFrame:
    """One row: overall state, its wording, and when it was checked; one pass over the ledger."""
    key, value = F.col("key"), F.col("value")
    known = key.isin(*[fv.SOURCE_STATUS_PREFIX + name for name, _ in sources])
    marked = metadata.select(
        F.when(known, read_state(value, SOURCE_STATE)["status"]).alias("source_status"),
        F.when(key == fv.LAST_RUN_KEY, read_state(value, RUN_STATE)).alias("run"),
        F.when(key == fv.LAST_SUCCESS_KEY, lenient_stamp(value)).alias("success_at"))
    row = marked.agg(
        F.count_if(F.col("source_status") == "failed").alias("failed"),
        F.count_if(F.col("source_status") == "success").alias("succeeded"),
        F.max("run.status").alias("run_status"), F.max(lenient_stamp(F.col("run.checked_at"))).alias("run_at"),
        F.max("success_at").alias("success_at"))
    failed, succeeded = F.col("failed") > 0, F.col("succeeded") > 0
    told = (
        F.when(F.col("run_status").isin(*RUN_STATES), F.col("run_status"))
        .when(failed & succeeded, "partial_success").when(failed, "failed").when(succeeded, "success")
        .when(F.col("success_at").isNotNull(), "success").otherwise("unknown"))
    late = F.col("success_at").isNull() | (F.col("success_at").cast("date") < F.lit(today).cast("date"))
    staged = row.withColumn("_told", told).withColumn(
        "status", F.when((F.col("_told") == "success") & late, "today_pending").otherwise(F.col("_told")))
    words = None
    for state, text in fv.HEALTH_TEXT.items():
        words = (words if words is not None else F).when(F.col("status") == state, F.lit(text))
    return staged.select("status", words.alias("label"),
                         shown_stamp(F.coalesce("run_at", "success_at")).alias("checked_at"))
