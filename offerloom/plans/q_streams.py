"""The stream forms, run to their end over the event table's file."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..model import CATALOGUE, SPECS
from ..session import fresh_path
from ..sources import buckets
from ..sources.snapshots import read_snapshot
from ..streaming import live
from .registry import query
from .sample import AS_OF, NOW, shown, table

TEXT = "'%Y-%m-%d %H:%M:%S'"
STATE = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("status", T.StringType()), T.StructField("checked_at", T.TimestampType()),
    T.StructField("last_successful_at", T.TimestampType()), T.StructField("checks", T.LongType())])


def events(spark, folder):
    return live.landed_stream(spark, folder, table(spark, folder, "events").schema, only="events.parquet")


@query("n01_upsert_stream", """select 'ukri:' || cast(p_partkey as string) as id, p_name as title, case when p_size < 25 then 'rolling' when date '1998-01-01' + p_size * 5 >= date '1998-06-01' then 'open' end as status from part
 where p_size < 25 or date '1998-01-01' + p_size * 5 >= date '1998-06-01' union all select 'old:' || cast(s_suppkey as string), s_name, 'open' from supplier""")
def _(spark, folder):
    root, place = fresh_path(spark, "stream"), fresh_path(spark, "place")
    stored = table(spark, folder, "supplier").select(F.concat(F.lit("old:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"), F.lit("open").alias("status"))
    stored = stored.select(*[(F.col(f.name) if f.name in stored.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CATALOGUE.fields])
    buckets.change(spark, root, stored, buckets.replaced)
    landed = live.landed_stream(spark, folder, table(spark, folder, "part").schema, only="part.parquet")
    items = landed.select(
        F.concat(F.lit("ukri:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("ukri").alias("source"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") >= 25, F.expr("date '1998-01-01' + p_size * 5")).alias("closes_date"))
    # Every offer comes twice, and the whole stream once more from another place.
    twice = items.withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("title", F.when(F.col("slot") == 0, F.col("title")).otherwise("again"))
    live.upsert_stream(twice, root, place, SPECS["ukri"], AS_OF, NOW, order=["slot"])
    live.upsert_stream(twice, root, fresh_path(spark, "place"), SPECS["ukri"], AS_OF, NOW, order=["slot"])
    return buckets.read(spark, root).select("id", "title", "status")


@query("n02_first_seen_stream", "select user_id, count(*) as n from (select distinct user_id from events) group by user_id")
def _(spark, folder):
    path, place = fresh_path(spark, "first"), fresh_path(spark, "place")
    rows = events(spark, folder).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    live.first_seen_stream(rows, "user_id", "ts", "60 days", path, place)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


@query("n03_health_stream", f"""select source, arg_max(status, (checked_at, check_id)) as status, strftime(max(checked_at), {TEXT}) as checked_at,
 strftime(max(checked_at) filter (where status = 'success'), {TEXT}) as last_successful_at, count(*) as checks from checks group by source""")
def _(spark, folder):
    root, place = fresh_path(spark, "health"), fresh_path(spark, "place")
    failed = F.col("event_type") == "error"
    checks = events(spark, folder).select(
        F.concat(F.lit("source_"), F.col("user_id").cast("string")).alias("source"), F.when(failed, "failed").otherwise("success").alias("status"),
        F.col("ts").cast("timestamp").alias("checked_at"), F.col("event_id").alias("check_id"))
    live.health_stream(checks, root, place, STATE)
    return shown(read_snapshot(spark, root, STATE))
