"""Run health from the event table: an error is a failed check of its user's source."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..model import SPECS
from ..operators import ledger
from . import ingest, q_changes as qc
from .registry import query
from .sample import AS_OF, NOW, checks, shown, table

TEXT = "'%Y-%m-%d %H:%M:%S'"
STATES = f"""states as (select source, arg_max(status, (checked_at, check_id)) as status, max(checked_at) as checked_at,
 max(checked_at) filter (where status = 'success') as last_successful_at, arg_max("count", (checked_at, check_id)) as "count",
 arg_max(coalesce(error, ''), (checked_at, check_id)) as error from checks group by source)"""
SHOWN_STATES = f"""source, status, strftime(checked_at, {TEXT}) as checked_at, strftime(last_successful_at, {TEXT}) as last_successful_at, "count", nullif(error, '') as error"""
SOURCES = tuple((f"source_{i}", f"Source {i}") for i in (1, 2, 3, 5, 8)) + (("source_none", "Never run"),)
COLUMNS = ("source", "status", "checked_at", "last_successful_at", "count", "error")


@query("l01_source_states", f"with {STATES} select {SHOWN_STATES} from states")
def _(spark, folder):
    return shown(ledger.source_states(checks(spark, folder), tie="check_id"), *COLUMNS)


@query("l01_states_carried_on", f"with {STATES} select {SHOWN_STATES} from states")
def _(spark, folder):
    """Folding the later checks into the earlier state gives what one pass over all gives."""
    rows, cut = checks(spark, folder), F.lit("2024-01-15").cast("timestamp")
    earlier = ledger.source_states(rows.where(F.col("checked_at") < cut), tie="check_id")
    return shown(ledger.source_states(rows.where(F.col("checked_at") >= cut), earlier, tie="check_id"), *COLUMNS)


@query("l02_run_state", f"""with {STATES} select case when count(*) filter (where status = 'failed') = count(*) then 'failed' when count(*) filter (where status = 'failed') > 0 then 'partial_success' else 'success' end as status,
 count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'success') as succeeded, count(*) as sources, strftime(max(checked_at), {TEXT}) as checked_at from states""")
def _(spark, folder):
    return shown(ledger.run_state(ledger.source_states(checks(spark, folder), tie="check_id")))


@query("g05_daily_run_states", """select day, case when failed = n then 'failed' when failed > 0 then 'partial_success' else 'success' end as status, n from
 (select day, count(*) as n, count(*) filter (where bad) as failed from
 (select cast(checked_at as date) as day, source, bool_or(status = 'failed') as bad from checks group by all) group by day)""")
def _(spark, folder):
    daily = checks(spark, folder).groupBy(F.col("checked_at").cast("date").alias("day"), "source").agg(F.bool_or(F.col("status") == "failed").alias("bad"))
    states = daily.select("day", F.when(F.col("bad"), "failed").otherwise("success").alias("status"), F.lit(None).cast("timestamp").alias("checked_at"))
    return ledger.run_state(states, "day").select("day", "status", F.col("sources").alias("n"))


@query("l03_last_success", f"select strftime(max(checked_at) filter (where status = 'success'), {TEXT}) as last_successful_at from checks")
def _(spark, folder):
    return shown(ledger.last_success(checks(spark, folder)))


def metadata(spark, folder):
    """The ledger a run over all checks would leave."""
    states = ledger.source_states(checks(spark, folder), tie="check_id")
    return ledger.state_rows(states).unionByName(ledger.run_rows(ledger.run_state(states)))


@query("l04_source_health", f"""with {STATES}, known as (select * from (values {', '.join(f"('{s}', '{n}', {i})" for i, (s, n) in enumerate(SOURCES))}) t(source, label, position))
 select position, known.source, label, coalesce(status, 'unknown') as status, "count", coalesce(strftime(checked_at, '%-d %B %Y, %H:%M') || ' UTC', 'Not yet updated') as checked_at,
 coalesce(strftime(last_successful_at, '%-d %B %Y, %H:%M') || ' UTC', 'Not yet updated') as last_successful_at, nullif(error, '') as error from known left join states on states.source = known.source""")
def _(spark, folder):
    return ledger.source_health(metadata(spark, folder), SOURCES)


@query("l04_health", f"""with {STATES}, run as (select case when count(*) filter (where status = 'failed') = count(*) then 'failed' when count(*) filter (where status = 'failed') > 0 then 'partial_success' else 'today_pending' end as status, max(checked_at) as seen from states)
 select status, case status when 'failed' then 'Daily run failed' when 'partial_success' then 'Partially loaded' else 'Today''s refresh pending' end as label, strftime(seen, '%-d %B %Y, %H:%M') || ' UTC' as checked_at from run""")
def _(spark, folder):
    return ledger.health(metadata(spark, folder), "2024-03-01", SOURCES)


@query("l05_check_note", f"""select case when count(*) = 0 then '{fv.ZERO_RESULT_TEXT}' end as note from events where event_type = 'refund'""")
def _(spark, folder):
    found = table(spark, folder, "events").where("event_type = 'refund'").agg(
        F.count("*").alias("non_duplicate_records"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("checked_at"))
    return ledger.check_note(metadata(spark, folder).unionByName(ledger.check_rows(found)))


@query("l06_failure_isolation", """select 'konfer' as source, 'success' as status, count(*) as "count", cast(null as string) as error from (""" + qc.upsert_sql("konfer") + """)
 where source in ('konfer', 'Konfer') and (action in ('insert', 'update') or (action = 'stale' and id not in (select id from catalogue where closes_date < date '1998-06-01')))
 union all select 'ukri', 'failed', null, 'HTTP 500'""")
def _(spark, folder):
    from ..session import fresh_path
    from ..sources import snapshots

    def broken(_spark):
        raise RuntimeError("HTTP 500")

    root = fresh_path(spark, "run")
    alive = qc.stored(spark, folder)
    snapshots.write_snapshot(alive, f"{root}/offers")
    jobs = [ingest.SourceJob(SPECS["ukri"], broken), ingest.SourceJob(SPECS["konfer"], lambda s: qc.crawl(s, folder, SPECS["konfer"]))]
    return ingest.run(spark, root, jobs, AS_OF, NOW, order=["slot"]).select("source", "status", "count", "error")
