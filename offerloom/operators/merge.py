"""Changes to the catalogue, each as a new snapshot: old rows in, new rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions.dates import status_on
from ..model import CATALOGUE, CATALOGUE_COLUMNS, LATE_COLUMNS, SourceSpec
from . import classify as cl

INACTIVE = "inactive"
ACTIONS = ("insert", "update", "stale", "keep")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in the given order.

    Spark keeps only the leading row of each key on the map side of this window
    (WindowGroupLimit), so a key with a third of all rows still sends one row per
    map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") == 1).drop("_n")


def union_items(batches: list[DataFrame]) -> DataFrame:
    """Items of several sources as one table; columns a source lacks are null."""
    whole = batches[0]
    for batch in batches[1:]:
        whole = whole.unionByName(batch, allowMissingColumns=True)
    return whole


def with_status(batch: DataFrame, as_of, rolling: bool = True) -> DataFrame:
    return batch.withColumn("status", status_on(
        F.col("opened_date"), F.col("closes_date"), F.lit(as_of).cast("date"), rolling=rolling))


def prepare_batches(batches: list[tuple[DataFrame, SourceSpec]], as_of, now, order: list | None = None) -> DataFrame:
    """Items of all sources, typed, one row per id, not expired, classed and stamped.

    ``_spec`` names the source.  Everything costly runs once over the union.
    """
    by_order = [F.col(c) if isinstance(c, str) else c for c in order or []]

    def typed(batch: DataFrame, spec: SourceSpec) -> DataFrame:
        have = set(batch.columns)
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CATALOGUE.fields]
        others = [F.col(c) for c in fv.CLASS_TEXT_FIELDS if c in have and c not in CATALOGUE_COLUMNS]
        return batch.where(F.col("id").isNotNull()).select(
            *columns, *others, *[c.alias(f"_order{i}") for i, c in enumerate(by_order)], F.lit(spec.name).alias("_spec"))

    whole = union_items([typed(batch, spec) for batch, spec in batches])
    # One row per id in any case; without an order, that with the least title, link and text.
    whole = first_per_key(whole, ["_spec", "id"], [f"_order{i}" for i in range(len(by_order))] or ["title", "url", "description"])
    day = F.lit(as_of).cast("date")
    no_rolling = [spec.name for _, spec in batches if not spec.rolling]
    status = status_on(F.col("opened_date"), F.col("closes_date"), day)
    if no_rolling:
        status = F.when(F.col("_spec").isin(*no_rolling) & (status == "rolling"), F.lit("open")).otherwise(status)
    alive = whole.withColumn("status", status).where(F.col("status") != "expired")
    classed = cl.classify(alive, keep_given=True)
    return classed.withColumn("last_seen", F.lit(now).cast("timestamp")).select("_spec", *CATALOGUE_COLUMNS)


def stored_not_seen(base: DataFrame, seen: DataFrame, keys=("id",)) -> DataFrame:
    """Rows of ``base`` whose keys no row of ``seen`` has, for all sources in one pass; a null key equals a null key."""
    other = seen.select(*[F.col(k).alias(f"_seen_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_seen_{k}")) for k in keys]
    return base.join(other, same, "left_anti")


def stale_candidates(base: DataFrame, seen: DataFrame, specs) -> DataFrame:
    """Live rows of the sources whose crawl did not bring them; ``seen`` has id and source."""
    names = [(spec.name, name) for spec in specs if spec.marks_stale for name in spec.stored_names]
    owner = None
    for spec, name in names:
        owner = (owner if owner is not None else F).when(F.col("source") == name, F.lit(spec))
    mine = base.where(F.col("status") != INACTIVE).withColumn("_owner", owner).where(F.col("_owner").isNotNull())
    return stored_not_seen(mine, seen.withColumn("_owner", owner), ("_owner", "id")).drop("_owner")


def purge_closed(base: DataFrame, spec: SourceSpec, as_of) -> DataFrame:
    """Drop the source's rows whose closing day has passed."""
    gone = F.col("source").isin(*spec.stored_names) & (F.col("closes_date") < F.lit(as_of).cast("date"))
    return base.where(~F.coalesce(gone, F.lit(False)))


def upsert_all(base: DataFrame, batches: list[tuple[DataFrame, SourceSpec]], as_of, now,
               order: list | None = None) -> DataFrame:
    """Merge the batches of several sources in one pass over the catalogue.

    The result has the catalogue columns and ``_action``: insert, update, stale or
    keep.  Each ``spec`` says which columns an update may touch and what an empty
    crawl does to the stored rows.  One full join on id decides every row, however
    many sources there are.
    """
    specs = [spec for _, spec in batches]
    fresh = prepare_batches(batches, as_of, now, order)
    for spec in specs:
        if spec.purge_closed:
            base = purge_closed(base, spec, as_of)
    new = fresh.select("_spec", *[F.col(c).alias(f"_new_{c}") for c in CATALOGUE_COLUMNS])
    joined = base.join(new, base["id"] == new["_new_id"], "full_outer")
    seen, stored, live = F.col("_new_id").isNotNull(), F.col("id").isNotNull(), F.col("status") != INACTIVE

    always = [n for s in specs if s.marks_stale and s.on_empty == "stale_all" for n in s.stored_names]
    if_crawled = [(batch, s) for batch, s in batches if s.marks_stale and s.on_empty == "skip"]
    swept = F.col("source").isin(*always) if always else F.lit(False)
    if if_crawled:
        # A row per stored name of the sources whose crawl brought anything at all.
        names = union_items([
            batch.select(F.lit(1)).limit(1).select(F.explode(F.array(*map(F.lit, s.stored_names))).alias("_name"))
            for batch, s in if_crawled])
        joined = joined.join(F.broadcast(names), F.col("source") == F.col("_name"), "left")
        swept = swept | F.col("_name").isNotNull()
    stale = F.coalesce(~seen & swept & live, F.lit(False))
    action = F.when(seen & stored, "update").when(seen, "insert").when(stale, "stale").otherwise("keep")
    return joined.withColumn("_action", action).select(
        *[_merged(c, specs, now).alias(c) for c in CATALOGUE_COLUMNS], "_action")


def upsert(base: DataFrame, batch: DataFrame, spec: SourceSpec, as_of, now, order: list | None = None) -> DataFrame:
    return upsert_all(base, [(batch, spec)], as_of, now, order)


def _merged(name: str, specs: list[SourceSpec], now) -> Column:
    old, new, act = F.col(name), F.col(f"_new_{name}"), F.col("_action")
    if name == "id":
        return F.coalesce(old, new)

    def of(test) -> Column:
        return F.col("_spec").isin(*[s.name for s in specs if test(s)]) if any(map(test, specs)) else F.lit(False)

    updated = F.when(of(lambda s: name in s.update_columns), new).otherwise(old)
    if name == "description":
        enriched = F.coalesce(old, F.lit("")) != F.coalesce(F.col("summary"), F.lit(""))
        updated = F.when(of(lambda s: s.keep_enriched_text) & enriched, old).otherwise(updated)
    inserted = F.when(of(lambda s: name in s.insert_columns), new)
    value = F.when(act == "insert", inserted).when(act == "update", updated)
    if name == "status":
        value = value.when(act == "stale", F.lit(INACTIVE))
    if name == "last_seen":
        touched = [n for s in specs if s.touch_stale for n in s.stored_names]
        if touched:
            value = value.when((act == "stale") & F.col("source").isin(*touched), F.lit(now).cast("timestamp"))
    return value.otherwise(old)


def change_counts(result: DataFrame) -> DataFrame:
    """Rows per action."""
    return result.groupBy("_action").agg(F.count("*").alias("n"))


def changed_rows(result: DataFrame) -> DataFrame:
    """The one number an upsert reports: all rows but the kept ones."""
    return result.agg(F.count_if(F.col("_action") != "keep").alias("changed"))


def mark_expired(base: DataFrame, as_of, now) -> DataFrame:
    """Closed rows become inactive; ``_changed`` marks them."""
    due = F.coalesce((F.col("closes_date") < F.lit(as_of).cast("date")) & (F.col("status") != INACTIVE), F.lit(False))
    return base.withColumn("_changed", due).withColumns({
        "status": F.when(F.col("_changed"), F.lit(INACTIVE)).otherwise(F.col("status")),
        "last_seen": F.when(F.col("_changed"), F.lit(now).cast("timestamp")).otherwise(F.col("last_seen"))})


def add_late_columns(table: DataFrame, columns=LATE_COLUMNS) -> DataFrame:
    """Add the columns a table of an older version lacks, as nulls; repeatable."""
    missing = [c for c in columns if c not in table.columns]
    return table.withColumns({c: F.lit(None).cast(CATALOGUE[c].dataType) for c in missing}) if missing else table


def migration_report(table: DataFrame) -> DataFrame:
    """Row count and filled rows of both class columns, in one pass."""
    whole = add_late_columns(table)
    return whole.agg(
        F.lit("geographic_scope" in whole.columns).alias("geographic_scope_present"),
        F.lit("eligible_applicants" in whole.columns).alias("eligible_applicants_present"),
        F.count("*").alias("total_rows"),
        F.count("geographic_scope").alias("geographic_scope_populated_rows"),
        F.count("eligible_applicants").alias("eligible_applicants_populated_rows"))


def upsert_metadata(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge (key, value) rows by key."""
    fresh = batch.select(F.col("key"), F.col("value").alias("_value"), F.lit(True).alias("_new"))
    return base.join(fresh, "key", "full_outer").select(
        "key", F.when(F.col("_new"), F.col("_value")).otherwise(F.col("value")).alias("value"))
