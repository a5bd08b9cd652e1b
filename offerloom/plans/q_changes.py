"""Catalogue changes: upsert, stale, expiry, dedupe, schema, reclassification, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..model import LATE_COLUMNS, SPECS, SourceSpec
from ..operators import classify, dedupe, enrich, merge
from . import q_extract as qx
from .registry import query
from .sample import AS_OF, NOW, catalogue, fill, shown, table

# A fresh crawl of the sample catalogue: finished orders are no longer listed, the
# texts and amounts have moved on, and a pending order is listed twice.
_CRAWL = {
    "id": "id",
    "source": "case when id like 'ifs:%' then 'innovate_uk' when id like 'iukbc:%' then 'iuk_business_connect' when id like 'konfer:%' then 'konfer' else source end",
    "title": "sector_tags || ' call' || case when slot = 1 then ' copy' else '' end",
    "url": "url", "opened_date": "opened_date", "closes_date": "closes_date",
    "funding_min": "funding_max", "funding_max": "funding_max * 2", "funding_currency": "'GBP'",
    "sector_tags": "'fresh ' || title", "summary": "'New: ' || title", "description": "'New: ' || title",
    "geographic_scope": "'scotland'", "eligible_applicants": "'business'", "slot": "slot",
}
_LISTED = "niche_tags is not null and (id not like 'horizon:%' or closes_date is null or description = summary)"
_SLOTS = "case when closes_date is null then {two} else {one} end"


def stored(spark, folder):
    """The catalogue as it was: offers opened before 1998."""
    return catalogue(spark, folder).where("opened_date < date '1998-01-01'")


def crawl(spark, folder, spec: SourceSpec):
    listed = catalogue(spark, folder).where(_LISTED).where(F.col("source").isin(*spec.stored_names))
    slots = F.when(F.col("closes_date").isNull(), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    return listed.withColumn("slot", F.explode(slots)).select(*[F.expr(text).alias(name) for name, text in _CRAWL.items()])


SHOWN = ("id", "source", "title", "status", "funding_max", "funding_currency", "sector_tags", "geographic_scope", "summary", "description", "last_seen", "action")


def upsert_sql(*names: str) -> str:
    """What the merge of the named sources' crawls has to give."""
    specs = [SPECS[n] for n in names]
    def has(test):
        return "f.source in (" + ", ".join(["''"] + [f"'{s.name}'" for s in specs if test(s)]) + ")"

    def merged(column):
        updated = f"case when {has(lambda s: column in s.update_columns)} then f.{column} else s.{column} end"
        if column == "description":
            updated = f"case when {has(lambda s: s.keep_enriched_text)} and coalesce(s.description, '') <> coalesce(s.summary, '') then s.description else {updated} end"
        inserted = f"case when {has(lambda s: column in s.insert_columns)} then f.{column} end"
        return f"case when action = 'insert' then {inserted} when action = 'update' then {updated} else s.{column} end as {column}"

    quote = lambda values: ", ".join(["''"] + [f"'{v}'" for v in values])
    wanted = quote(n for s in specs for n in s.stored_names)
    rolls = quote(s.name for s in specs if s.rolling)
    swept = quote(n for s in specs if s.marks_stale for n in s.stored_names)
    touched = quote(n for s in specs if s.touch_stale for n in s.stored_names)
    purged = quote(n for s in specs if s.purge_closed for n in s.stored_names)
    crawled = ", ".join(f"{text} as {name}" for name, text in _CRAWL.items() if name != "slot")
    columns = [merged(c) for c in SHOWN if c not in ("id", "status", "last_seen", "action")]
    return f"""with listed as (select {crawled} from (select *, 0 as slot from catalogue where {_LISTED} and source in ({wanted}))),
 fresh as (select *, case when opened_date > date '1998-06-01' then 'upcoming' when closes_date is null and source in ({rolls}) then 'rolling' else 'open' end as status from listed
   where opened_date > date '1998-06-01' or closes_date is null or closes_date >= date '1998-06-01'),
 old as (select * from catalogue where opened_date < date '1998-01-01' and not (source in ({purged}) and coalesce(closes_date < date '1998-06-01', false))),
 paired as (select s, f, case when f.id is not null and s.id is not null then 'update' when f.id is not null then 'insert'
   when s.source in ({swept}) and s.status <> 'inactive' then 'stale' else 'keep' end as action from old s full join fresh f on s.id = f.id)
 select coalesce(s.id, f.id) as id, action, {', '.join(columns)}, case action when 'stale' then 'inactive' when 'keep' then s.status else f.status end as status,
 strftime(case when action in ('insert', 'update') or (action = 'stale' and s.source in ({touched})) then timestamp '1998-06-01 06:00:00' else s.last_seen end, '%Y-%m-%d %H:%M:%S') as last_seen from paired"""


def upsert_plan(spark, folder, *names: str):
    batches = [(crawl(spark, folder, SPECS[n]), SPECS[n]) for n in names]
    result = merge.upsert_all(stored(spark, folder), batches, AS_OF, NOW, order=["slot"])
    return shown(result.withColumnRenamed("_action", "action"), *SHOWN)


@query("j01_upsert_all", upsert_sql(*SPECS))
def _(spark, folder):
    return upsert_plan(spark, folder, *SPECS)


@query("j01_upsert_broker", upsert_sql("konfer"))
def _(spark, folder):
    return upsert_plan(spark, folder, "konfer")


@query("j02_mark_stale", upsert_sql("ukri", "horizon_europe"))
def _(spark, folder):
    return upsert_plan(spark, folder, "ukri", "horizon_europe")


@query("j07_keep_enriched_text", upsert_sql("innovate_uk"))
def _(spark, folder):
    return upsert_plan(spark, folder, "innovate_uk")


@query("f06_batch_and_stored", "select id, action from (" + upsert_sql("iuk_business_connect") + ") where action <> 'keep'")
def _(spark, folder):
    return upsert_plan(spark, folder, "iuk_business_connect").where("action <> 'keep'").select("id", "action")


@query("g08_change_counts", "select action, count(*) as n from (" + upsert_sql(*SPECS) + ") group by action")
def _(spark, folder):
    batches = [(crawl(spark, folder, spec), spec) for spec in SPECS.values()]
    result = merge.upsert_all(stored(spark, folder), batches, AS_OF, NOW, order=["slot"])
    return merge.change_counts(result).withColumnRenamed("_action", "action")


@query("j02_empty_crawl", """select id, case when source = 'Konfer' then 'inactive' else status end as status from catalogue""")
def _(spark, folder):
    nothing = lambda name: (crawl(spark, folder, SPECS[name]).where("id is null"), SPECS[name])
    return merge.upsert_all(catalogue(spark, folder), [nothing("konfer"), nothing("ukri"), nothing("iuk_business_connect")], AS_OF, NOW).select("id", "status")


@query("j03_purge_closed", """select id from catalogue where not (source in ('innovate_uk', 'Innovate UK') and coalesce(closes_date < date '1998-06-01', false))""")
def _(spark, folder):
    return merge.purge_closed(catalogue(spark, folder), SPECS["innovate_uk"], AS_OF).select("id")


@query("j04_mark_expired", """select id, case when due then 'inactive' else status end as status, due as changed, strftime(case when due then timestamp '1998-06-01 06:00:00' else last_seen end, '%Y-%m-%d %H:%M:%S') as last_seen
 from (select *, coalesce(closes_date < date '1998-06-01' and status <> 'inactive', false) as due from catalogue)""")
def _(spark, folder):
    return shown(merge.mark_expired(catalogue(spark, folder), AS_OF, NOW).withColumnRenamed("_changed", "changed"), "id", "status", "changed", "last_seen")


# The ranking walked row by row.  A row none of whose keys is on another row is kept
# and owns no copy, so only the others have to be walked.
SEQUENTIAL = """ranked as (select id, row_number() over (order by priority, title, id) as r, keys from keyed),
 edges as (select r, unnest(keys) as key from ranked), shared as (select key from edges group by key having count(*) > 1),
 contested as (select r, list(key) as keys, row_number() over (order by r) as step from edges where key in (select key from shared) group by r),
 walk(step, owned, owners, dups) as (select 0::bigint, cast([] as varchar[]), cast([] as bigint[]), cast([] as bigint[]) union all
  select walk.step + 1, case when list_has_any(owned, c.keys) then owned else list_concat(owned, c.keys) end,
   case when list_has_any(owned, c.keys) then owners else list_concat(owners, list_transform(c.keys, lambda k: c.r)) end,
   case when list_has_any(owned, c.keys) then list_append(dups, c.r) else dups end from walk join contested c on c.step = walk.step + 1),
 final as (select owned, owners, dups from walk order by step desc limit 1),
 dup as (select unnest(dups) as r from final), own as (select unnest(owned) as key, unnest(owners) as r from final),
 kept_owner as (select distinct own.r from own join edges e on e.key = own.key join dup on dup.r = e.r where e.r > own.r)"""


@query("j05_dedupe", r"""with recursive keyed as (select id, title, case when source in ('iuk_business_connect', 'horizon_europe') then 0 when source = 'Konfer' then 2 else 1 end as priority,
 list_distinct(list_filter([case when closes_date is not null then 'title-close:' || lower(title) || ':' || strftime(closes_date, '%Y-%m-%d') end,
 'url:' || case when id like 'ifs:%' then 'apply-for-innovation-funding.service.gov.uk/competition/' || regexp_extract(url, 'competition/([^/]+)/', 1) || '/overview'
   when id like 'iukbc:%' then 'iuk-business-connect.org.uk/opportunities/' || regexp_extract(url, 'opportunities/([^/]+)/', 1) else lower(regexp_extract(url, 'https://([^?]*)/', 1)) end,
 case when id like 'ifs:%' or id like 'iukbc:%' then split_part(id, ':', 1) || ':' || regexp_extract(url, '(?:competition|opportunities)/([^/]+)/', 1) end,
 case when description like 'Round page%' then 'url:iuk-business-connect.org.uk/opportunities/' || regexp_extract(description, 'opportunities/([^/]+)/', 1) end,
 case when description like 'Round page%' then 'iukbc:' || regexp_extract(description, 'opportunities/([^/]+)/', 1) end], lambda k: k is not null)) as keys
 from catalogue where closes_date is null or closes_date >= date '1998-06-01'), """ + SEQUENTIAL + """,
 fate as (select id, r in (select r from dup) as lost, r in (select r from kept_owner) as owner from ranked)
 select c.id, case when lost then 'inactive' when owner and status = 'inactive' then case when opened_date > date '1998-06-01' then 'upcoming' when closes_date is null then 'rolling' else 'open' end else status end as status,
 coalesce((lost and status <> 'inactive') or (owner and status = 'inactive'), false) as changed from catalogue c left join fate on fate.id = c.id""")
def dedupe_catalogue(spark, folder):
    return dedupe.mark_duplicates(catalogue(spark, folder), AS_OF, NOW).select("id", "status", F.col("_changed").alias("changed"))


@query("j05_dedupe_pages", r"""with recursive keyed as (select cast(page_id as string) as id, regexp_extract(html, '<title>(.*?)</title>', 1) as title, 99 as priority,
 list_distinct(['url:' || lower(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '')),
 'title-close:' || trim(regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) || ':1998-07-01']) as keys from pages), """ + SEQUENTIAL + """
 select id, r in (select r from dup) as duplicate, r in (select r from kept_owner) as owns_copy from ranked""")
def _(spark, folder):
    base = table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.lit("web").alias("source"), "url", F.lit("").alias("description"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.lit("1998-07-01").cast("date").alias("closes_date"))
    fate = dedupe.decide(dedupe.ranked_keys(base, AS_OF))
    return fate.select("id", (~F.col("kept")).alias("duplicate"), "owns_copy")


# One link in every text of a brand: keys on 4% of the rows each, and one on a third.
@query("j05_dedupe_hot_keys", """select id, id = min(id) over (partition by hot) as kept, id = min(id) over (partition by hot) and count(*) over (partition by hot) > 1 as owns_copy from (select 'p' || lpad(cast(p_partkey as string), 12, '0') as id,
 case when p_size <= 17 then 'third' else p_brand end as hot from part)""")
def _(spark, folder):
    hot = F.when(F.col("p_size") <= 17, "third").otherwise(F.col("p_brand"))
    base = table(spark, folder, "part").select(
        F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("id"), F.lit("ukri").alias("source"), F.lit("same").alias("title"),
        fill("https://own.example.org/{p_partkey}").alias("url"), fill("See https://guide.example.org/{hot} for more", hot=F.replace(hot, F.lit("#"), F.lit("-"))).alias("description"),
        F.lit(None).cast("date").alias("closes_date"))
    return dedupe.decide(dedupe.ranked_keys(base, AS_OF)).select("id", "kept", "owns_copy")


@query("j08_late_columns", f"""select id, {', '.join(f'cast(null as {kind}) as {name}' for name, kind in (
    ('funding_currency', 'string'), ('funding_min_native', 'double'), ('funding_max_native', 'double'), ('exchange_rate', 'double'),
    ('exchange_rate_date', 'date'), ('eligible_applicants', 'string')))}, geographic_scope from catalogue""")
def _(spark, folder):
    legacy = catalogue(spark, folder).drop(*[c for c in LATE_COLUMNS if c != "geographic_scope"])
    return merge.add_late_columns(merge.add_late_columns(legacy)).select("id", *LATE_COLUMNS)


@query("j09_migration_report", """select true as geographic_scope_present, true as eligible_applicants_present, count(*) as total_rows,
 count(geographic_scope) as geographic_scope_populated_rows, cast(0 as bigint) as eligible_applicants_populated_rows from catalogue""")
def _(spark, folder):
    return merge.migration_report(catalogue(spark, folder).drop("eligible_applicants"))


@query("j10_reclassify", """select 'uk_wide' as geographic_scope, count(*) as rows_seen,
 count(*) filter (where geographic_scope is distinct from 'uk_wide') as rows_changed from catalogue""")
def _(spark, folder):
    return classify.reclassify_report(classify.reclassify(catalogue(spark, folder)))


@query("j10_reclassify_applicants", """select who as eligible_applicants, count(*) as rows_seen, count(*) filter (where eligible_applicants is distinct from who) as rows_changed
 from (select *, case when source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect') then 'business' else 'any' end as who from catalogue) group by who""")
def _(spark, folder):
    return classify.reclassify_report(classify.reclassify(catalogue(spark, folder)), "eligible_applicants")


# --- enrichment: a stored competition per part, and the detail page of most ---------------

def competitions(spark, folder):
    """Part rows as stored competitions, some with text of their own, some with bad ids."""
    kind = F.col("p_type")
    return table(spark, folder, "part").select(
        F.when(kind == "PROMO", fill("ifs:x{p_partkey}")).otherwise(fill("ifs:{p_partkey}")).alias("id"), F.lit("innovate_uk").alias("source"),
        F.col("p_name").alias("title"), F.lit("Short").alias("summary"), F.when(kind == "LARGE", "Long text").otherwise("Short").alias("description"),
        F.lit(1.0).alias("funding_min"), F.lit(None).cast("double").alias("funding_max"), F.lit(None).cast("double").alias("funding_min_native"),
        F.lit(None).cast("double").alias("funding_max_native"), F.lit(None).cast("string").alias("funding_currency"),
        F.lit(None).cast("double").alias("exchange_rate"), F.lit(None).cast("date").alias("exchange_rate_date"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(hours=F.col("p_size"))).alias("last_seen"))


def competition_detail_pages(spark, folder):
    pages = qx.competition_pages(spark, folder).where("url is not null")
    landed = pages.join(table(spark, folder, "part").where("p_type <> 'SMALL'").select("p_partkey"), "p_partkey", "left_semi")
    return landed.select(fill(fv.COMPETITION_BASE + "/competition/{p_partkey}/overview").alias("url"), "html")


ENRICHED = """select p_partkey, case when due is null then null when p_type = 'PROMO' then 'skipped' when p_type = 'SMALL' then 'failed' else 'enriched' end as outcome,
 case when due and p_type not in ('PROMO', 'SMALL') then 'enriched' when p_type = 'LARGE' then 'Long text' else 'Short' end as text,
 case when due and p_type not in ('PROMO', 'SMALL') and p_size < 40 then p_size * 1000.0 else 1.0 end::double as funding_min,
 case when due and p_type not in ('PROMO', 'SMALL') then case when p_size < 25 then 2000000.0 when p_size < 40 then p_size * 1000.0 end end::double as funding_max
 from (select *, case when p_type <> 'LARGE' {fresh} then true end as due from part)"""


def enriched(spark, folder, now):
    result = enrich.enrich_from_pages(competitions(spark, folder), competition_detail_pages(spark, folder), AS_OF, now=now)
    return result.select(
        F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("p_partkey"), F.col("_outcome").alias("outcome"),
        F.when(F.col("description").startswith("Source page"), "enriched").otherwise(F.col("description")).alias("text"), "funding_min", "funding_max")


@query("j11_enrich_new_rows", ENRICHED.format(fresh="and p_size <= 24"))
def _(spark, folder):
    return enriched(spark, folder, NOW)


@query("j12_enrich_all", "select outcome, count(*) as n from (" + ENRICHED.format(fresh="") + ") where outcome is not null group by outcome")
def _(spark, folder):
    result = enrich.enrich_from_pages(competitions(spark, folder), competition_detail_pages(spark, folder), AS_OF)
    return enrich.outcome_counts(result).withColumnRenamed("_outcome", "outcome")
