"""The five source jobs and a whole run, over pages and answers written out of the part table.

A brand's parts are the pages of one crawl, by part key; a part of size 50 has a page without
cards, where its crawl ends.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..model import SPECS
from ..operators import enrich, ledger
from ..session import by_shuffle, fresh_path
from ..sources import landed, snapshots
from . import ingest, jobs, q_changes as qc, q_extract as qx, q_shape as qs
from .registry import query
from .sample import AS_OF, NOW, fill, long_day, part_days, table

SITE = "https://site.example.org/list/"
GAP = "chr(10) || chr(10)"
# Parts with their place in the crawl of their brand, and whether the crawl gets there.
PLACED = """placed as (select * from (select *, row_number() over (partition by p_brand order by p_partkey) as page_no from parts)
 join (select p_brand, min(case when p_size = 50 then n end) as stop from (select p_brand, p_size, row_number() over (partition by p_brand order by p_partkey) as n from parts) group by p_brand) using (p_brand)
 where stop is null or page_no < stop)"""


def places(spark, folder):
    """Page number and next page per part; the last page of a crawl leads back to its second one, or to itself."""
    by_brand = Window.partitionBy("p_brand").orderBy("p_partkey")
    whole = by_brand.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value("p_partkey", 2, ignoreNulls=True).over(whole)
    return table(spark, folder, "part").select(
        "p_partkey", F.col("p_brand").alias("crawl"), "p_size", F.row_number().over(by_brand).alias("page_no"),
        F.coalesce(F.lead("p_partkey").over(by_brand), second, F.col("p_partkey")).alias("next_key"),
        F.first("p_partkey").over(whole).alias("first_key"))


def numbered(spark, folder, pages):
    """Pages of parts in their crawls; a part of size 50 has an empty page."""
    empty = F.when(F.col("p_size") == 50, F.lit("<p>No offers.</p>")).otherwise(F.col("html"))
    return pages.join(by_shuffle(places(spark, folder)), "p_partkey").select("p_partkey", "crawl", "page_no", "next_key", "url", empty.alias("html"))


def starts(spark, folder):
    return places(spark, folder).select("crawl", F.concat(F.lit(SITE), F.col("first_key").cast("string")).alias("url")).distinct()


def linked(html, next_key, old: str):
    """A page whose next link leads to the next part's page."""
    return F.replace(html, F.lit(old), F.concat(F.lit('href="/list/'), next_key.cast("string"), F.lit('"')))


@query("a09_next_links", """select c_custkey, n as page_no from (select c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as n from customer)""")
def _(spark, folder):
    """One crawl per nation through all of its customers; half of the crawls end in a cycle of odd or even length, one in no link."""
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Only the last customer of a nation takes these: its first one, the one two before the last, itself.
    back = F.when(F.col("c_nationkey") % 4 == 0, F.first("c_custkey", ignorenulls=True).over(whole)).when(F.col("c_nationkey") % 4 == 1, F.lag("c_custkey", 2).over(order)).when(
        F.col("c_nationkey") % 4 == 2, F.col("c_custkey"))
    address = lambda c: F.concat(F.lit(SITE), c.cast("string"))
    rows = table(spark, folder, "customer").select("c_custkey", "c_nationkey", F.coalesce(F.lead("c_custkey").over(order), back).alias("next"), F.first("c_custkey").over(whole).alias("head"))
    links = rows.select(address(F.col("c_custkey")).alias("url"), address(F.col("next")).alias("next_url"))
    reached = landed.by_next_link(links, rows.select(F.col("c_nationkey").alias("crawl"), address(F.col("head")).alias("url")))
    return reached.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("c_custkey"), "page_no")


def competition_pages(spark, folder):
    pages = qx.pages_of(spark, folder, qx.COMPETITION_LIST, opens_text=long_day(F.col("opens")), ends_text=long_day(F.col("ends")))
    return numbered(spark, folder, pages)


COMPETITIONS_SQL = f"""{PLACED}, found as (select 'ifs:' || cast(p_partkey as string) as id, p_name || ' ' || p_type || ' & co' as title,
 'https://apply-for-innovation-funding.service.gov.uk/competition/' || cast(p_partkey as string) || '/overview?a=1&b=2' as url,
 'Size' || chr(160) || cast(p_size as string) || ' ££' as description, opens as opened_date, ends as closes_date, page_no, 0 as slot from placed
 union all select 'ifs:x' || cast(p_partkey as string), 'Second', 'https://other.example.org/competition/x' || cast(p_partkey as string), '', null, null, page_no, 1 from placed)"""


@query("p01_competitions", f"with {COMPETITIONS_SQL} select * from found")
def _(spark, folder):
    return jobs.competitions(competition_pages(spark, folder)).select("id", "title", "url", "description", "opened_date", "closes_date", "page_no", "slot")


def connect_lists(spark, folder):
    slash = lambda c: F.date_format(c, "dd/MM/yyyy")
    pages = qx.pages_of(spark, folder, qx.CONNECT_LIST, opens_text=slash("opens"), ends_text=slash("ends"), slug=F.lit("offer"), next=F.lit('<a rel="next" NEXT>More</a>'))
    pages = numbered(spark, folder, pages)
    return pages.withColumn("html", linked(F.col("html"), F.col("next_key"), "NEXT"))


def connect_details(spark, folder):
    """Detail pages of source 2; a page without prose, award or meta text leaves no text of its own but its address."""
    return qx.pages_of(spark, folder, qx.CONNECT_PAGE, url="https://site.example.org/opportunities/offer-{p_partkey}/",
                       award=F.when(F.col("p_size") < 40, fill("Up to £{p_size}k")).otherwise("none stated"), sector=F.lit("Plain sector"),
                       link_text=F.lit("Apply"), article=F.lit("")).select("url", "html")


CONNECTIONS_SQL = f"""select 'iukbc:offer-' || cast(p_partkey as string) as id, p_name || ': Round ' || cast(p_size as string) as title, 'https://iuk-business-connect.org.uk/apply/' || cast(p_partkey as string) as url,
 'Award: ' || case when p_size < 40 then 'Up to £' || cast(p_size as string) || 'k' else 'none stated' end || {GAP} || 'Source page: https://site.example.org/opportunities/offer-' || cast(p_partkey as string) || '/' || {GAP} || 'Meta ' || p_name as description,
 opens as opened_date, ends as closes_date, case when p_size < 40 then p_size * 1000.0 end::double as funding_max, 'Plain sector' as sector_tags, page_no from placed"""


@query("p02_connections", f"with {PLACED} {CONNECTIONS_SQL}")
def _(spark, folder):
    found = jobs.connections(connect_lists(spark, folder), connect_details(spark, folder), starts(spark, folder))
    return found.select("id", "title", "url", "description", "opened_date", "closes_date", "funding_max", "sector_tags", F.col("page_no").cast("bigint").alias("page_no"))


@query("f01_overlay", """select p_partkey, case when p_size < 40 then 'D ' || p_type end as award, p_name as title,
 case when p_size < 40 then case when p_size >= 20 then 'Text ' || p_brand when p_size >= 10 then 'Sum ' || p_name else p_name end when p_size >= 45 then 'listed' else 'Sum ' || p_name end as description from part""")
def _(spark, folder):
    """Cards with full, with empty and without detail pages, where a missing page is no error."""
    size = F.col("p_size")
    cards = table(spark, folder, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.when(size >= 10, fill("Sum {p_name}")).otherwise("").alias("summary"), F.when(size >= 45, "listed").alias("description"),
        F.lit(None).cast("string").alias("award"))
    pages = table(spark, folder, "part").where(size < 40).select(
        "p_partkey", fill("D {p_type}").alias("award"), F.when(size >= 20, fill("Text {p_brand}")).when(size >= 15, "").alias("description"))
    return enrich.overlaid(cards, pages, "p_partkey", strict=False).select("p_partkey", "award", "title", "description")


def council_lists(spark, folder):
    kind = F.col("p_type")
    pages = qx.pages_of(spark, folder, qx.COUNCIL_LIST, ends_text=long_day(F.col("ends")), money_label=F.lit("Maximum award"),
                        funders=F.when(kind == "PROMO", "<a>Innovate UK</a>, innovate uk").otherwise(fill("Council of {p_type}, <a>Innovate UK</a>")))
    pages = numbered(spark, folder, pages)
    return pages.withColumn("html", linked(F.col("html"), F.col("next_key"), 'href="/opportunity/page/2/"'))


def council_pages(spark, folder):
    """Detail pages of source 3, for some of the parts."""
    return qx.council_pages(spark, folder, url="https://site.example.org/opportunity/call-{p_partkey}/").join(
        by_shuffle(table(spark, folder, "part").where("p_size < 30").select("p_partkey")), "p_partkey").select("url", "html")


COUNCILS_SQL = f"""select 'ukri:call-' || cast(p_partkey as string) as id, case when p_size < 30 then p_name || ' internships' else p_name || ' call' end as title, opens as opened_date, ends as closes_date,
 case when p_size >= 30 then p_size * 1000.0 end::double as funding_max, case when p_size < 30 then 'Council ' || p_type else 'Council of ' || p_type || ', Innovate UK' end as sector_tags,
 'Funders: ' || case when p_size < 30 then 'Council ' || p_type else 'Council of ' || p_type || ', Innovate UK' end || {GAP} || 'Funding type: Grant' || {GAP} ||
 case when p_size < 30 then '' else 'Maximum award: £' || cast(p_size as string) || ',000 - £2 million' || {GAP} || 'Total fund: £9m' || {GAP} end ||
 'Source page: https://site.example.org/opportunity/call-' || cast(p_partkey as string) || '/' || {GAP} || case when p_size < 30 then 'An opportunity for ' || p_brand || ' students.' else 'Apply for ' || p_type || ' funding.' end as description,
 page_no from placed where p_type <> 'PROMO'"""


@query("p03_councils", f"with {PLACED} {COUNCILS_SQL}")
def _(spark, folder):
    found = jobs.councils(council_lists(spark, folder), council_pages(spark, folder), starts(spark, folder), AS_OF)
    return found.select("id", "title", "opened_date", "closes_date", "funding_max", "sector_tags", "description", F.col("page_no").cast("bigint").alias("page_no"))


PER_PAGE = 3


def paged(rows, spark, folder, per_page: int):
    """Records of parts as answers of so many each, in the crawl of their brand."""
    record = F.struct(*[c for c in rows.columns if c != "p_partkey"])
    placed = rows.withColumn("record", record).join(by_shuffle(places(spark, folder)), "p_partkey")
    page = F.floor((F.col("page_no") - 1) / per_page + 1).cast("int")
    answers = placed.groupBy("crawl", page.alias("page_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), "p_partkey"))).alias("order"), F.map_from_entries(F.collect_list(F.struct("p_partkey", "record"))).alias("by_key"))
    return answers.select("crawl", "page_no", F.transform("order", lambda o: F.try_element_at("by_key", o["k"])).alias("results"))


@query("p04_topics", f"""select 'horizon:' || lower(key) as id, p_name || ' & chips' as title, low as funding_min_native, high * rate as funding_max, 'Innovation Actions, Call ' || p_type as niche_tags, p as page_no
 from (select *, {qs.PORTAL_LOW} as low, {qs.PORTAL_HIGH} as high, cast((n - 1) // {PER_PAGE} + 1 as integer) as p, case when p_type = 'PROMO' then case when p_size < 45 then 'HORIZON-CALL-' || cast(p_partkey as string) end else 'HORIZON-' || cast(p_partkey as string) || '-X' end as key
 from (select *, row_number() over (partition by p_brand order by p_partkey) as n from parts)), (select min(s_acctbal) as rate from supplier) where key is not null""")
def _(spark, folder):
    records = qs.portal_records(spark, folder)
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), F.array(value).alias("value"))
    hits = table(spark, folder, "part").select(
        fill("HORIZON-{p_partkey}-X").alias("identifier"), F.explode(F.array(F.lit(0), F.lit(1))).alias("slot"), "p_type").select(
        "identifier", "slot", F.when(F.col("slot") == 1, F.col("identifier")).otherwise("other").alias("found"), F.lit("detail").alias("summary"), F.lit("c").alias("content"),
        F.map_from_entries(F.array(entry("title", F.lit("not this")), entry("callTitle", F.lit("nor this")))).alias("metadata"))
    rate = table(spark, folder, "supplier").agg(F.min("s_acctbal").alias("rate")).withColumn("rate_date", F.lit(AS_OF).cast("date"))
    found = jobs.topics(paged(records, spark, folder, PER_PAGE), hits, rate, AS_OF, PER_PAGE)
    return found.select("id", "title", "funding_min_native", "funding_max", "niche_tags", "page_no")


def broker_answers(spark, folder):
    """Answers of four; a brand announces seven ids; offers of type MEDIUM lead to source 2."""
    rows = qs.broker_records(spark, folder).withColumn(
        "fundingUrl", F.when(F.col("organisation") == "", "https://iuk-business-connect.org.uk/opportunities/x").otherwise(F.col("fundingUrl")))
    return paged(rows, spark, folder, 4).withColumn("total", F.lit(7).cast("bigint"))


BROKERED_SQL = """numbered as (select *, row_number() over (partition by p_brand order by p_partkey) as n from parts), asked as (select *, cast((n - 1) // 4 + 1 as integer) as p, p_size < 45 and p_type <> 'MEDIUM' as own from numbered),
 brokered as (select 'konfer:' || case when p_size < 40 then 'm' else 'e' end || cast(p_partkey as string) as id, p_name || ' & co' as title, ends as closes_date, p as page_no
 from asked a where own and (select count(*) from asked b where b.p_brand = a.p_brand and b.own and b.p < a.p) < 7)"""


@query("p05_brokered", f"with {BROKERED_SQL} select * from brokered")
def _(spark, folder):
    return jobs.brokered(broker_answers(spark, folder)).select("id", "title", "closes_date", "page_no")


@query("p06_full_run", f"""with {PLACED}, {COMPETITIONS_SQL.split(', found as', 1)[1].join(['found as', ''])}, {BROKERED_SQL},
 old as (select id, source from catalogue where opened_date < date '1998-01-01' and status <> 'inactive' and (closes_date is null or closes_date >= date '1998-06-01'))
 select 'innovate_uk' as source, 'success' as status, (select count(*) from found) as n, cast(null as string) as error
 union all select 'iuk_business_connect', 'failed', null, 'no detail page'
 union all select 'ukri', 'success', (select count(*) from placed where p_type <> 'PROMO') + (select count(*) from old where source = 'ukri'), null
 union all select 'konfer', 'success', (select count(*) from brokered) + (select count(*) from old where source in ('konfer', 'Konfer')), null
 union all select 'run', 'partial_success', null, null union all select 'note', null, (select count(*) from brokered), null
 union all select 'enriched', null, (select count(*) from placed where 'ifs:' || cast(p_partkey as string) not in (select id from catalogue
   where opened_date < date '1998-01-01' and not coalesce(closes_date < date '1998-06-01', false) and coalesce(description, '') <> coalesce(summary, ''))), null
 union all select 'kept', 'iuk_business_connect', (select count(*) from old where source = 'iuk_business_connect'), null""")
def _(spark, folder):
    """Four jobs over a stored catalogue, one of which misses a detail page: its rows stay, the others are merged, the ledger tells."""
    root = fresh_path(spark, "run")
    snapshots.write_snapshot(qc.stored(spark, folder), f"{root}/offers")
    short = connect_details(spark, folder).where(~F.col("url").endswith("1/"))
    work = [
        ingest.SourceJob(SPECS["innovate_uk"], lambda s: jobs.competitions(competition_pages(s, folder))),
        ingest.SourceJob(SPECS["iuk_business_connect"], lambda s: jobs.connections(connect_lists(s, folder), short, starts(s, folder))),
        ingest.SourceJob(SPECS["ukri"], lambda s: jobs.councils(council_lists(s, folder), council_pages(s, folder), starts(s, folder), AS_OF)),
        ingest.SourceJob(SPECS["konfer"], lambda s: jobs.brokered(broker_answers(s, folder)))]
    details = part_days(spark, folder).select(
        fill("https://apply-for-innovation-funding.service.gov.uk/competition/{p_partkey}/overview").alias("url"),
        fill('<body><main><h2>Description</h2><p>About {p_name}.</p></main></body>').alias("html"))
    ingest.run(spark, root, work, AS_OF, NOW, order=list(jobs.PLACE), pages=details)
    metadata = snapshots.read_metadata(spark, f"{root}/ledger")
    state = ledger.read_state(F.col("value"), ledger.SOURCE_STATE)
    states = metadata.where(F.col("key").startswith(ledger.fv.SOURCE_STATUS_PREFIX)).select(state.alias("s")).select(
        "s.source", "s.status", F.col("s.count").alias("n"), F.regexp_extract("s.error", "no detail page", 0).alias("error"))
    states = states.withColumn("error", F.nullif("error", F.lit("")))
    one = metadata.where(F.col("key") == ledger.fv.LAST_RUN_KEY).select(F.lit("run").alias("source"), ledger.read_state(F.col("value"), ledger.RUN_STATE)["status"].alias("status"), F.lit(None).cast("bigint").alias("n"))
    note = metadata.where(F.col("key") == ledger.fv.BROKER_CHECK_KEY).select(
        F.lit("note").alias("source"), F.lit(None).cast("string").alias("status"), ledger.read_state(F.col("value"), ledger.CHECK_STATE)["non_duplicate_records"].alias("n"))
    offers = snapshots.read_snapshot(spark, f"{root}/offers")
    enriched = offers.where("source = 'innovate_uk' and description like '%About %'").agg(F.count("*").alias("n")).select(
        F.lit("enriched").alias("source"), F.lit(None).cast("string").alias("status"), "n")
    alive = qc.stored(spark, folder).where("source = 'iuk_business_connect' and status <> 'inactive' and (closes_date is null or closes_date >= date '1998-06-01')").select("id")
    kept = offers.where("source = 'iuk_business_connect'").join(alive, "id").agg(F.count("*").alias("n")).select(F.lit("kept").alias("source"), F.lit("iuk_business_connect").alias("status"), "n")
    bare = lambda df: df.select("source", "status", "n", F.lit(None).cast("string").alias("error"))
    return states.select("source", "status", "n", "error").union(bare(one)).union(bare(note)).union(bare(enriched)).union(bare(kept))
