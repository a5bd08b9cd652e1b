"""Records to items, and the joins between landed and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe, enrich, merge, normalise, search as s
from ..session import by_shuffle
from ..sources import landed
from . import q_extract as qx
from .registry import query
from .sample import AS_OF, catalogue, fill, long_day, part_days, table

BR = "chr(10)"
GAP = f"{BR} || {BR}"


def broker_records(spark, folder):
    kind = F.col("p_type")
    return part_days(spark, folder).select(
        "p_partkey",
        F.when(F.col("p_size") < 40, fill("m{p_partkey}")).otherwise("").alias("mongoId"),
        F.when(F.col("p_size") < 45, fill("e{p_partkey}")).alias("elasticSearchId"),
        F.when(kind == "SMALL", "").otherwise(fill("Up to &pound;{p_size}m of £{p_size}k")).alias("award"),
        fill(" <b>{p_name}</b> &amp; co").alias("title"), fill("<p>On {p_brand}.</p>").alias("summary"),
        F.when(kind == "LARGE", fill("/funding/{p_partkey}")).when(kind == "PROMO", "https://x.org/p").alias("url"),
        F.when(kind == "ECONOMY", "").otherwise(F.concat(F.date_format("opens", "MMM d"), F.lit("th "), F.date_format("opens", "yyyy"))).alias("registrationStartDate"),
        long_day(F.col("ends")).alias("registrationCloseDate"), F.date_format("opens", "yyyy-MM-dd").alias("datePublished"),
        F.when(kind == "STANDARD", fill("https://y.org/{p_size}")).otherwise("").alias("fundingUrl"),
        F.when(kind == "MEDIUM", "").otherwise("Body").alias("organisation"), F.lit("Institute").alias("institutionName"),
        F.when(kind == "SMALL", "Transport").alias("sector"), F.struct(F.lit("Other").alias("category")).alias("konferCategory"))


@query("d01_broker_items", f"""select 'konfer:' || case when p_size < 40 then 'm' else 'e' end || cast(p_partkey as string) as id, p_name || ' & co' as title, opens as opened_date, ends as closes_date,
 case when p_type = 'STANDARD' then 'https://y.org/' || cast(p_size as string) when page <> '' then page else 'https://konfer.online/fundings' end as url, case when p_type <> 'SMALL' then p_size * 1000000.0 end::double as funding_max,
 case when p_type = 'SMALL' then 'Transport' else 'Other' end as sector_tags, body || ', Grant Funding' as niche_tags,
 case when p_type <> 'SMALL' then 'Award: Up to £' || cast(p_size as string) || 'm of £' || cast(p_size as string) || 'k' || {GAP} else '' end || 'Organisation: ' || body || {GAP} ||
 case when page <> '' then 'Konfer page: ' || page || {GAP} else '' end || 'On ' || p_brand || '.' as description
 from (select *, case when p_type = 'MEDIUM' then 'Institute' else 'Body' end as body, case p_type when 'LARGE' then 'https://konfer.online/funding/' || cast(p_partkey as string) when 'PROMO' then 'https://x.org/p' else '' end as page from parts) where p_size < 45""")
def _(spark, folder):
    return normalise.broker_items(broker_records(spark, folder)).select(
        "id", "title", "opened_date", "closes_date", "url", "funding_max", "sector_tags", "niche_tags", "description")


def portal_records(spark, folder):
    """Portal records of the parts, with array-valued metadata."""
    stamp = lambda d: F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00.000+0000"))
    kind = F.col("p_type")
    base = qx.budgets(spark, folder).withColumns({
        "opens": F.expr("date '1998-01-01' + p_size"), "ends": F.expr("date '1998-06-01' + p_size * 2")})
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    return base.select(
        "p_partkey", F.when(kind == "SMALL", "").otherwise(fill("Summary of {p_name}")).alias("summary"), F.lit(None).cast("string").alias("content"),
        F.map_from_entries(F.array(
            entry("identifier", F.array(F.when(kind == "PROMO", "").otherwise(fill("HORIZON-{p_partkey}-X")))),
            entry("callIdentifier", F.array(F.when(F.col("p_size") < 45, fill("HORIZON-CALL-{p_partkey}")))),
            entry("title", F.array(fill("{p_name} &amp;  chips"))), entry("type", F.array(F.lit("1"))),
            entry("startDate", F.array(stamp(F.col("opens")))), entry("deadlineDate", F.array(F.lit("1998-02-01"), stamp(F.col("ends")))),
            entry("typesOfAction", F.array(F.lit("Innovation  Actions"))), entry("callTitle", F.array(fill("Call {p_type}"))),
            entry("keywords", F.array(F.lit("A&amp;B"), F.lit(" "), F.col("p_brand"), *[F.lit(f"k{i}") for i in range(9)])),
            entry("descriptionByte", F.array(fill("<span>Outcome:</span><p>Develop {p_name}&nbsp;chips.</p>"))),
            entry("budgetOverview", F.col("payloads")))).alias("metadata"))


PORTAL_LOW = "case when p_size < 10 then 25.0 else least(cast(p_size as double), 25.0) end"
PORTAL_HIGH = "greatest(p_size * 1000.0, 20000.0)::double"


@query("d02_portal_items", f"""select 'horizon:' || lower(key) as id, p_name || ' & chips' as title, 'https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/topic-details/' || key as url,
 opens as opened_date, ends as closes_date, low as funding_min_native, high as funding_max_native, low * rate as funding_min, high * rate as funding_max, 'EUR' as funding_currency, 'A&B, ' || p_brand || ', k0, k1, k2, k3, k4, k5' as sector_tags,
 'Innovation Actions, Call ' || p_type as niche_tags, case when p_type = 'SMALL' then 'Outcome: Develop ' || p_name || ' chips.' else 'Summary of ' || p_name end as summary,
 'Action type: Innovation Actions' || {GAP} || 'Call: Call ' || p_type || {GAP} || 'Topic budget: EUR ' || cast(p_size as string) || ',001,500' || {GAP} || 'Expected grants: ' || cast(p_size as string) || {GAP} ||
 'Outcome: Develop ' || p_name || ' chips.' || {GAP} || 'Source page: https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/topic-details/' || key as description
 from (select *, {PORTAL_LOW} as low, {PORTAL_HIGH} as high, case when p_type = 'PROMO' then case when p_size < 45 then 'HORIZON-CALL-' || cast(p_partkey as string) end else 'HORIZON-' || cast(p_partkey as string) || '-X' end as key
 from parts), (select min(s_acctbal) as rate from supplier) where key is not null""")
def _(spark, folder):
    rate = table(spark, folder, "supplier").agg(F.min("s_acctbal").alias("rate")).withColumn("rate_date", F.lit(AS_OF).cast("date"))
    return normalise.portal_items(portal_records(spark, folder), rate, AS_OF).select(
        "id", "title", "url", "opened_date", "closes_date", "funding_min_native", "funding_max_native", "funding_min", "funding_max",
        "funding_currency", "sector_tags", "niche_tags", "summary", "description")


@query("d03_council_items", f"""select 'ukri:' || cast(p_partkey as string) as id, p_name as title, case when p_size < 25 then 'https://a.org/x' else 'https://c.org/o/' || cast(p_partkey as string) || '/' end as url,
 cast(p_size as double) * 1000 as funding_max, case when p_size < 10 then 'Grant' end as niche_tags, case when p_size < 10 then 'Funding type: Grant' || {GAP} else '' end || 'Maximum award: £' || cast(p_size as string) || 'k' || {GAP} ||
 'Source page: https://c.org/o/' || cast(p_partkey as string) || '/' || case when p_size < 40 then {GAP} || 'Sum ' || p_type else '' end as description from part""")
def _(spark, folder):
    fact = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(None).cast("string").alias("stamp"))
    cards = table(spark, folder, "part").select(
        fill("https://c.org/o/{p_partkey}/").alias("source_url"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") < 40, fill("Sum {p_type}")).otherwise("").alias("summary"), F.lit("").alias("description"),
        F.array_compact(F.array(F.when(F.col("p_size") < 10, fact("funding type", F.lit("Grant"))), fact("maximum award", fill("£{p_size}k")))).alias("facts"),
        F.lit(None).cast("date").alias("opened_date"), F.lit(None).cast("date").alias("closes_date"),
        F.when(F.col("p_size") < 25, "https://a.org/x").alias("application_url"))
    return normalise.council_items(cards, AS_OF).select("id", "title", "url", "funding_max", "niche_tags", "description")


@query("d04_money_precedence", """select p_partkey, case when p_size between 10 and 29 then 5.0 when p_size < 40 then cast(p_size as double) end as low,
 case when p_size between 20 and 44 then 7000.0 when p_size < 40 then p_size * 1000.0 else 9000000.0 end::double as high,
 case when p_size < 40 then 1 else 0 end + case when p_size between 10 and 29 then 1 else 0 end + case when p_size between 20 and 44 then 1 else 0 end + 1 as notes from part""")
def _(spark, folder):
    size = F.col("p_size")
    low, high, notes = normalise.funding_from_facts(
        F.when(size < 40, fill("£{p_size} to £{p_size}k")), F.when(size.between(10, 29), "GBP 5"), F.when(size.between(20, 44), "£7,000"), F.lit("£9m"))
    return table(spark, folder, "part").select("p_partkey", low.alias("low"), high.alias("high"), F.size(notes).alias("notes"))


@query("d05_apply_detail", """select id, case when p_size < 30 then 'Detail of ' || p_name else description end as description, case when p_size < 15 then 1000.0 else funding_min end as funding_min,
 case when p_size < 30 then 2000.0 else funding_max end as funding_max, case when p_size < 30 then 'GBP' else funding_currency end as funding_currency,
 case when p_size < 30 then cast(1.0 as double) else exchange_rate end as exchange_rate, case when p_size < 30 then date '1998-06-01' else exchange_rate_date end as exchange_rate_date
 from (select *, case when niche_tags like 'size %' then cast(regexp_extract(niche_tags, '(\\d+)', 1) as integer) end as p_size, rtrim(substr(title, 1, length(title) - length(split_part(title, ' ', -1)))) as p_name from catalogue)""")
def _(spark, folder):
    base = catalogue(spark, folder).withColumn("size", F.when(F.col("niche_tags").like("size %"), F.regexp_extract("niche_tags", r"(\d+)", 1).cast("int")))
    name = F.regexp_replace("title", r" [^ ]*$", "")
    detail = base.select("id", F.when(F.col("size") < 30, F.concat(F.lit(" Detail of "), name)).otherwise(" ").alias("description"),
                         F.when(F.col("size") < 15, F.lit(1000.0)).alias("funding_min"), F.lit(2000.0).alias("funding_max"))
    return enrich.apply_detail(enrich.join_detail(base, detail, "id"), AS_OF).select(
        "id", "description", "funding_min", "funding_max", "funding_currency", "exchange_rate", "exchange_rate_date")


@query("d06_facts_from_tags", """select id, 'funders=' || sector_tags || case when niche_tags is null then '' else '|funding type=' || split_part(niche_tags, ',', 1) end as facts from catalogue""")
def _(spark, folder):
    facts = normalise.facts_from_tags(F.col("sector_tags"), F.col("niche_tags"))
    return catalogue(spark, folder).select("id", F.array_join(F.transform(facts, lambda f: F.concat_ws("=", f["label"], f["value"])), "|").alias("facts"))


@query("d07_item_projection", """select 'p:' || cast(p_partkey as string) as id, p_name as title, cast(p_size as double) as funding_max, cast(null as string) as url, 19 as n_columns from part""")
def _(spark, folder):
    raw = table(spark, folder, "part").select(
        fill("p:{p_partkey}").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("funding_max"), F.col("p_brand").alias("organisation"))
    items = normalise.to_items(raw)
    return items.select("id", "title", "funding_max", "url", F.lit(len(items.columns)).alias("n_columns"))


# --- joins ------------------------------------------------------------------------

@query("f01_detail_join", """select p_partkey, title, opened_date, closes_date, description from (select p_partkey, case when p_size < 35 then p_name || ' internships' else p_name || ' call' end as title, opens as opened_date,
 ends as closes_date, case when p_size < 35 then 'An opportunity for ' || p_brand || ' students.' else 'Apply for ' || p_type || ' funding.' end as description, p_type from parts)""")
def _(spark, folder):
    cards = qx.council_cards(spark, folder)
    details = F.col("p_size") < 35
    pages = qx.council_pages(spark, folder, url="https://site.example.org/opportunity/call-{p_partkey}/").join(
        by_shuffle(table(spark, folder, "part").where(details).select("p_partkey")), "p_partkey", "left_semi")
    both = enrich.council_with_detail(cards, qx.extract.council_details(pages.select("url", "html")))
    return qx.with_key(both, "page_url").select("p_partkey", "title", "opened_date", "closes_date", "description")


@query("f02_listing_over_detail", """select p_partkey, case when p_size < 20 then 'own' else 'detail ' || p_brand end as keywords, case when p_size < 10 then '' else p_name end as title, 'only detail' as extra,
 case when p_size < 30 then 'listed' else p_type end as summary from part""")
def _(spark, folder):
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    part = table(spark, folder, "part").withColumn("identifier", fill("I{p_partkey}"))
    listing = part.select("p_partkey", "identifier", F.when(F.col("p_size") < 30, "listed").alias("summary"), F.lit(None).cast("string").alias("content"),
                          F.map_from_entries(F.array(
                              entry("keywords", F.when(F.col("p_size") < 20, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>"))),
                              entry("title", F.when(F.col("p_size") < 10, F.array(F.lit(""))).otherwise(F.array("p_name"))))).alias("metadata"))
    detail = part.select("identifier", F.col("p_type").alias("summary"), F.lit("c").alias("content"), F.map_from_entries(F.array(
        entry("keywords", F.array(fill("detail {p_brand}"))), entry("title", F.array(F.lit("no"))), entry("extra", F.array(F.lit("only detail"))))).alias("metadata"))
    merged = normalise.merge_listing_and_detail(listing, detail)
    first = lambda key: F.get(normalise.meta(F.col("metadata"), key), F.lit(0)).alias(key)
    return merged.select("p_partkey", first("keywords"), first("title"), first("extra"), "summary")


@query("f03_anti_join", """select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')""")
def _(spark, folder):
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    seen = urgent.select(F.col("o_custkey").alias("c_custkey"))
    return merge.stored_not_seen(table(spark, folder, "customer"), seen, ("c_custkey",)).select("c_custkey")


@query("f04_source_dimension", """select id, case when source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect') then 'innovate_uk' when source = 'Konfer' then 'konfer' else source end as source_key,
 case when source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect') then 0 when source = 'ukri' then 1 when source = 'horizon_europe' then 2 else 3 end as source_position,
 case when source in ('iuk_business_connect', 'horizon_europe') then 0 when source = 'Konfer' then 2 else 1 end as source_priority from catalogue""")
def _(spark, folder):
    return s.with_source_names(catalogue(spark, folder)).select("id", "source_key", "source_position", "source_priority")


@query("f04_unknown_sources", """select doc_id, source as source_key, upper(substr(source, 1, 1)) || substr(source, 2) as source_label, 99 as source_priority from documents""")
def _(spark, folder):
    return s.with_source_names(table(spark, folder, "documents")).select("doc_id", "source_key", "source_label", "source_priority")


@query("f05_alias_expansion", "select id, source from catalogue where source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect', 'Konfer')")
def _(spark, folder):
    wanted = catalogue(spark, folder).where(F.col("source").isin("Innovate UK", "Konfer")).select(
        s.DEFAULT_BOOK.key_of(F.col("source")).alias("source_key")).distinct()
    return s.in_any_spelling(catalogue(spark, folder), wanted).select("id", "source")


@query("f07_rate_on_every_record", """select c_custkey, c_acctbal * rate as converted, day from customer, (select min(s_acctbal) as rate, date '1998-06-01' as day from supplier)""")
def _(spark, folder):
    from ..functions.money import convert
    rate = table(spark, folder, "supplier").agg(F.min("s_acctbal")).scalar()
    return table(spark, folder, "customer").select(
        "c_custkey", convert(F.col("c_acctbal"), rate).alias("converted"), F.lit(AS_OF).cast("date").alias("day"))


@query("f08_rows_sharing_a_key", """select key, count(*) as n from (select 'title-close:' || lower(title) || ':' || strftime(closes_date, '%Y-%m-%d') as key from catalogue where closes_date >= date '1998-06-01'
 union all select 'url:' || case when id like 'ifs:%' then 'apply-for-innovation-funding.service.gov.uk/competition/' || regexp_extract(url, 'competition/([^/]+)/', 1) || '/overview'
   when id like 'iukbc:%' then 'iuk-business-connect.org.uk/opportunities/' || regexp_extract(url, 'opportunities/([^/]+)/', 1) else lower(regexp_extract(url, 'https://([^?]*)/', 1)) end from catalogue where closes_date is null or closes_date >= date '1998-06-01'
 union all select split_part(id, ':', 1) || ':' || regexp_extract(url, '(?:competition|opportunities)/([^/]+)/', 1) from catalogue where (id like 'ifs:%' or id like 'iukbc:%') and (closes_date is null or closes_date >= date '1998-06-01')
 union all select 'url:iuk-business-connect.org.uk/opportunities/' || regexp_extract(description, 'opportunities/([^/]+)/', 1) from catalogue where description like 'Round page%' and (closes_date is null or closes_date >= date '1998-06-01')
 union all select 'iukbc:' || regexp_extract(description, 'opportunities/([^/]+)/', 1) from catalogue where description like 'Round page%' and (closes_date is null or closes_date >= date '1998-06-01'))
 group by key having count(*) > 1""")
def _(spark, folder):
    return dedupe.shared_key_groups(dedupe.ranked_keys(catalogue(spark, folder), AS_OF)).select("key", "n")


@query("f09_asked_once", "select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_returnflag = 'R')")
def _(spark, folder):
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return landed.ask_once(lines, table(spark, folder, "part"), "p_partkey").select("p_partkey", "p_name")


@query("h03_best_hit", """select l_partkey, l_orderkey from (select *, row_number() over (partition by l_partkey order by case when l_returnflag = 'A' then 0 else 1 end, l_orderkey, l_linenumber, l_extendedprice) as n from lineitem) where n = 1""")
def _(spark, folder):
    hits = table(spark, folder, "lineitem").select(
        "l_partkey", "l_orderkey", F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("found"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("slot"))
    return landed.best_hits(hits, "l_partkey").select("l_partkey", "l_orderkey")


@query("h04_rate_day", """select p_partkey, case when p_size < 25 then date '1998-01-01' + p_size else date '1997-01-01' end as rate_date from part""")
def _(spark, folder):
    day = F.expr("date '1998-01-01' + p_size")
    two_days = fill("<E><Cube><Cube time='{day}'><Cube currency='{first}' rate='1'/></Cube><Cube time='1997-01-01'><Cube currency='USD' rate='2'/><Cube currency='GBP' rate='3'/></Cube></Cube></E>",
                    day=day, first=F.when(F.col("p_size") < 25, "GBP").otherwise("JPY"))
    return table(spark, folder, "part").select("p_partkey", landed.rate_columns(two_days)[1])


@query("i01_first_wins", """select identifier, l_orderkey from (select 'P' || cast(l_partkey as string) as identifier, l_orderkey, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as n from lineitem) where n = 1""")
def _(spark, folder):
    items = table(spark, folder, "lineitem").select(fill("P{l_partkey}").alias("identifier"), "l_orderkey", "l_linenumber")
    return merge.first_per_key(items, ["identifier"], ["l_orderkey", "l_linenumber"]).select("identifier", "l_orderkey")
