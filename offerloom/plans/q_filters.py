"""Filters, aggregates, windows, order and set operations, report columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from .. import fixed_values as fv
from ..functions import report
from ..model import DEFAULT_BOOK, SPECS
from ..operators import enrich, merge, normalise, search as s, stats
from ..functions.urls import is_partner_link
from .registry import query
from .sample import AS_OF, NOW, catalogue, fill, shown, table

LIVE = "status <> 'inactive' and (closes_date is null or closes_date >= date '1998-06-01')"


@query("e01_live_rows", f"select id, status, closes_date from catalogue where {LIVE}")
def _(spark, folder):
    return s.live(catalogue(spark, folder), AS_OF).select("id", "status", "closes_date")


@query("e02_keyword", """select id, title from catalogue
 where title ilike '%WIDGET%' or summary ilike '%WIDGET%' or description ilike '%WIDGET%'""")
def _(spark, folder):
    return s.keyword_filter(catalogue(spark, folder), " WIDGET ").select("id", "title")


@query("e02_keyword_wildcard", """select id, title from catalogue
 where title ilike '%red_wid%eco%' or summary ilike '%red_wid%eco%' or description ilike '%red_wid%eco%'""")
def _(spark, folder):
    return s.keyword_filter(catalogue(spark, folder), "red_wid%eco").select("id", "title")


@query("e02_keyword_documents", """select doc_id, lang from documents where text ilike '%the of%'""")
def _(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("text", "description")
    return s.keyword_filter(docs, "The Of", literal=True).select("doc_id", "lang")


@query("e03_source_in", "select id, source from catalogue where source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect', 'nowhere')")
def _(spark, folder):
    return s.source_filter(catalogue(spark, folder), ["innovate_uk", "nowhere"]).select("id", "source")


@query("e04_opens_from", "select id, opened_date from catalogue where opened_date >= date '1998-03-01'")
def _(spark, folder):
    return s.date_filters(catalogue(spark, folder), opens_from=dt.date(1998, 3, 1)).select("id", "opened_date")


@query("e05_closes_between", """select id, closes_date from catalogue
 where closes_date >= date '1998-07-01' and closes_date <= date '1999-06-30'""")
def _(spark, folder):
    return s.date_filters(catalogue(spark, folder), closes_from=dt.date(1998, 7, 1), closes_to=dt.date(1999, 6, 30)).select(
        "id", "closes_date")


@query("e06_sector_or_niche", """select id, sector_tags, niche_tags from catalogue where title ilike '%size 1%'
 or summary ilike '%size 1%' or sector_tags ilike '%size 1%' or niche_tags ilike '%size 1%' or description ilike '%size 1%'""")
def _(spark, folder):
    return s.tag_filter(catalogue(spark, folder), "Size 1").select("id", "sector_tags", "niche_tags")


@query("e07_min_funding", "select id, funding_max from catalogue where funding_max is null or funding_max >= 60000")
def _(spark, folder):
    return s.funding_filters(catalogue(spark, folder), low=60000).select("id", "funding_max")


@query("e08_max_funding", "select id, funding_min from catalogue where funding_min is null or funding_min <= 5000")
def _(spark, folder):
    return s.funding_filters(catalogue(spark, folder), high=5000).select("id", "funding_min")


@query("e09_sole_funder", """select id from catalogue
 where not (source in ('innovate_uk', 'Innovate UK'))""")
def _(spark, folder):
    funders = F.when(F.col("source") == "innovate_uk", "Innovate UK").when(
        F.col("source") == "Innovate UK", " innovate uk ,INNOVATE UK,").when(
        F.col("source") == "Konfer", "").otherwise(F.concat(F.lit("Innovate UK, "), "source"))
    return catalogue(spark, folder).where(~normalise.sole_funder(funders)).select("id")


@query("e10_partner_links", "select id from catalogue where not (id like 'iukbc:%')")
def _(spark, folder):
    return catalogue(spark, folder).where(~is_partner_link(F.col("url"))).select("id")


@query("e11_not_expired", """select id from catalogue
 where opened_date > date '1998-06-01' or closes_date is null or closes_date >= date '1998-06-01'""")
def _(spark, folder):
    return merge.with_status(catalogue(spark, folder), AS_OF).where(F.col("status") != "expired").select("id")


@query("e12_point_lookup", "select id, title from catalogue where id in (select id from catalogue where id like '%:7')")
def _(spark, folder):
    df = catalogue(spark, folder)
    found = [s.by_id(df, f"{prefix}:7") for prefix in ("ifs", "iukbc", "horizon", "ukri", "konfer")]
    return merge.union_items(found).select("id", "title")


UNENRICHED = "source in ('innovate_uk', 'Innovate UK') and description = summary"


@query("e13_new_unenriched", f"""select id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') as last_seen from catalogue
 where {UNENRICHED} and last_seen >= timestamp '1998-06-01 06:00:00' - interval 24 hour""")
def _(spark, folder):
    return shown(enrich.unenriched(catalogue(spark, folder), now=NOW), "id", "last_seen")


@query("e14_all_unenriched", f"select id from catalogue where {UNENRICHED}")
def _(spark, folder):
    return enrich.unenriched(catalogue(spark, folder)).select("id")


@query("e15_stale_candidates", """select id from catalogue where source in ('konfer', 'Konfer') and status <> 'inactive'
 and id not in (select 'konfer:' || cast(l_orderkey as string) from lineitem where l_returnflag = 'R')""")
def _(spark, folder):
    seen = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("konfer:"), F.col("l_orderkey").cast("string")).alias("id"))
    return merge.stale_candidates(catalogue(spark, folder), seen.withColumn("source", F.lit("konfer")), [SPECS["konfer"]]).select("id")


@query("e16_expired_candidates", """select id from catalogue
 where closes_date is not null and closes_date < date '1998-06-01' and status <> 'inactive'""")
def _(spark, folder):
    return merge.mark_expired(catalogue(spark, folder), AS_OF, NOW).where("_changed").select("id")


@query("e17_dedupe_candidates", "select id, status from catalogue where closes_date is null or closes_date >= date '1998-06-01'")
def _(spark, folder):
    from ..operators.dedupe import candidates
    return candidates(catalogue(spark, folder), AS_OF).select("id", "status")


@query("e18_filled_counts", """select count(*) as total_rows, count(geographic_scope) as geographic_scope_filled,
 count(eligible_applicants) as eligible_applicants_filled from catalogue""")
def _(spark, folder):
    return stats.filled_counts(catalogue(spark, folder), ["geographic_scope", "eligible_applicants"])


FORM = s.SearchForm(keyword="widget", sources=("innovate_uk",), min_funding=20000.0, max_funding=60000.0)
FLAGSHIP_SQL = f"""select id, source, title, status, closes_date, funding_min, funding_max from catalogue
 where {LIVE} and source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect')
 and (funding_max is null or funding_max >= 20000) and (funding_min is null or funding_min <= 60000)
 and (title ilike '%widget%' or summary ilike '%widget%' or description ilike '%widget%')
 and status in ('open', 'rolling', 'upcoming')
 order by status, closes_date nulls last, title, id"""


@query("i02_search", FLAGSHIP_SQL)
def flagship(spark, folder):
    return s.search(catalogue(spark, folder), FORM, AS_OF).select(
        "id", "source", "title", "status", "closes_date", "funding_min", "funding_max")


# --- aggregates ---------------------------------------------------------------

@query("g01_class_counts", "select source, count(*) as n from catalogue group by source order by source")
def _(spark, folder):
    return stats.class_counts(catalogue(spark, folder), "source")


@query("g02_seen_and_changed", """select count(*) as rows_seen, count(*) filter (where closes_date < date '1998-06-01'
 and status <> 'inactive') as rows_changed from catalogue""")
def _(spark, folder):
    return stats.change_summary(merge.mark_expired(catalogue(spark, folder), AS_OF, NOW))


@query("g03_migration_counts", """select true as geographic_scope_present, true as eligible_applicants_present,
 count(*) as total_rows, count(geographic_scope) as geographic_scope_populated_rows,
 count(eligible_applicants) as eligible_applicants_populated_rows from catalogue""")
def _(spark, folder):
    return merge.migration_report(catalogue(spark, folder))


@query("g04_group_counts", f"""with hits as (select status from catalogue where {LIVE} and source in ('ukri'))
 select g.status, cast(count(hits.status) as bigint) as n, g.position
 from (values ('open', 0), ('rolling', 1), ('upcoming', 2)) g(status, position) left join hits on hits.status = g.status
 group by g.status, g.position""")
def _(spark, folder):
    return s.group_counts(s.source_filter(s.live(catalogue(spark, folder), AS_OF), ["ukri"]))


@query("g04_group_counts_by_source", f"""with hits as (select source, status from catalogue where {LIVE})
 select x.source, g.status, cast(count(hits.status) as bigint) as n, g.position
 from (select distinct source from hits) x cross join (values ('open', 0), ('rolling', 1), ('upcoming', 2)) g(status, position)
 left join hits on hits.status = g.status and hits.source = x.source group by x.source, g.status, g.position""")
def _(spark, folder):
    return s.group_counts_by(s.live(catalogue(spark, folder), AS_OF), "source")


@query("g06_amount_span", """select l_orderkey, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by l_orderkey""")
def _(spark, folder):
    from ..functions import money
    text = fill("Prices from £{l_extendedprice}")
    lines = table(spark, folder, "lineitem").withColumn(
        "l_extendedprice", F.col("l_extendedprice").cast("decimal(12,2)")).select("l_orderkey", money.largest_amount(text).alias("amount"))
    return lines.groupBy("l_orderkey").agg(F.min("amount").alias("low"), F.max("amount").alias("high"))


@query("g09_live_sources", f"select distinct source from catalogue where {LIVE}")
def _(spark, folder):
    return stats.live_sources(catalogue(spark, folder), AS_OF)


# --- windows, order, sets -------------------------------------------------------

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("h01_first_per_id", """select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey
 order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem) where n = 1""")
def _(spark, folder):
    return merge.first_per_key(table(spark, folder, "lineitem"), ["l_orderkey"], LINE_ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("h02_rank_order", """select id, row_number() over (order by case source when 'iuk_business_connect' then 0
 when 'horizon_europe' then 0 when 'innovate_uk' then 1 when 'Innovate UK' then 1 when 'ukri' then 1 when 'Konfer' then 2 else 99 end,
 title, id) as place from catalogue where closes_date is null or closes_date >= date '1998-06-01'""")
def _(spark, folder):
    # Dense places for the comparison: rows per range partition, then an offset each.
    from ..operators.dedupe import ranked_keys
    ranked = ranked_keys(catalogue(spark, folder), AS_OF).select("id", "rank")
    part = F.shiftright("rank", 33)
    sizes = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row per partition of the sort, a number the session sets, so one task can add them up.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return ranked.withColumn("part", part).join(F.broadcast(before), "part").select(
        "id", (F.col("offset") + F.col("rank").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


@query("i03_status_groups", f"""select id, status from catalogue where {LIVE} and status in ('open', 'rolling', 'upcoming')
 order by status, closes_date nulls last, title, id""")
def _(spark, folder):
    return s.search(catalogue(spark, folder), s.SearchForm(), AS_OF).select("id", "status")


@query("i04_facets", f"""select * from (select 'innovate_uk' as "value", 'Innovate UK' as label, 0 as position union select 'ukri', 'UKRI', 1
 union select 'horizon_europe', 'Horizon Europe', 2 union select 'konfer', 'Konfer', 3
 union select case when source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect') then 'innovate_uk' when source = 'Konfer' then 'konfer' else source end,
  case when source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect') then 'Innovate UK' when source = 'Konfer' then 'Konfer'
  when source = 'ukri' then 'UKRI' else 'Horizon Europe' end,
  case when source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect') then 0 when source = 'ukri' then 1 when source = 'horizon_europe' then 2 else 3 end
 from catalogue where {LIVE}) order by position, label""")
def _(spark, folder):
    return s.facets(catalogue(spark, folder), AS_OF)


@query("i04_facets_documents", """select distinct source as "value", upper(substr(source, 1, 1)) || substr(source, 2) as label, 99 as position
 from documents union select * from (values ('innovate_uk', 'Innovate UK', 0), ('ukri', 'UKRI', 1), ('horizon_europe', 'Horizon Europe', 2),
 ('konfer', 'Konfer', 3)) t""")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("source", F.lit("open").alias("status"), F.lit(None).cast("date").alias("closes_date"))
    return s.facets(docs, AS_OF)


@query("i05_enrichment_order", f"""select id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') as last_seen, title from catalogue where {UNENRICHED}
 order by last_seen desc, title, id""")
def _(spark, folder):
    return shown(enrich.in_enrichment_order(enrich.unenriched(catalogue(spark, folder))), "id", "last_seen", "title")


@query("i06_backfill_order", "select source, title, id from catalogue order by source, title, id")
def _(spark, folder):
    return enrich.in_backfill_order(catalogue(spark, folder)).select("source", "title", "id")


@query("i07_first_k", """select doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ') as words from documents""")
def _(spark, folder):
    from ..functions.text import first_n
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(first_n(F.split("text", " "), 8), " ").alias("words"))


@query("i08_union_of_sources", """select 'c:' || cast(c_custkey as string) as id, c_name as title, c_acctbal as funding_max, cast(null as string) as sector_tags from customer
 union all select 's:' || cast(s_suppkey as string), s_name, s_acctbal, null from supplier
 union all select 'p:' || cast(p_partkey as string), p_name, null, p_type from part""")
def _(spark, folder):
    def items(name, prefix, **columns):
        df = table(spark, folder, name)
        key = df.columns[0]
        return df.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"),
                         *[F.col(c).alias(a) for a, c in columns.items()])
    return merge.union_items([
        items("customer", "c", title="c_name", funding_max="c_acctbal"), items("supplier", "s", title="s_name", funding_max="s_acctbal"),
        items("part", "p", title="p_name", sector_tags="p_type")]).select("id", "title", "funding_max", "sector_tags")


@query("i09_stored_minus_seen", """select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def _(spark, folder):
    seen = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.stored_not_seen(table(spark, folder, "orders"), seen, ("o_orderkey",)).select("o_orderkey")


@query("i10_key_overlap", """select id, coalesce(list_has_any(string_split(sector_tags || ', ' || coalesce(niche_tags, ''), ', '), ['size 7', 'size 9', 'PROMO']), false) as shares from catalogue""")
def _(spark, folder):
    from ..operators.dedupe import shares_key
    keys = F.concat(F.split("sector_tags", ", "), F.coalesce(F.split("niche_tags", ", "), F.array().cast("array<string>")))
    return catalogue(spark, folder).select("id", shares_key(keys, ("size 7", "size 9", "PROMO")).alias("shares"))


# --- report columns -----------------------------------------------------------------

@query("m01_closing_soon", """select id, coalesce(status = 'open' and date_diff('day', date '1998-06-01', closes_date) between 0 and 14, false) as closing_soon from catalogue""")
def _(spark, folder):
    return s.cards(catalogue(spark, folder), AS_OF).select("id", "closing_soon")


@query("m02_clean_tags", """select id, case when source = 'horizon_europe' then sector_tags[1:strpos(sector_tags, ',') - 1] || '|' || split_part(sector_tags, ', ', 2)
 when niche_tags is null then replace(sector_tags, ', ', '|') else replace(sector_tags, ', ', '|') || '|' || niche_tags end as tags from catalogue""")
def _(spark, folder):
    tags = report.clean_tags(report.tag_list(F.col("sector_tags"), F.col("niche_tags")), DEFAULT_BOOK.label_of(F.col("source")))
    return shown(catalogue(spark, folder).select("id", tags.alias("tags")))


@query("m03_tag_list", """select id, array_to_string(list_transform(string_split(sector_tags || coalesce(',' || niche_tags, ''), ','),
 lambda t: trim(t)), '|') as tags from catalogue""")
def _(spark, folder):
    return shown(catalogue(spark, folder).select("id", report.tag_list(F.col("sector_tags"), F.col("niche_tags")).alias("tags")))


STOP = ", ".join(f"'{w}'" for w in fv.WORD_CHIP_STOP)


@query("m04_word_chips", f"""with words as (select doc_id, lang, unnest(w) as w, generate_subscripts(w, 1) as i from (select doc_id, lang,
  string_split(trim(regexp_replace(regexp_replace(lower(lang || ' ' || text), '[,.:()/&-]', ' ', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g')), ' ') as w from documents)),
 firsts as (select doc_id, w, min(i) as i from words where length(w) >= 4 and w not in ({STOP}) group by doc_id, w),
 picked as (select *, row_number() over (partition by doc_id order by i) as n from firsts)
 select d.doc_id, coalesce(string_agg(replace(upper(substr(w, 1, 1)), 'ẞ', 'SS') || substr(w, 2), '|' order by n), '') as chips from documents d
 left join picked p on p.doc_id = d.doc_id and n <= 4 group by d.doc_id""")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return shown(docs.select("doc_id", report.word_chips(F.col("lang"), F.col("text")).alias("chips")))


def _money_sql(x):
    return f"format('{{:,}}', cast(trunc({x}) as bigint))"


@query("m05_funding_text", f"""select id, case when funding_currency is not null then coalesce(funding_currency || ' ' || {_money_sql('funding_min_native')}, 'Not listed')
  || ' - ' || funding_currency || ' ' || {_money_sql('funding_max_native')}
 else coalesce('GBP ' || {_money_sql('funding_min')}, 'Not listed') || ' - GBP ' || {_money_sql('funding_max')} end as funding_text,
 case when funding_currency = 'EUR' then 'approx GBP ' || coalesce({_money_sql('funding_min')}, 'not listed') || ' - GBP ' || {_money_sql('funding_max')} end as converted_text
 from catalogue""")
def _(spark, folder):
    return s.cards(catalogue(spark, folder), AS_OF).select("id", "funding_text", "converted_text")


@query("m06_source_label", """select id, case when source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect') then 'Innovate UK'
 when source = 'ukri' then 'UKRI' when source = 'horizon_europe' then 'Horizon Europe' else 'Konfer' end as source_label from catalogue""")
def _(spark, folder):
    return s.cards(catalogue(spark, folder), AS_OF).select("id", "source_label")


@query("m07_detail_view", """select id, title, description, url, case when id like 'horizon:%' then split_part(niche_tags, ',', 1) else '' end as reference
 from catalogue where id like '%:3'""")
def _(spark, folder):
    df = s.cards(catalogue(spark, folder), AS_OF)
    found = [s.by_id(df, f"{prefix}:3") for prefix in ("ifs", "iukbc", "horizon", "ukri", "konfer")]
    return merge.union_items(found).select("id", "title", "description", "url", "reference")
