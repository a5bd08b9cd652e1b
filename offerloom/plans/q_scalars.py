"""Text, date, money and link functions over texts made from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import dates, money, report, text as tx, urls
from ..model import DEFAULT_BOOK
from ..operators import ledger
from ..operators.dedupe import canonical_keys
from .registry import query
from .sample import AS_OF, catalogue, fill, long_day, shown, spread_table, table

BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SQUASHED = f"trim(regexp_replace(text, '{BLANKS}', ' ', 'g'))"


def day():
    return F.lit(AS_OF).cast("date")


def documents(spark, folder):
    return spread_table(spark, folder, "documents")


@query("c01_squash", f"select doc_id, md5({SQUASHED}) as digest, cast(length({SQUASHED}) as integer) as n from documents")
def _(spark, folder):
    df = documents(spark, folder).withColumn("t", tx.squash(F.col("text")))
    return df.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query("c02_unescape", r"""select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(html, '&copy;', '©'),
 '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g'))) as digest from pages""")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(tx.squash_unescaped(F.col("html"))).alias("digest"))


@query("c02_strip_markup", """select p_partkey, p_name || ' & ' || p_type || ' for £' || cast(p_size as string) || 'k é' as plain from part""")
def _(spark, folder):
    markup = fill("<p class='x'>{p_name} &amp; <b>{p_type}</b></p><!-- {p_brand} --><script>var a='<p>';</script>\n for &pound;{p_size}k &#233;")
    return table(spark, folder, "part").select("p_partkey", tx.squash_markup(markup).alias("plain"))


@query("c03_squash_lines", """select doc_id, md5(coalesce(string_agg(line, chr(10) order by i), '')) as digest from (select doc_id, i, trim(regexp_replace(l, '[\\s\\x{A0}]+', ' ', 'g')) as line
 from (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as i from (select doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r]') as ls from documents)))
 where line <> '' group by doc_id""")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", F.md5(tx.squash_lines(F.col("text"))).alias("digest"))


@query("c04_words_key", """select doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as digest from documents""")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", F.md5(tx.words_key(F.col("text"))).alias("digest"))


@query("c05_phrase_key", """select page_id, md5(trim(regexp_replace(lower(replace(html, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))) as digest from pages""")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(tx.phrase_key(F.col("html"))).alias("digest"))


@query("c06_has_phrase", """select doc_id, k like '%of the%' or k like '%for and%' as part, ' ' || k || ' ' like '% of the %' as whole from
 (select doc_id, trim(regexp_replace(lower(replace(text, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')) as k from documents)""")
def _(spark, folder):
    df = documents(spark, folder).withColumn("k", tx.padded_key(F.col("text")))
    return df.select("doc_id", tx.has_phrase(F.col("k"), ["Of The", "for & "]).alias("part"),
                     tx.has_words(F.col("k"), ["of the"]).alias("whole"))


# --- dates ----------------------------------------------------------------------

@query("c07_long_date", """select o_orderkey, case when o_orderstatus <> 'P' then cast(o_orderdate as date) end as day from orders""")
def _(spark, folder):
    shown_text = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), long_day(F.col("o_orderdate")))).when(
        F.col("o_orderstatus") == "F", F.upper(F.date_format("o_orderdate", "dd MMMM yyyy"))).otherwise(
        F.concat(F.lit("31 February "), F.date_format("o_orderdate", "yyyy")))
    return table(spark, folder, "orders").select("o_orderkey", dates.long_date(shown_text).alias("day"))


@query("c08_slash_date", """select o_orderkey, case when o_orderstatus <> 'P' then cast(o_orderdate as date) end as day from orders""")
def _(spark, folder):
    written = F.concat(F.lit("Opens:  "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" then 01/01/2030"))
    return table(spark, folder, "orders").select(
        "o_orderkey", dates.slash_date(F.when(F.col("o_orderstatus") == "P", "99/99/1998").otherwise(written)).alias("day"))


@query("c09_loose_date", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber < 7 then cast(l_shipdate as date) end as day from lineitem""")
def _(spark, folder):
    d = F.col("l_shipdate")
    n = F.col("l_linenumber")
    number = F.date_format(d, "d")
    ending = F.when(number.isin("1", "21", "31"), "st").when(number.isin("2", "22"), "nd").when(number.isin("3", "23"), "rd").otherwise("th")
    text = (F.when(n == 1, F.concat(F.date_format(d, "MMM "), number, ending, F.date_format(d, " yyyy")))
            .when(n == 2, F.date_format(d, "MMMM d yyyy")).when(n == 3, F.concat(number, ending, F.date_format(d, "  MMMM yyyy")))
            .when(n == 4, F.date_format(d, "yyyy-MM-dd")).when(n == 5, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T23:30:00Z")))
            .when(n == 6, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:10:00.5+05:00"))).otherwise("soon"))
    return spread_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.loose_date(text).alias("day"))


@query("c10_cell_date", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber <= 4 then cast(l_shipdate as date) end as day from lineitem""")
def _(spark, folder):
    d, n = F.col("l_shipdate"), F.col("l_linenumber")
    stamp = F.when(n == 1, F.date_format(d, "yyyy-MM-dd'T'09:00:00")).when(n == 2, F.date_format(d, "yyyy-MM-dd")).when(n == 3, "")
    text = (F.when(n <= 2, "5 May 1990").when(n <= 4, F.concat(F.lit("By "), long_day(d), F.lit(" at noon")))
            .when(n == 5, F.concat(F.lit("To be  Confirmed, not "), long_day(d))).when(n == 6, "31 June 1998").otherwise("No closing date"))
    return spread_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.cell_date(stamp, text).alias("day"))


@query("c11_api_date", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber <= 4 then cast(l_shipdate as date) end as day from lineitem""")
def _(spark, folder):
    d, n = F.col("l_shipdate"), F.col("l_linenumber")
    base = F.date_format(d, "yyyy-MM-dd")
    text = (F.when(n == 1, F.concat(base, F.lit("T00:00:00.000+0000"))).when(n == 2, F.concat(base, F.lit("T23:59:59.999-11:00")))
            .when(n == 3, F.concat(base, F.lit("T12:00:00.5Z"))).when(n == 4, base)
            .when(n == 5, F.concat(base, F.lit("T25:00:00.000+0000"))).when(n == 6, F.concat(base, F.lit("T00:00:00"))).otherwise("1998-02-30"))
    return spread_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.api_date(text).alias("day"))


# --- money ----------------------------------------------------------------------

THOUSANDS = "case when p_size >= 10 then cast(p_size as string) || ',500' else cast(p_size as string) || '.5' end"
SCALED = "(case when p_size >= 10 then p_size * 1000.0 + 500 else p_size + 0.5 end)"


def awards(spark, folder):
    amount = F.when(F.col("p_size") >= 10, fill("{p_size},500")).otherwise(fill("{p_size}.5"))
    suffix = F.when(F.col("p_type") == "ECONOMY", " million").when(F.col("p_type") == "SMALL", "m").when(
        F.col("p_type") == "LARGE", "K").when(F.col("p_type") == "PROMO", " thousand").otherwise(" in all")
    return table(spark, folder, "part").withColumn("award", fill(
        "Share of up to £{amount}{suffix}, at least GBP {p_partkey} and £7", amount=amount, suffix=suffix))


TIMES = "case p_type when 'ECONOMY' then 1000000.0 when 'SMALL' then 1000000.0 when 'LARGE' then 1000.0"


@query("c12_first_amount", f"select p_partkey, cast({SCALED} * {TIMES} else 1.0 end as double) as amount from part")
def _(spark, folder):
    return awards(spark, folder).select("p_partkey", money.first_amount(F.col("award")).alias("amount"))


@query("c13_all_amounts", f"""select p_partkey, 3 as n, cast(p_partkey as double) as second,
 greatest(cast({SCALED} * {TIMES} else 1.0 end as double), cast(p_partkey as double), 7.0) as largest from part""")
def _(spark, folder):
    df = awards(spark, folder).withColumn("a", money.all_amounts(F.col("award")))
    return df.select("p_partkey", F.size("a").alias("n"), F.get("a", F.lit(1)).alias("second"), money.largest_amount(F.col("award")).alias("largest"))


@query("c14_pound_range", f"""select p_partkey, least(a, 7.0) as low, greatest(a, 7.0) as high, a as first_one from
 (select p_partkey, cast({SCALED} * {TIMES} when 'PROMO' then 1000.0 else 1.0 end as double) as a from part)""")
def _(spark, folder):
    low, high = money.pound_range(F.col("award"))
    return awards(spark, folder).select(
        "p_partkey", low.alias("low"), high.alias("high"), money.pound_amount(F.col("award")).alias("first_one"))


@query("c28_convert", """select c_custkey, case when c_nationkey > 0 and c_mktsegment <> 'MACHINERY' then c_acctbal * (c_nationkey / 10.0) end as converted from customer""")
def _(spark, folder):
    rate = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey") / F.lit(10.0))
    return table(spark, folder, "customer").select("c_custkey", money.convert(F.col("c_acctbal"), rate).alias("converted"))


# --- links ----------------------------------------------------------------------

PAGE_KEY = "lower(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', ''))"


@query("c15_link_key", f"select page_id, {PAGE_KEY} as key from pages")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.link_key(F.concat(F.lit("  "), F.col("url"))).alias("key"))


@query("c16_resolve", """select page_id, 'https://other.example.org/x' as absolute, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/a/b?q=1' as rooted,
 split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4) || '/next' as beside,
 split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/up' as above, split_part(url, '/', 1) || '//cdn.example.org/y' as same_scheme,
 regexp_replace(url, '[?#].*$', '') || '?p=2' as query_only from (select page_id, regexp_replace(url, '/$', '') as url from pages)""")
def _(spark, folder):
    base = F.regexp_replace("url", "/$", "")
    links = {"absolute": "https://other.example.org/x", "rooted": "/a/b?q=1", "beside": "next", "above": "../up",
             "same_scheme": "//cdn.example.org/y", "query_only": "?p=2"}
    return table(spark, folder, "pages").select("page_id", *[urls.resolve(base, F.lit(v)).alias(k) for k, v in links.items()])


@query("c17_competition_of", """select p_partkey, case when p_size < 25 then cast(p_partkey as string) end as number from part""")
def _(spark, folder):
    link = F.when(F.col("p_size") < 25, fill("https://x.org/competition/{p_partkey}/overview")).otherwise(fill("https://x.org/competition/{p_partkey}"))
    return table(spark, folder, "part").select("p_partkey", urls.competition_of(link).alias("number"))


@query("c18_competition_in_path", """select p_partkey, case when p_size < 40 then cast(p_partkey as string) end as number from part""")
def _(spark, folder):
    link = F.when(F.col("p_size") < 25, fill("/competition/{p_partkey}/overview")).when(
        F.col("p_size") < 40, fill("https://x.org/competition/{p_partkey}")).otherwise(fill("/my-competition/{p_partkey}/"))
    return table(spark, folder, "part").select("p_partkey", urls.competition_in_path(link).alias("number"))


@query("c19_offer_slug", """select p_partkey, case when p_size < 40 then lower(replace(p_name, ' ', '-')) || '-' || cast(p_partkey as string) end as slug from part""")
def _(spark, folder):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    link = F.when(F.col("p_size") < 40, fill("https://x.org/Opportunities/opportunities/{n}-{p_partkey}/?x=/opportunities/y", n=F.initcap(name))).otherwise(
        fill("https://x.org/opportunities/a/{p_partkey}"))
    return table(spark, folder, "part").select("p_partkey", urls.offer_slug(link).alias("slug"))


@query("c20_id_from_link", """select page_id, 'page:' || regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$') as id,
 'page:' || split_part(url, '/', 3) as host_id from pages""")
def _(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", urls.id_from_link(F.col("url"), "page").alias("id"),
        urls.id_from_link(F.regexp_extract("url", "^https?://[^/]+", 0), "page").alias("host_id"))


@query("c21_competition_link", """select id, case when id like 'ifs:%' then split_part(id, ':', 2) end as number,
 case when id like 'ifs:%' then 'https://apply-for-innovation-funding.service.gov.uk/competition/' || split_part(id, ':', 2) || '/overview' end as link from catalogue""")
def _(spark, folder):
    return catalogue(spark, folder).select(
        "id", urls.competition_number(F.col("id")).alias("number"), urls.competition_link(F.col("id")).alias("link"))


@query("c22_partner_hosts", """select id, id like 'iukbc:%' as partner, description like '%/programme/%' as generic from catalogue""")
def _(spark, folder):
    first = F.coalesce(F.nullif(F.regexp_extract("description", r"https?://[^\s)]+", 0), F.lit("")), F.lit(""))
    return catalogue(spark, folder).select(
        "id", urls.is_partner_link(F.col("url")).alias("partner"), urls.is_generic_partner_link(first).alias("generic"))


@query("c23_portal_link", """select p_partkey, 'https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/' ||
 case when p_size < 10 or p_type = 'PROMO' then 'calls-for-proposals?order=DESC&pageNumber=1&pageSize=50&sortBy=relevance&keywords=' || replace(replace(replace(p_brand, '#', '%23'), ' ', '+'), '*', '%2A') || '+' ||
  cast(p_partkey as string) || '&isExactMatch=true&status=31094501%2C31094502&programmePeriod=2021+-+2027&frameworkProgramme=43108390&type=8'
 else 'topic-details/' || p_brand || ' ' || cast(p_partkey as string) end as link from part""")
def _(spark, folder):
    kind = F.when(F.col("p_size") < 10, "8").otherwise("1")
    page = F.when(F.col("p_type") == "PROMO", "https://x.org/competitive-calls-cs/9")
    return table(spark, folder, "part").select("p_partkey", urls.portal_link(fill("{p_brand} {p_partkey}"), kind, page).alias("link"))


# --- rules on dates, names, formats -------------------------------------------------

@query("c24_status", """select id, case when opened_date > date '1998-06-01' then 'upcoming' when closes_date < date '1998-06-01' then 'expired'
 when closes_date is null then 'rolling' else 'open' end as full_status, case when opened_date > date '1998-06-01' then 'upcoming' when closes_date < date '1998-06-01' then 'expired'
 else 'open' end as no_rolling, case when opened_date > date '1998-06-01' then 'upcoming' when closes_date is null then 'rolling' else 'open' end as no_expired from catalogue""")
def _(spark, folder):
    o, c = F.col("opened_date"), F.col("closes_date")
    return catalogue(spark, folder).select(
        "id", dates.status_on(o, c, day()).alias("full_status"), dates.status_on(o, c, day(), rolling=False).alias("no_rolling"),
        dates.status_on(o, c, day(), expired=False).alias("no_expired"))


@query("c25_deadlines", """select p_partkey, coalesce(min(d) filter (where d >= date '1998-06-01'), max(d)) as current_day, count(distinct d) as n from (select p_partkey, unnest([date '1998-01-01' + p_size * 5, date '1998-06-20' - p_size,
 date '1998-01-01' + p_size * 5, case when p_size < 25 then date '1997-01-01' end]) as d from part) group by p_partkey""")
def _(spark, folder):
    stamp = lambda d: F.concat(F.date_format(F.expr(d), "yyyy-MM-dd"), F.lit("T17:00:00.000+0000"))
    stamps = F.array(stamp("date '1998-01-01' + p_size * 5"), stamp("date '1998-06-20' - p_size"), stamp("date '1998-01-01' + p_size * 5"),
                     F.when(F.col("p_size") < 25, "1997-01-01").otherwise("unknown"))
    df = table(spark, folder, "part").withColumn("days", dates.deadlines(stamps))
    return df.select("p_partkey", dates.current_deadline(F.col("days"), day()).alias("current_day"), F.size("days").cast("bigint").alias("n"))


@query("c26_join_filled", """select id, concat_ws(' / ', nullif(summary, ''), niche_tags, nullif(case when funding_min is null then '' else 'x' end, '')) as joined from catalogue""")
def _(spark, folder):
    return catalogue(spark, folder).select("id", tx.join_filled(
        " / ", F.col("summary"), F.col("niche_tags"), F.when(F.col("funding_min").isNull(), "").otherwise("x")).alias("joined"))


@query("c27_first_chars", "select doc_id, substr(text, 1, 320) as start from documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", tx.head(F.col("text"), fv.SUMMARY_CHARS).alias("start"))


@query("c29_lenient_values", """select event_id, case when event_type <> 'error' then cast(ts as date) end as day,
 case when event_type in ('view', 'click') then "value" end as number from events""")
def _(spark, folder):
    kind = F.col("event_type")
    day = F.when(kind == "error", "2024-02-31").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    number = F.when(kind == "view", F.col("value").cast("string")).when(kind == "click", F.concat(F.lit(" "), F.col("value").cast("string"))).when(
        kind == "signup", "nan").when(kind == "purchase", "inf").otherwise("1_000")
    return table(spark, folder, "events").select("event_id", dates.lenient_day(day).alias("day"), dates.lenient_number(number).alias("number"))


@query("c30_source_names", """select doc_id, source as key, upper(substr(source, 1, 1)) || substr(source, 2) || ' Of ' || upper(substr(lang, 1, 1)) || substr(lang, 2) as label from documents""")
def _(spark, folder):
    return documents(spark, folder).select(
        "doc_id", DEFAULT_BOOK.key_of(fill(" {source} ")).alias("key"), DEFAULT_BOOK.label_of(fill("{source}_of_{lang}")).alias("label"))


@query("c30_source_keys", """select id, case when source in ('innovate_uk', 'Innovate UK', 'iuk_business_connect') then 'innovate_uk' when source = 'Konfer' then 'konfer' else source end as key,
 case when source in ('iuk_business_connect', 'horizon_europe') then 0 when source = 'Konfer' then 2 else 1 end as priority from catalogue""")
def _(spark, folder):
    return catalogue(spark, folder).select(
        "id", DEFAULT_BOOK.key_of(F.col("source")).alias("key"), DEFAULT_BOOK.priority_of(F.col("source")).alias("priority"))


@query("c31_eu_reference", """select id, case when source = 'horizon_europe' then case when funding_min is null then upper(split_part(id, ':', 2)) else split_part(niche_tags, ',', 1) end else '' end as reference from catalogue""")
def _(spark, folder):
    tags = F.when(F.col("funding_min").isNotNull(), F.col("niche_tags"))
    return catalogue(spark, folder).select(
        "id", report.eu_reference(F.col("source"), F.col("id"), F.col("sector_tags"), tags, F.col("description")).alias("reference"))


@query("c32_shown_dates", """select event_id, case when event_type = 'error' then 'Not yet updated' else strftime(ts, '%-d %B %Y, %H:%M') || ' UTC' end as stamp,
 case when event_type = 'error' then 'TBD' else strftime(ts, '%d/%m/%Y') end as day from events""")
def _(spark, folder):
    ts = F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select("event_id", dates.shown_stamp(ts).alias("stamp"), dates.shown_date(ts.cast("date")).alias("day"))


@query("c33_lenient_json", """select event_id, case when event_type in ('view', 'click') then cast(json_extract_string(props, '$.k') as bigint) end as k,
 case when event_type <> 'signup' then strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') end as stamp from events""")
def _(spark, folder):
    kind = F.col("event_type")
    raw = F.when(kind.isin("view", "click"), F.col("props")).when(kind == "error", "{broken").when(kind == "signup", "[1, 2]").otherwise("7")
    text = F.when(kind == "signup", "yesterday").when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = table(spark, folder, "events").select(
        "event_id", ledger.read_state(raw, "k bigint")["k"].alias("k"), dates.lenient_stamp(text).alias("stamp"))
    return shown(df)


@query("j06_canonical_keys", r"""select id, array_to_string(list_sort(list_distinct(list_filter(list_concat([
 case when id like 'ifs:%' then 'url:apply-for-innovation-funding.service.gov.uk/competition/' || regexp_extract(url, 'competition/([^/]+)/', 1) || '/overview' end,
 case when id like 'ifs:%' then 'ifs:' || regexp_extract(url, 'competition/([^/]+)/', 1) end,
 case when id like 'iukbc:%' then 'url:iuk-business-connect.org.uk/opportunities/' || regexp_extract(url, 'opportunities/([^/]+)/', 1) end,
 case when id like 'iukbc:%' then 'iukbc:' || regexp_extract(url, 'opportunities/([^/]+)/', 1) end,
 case when url like '%Offers%' then 'url:' || lower(regexp_extract(url, 'https://(Offers.*)/\?', 1)) end,
 case when description like 'Round page%' then 'url:iuk-business-connect.org.uk/opportunities/' || regexp_extract(description, 'opportunities/([^/]+)/', 1) end,
 case when description like 'Round page%' then 'iukbc:' || regexp_extract(description, 'opportunities/([^/]+)/', 1) end],
 [case when closes_date is not null then 'title-close:' || lower(title) || ':' || strftime(closes_date, '%Y-%m-%d') end]), lambda k: k is not null))), ' ') as keys from catalogue""")
def _(spark, folder):
    keys = canonical_keys(F.col("url"), F.col("description"), F.col("title"), F.col("closes_date"))
    return catalogue(spark, folder).select("id", F.array_join(F.array_sort(keys), " ").alias("keys"))
