"""Landed sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..model import CATALOGUE
from ..operators import enrich, merge
from ..session import cut_lineage, fresh_path
from ..sources import buckets, landed, snapshots
from .registry import query
from .sample import catalogue, fill, shown, table

ALL_COLUMNS = ", ".join(
    "strftime(last_seen, '%Y-%m-%d %H:%M:%S') as last_seen" if f.name == "last_seen" else f.name for f in CATALOGUE.fields)


@query("a01_scan_catalogue", f"select {ALL_COLUMNS} from catalogue")
def _(spark, folder):
    path = fresh_path(spark, "offers")
    catalogue(spark, folder).write.parquet(path)
    return shown(landed.read_catalogue(spark, path))


@query("a02_metadata_key", """select 'event:' || cast(event_id as string) as key, props as "value" from events where event_id = 17""")
def _(spark, folder):
    from ..operators.ledger import metadata_value
    metadata = table(spark, folder, "events").select(fill("event:{event_id}").alias("key"), F.col("props").alias("value"))
    return metadata_value(metadata, "event:17")


@query("a03_listing_pages", "select url, md5(html) as digest from pages")
def _(spark, folder):
    return landed.read_pages(spark, f"{folder}/pages.parquet").select("url", F.md5("html").alias("digest"))


@query("a04_detail_pages", """select doc_id, url, md5(html) as digest from documents left join pages on page_id = doc_id""")
def _(spark, folder):
    pages = landed.read_pages(spark, f"{folder}/pages.parquet").select("url", "html")
    links = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url")
    listing = table(spark, folder, "documents").select("doc_id").join(links, "doc_id", "left")
    return enrich.join_detail(listing, pages, "url").select("doc_id", "url", F.md5("detail_html").alias("digest"))


RESULT = T.StructType([T.StructField("identifier", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("status", T.StringType())])


@query("a05_search_results", """select cast(page_no as integer) as page_no, cast(total as bigint) as total, slot, identifier, amount, status from (select year(o_orderdate) as page_no, 2 as total,
 unnest([0, 1]) as slot, unnest(['A' || cast(o_orderkey as string), 'B' || cast(o_custkey as string)]) as identifier,
 unnest([o_totalprice, cast(null as double)]) as amount, unnest([o_orderstatus, 'X']) as status from orders where o_orderstatus <> 'P')""")
def _(spark, folder):
    hit = lambda name, amount, status: F.struct(name.alias("identifier"), amount.alias("amount"), status.alias("status"))
    hits = F.array(hit(fill("A{o_orderkey}"), F.col("o_totalprice"), F.col("o_orderstatus")),
                   hit(fill("B{o_custkey}"), F.lit(None).cast("double"), F.lit("X")))
    answers = table(spark, folder, "orders").select(F.to_json(F.struct(
        F.year("o_orderdate").alias("page_no"), F.lit(2).alias("total"),
        F.when(F.col("o_orderstatus") != "P", hits).otherwise(F.slice(hits, 1, 0)).alias("results"))))
    path = fresh_path(spark, "answers")
    answers.write.text(path)
    return landed.read_results(spark, path, RESULT, multi_line=False)


@query("a06_best_hits", """select identifier, found, slot from (select *, row_number() over (partition by identifier order by case when found = identifier then 0 else 1 end, slot, l_partkey, l_suppkey, l_extendedprice) as n
 from (select 'O' || cast(l_orderkey as string) || '-' || l_returnflag as identifier, 'O' || cast(l_orderkey as string) || '-' || l_linestatus || l_returnflag as f0,
 case when l_linestatus = 'O' then 'O' || cast(l_orderkey as string) || '-' || l_returnflag else 'other' end as found, l_linenumber as slot, l_partkey, l_suppkey, l_extendedprice from lineitem)) where n = 1""")
def _(spark, folder):
    asked = fill("O{l_orderkey}-{l_returnflag}")
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    hits = table(spark, folder, "lineitem").select(
        asked.alias("identifier"), F.when(F.col("l_linestatus") == "O", asked).otherwise("other").alias("found"), place.alias("slot"))
    return landed.best_hits(hits).select("identifier", "found", F.col("slot.l_linenumber").alias("slot"))


@query("a07_source_predicate", """select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus in ('O', 'P')
 and year(o_orderdate) >= 1998 and o_totalprice >= 200000""")
def _(spark, folder):
    records = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status"),
        F.when(F.year("o_orderdate") >= 1998, "1998 - 2004").otherwise("1991 - 1997").alias("programmePeriod"),
        F.when(F.col("o_totalprice") >= 200000, "big").otherwise("small").alias("frameworkProgramme"))
    return landed.wanted_records(records, ("1-URGENT", "2-HIGH"), ("O", "P"), "1998 - 2004", "big").select("o_orderkey")


@query("a08_rate_feed", """select p_partkey, case when p_size <> 7 then round(p_retailprice / 1000, 4) end as rate, date '1998-01-01' + p_size as rate_date from part""")
def _(spark, folder):
    rate = F.round(F.col("p_retailprice") / 1000, 4)
    feed = table(spark, folder, "part").withColumn("xml", fill(
        "<?xml version='1.0'?><gesmes:Envelope xmlns:gesmes='http://x.org/g' xmlns='http://x.org/e'><gesmes:subject>Rates</gesmes:subject>"
        "<Cube><Cube time='{day}'><Cube currency='USD' rate='1.1'/><Cube currency='{unit}' rate='{rate}'/><Cube currency='JPY' rate='9'/>"
        "</Cube></Cube></gesmes:Envelope>", day=F.expr("date '1998-01-01' + p_size"), rate=rate,
        unit=F.when(F.col("p_size") == 7, "CHF").otherwise("GBP")))
    plain = landed.rate_columns(F.col("xml"))
    return feed.select("p_partkey", *plain)


@query("a09_crawled_pages", """with capped as (select *, case when l_quantity <= 5 then 0 else l_quantity end as size from lineitem),
 stops as (select l_orderkey, min(case when size = 0 then l_linenumber end) as empty, min(case when size < 12 then l_linenumber end) as short from capped group by l_orderkey)
 select l_orderkey, l_linenumber, l_partkey, l_quantity from capped join stops using (l_orderkey)
 where (empty is null or l_linenumber < empty) and (short is null or l_linenumber <= short)""")
def _(spark, folder):
    size = F.when(F.col("l_quantity") <= 5, 0).otherwise(F.col("l_quantity"))
    return landed.crawled_pages(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", size, page_size=12).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("a09_until_complete", """with firsts as (select l_orderkey, l_returnflag, min(l_linenumber) as l_linenumber from lineitem group by all),
 stops as (select l_orderkey, min(page) as stop from (select l_orderkey, page, (select count(*) from firsts f where f.l_orderkey = p.l_orderkey and f.l_linenumber < page) as seen,
   (select max(l_linenumber) from lineitem l where l.l_orderkey = p.l_orderkey and l.l_linenumber < page) as previous
   from (select distinct l_orderkey, l_linenumber as page from lineitem) p) where seen >= 2 and previous is not null group by l_orderkey)
 select l_orderkey, l_linenumber, l_partkey from lineitem left join stops using (l_orderkey) where stop is null or l_linenumber < stop""")
def _(spark, folder):
    records = table(spark, folder, "lineitem").withColumn("total", F.lit(2))
    return landed.until_complete(records, "l_orderkey", "l_linenumber", "l_returnflag", "total").select("l_orderkey", "l_linenumber", "l_partkey")


@query("a10_snapshot_sink", f"select {ALL_COLUMNS} from catalogue where source <> 'ukri'")
def _(spark, folder):
    root = fresh_path(spark, "snapshots")
    snapshots.write_snapshot(catalogue(spark, folder), root)
    snapshots.write_snapshot(snapshots.read_snapshot(spark, root).where("source <> 'ukri'"), root)
    return shown(snapshots.read_snapshot(spark, root))


@query("a10_bucket_sink", f"""select {ALL_COLUMNS.replace('title,', "case when id like 'konfer:%' then 'New ' || title else title end as title,")} from catalogue where source <> 'ukri'
 union all select {ALL_COLUMNS.replace('id,', "id || '-b' as id,", 1)} from catalogue where source = 'ukri'""")
def _(spark, folder):
    """The whole catalogue, then rows replaced, rows added, rows taken out, each by the buckets it touches."""
    root, offers = fresh_path(spark, "buckets"), cut_lineage(catalogue(spark, folder), "offers")
    buckets.change(spark, root, offers, buckets.replaced)
    told = cut_lineage(offers.where("id like 'konfer:%'").withColumn("title", F.concat(F.lit("New "), F.col("title"))), "told")
    for _ in range(2):  # the second time is a repeated epoch
        buckets.change(spark, root, told, buckets.replaced, epoch=("crawl", 1))
    old = cut_lineage(offers.where("source = 'ukri'"), "old")
    buckets.change(spark, root, old.withColumn("id", F.concat("id", F.lit("-b"))), buckets.replaced)
    buckets.change(spark, root, old, buckets.without)
    return shown(buckets.read(spark, root))


@query("a11_metadata_sink", """select 'c:' || cast(c_custkey as string) as key, case when c_acctbal < 0 then '{"name":"' || c_name || '","nation":' || cast(c_nationkey as string) || '}' else c_name end as "value" from customer
 union all select 's:' || cast(s_suppkey as string), '{"name":"' || s_name || '","nation":' || cast(s_nationkey as string) || '}' from supplier""")
def _(spark, folder):
    customers = table(spark, folder, "customer")
    base = customers.select(fill("c:{c_custkey}").alias("key"), F.col("c_name").alias("value"))
    state = lambda p: F.to_json(F.struct(F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nation"))).alias("value")
    batch = customers.where("c_acctbal < 0").select(fill("c:{c_custkey}").alias("key"), state("c")).unionByName(
        table(spark, folder, "supplier").select(fill("s:{s_suppkey}").alias("key"), state("s")))
    root = fresh_path(spark, "ledger")
    snapshots.write_metadata(merge.upsert_metadata(base, batch), root)
    return snapshots.read_metadata(spark, root)
