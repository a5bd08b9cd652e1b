"""Landed pages, records and rates, as the crawlers left them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .. import fixed_values as fv
from ..functions.dates import api_date
from ..model import CATALOGUE
from ..operators.merge import first_per_key
from ..session import by_shuffle, cut_lineage, forget

PAGE = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

_RATE_DAY = T.StructType([
    T.StructField("_time", T.StringType()),
    T.StructField("Cube", T.ArrayType(T.StructType([
        T.StructField("_currency", T.StringType()), T.StructField("_rate", T.DoubleType())]))),
])
RATE_FEED = T.StructType([T.StructField("Cube", T.StructType([T.StructField("Cube", T.ArrayType(_RATE_DAY))]))])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE).parquet(path)


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Landed HTML: a table with url and html, or a folder of one file per page."""
    if form == "text":
        return spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"),
            F.col("_metadata.file_modification_time").alias("fetched_at"))
    return spark.read.schema(PAGE).format(form).load(path)


def read_results(spark: SparkSession, path: str, record: T.StructType, multi_line: bool = True) -> DataFrame:
    """Landed search answers, one row per result, with page number and place."""
    schema = T.StructType([
        T.StructField("page_no", T.IntegerType()), T.StructField("total", T.LongType()),
        T.StructField("results", T.ArrayType(record))])
    pages = spark.read.schema(schema).json(path, multiLine=multi_line)
    return explode_results(pages)


def explode_results(pages: DataFrame) -> DataFrame:
    """One row per result; a page without results gives none."""
    kept = [c for c in pages.columns if c != "results"]
    rows = pages.select(*kept, F.posexplode("results").alias("slot", "record"))
    return rows.select(*kept, "slot", "record.*")


def read_rate(spark: SparkSession, path: str) -> DataFrame:
    """Rate feed in XML files: (rate, rate_date) of the first day that lists the pound."""
    return rate_from_xml(spark.read.text(path, wholetext=True).select(F.col("value").alias("xml")))


def rate_columns(xml: Column, currency: str = "GBP") -> tuple[Column, Column]:
    """First rate of ``currency`` in a feed and the day it stands under; the last day if none."""
    # Namespaces only get in the way of the element names.
    plain = F.regexp_replace(xml, r"(</?)[A-Za-z]+:", "$1")
    days = F.from_xml(plain, RATE_FEED.simpleString())["Cube"]["Cube"]
    hit = F.get(F.filter(days, lambda d: F.exists(d["Cube"], lambda c: c["_currency"] == currency)), F.lit(0))
    rate = F.get(F.filter(hit["Cube"], lambda c: c["_currency"] == currency), F.lit(0))["_rate"]
    return rate.alias("rate"), api_date(F.coalesce(hit["_time"], F.try_element_at(days, F.lit(-1))["_time"])).alias("rate_date")


def rate_from_xml(feed: DataFrame, currency: str = "GBP") -> DataFrame:
    return feed.select(*rate_columns(F.col("xml"), currency))


def wanted_records(records: DataFrame, types=fv.PORTAL_RECORD_TYPES, statuses=fv.PORTAL_STATUSES,
                   period: str = fv.PORTAL_PERIOD, programme: str = fv.PORTAL_PROGRAMME) -> DataFrame:
    """The search's own conditions, for a landed dump that holds more than was asked."""
    return records.where(
        F.col("type").isin(*types) & F.col("status").isin(*statuses)
        & (F.col("programmePeriod") == period) & (F.col("frameworkProgramme") == programme))


def best_hits(hits: DataFrame, key: str = "identifier", found: str = "found", slot: str = "slot") -> DataFrame:
    """One search hit per asked identifier: the exact one, else the first."""
    exact = F.coalesce(F.col(found) == F.col(key), F.lit(False))
    return first_per_key(hits.withColumn("_exact", exact), [key], [F.col("_exact").desc(), F.col(slot)]).drop("_exact")


def _capped(pages: DataFrame, page_no: str, max_pages: int | None) -> DataFrame:
    return pages if max_pages is None else pages.where(F.col(page_no) <= max_pages)


def crawled_pages(pages: DataFrame, crawl: str, page_no: str, size: Column, max_pages: int | None = None,
                  page_size: int | None = None) -> DataFrame:
    """Pages a crawl would have read: before its first empty page, up to its first short
    page when there is a page size, and up to a cap if one is given.

    The first stop is found by grouping, with map-side combine, not by gathering a
    crawl in one task.
    """
    sized = _capped(pages, page_no, max_pages).withColumn("_size", size)
    stops = sized.groupBy(crawl).agg(
        F.min(F.when(F.col("_size") == 0, F.col(page_no))).alias("_empty"),
        F.min(F.when(F.col("_size") < (page_size or 0), F.col(page_no))).alias("_short"))
    inside = (
        (F.col("_empty").isNull() | (F.col(page_no) < F.col("_empty")))
        & (F.col("_short").isNull() | (F.col(page_no) <= F.col("_short"))))
    return sized.join(stops, crawl).where(inside).drop("_size", "_empty", "_short")


def by_next_link(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Pages that crawls reach by next links: ``crawl``, ``url`` and ``page_no`` from 1; a page seen before ends a crawl.

    ``links`` has url and next_url (a repeated url counts with its least link), ``starts``
    crawl and url.  Pointers are doubled: a round knows the first 2^k pages of each crawl
    and the page 2^k links on from any page, so rounds go by the logarithm of the longest
    crawl.  A crawl that comes back to a page of its own finds no new page, so any cycle
    ends.  A linked page that has not landed is not there; a null link ends the crawl.
    """
    one = links.groupBy("url").agg(F.min("next_url").alias("next_url"))
    known = one.select(F.col("url").alias("next_url"))
    jumps = cut_lineage(one.where(F.col("next_url").isNotNull()).join(by_shuffle(known), "next_url", "left_semi").select("url", "next_url"), "links")
    first = starts.select("crawl", "url").distinct().join(by_shuffle(one.select("url")), "url", "left_semi")
    reached, step, count = cut_lineage(first.select("crawl", "url", F.lit(1).cast("bigint").alias("page_no")), "reached"), 1, -1
    while True:
        before, count = count, reached.count()
        if count == before:
            forget(jumps)
            return reached
        further = reached.join(by_shuffle(jumps), "url").select("crawl", F.col("next_url").alias("url"), (F.col("page_no") + step).alias("page_no"))
        wider = cut_lineage(reached.union(further).groupBy("crawl", "url").agg(F.min("page_no").alias("page_no")), "reached")
        onward = jumps.withColumnsRenamed({"url": "middle", "next_url": "last"})
        twice = cut_lineage(jumps.join(by_shuffle(onward), F.col("next_url") == F.col("middle")).select("url", F.col("last").alias("next_url")), "links")
        forget(reached, jumps)
        reached, jumps, step = wider, twice, 2 * step


def ask_once(records: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Answers to the distinct keys of ``records``: each key is asked once, however many records hold it."""
    asked = records.where(F.col(key).isNotNull()).select(key).distinct()
    return answers.join(by_shuffle(asked), key, "left_semi")


def until_complete(records: DataFrame, crawl: str, page_no: str, key: str, total: str, max_pages: int | None = None) -> DataFrame:
    """Records of the pages read before the crawl had seen as many keys as announced."""
    capped = _capped(records, page_no, max_pages)
    first_seen = capped.groupBy(crawl, key).agg(F.min(page_no).alias(page_no))
    new_keys = first_seen.groupBy(crawl, page_no).agg(F.count("*").alias("_new"))
    per_page = capped.groupBy(crawl, page_no).agg(F.max(total).alias("_total")).join(new_keys, [crawl, page_no], "left")
    # One row per page of a crawl reaches this window.
    before = Window.partitionBy(crawl).orderBy(page_no).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum("_new").over(before), F.lit(0)) >= F.nullif(F.lag("_total").over(
        Window.partitionBy(crawl).orderBy(page_no)), F.lit(0))
    stop = per_page.withColumn("_done", F.coalesce(done, F.lit(False))).groupBy(crawl).agg(
        F.min(F.when(F.col("_done"), F.col(page_no))).alias("_stop"))
    return capped.join(stop, crawl).where(F.col("_stop").isNull() | (F.col(page_no) < F.col("_stop"))).drop("_stop")
