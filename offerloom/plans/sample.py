"""The benchmark's tables seen as an offer catalogue, its pages and its ledger.

There is no offers table among the given ones, so one is derived: an order with
its lines and a part is an offer.  ``CATALOGUE_SQL`` says the same in plain SQL for
the checking engine; the text of the columns is shared, the operators are not.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import spread

AS_OF = dt.date(1998, 6, 1)
STORED_ON = dt.date(1998, 3, 1)
NOW = dt.datetime(1998, 6, 1, 6, 0, 0)
STAMP = "yyyy-MM-dd HH:mm:ss"

_SOURCE = """case o_orderpriority when '1-URGENT' then 'innovate_uk' when '2-HIGH' then 'Innovate UK'
  when '3-MEDIUM' then 'iuk_business_connect' when '4-NOT SPECIFIED' then 'horizon_europe'
  else (case o_orderstatus when 'P' then 'ukri' else 'Konfer' end) end"""
_PREFIX = """case o_orderpriority when '1-URGENT' then 'ifs' when '2-HIGH' then 'ifs' when '3-MEDIUM' then 'iukbc'
  when '4-NOT SPECIFIED' then 'horizon' else (case o_orderstatus when 'P' then 'ukri' else 'konfer' end) end"""

# Columns of a joined order row, then of the offer made from it.
_FIRST = {
    "id": f"{_PREFIX} || ':' || cast(o_orderkey as string)",
    "source": _SOURCE,
    "title": "p_name || ' ' || p_type",
    "opened_date": "cast(o_orderdate as date)",
    "closes_date": "case when o_orderstatus = 'P' then null else closes end",
    "low": "case when n > 1 then fmin end",
    "high": "fmax",
    "pair": "cast(pk as string) || '-' || cast(sk as string)",
    "o_orderkey": "o_orderkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice",
    "o_orderdate": "o_orderdate", "p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "p_size",
}
_SECOND = {
    "id": "id", "source": "source", "title": "title",
    "url": """case when id like 'ifs:%' then 'https://apply-for-innovation-funding.service.gov.uk/competition/' || pair || '/overview'
      when id like 'iukbc:%' then 'https://iuk-business-connect.org.uk/opportunities/' || pair || '/'
      else 'https://Offers.example.org/P' || pair || '/?ref=' || cast(o_orderkey as string) end""",
    "opened_date": "opened_date", "closes_date": "closes_date",
    "funding_min": "case when source = 'horizon_europe' then low * 0.86 else low end",
    "funding_max": "case when source = 'horizon_europe' then high * 0.86 else high end",
    "funding_currency": "case when source = 'horizon_europe' then 'EUR' when high > 20000 then 'GBP' end",
    "funding_min_native": "low", "funding_max_native": "high",
    "exchange_rate": "case when source = 'horizon_europe' then cast(0.86 as double) else cast(1.0 as double) end",
    "exchange_rate_date": "date '1998-05-29'",
    "sector_tags": "p_brand || ', ' || p_type",
    "niche_tags": """case when source = 'horizon_europe' then 'HORIZON-CL' || cast(p_size as string) || '-1998-01, HORIZON ' || p_type
      when o_orderstatus = 'F' then null else 'size ' || cast(p_size as string) end""",
    "geographic_scope": "case when o_orderstatus = 'O' then 'uk_wide' end",
    "eligible_applicants": "case when o_orderstatus = 'F' then 'any' end",
    "summary": "case when o_orderstatus = 'P' then null else 'Grant for ' || p_name || ' makers & partners (' || p_type || ')' end",
    "description": """case when o_orderstatus = 'O' then 'Grant for ' || p_name || ' makers & partners (' || p_type || ')'
      when source = 'Konfer' then 'Round page: https://iuk-business-connect.org.uk/opportunities/' || pair || '/ and more'
      else 'Award for ' || p_brand || '. Programme: https://iuk-business-connect.org.uk/programme/' || p_type || '/' end""",
    "status": f"""case when o_totalprice < 60000 then 'inactive' when opened_date > date '{STORED_ON}' then 'upcoming'
      when closes_date is null then 'rolling' else 'open' end""",
    "last_seen": "cast(o_orderdate as timestamp)",
}


def _select(columns: dict[str, str]) -> str:
    return ",\n  ".join(f"{text} as {name}" for name, text in columns.items())


CATALOGUE_SQL = f"""catalogue as (select
  {_select(_SECOND)}
from (select
  {_select(_FIRST)}
from orders
join (select l_orderkey, cast(max(l_shipdate) as date) as closes, min(l_extendedprice) as fmin,
        max(l_extendedprice) as fmax, count(*) as n, min(l_partkey) as pk, min(l_suppkey) as sk
      from lineitem group by l_orderkey) on l_orderkey = o_orderkey
join part on p_partkey = pk))"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table ahead of heavy work per row."""
    return spread(table(spark, folder, name))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, their line totals and one part each, as offers."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").cast("date").alias("closes"), F.min("l_extendedprice").alias("fmin"),
        F.max("l_extendedprice").alias("fmax"), F.count("*").alias("n"),
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"))
    joined = (table(spark, folder, "orders")
              .join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(table(spark, folder, "part"), F.col("p_partkey") == F.col("pk")))
    first = joined.select(*[F.expr(text).alias(name) for name, text in _FIRST.items()])
    return first.select(*[F.expr(text).alias(name) for name, text in _SECOND.items()])


def shown(df: DataFrame, *names: str) -> DataFrame:
    """Columns as the checks compare them: time stamps as text, arrays joined."""
    kinds = dict(df.dtypes)
    picked = names or df.columns

    def plain(name: str) -> Column:
        if kinds[name].startswith("timestamp"):
            return F.date_format(name, STAMP).alias(name)
        if kinds[name].startswith("array"):
            return F.array_join(name, "|").alias(name)
        return F.col(name)

    return df.select(*map(plain, picked))


def fill(template: str, **values: Column) -> Column:
    """Text with ``{name}`` parts taken from columns or from ``values``."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            name = piece[1:-1]
            parts.append(F.coalesce(values.get(name, F.col(name)).cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def long_day(column: Column) -> Column:
    return F.date_format(column, "d MMMM yyyy")


def part_days(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with an opening and a closing day."""
    return spread_table(spark, folder, "part").withColumns({
        "opens": F.expr("date '1998-01-01' + p_size"), "ends": F.expr("date '1998-06-01' + p_size * 2")})


PART_DAYS_SQL = """parts as (select *, date '1998-01-01' + p_size as opens, date '1998-06-01' + p_size * 2 as ends from part)"""


def checks(spark: SparkSession, folder: str) -> DataFrame:
    """Events as source checks: an error is a failed check of its source."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("source_"), F.col("user_id").cast("string")).alias("source"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("ts").cast("timestamp").alias("checked_at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("count"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), F.col("value").cast("bigint").cast("string"))).alias("error"),
        F.col("event_id").alias("check_id"))


CHECKS_SQL = """checks as (select 'source_' || cast(user_id as string) as source,
  case when event_type = 'error' then 'failed' else 'success' end as status, ts as checked_at,
  cast(json_extract_string(props, '$.k') as bigint) as "count",
  case when event_type = 'error' then 'HTTP ' || cast(cast(trunc("value") as bigint) as string) end as error,
  event_id as check_id from events)"""
