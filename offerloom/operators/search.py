"""Filters, order and facets over the catalogue."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions import report
from ..functions.text import contains_any_case, strip
from ..model import DEFAULT_BOOK, SourceBook

TEXT_COLUMNS = ("title", "summary", "description")
TAGGED_COLUMNS = ("title", "summary", "sector_tags", "niche_tags", "description")


def parse_day(value: str | None) -> dt.date | None:
    """Day from a form field; null when it is not one."""
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date() if value else None
    except ValueError:
        return None


def parse_number(value: str | None) -> float | None:
    """Number from a form field; null when it is not one, or not finite."""
    try:
        number = float(value) if value else None
    except ValueError:
        return None
    return number if number is not None and math.isfinite(number) else None


@dataclass(frozen=True)
class SearchForm:
    keyword: str | None = None
    sources: tuple[str, ...] = ()
    opens_from: dt.date | None = None
    closes_from: dt.date | None = None
    closes_to: dt.date | None = None
    sector_or_niche: str | None = None
    min_funding: float | None = None
    max_funding: float | None = None
    literal: bool = False

    @classmethod
    def from_text(cls, **fields) -> "SearchForm":
        """Form from raw query strings, read leniently."""
        days = {k: parse_day(fields.get(k)) for k in ("opens_from", "closes_from", "closes_to")}
        numbers = {k: parse_number(fields.get(k)) for k in ("min_funding", "max_funding")}
        source = fields.get("source") or ()
        return cls(keyword=fields.get("keyword"), sector_or_niche=fields.get("sector_or_niche"),
                   sources=(source,) if isinstance(source, str) else tuple(source), **days, **numbers)


def is_live(as_of) -> Column:
    """Not inactive, and not closed on that day; rolling rows stay."""
    closes = F.col("closes_date")
    return (F.col("status") != "inactive") & (closes.isNull() | (closes >= F.lit(as_of).cast("date")))


def live(df: DataFrame, as_of) -> DataFrame:
    return df.where(is_live(as_of))


def _text_test(df: DataFrame, columns, text: str, literal: bool) -> Column:
    have = set(df.columns)
    return contains_any_case([F.col(c) for c in columns if c in have], text, literal)


def keyword_filter(df: DataFrame, keyword: str | None, literal: bool = False) -> DataFrame:
    return df.where(_text_test(df, TEXT_COLUMNS, keyword, literal)) if keyword else df


def tag_filter(df: DataFrame, text: str | None, literal: bool = False) -> DataFrame:
    return df.where(_text_test(df, TAGGED_COLUMNS, text, literal)) if text else df


def source_names(spark: SparkSession, book: SourceBook = DEFAULT_BOOK) -> DataFrame:
    """The source book as a table: one row per stored spelling."""
    stored = sorted(set(book.labels) | set(book.priority) | {a for names in book.aliases.values() for a in names})
    names = spark.createDataFrame([(n,) for n in stored], "source string")
    c = F.col("source")
    return names.select(
        "source", book.key_of(c).alias("source_key"), book.label_of(c).alias("source_label"),
        book.order_of(book.key_of(c)).alias("source_position"), book.priority_of(c).alias("source_priority"))


def with_source_names(df: DataFrame, book: SourceBook = DEFAULT_BOOK) -> DataFrame:
    """Key, label, position and priority by join; an unknown source gets the defaults.

    The broadcast side has a row per spelling in the book, a constant of the code.
    """
    c = F.col("source")
    joined = df.join(F.broadcast(source_names(df.sparkSession, book)), "source", "left")
    return joined.withColumns({
        "source_key": F.coalesce("source_key", strip(c)),
        "source_label": F.coalesce("source_label", F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))),
        "source_position": F.coalesce("source_position", F.lit(fv.UNRANKED)),
        "source_priority": F.coalesce("source_priority", F.lit(fv.UNRANKED))})


def in_any_spelling(df: DataFrame, wanted: DataFrame, book: SourceBook = DEFAULT_BOOK) -> DataFrame:
    """Rows of the sources in ``wanted`` (a table of keys), whatever their spelling.

    Sources are few and their rows many, so a shuffle by source would be all skew.
    Spark sees the size of the names and broadcasts them while that is small.
    """
    asked = wanted.select("source_key").distinct()
    spelled = asked.join(F.broadcast(source_names(df.sparkSession, book)), "source_key").select("source")
    stored = spelled.union(asked).distinct()
    return df.join(stored, "source", "left_semi")


def source_filter(df: DataFrame, names, book: SourceBook = DEFAULT_BOOK) -> DataFrame:
    stored = book.expand(list(names or ()))
    return df.where(F.col("source").isin(*stored)) if stored else df


def date_filters(df: DataFrame, opens_from=None, closes_from=None, closes_to=None) -> DataFrame:
    if opens_from:
        df = df.where(F.col("opened_date") >= F.lit(opens_from).cast("date"))
    if closes_from:
        df = df.where(F.col("closes_date") >= F.lit(closes_from).cast("date"))
    if closes_to:
        df = df.where(F.col("closes_date") <= F.lit(closes_to).cast("date"))
    return df


def funding_filters(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose funding range overlaps [low, high]; an open end matches."""
    if low is not None:
        df = df.where(F.col("funding_max").isNull() | (F.col("funding_max") >= F.lit(float(low))))
    if high is not None:
        df = df.where(F.col("funding_min").isNull() | (F.col("funding_min") <= F.lit(float(high))))
    return df


def matching(df: DataFrame, form: SearchForm, as_of, book: SourceBook = DEFAULT_BOOK) -> DataFrame:
    """All filters, without order, for counts and further joins."""
    df = live(df, as_of)
    df = source_filter(df, form.sources, book)
    df = date_filters(df, form.opens_from, form.closes_from, form.closes_to)
    df = funding_filters(df, form.min_funding, form.max_funding)
    df = keyword_filter(df, form.keyword, form.literal)
    df = tag_filter(df, form.sector_or_niche, form.literal)
    return df.where(F.col("status").isin(*fv.STATUS_GROUPS))


def in_search_order(df: DataFrame) -> DataFrame:
    return df.orderBy("status", F.col("closes_date").asc_nulls_last(), "title", "id")


def search(df: DataFrame, form: SearchForm, as_of, book: SourceBook = DEFAULT_BOOK) -> DataFrame:
    return in_search_order(matching(df, form, as_of, book))


def facets(df: DataFrame, as_of, book: SourceBook = DEFAULT_BOOK) -> DataFrame:
    """Core sources and those found among live rows, in display order."""
    session = df.sparkSession
    core = session.createDataFrame([(k,) for k in book.core], "value string")
    # Keying after the distinct keeps the shuffle at a handful of names.
    found = live(df, as_of).select("source").distinct().select(book.key_of(F.col("source")).alias("value"))
    named = core.union(found).distinct().withColumns({
        "label": book.label_of(F.col("value")), "position": book.order_of(F.col("value"))})
    return named.orderBy("position", "label").select("value", "label", "position")


def group_counts(df: DataFrame) -> DataFrame:
    """Rows in each of the three status groups, empty groups included."""
    session = df.sparkSession
    groups = session.createDataFrame([(g, i) for i, g in enumerate(fv.STATUS_GROUPS)], "status string, position int")
    counted = df.where(F.col("status").isin(*fv.STATUS_GROUPS)).groupBy("status").agg(F.count("*").alias("n"))
    return groups.join(counted, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "position").orderBy("position")


def group_counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows in each status group for every value of a column, groups without rows included; a null value is a value."""
    inside = [F.count(F.when(F.col("status") == g, 1)).alias("n") for g in fv.STATUS_GROUPS]
    counted = df.groupBy(column).agg(F.array(*inside).alias("counts"))
    groups = F.array(*[F.struct(F.lit(g).alias("status"), F.col("counts")[i].alias("n"), F.lit(i).alias("position")) for i, g in enumerate(fv.STATUS_GROUPS)])
    return counted.select(column, F.inline(groups))


def by_id(df: DataFrame, record_id: str) -> DataFrame:
    return df.where(F.col("id") == record_id).limit(1)


def cards(df: DataFrame, as_of, book: SourceBook = DEFAULT_BOOK) -> DataFrame:
    """Report columns beside the catalogue columns."""
    day = F.lit(as_of).cast("date")
    c = F.col
    named = df.withColumn("source_label", book.label_of(c("source")))
    money_columns = [c(x) for x in ("funding_currency", "funding_min_native", "funding_max_native", "funding_min", "funding_max")]
    return named.withColumns({
        "closing_soon": report.closing_soon(c("status"), c("closes_date"), day),
        "funding_text": report.funding_text(*money_columns),
        "converted_text": report.converted_text(*money_columns),
        "chips": report.chips(c("title"), c("summary"), c("sector_tags"), c("niche_tags"), c("source_label")),
        "reference": report.eu_reference(c("source"), c("id"), c("sector_tags"), c("niche_tags"), c("description")),
    })
