"""Source records to catalogue items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as fv
from ..functions import dates, money, urls
from ..functions.text import (first_n, first_value, head, join_filled, none_if_empty, squash, squash_markup,
                              squash_unescaped, text_or_empty, unescape)
from ..model import CATALOGUE
from ..session import by_shuffle
from . import dom
from .extract import fact_value

BROKER_RECORD = T.StructType([
    T.StructField(name, T.StringType()) for name in (
        "mongoId", "elasticSearchId", "award", "title", "summary", "url", "registrationStartDate",
        "registrationCloseDate", "datePublished", "fundingUrl", "organisation", "institutionName", "sector")
] + [T.StructField("konferCategory", T.StructType([T.StructField("category", T.StringType())]))])

PORTAL_RECORD = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

BUDGET = T.StructType([T.StructField("budgetTopicActionMap", T.MapType(T.StringType(), T.ArrayType(T.StructType([
    T.StructField("expectedGrants", T.StringType()),
    T.StructField("minContribution", T.StringType()),
    T.StructField("maxContribution", T.StringType()),
    T.StructField("budgetYearMap", T.MapType(T.StringType(), T.StringType())),
]))))])

ITEM = T.StructType([f for f in CATALOGUE.fields if f.name not in ("status", "last_seen")])


def to_items(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project to the item columns in order, typed, missing ones null, transients gone."""
    have = set(df.columns)
    columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ITEM.fields]
    return df.select(*columns, *[c for c in extra if c in have])


# --- broker records (flat JSON) ---------------------------------------------------

def broker_items(records: DataFrame, base: str = fv.BROKER_BASE, extra: tuple[str, ...] = ()) -> DataFrame:
    """Flat records to items.  Records without any id are dropped, not merged into one."""
    def filled(*names):
        return F.coalesce(*[none_if_empty(F.col(n)) for n in names], F.lit(""))

    link = text_or_empty(F.col("url"))
    staged = records.withColumns({
        "_id": none_if_empty(filled("mongoId", "elasticSearchId")),
        "_title": squash_markup(F.col("title")),
        "_summary": squash_markup(F.col("summary")),
        "_award": squash_markup(F.col("award")),
        "_body": squash_markup(filled("organisation", "institutionName")),
        "_sector": squash_markup(filled("sector", "konferCategory.category")),
        "_page": F.when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(link),
        "_opened": dates.loose_date(squash_markup(filled("registrationStartDate", "datePublished"))),
        "_closes": dates.loose_date(squash_markup(F.col("registrationCloseDate"))),
    }).where(F.col("_id").isNotNull())

    def labelled(label, name):
        return F.when(F.col(name) != "", F.concat(F.lit(f"{label}: "), F.col(name)))

    description = join_filled("\n\n", labelled("Award", "_award"), labelled("Organisation", "_body"),
                              labelled("Konfer page", "_page"), F.col("_summary"))
    return to_items(staged.select(
        F.concat(F.lit("konfer:"), F.col("_id")).alias("id"), F.lit("konfer").alias("source"),
        F.col("_title").alias("title"),
        F.coalesce(none_if_empty(F.col("fundingUrl")), none_if_empty(F.col("_page")), F.lit(f"{base}/fundings")).alias("url"),
        F.col("_summary").alias("summary"),
        F.coalesce(none_if_empty(description), F.col("_title")).alias("description"),
        F.col("_opened").alias("opened_date"), F.col("_closes").alias("closes_date"),
        money.largest_amount(F.col("_award")).alias("funding_max"),
        none_if_empty(F.col("_sector")).alias("sector_tags"),
        join_filled(", ", F.col("_body"), F.lit(fv.BROKER_NICHE)).alias("niche_tags"),
        *[c for c in extra if c in records.columns]), extra)


# --- portal records (array-valued metadata) ---------------------------------------

def meta(column: Column, key: str) -> Column:
    return F.try_element_at(column, F.lit(key))


def record_identifier(metadata: Column) -> Column:
    return F.coalesce(none_if_empty(first_value(meta(metadata, "identifier"))),
                      none_if_empty(first_value(meta(metadata, "callIdentifier"))))


def budget_actions(payloads: Column) -> Column:
    """All actions of all readable budget payloads, in order; bad JSON gives none."""
    parsed = F.transform(payloads, lambda raw: F.flatten(F.transform(
        F.map_values(F.from_json(raw, BUDGET)["budgetTopicActionMap"]),
        lambda actions: F.coalesce(actions, F.array().cast(BUDGET[0].dataType.valueType)))))
    return F.flatten(F.array_compact(parsed))


def budget_range(actions: Column) -> tuple[Column, Column]:
    """Smallest positive minimum and largest maximum; quoted numbers count as numbers."""
    lows = F.filter(F.transform(actions, lambda a: a["minContribution"].try_cast("double")), lambda v: v > 0)
    return F.array_min(lows), F.array_max(F.transform(actions, lambda a: a["maxContribution"].try_cast("double")))


def year_total(years: Column) -> Column:
    """Sum of a year map's plain positive numbers."""
    # JSON numbers arrive as Spark prints doubles, so an exponent may follow.
    numbers = F.filter(F.map_values(years), lambda v: v.rlike(r"^(\d+\.?\d*|\.\d+)(E\d+)?$"))
    return F.aggregate(numbers, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def budget_notes(actions: Column) -> Column:
    def notes(a: Column) -> Column:
        total = year_total(a["budgetYearMap"])
        grants = a["expectedGrants"]
        return F.array_compact(F.array(
            F.when(total != 0, F.concat(F.lit("Topic budget: EUR "), F.format_number(total, 0))),
            F.when(text_or_empty(grants).isin("", "0") == F.lit(False), F.concat(F.lit("Expected grants: "), grants))))

    return F.flatten(F.transform(actions, notes))


def _unescaped_each(values: Column) -> Column:
    """``unescape`` over an array in one call per row."""
    return F.split(unescape(F.array_join(values, "\x1f")), "\x1f")


def merge_listing_and_detail(listing: DataFrame, detail: DataFrame, key: str = "identifier") -> DataFrame:
    """Left join on ``key``; listing values win, five named fields fall back when empty."""
    backed_up = ("descriptionByte", "budgetOverview", "typesOfAction", "callTitle", "keywords")
    other = detail.select(F.col(key), F.col("summary").alias("_d_summary"), F.col("content").alias("_d_content"),
                          F.col("metadata").alias("_d_meta"))
    mine, theirs = F.col("metadata"), F.col("_d_meta")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    both = F.map_zip_with(
        F.coalesce(mine, empty), F.coalesce(theirs, empty),
        lambda k, l, d: F.when(
            k.isin(*backed_up) & (F.coalesce(F.size(l), F.lit(0)) <= 0), F.coalesce(d, l))
        .otherwise(F.coalesce(l, d)))
    joined = listing.join(by_shuffle(other), key, "left")
    return joined.withColumns({
        "metadata": both, "summary": F.coalesce("summary", "_d_summary"), "content": F.coalesce("content", "_d_content"),
    }).drop("_d_summary", "_d_content", "_d_meta")


def portal_items(records: DataFrame, rate: DataFrame, as_of, extra: tuple[str, ...] = ()) -> DataFrame:
    """Records to items with native and converted money.

    Of the feed's (rate, rate_date) rows the newest counts, of one day the highest rate;
    it comes in as a scalar, without a join.  Records without an identifier are dropped.
    """
    day = F.lit(as_of).cast("date")
    m = F.col("metadata")
    newest = rate.agg(F.max(F.struct("rate_date", "rate")).alias("r")).select("r").scalar()
    kept = [c for c in records.columns if c not in ("nodes",)]
    flat = dom.flatten(records.withColumn("_html", F.coalesce(first_value(meta(m, "descriptionByte")), F.lit(""))), "_html")
    body = squash_unescaped(dom.text_in(F.col("nodes"), "\n"))
    base = flat.select(*kept, body.alias("_body")).withColumn("_key", record_identifier(m)).where(F.col("_key").isNotNull())
    staged = base.withColumns({"_rate": newest["rate"], "_rate_date": newest["rate_date"]}).withColumns({
        "_actions": budget_actions(meta(m, "budgetOverview")),
        "_days": dates.deadlines(meta(m, "deadlineDate")),
        "_kind": squash_unescaped(first_value(meta(m, "typesOfAction"))),
        "_call": squash_unescaped(first_value(meta(m, "callTitle"))),
        "_words": F.filter(F.transform(_unescaped_each(meta(m, "keywords")), squash), lambda w: w != ""),
        "_url": urls.portal_link(F.col("_key"), first_value(meta(m, "type")), first_value(meta(m, "url"))),
        "_title": squash_unescaped(F.coalesce(
            none_if_empty(first_value(meta(m, "title"))), none_if_empty(F.col("summary")),
            none_if_empty(F.col("content")), F.col("_key"))),
    })
    low, high = budget_range(F.col("_actions"))
    staged = staged.withColumns({"_low": low, "_high": high, "_notes": budget_notes(F.col("_actions"))})
    label = lambda text, name: F.when(F.col(name) != "", F.concat(F.lit(text), F.col(name)))
    description = F.concat_ws(
        "\n\n", label("Action type: ", "_kind"), label("Call: ", "_call"), F.col("_notes"),
        none_if_empty(F.col("_body")), F.concat(F.lit("Source page: "), F.col("_url")))
    summary = squash_unescaped(F.coalesce(
        none_if_empty(F.col("summary")), none_if_empty(head(F.col("_body"), fv.SUMMARY_CHARS)), F.col("_title")))
    priced = F.col("_low").isNotNull() | F.col("_high").isNotNull()
    return to_items(staged.select(
        F.concat(F.lit("horizon:"), F.lower("_key")).alias("id"), F.lit("horizon_europe").alias("source"),
        F.col("_title").alias("title"), F.col("_url").alias("url"),
        dates.api_date(first_value(meta(m, "startDate"))).alias("opened_date"),
        dates.current_deadline(F.col("_days"), day).alias("closes_date"),
        money.convert(F.col("_low"), F.col("_rate")).alias("funding_min"),
        money.convert(F.col("_high"), F.col("_rate")).alias("funding_max"),
        F.when(priced, "EUR").alias("funding_currency"),
        F.col("_low").alias("funding_min_native"), F.col("_high").alias("funding_max_native"),
        F.col("_rate").alias("exchange_rate"), F.col("_rate_date").alias("exchange_rate_date"),
        none_if_empty(F.array_join(first_n(F.col("_words"), fv.KEYWORD_LIMIT), ", ")).alias("sector_tags"),
        none_if_empty(join_filled(", ", F.col("_kind"), F.col("_call"))).alias("niche_tags"),
        F.lit(fv.UK_WIDE).alias("geographic_scope"), F.lit(fv.ANY_APPLICANT).alias("eligible_applicants"),
        summary.alias("summary"), description.alias("description"),
        *[c for c in extra if c in records.columns]), extra)


# --- council facts -----------------------------------------------------------------

def sole_funder(funders: Column, name: str = fv.SOLE_FUNDER) -> Column:
    """True when there are funders and every one of them is ``name``."""
    names = F.filter(F.transform(F.split(squash(funders), ","), squash), lambda f: f != "")
    return (F.size(names) > 0) & F.forall(names, lambda f: F.lower(f) == name)


def funding_from_facts(award_range: Column, minimum: Column, maximum: Column, total: Column):
    """(low, high, notes): range, overridden by the minimum and maximum; the total only without a maximum."""
    span = money.all_amounts(award_range)
    low, high, fund = (money.first_amount(c) for c in (minimum, maximum, total))
    notes = F.array_compact(F.array(
        F.when(F.size(span) > 0, F.concat(F.lit("Award range: "), award_range)),
        F.when(low.isNotNull(), F.concat(F.lit("Minimum award: "), minimum)),
        F.when(high.isNotNull(), F.concat(F.lit("Maximum award: "), maximum)),
        F.when(fund.isNotNull(), F.concat(F.lit("Total fund: "), total))))
    return F.coalesce(low, F.array_min(span)), F.coalesce(high, F.array_max(span), fund), notes


def council_items(cards: DataFrame, as_of, extra: tuple[str, ...] = ()) -> DataFrame:
    """Facts to items; cards of the sole funder are left out."""
    facts = F.col("facts")
    day = F.lit(as_of).cast("date")
    low, high, notes = funding_from_facts(
        *[fact_value(facts, k) for k in ("award range", "minimum award", "maximum award", "total fund")])
    staged = cards.withColumns({
        "_funders": fact_value(facts, "funders"), "_kind": fact_value(facts, "funding type"),
        "_state": fact_value(facts, "opportunity status"), "_low": low, "_high": high, "_notes": notes,
    }).where(~sole_funder(F.coalesce("_funders", F.lit(""))))
    priced = F.col("_low").isNotNull() | F.col("_high").isNotNull()
    label = lambda text, name: F.when(text_or_empty(F.col(name)) != "", F.concat(F.lit(text), F.col(name)))
    description = F.concat_ws(
        "\n\n", label("Funders: ", "_funders"), label("Funding type: ", "_kind"), F.col("_notes"),
        F.concat(F.lit("Source page: "), F.col("source_url")),
        none_if_empty(F.coalesce(none_if_empty(F.col("description")), F.col("summary"))))
    return to_items(staged.select(
        urls.id_from_link(F.col("source_url"), "ukri").alias("id"), F.lit("ukri").alias("source"), "title",
        F.coalesce(none_if_empty(F.col("application_url")), F.col("source_url")).alias("url"),
        "opened_date", "closes_date",
        F.col("_low").alias("funding_min"), F.col("_high").alias("funding_max"),
        F.when(priced, "GBP").alias("funding_currency"),
        F.col("_low").alias("funding_min_native"), F.col("_high").alias("funding_max_native"),
        F.when(priced, F.lit(1.0)).alias("exchange_rate"), F.when(priced, day).alias("exchange_rate_date"),
        F.col("_funders").alias("sector_tags"),
        none_if_empty(join_filled(", ", F.col("_kind"), F.col("_state"))).alias("niche_tags"),
        "summary", description.alias("description"),
        *[c for c in extra if c in cards.columns]), extra)


def facts_from_tags(sector_tags: Column, niche_tags: Column) -> Column:
    """Facts as far as stored tags still tell them."""
    def fact(label, value):
        return F.when(text_or_empty(value) != "", F.struct(
            F.lit(label).alias("label"), value.alias("value"), F.lit(None).cast("string").alias("stamp")))

    return F.array_compact(F.array(
        fact("funders", sector_tags), fact("funding type", F.substring_index(niche_tags, ",", 1))))
