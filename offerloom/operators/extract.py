"""Landed pages to items: one function per page kind.

Listing functions return one row per card with its place on the page (``slot``);
detail functions return one row per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import dates, money, urls
from ..functions.text import join_filled, none_if_empty, once, squash, squash_lines, strip, text_or_empty
from . import dom

NOISE_TAGS = ("script", "style", "nav")
NOISE_CLASSES = ("govuk-breadcrumbs", "govuk-phase-banner")
HEADINGS = ("h1", "h2", "h3", "h4")


def _cards(pages: DataFrame, test, scope=None) -> DataFrame:
    """One row per card element: page columns, ``slot`` and the card's own nodes."""
    flat = dom.flatten(pages)
    kept = [c for c in flat.columns if c != "nodes"]
    nodes = F.col("nodes")
    found = F.filter(nodes, lambda n: test(nodes, n))
    if scope is not None:
        flat = flat.withColumn("scope", scope(nodes))
        found = F.filter(found, lambda n: F.col("scope").isNull() | dom.holds(F.col("scope"), n))
    return flat.select(
        *kept, F.posexplode(F.transform(found, lambda n: dom.subtree(nodes, n))).alias("slot", "nodes"))


# --- source 1 -------------------------------------------------------------------

def competition_cards(pages: DataFrame, base: str = fv.COMPETITION_BASE) -> DataFrame:
    """List items with a titled link; opening and closing day by place in the list."""
    def is_card(nodes: Column, n: Column) -> Column:
        parent = F.get(nodes, n["parent"])
        return dom.is_tag(n, "li") & dom.is_tag(parent, "ul") & dom.has_class(parent, "govuk-list")

    nodes = F.col("nodes")
    heads = F.filter(nodes, lambda n: dom.is_tag(n, "h2"))
    link = dom.find(nodes, lambda n: dom.is_tag(n, "a") & dom.has_class(n, "govuk-link")
                    & dom.attr(n, "href").isNotNull() & F.exists(heads, lambda h: dom.holds(h, n)))
    blurb = dom.find(nodes, lambda n: dom.is_tag(n, "div") & dom.has_class(n, "wysiwyg-styles"))
    lists = F.filter(nodes, lambda n: dom.is_tag(n, "dl") & dom.has_class(n, "date-definition-list"))
    days = F.filter(nodes, lambda n: dom.is_tag(n, "dd") & F.exists(lists, lambda d: dom.holds(d, n)))
    cards = _cards(pages, is_card).withColumns({"link": link, "blurb": blurb, "days": days})
    href = strip(dom.attr(F.col("link"), "href"))
    summary = text_or_empty(dom.text_of(nodes, F.col("blurb")))

    def day(i: int) -> Column:
        return dates.long_date(dom.text_of(nodes, F.get(F.col("days"), F.lit(i))))

    number = urls.competition_in_path(href)
    return cards.where((href != "") & number.isNotNull()).select(
        F.col("url").alias("page_url"), "slot",
        F.concat(F.lit("ifs:"), number).alias("id"),
        F.lit("innovate_uk").alias("source"),
        dom.text_of(nodes, F.col("link")).alias("title"),
        F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href)).alias("url"),
        summary.alias("summary"), summary.alias("description"),
        day(0).alias("opened_date"), day(1).alias("closes_date"))


def main_part(nodes: Column) -> Column:
    """The element that holds the content, by a chain of ever wider choices."""
    return F.coalesce(
        dom.find(nodes, lambda n: dom.attr(n, "id") == "main-content"),
        dom.find(nodes, lambda n: dom.is_tag(n, "main")),
        dom.find(nodes, lambda n: dom.has_class(n, "govuk-main-wrapper")),
        dom.find(nodes, lambda n: dom.is_tag(n, "body")))


def main_nodes(nodes: Column) -> Column:
    return F.coalesce(dom.subtree(nodes, main_part(nodes)), nodes)


def sections(nodes: Column) -> Column:
    """(heading, body) pairs: what follows a heading up to the next one beside it."""
    heads = F.filter(nodes, lambda n: dom.is_tag(n, *HEADINGS))

    def body(h: Column) -> Column:
        beside = F.filter(nodes, lambda n: (n["parent"] == h["parent"]) & (n["pos"] > h["last"]) & (n["tag"] != ""))
        stop = F.coalesce(
            F.array_min(F.transform(F.filter(beside, lambda n: dom.is_tag(n, *HEADINGS)), lambda n: n["pos"])),
            F.lit(2**31 - 1))
        until = lambda end: F.filter(beside, lambda n: (n["pos"] < end) & ~dom.is_tag(n, *NOISE_TAGS))
        chunks = F.transform(once(stop, until), lambda n: squash_lines(dom.text_of(nodes, n, "\n")))
        return F.array_join(F.filter(chunks, lambda c: c != ""), "\n")

    pairs = F.transform(heads, lambda h: F.struct(
        squash_lines(dom.text_of(nodes, h, "\n")).alias("heading"), body(h).alias("body")))
    return F.filter(pairs, lambda p: (p["heading"] != "") & (p["body"] != ""))


def page_sections(pages: DataFrame) -> DataFrame:
    flat = dom.flatten(pages, prune_tags=NOISE_TAGS, prune_classes=NOISE_CLASSES)
    return flat.withColumn("nodes", main_nodes(F.col("nodes"))).withColumn("sections", sections(F.col("nodes")))


def competition_details(pages: DataFrame) -> DataFrame:
    """Wanted sections as one text, else the body blocks; pound range found in it."""
    nodes = F.col("nodes")
    wanted = F.filter(F.col("sections"), lambda s: s["heading"].rlike(fv.WANTED_HEADING_PATTERN))
    blocks = F.transform(
        F.filter(nodes, lambda n: dom.has_class(n, "wysiwyg-styles") | dom.has_class(n, "govuk-body")),
        lambda n: squash_lines(dom.text_of(nodes, n, "\n")))
    parts = page_sections(pages).withColumn("wanted", wanted)
    text = F.when(
        F.size("wanted") > 0,
        F.array_join(F.transform("wanted", lambda s: F.concat_ws("\n", s["heading"], s["body"])), "\n\n"),
    ).otherwise(F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n"))
    lead = F.when(text_or_empty(F.col("url")) != "", F.concat(F.lit("Source page: "), F.col("url")))
    described = parts.withColumn("description", strip(join_filled("\n\n", lead, text)))
    searched = F.coalesce(none_if_empty(F.col("description")), squash_lines(dom.text_in(nodes, "\n")))
    amounts = described.withColumn("amounts", money.all_amounts(searched, fv.POUND_PATTERN))
    return amounts.select(
        "url", "description",
        F.array_min("amounts").alias("funding_min"), F.array_max("amounts").alias("funding_max"))


# --- source 2 -------------------------------------------------------------------

def next_page(nodes: Column, page_url: Column, box_class: str | None = "pagination") -> Column:
    """Link to the next page: marked as next, else worded as next; anywhere if no box is named."""
    inside = (lambda n: F.lit(True)) if box_class is None else (lambda n: dom.under_class(nodes, n, box_class))
    linked = F.filter(nodes, lambda n: dom.is_tag(n, "a") & dom.attr(n, "href").isNotNull() & inside(n))
    marked = dom.find(linked, lambda n: F.coalesce(F.array_contains(F.split(dom.attr(n, "rel"), " "), "next"), F.lit(False))
                      | dom.has_class(n, "next"))
    worded = dom.find(linked, lambda n: F.contains(F.lower(dom.text_of(nodes, n)), F.lit("next")))
    return urls.resolve(page_url, dom.attr(F.coalesce(marked, worded), "href"))


def next_links(pages: DataFrame, box_class: str | None = "pagination") -> DataFrame:
    return dom.flatten(pages).select("url", next_page(F.col("nodes"), F.col("url"), box_class).alias("next_url"))


def connect_cards(pages: DataFrame, scope_id: str = "search-filter-results-366", prefix: str = "iukbc",
                  source: str = "iuk_business_connect") -> DataFrame:
    """Link cards with a heading; days by their "Opens:" and "Closes:" labels."""
    def is_card(nodes: Column, n: Column) -> Column:
        return (dom.is_tag(n, "a") & F.contains(text_or_empty(dom.attr(n, "href")), F.lit("/opportunities/"))
                & F.exists(nodes, lambda h: dom.is_tag(h, "h3") & dom.holds(n, h)))

    nodes = F.col("nodes")
    cards = _cards(pages, is_card, lambda ns: dom.find(ns, lambda n: dom.attr(n, "id") == scope_id))
    lines = F.transform(F.filter(nodes, lambda n: dom.is_tag(n, "p")), lambda n: dom.text_of(nodes, n))
    opens = F.filter("lines", lambda t: F.contains(t, F.lit("Opens:")))
    closes = F.filter("lines", lambda t: F.contains(t, F.lit("Closes:")) & ~F.contains(t, F.lit("Opens:")))
    link = urls.resolve(F.col("url"), strip(dom.attr(F.get(nodes, F.lit(0)), "href")))
    title = squash(dom.text_of(nodes, dom.find(nodes, lambda n: dom.is_tag(n, "h3"))))
    summary = squash(dom.text_of(nodes, dom.find(nodes, lambda n: dom.has_class(n, "line-clamp-5"))))
    return cards.withColumns({"lines": lines, "link": link}).select(
        F.col("url").alias("page_url"), "slot",
        urls.id_from_link(F.col("link"), prefix).alias("id"), F.lit(source).alias("source"),
        title.alias("title"), F.col("link").alias("source_url"), F.col("link").alias("url"),
        summary.alias("summary"), summary.alias("description"),
        dates.slash_date(F.try_element_at(opens, F.lit(-1))).alias("opened_date"),
        dates.slash_date(F.try_element_at(closes, F.lit(-1))).alias("closes_date"))


def block_under(nodes: Column, heading: str, tag: str = "h5") -> Column:
    """Nodes of the box around the first heading with that text; null without one."""
    head = dom.find(nodes, lambda n: dom.is_tag(n, tag) & (F.lower(squash(dom.text_of(nodes, n))) == heading.lower()))
    return dom.subtree(nodes, dom.ancestor(nodes, head, "div"))


def block_text(block: Column, heading: str) -> Column:
    def texts(nodes: Column) -> Column:
        boxes = F.filter(nodes, lambda n: dom.is_tag(n, "div") & (n["parent"] == F.get(nodes, F.lit(0))["pos"]))
        return F.transform(boxes, lambda n: squash(dom.text_of(nodes, n)))

    wanted = F.filter(once(block, texts), lambda t: (t != "") & (F.lower(t) != heading.lower()))
    return none_if_empty(F.array_join(wanted, ", "))


def block_links(block: Column) -> Column:
    def texts(nodes: Column) -> Column:
        return F.transform(F.filter(nodes, lambda n: dom.is_tag(n, "a")), lambda n: squash(dom.text_of(nodes, n)))

    return F.filter(once(block, texts), lambda t: t != "")


def apply_link(nodes: Column, base: str = fv.CONNECT_BASE) -> Column:
    """First link worded as apply or register."""
    link = dom.find(nodes, lambda n: dom.is_tag(n, "a") & dom.attr(n, "href").isNotNull()
                    & F.lower(dom.text_of(nodes, n)).rlike("apply|register"))
    return urls.resolve(F.lit(base), dom.attr(link, "href"))


def connect_details(pages: DataFrame, base: str = fv.CONNECT_BASE) -> DataFrame:
    """Facts under small headings, award amount, prose; input ``url`` is the page."""
    nodes = F.col("nodes")
    articles = F.filter(nodes, lambda n: dom.is_tag(n, "article") & dom.has_class(n, "single_opportunities"))
    prose = dom.find(nodes, lambda n: dom.has_class(n, "prose") & F.exists(articles, lambda a: dom.holds(a, n)))
    meta = dom.find(nodes, lambda n: dom.is_tag(n, "meta") & (dom.attr(n, "name") == "description"))
    flat = dom.flatten(pages).withColumns({
        "kind_box": block_under(nodes, "Opportunity Type"), "body_box": block_under(nodes, "Organisation"),
        "sector_box": block_under(nodes, "Sector"), "award_box": block_under(nodes, "Award")})
    facts = flat.withColumns({
        "opportunity_type": block_text(F.col("kind_box"), "Opportunity Type"),
        "organisation": block_text(F.col("body_box"), "Organisation"),
        "sector_tags": F.coalesce(
            none_if_empty(F.array_join(block_links(F.col("sector_box")), ", ")),
            block_text(F.col("sector_box"), "Sector")),
        "award": block_text(F.col("award_box"), "Award"),
        "application_url": apply_link(nodes, base),
        "prose": F.coalesce(squash(F.coalesce(dom.text_of(nodes, prose, "\n"), dom.attr(meta, "content"))), F.lit("")),
    }).withColumn("funding_max", money.first_amount(F.col("award")))
    open_ended = text_or_empty(F.col("award")).rlike(fv.NOT_A_MINIMUM_PATTERN)
    return facts.select(
        F.col("url").alias("source_url"),
        F.coalesce("application_url", "url").alias("url"),
        "application_url", "opportunity_type", "organisation", "award",
        join_filled(
            "\n\n", F.concat(F.lit("Award: "), F.col("award")),
            F.when(text_or_empty(F.col("url")) != "", F.concat(F.lit("Source page: "), F.col("url"))),
            F.col("prose")).alias("description"),
        F.when((F.col("funding_max") != 0) & ~open_ended, F.col("funding_max")).alias("funding_min"),
        "funding_max", "sector_tags",
        none_if_empty(join_filled(", ", F.col("opportunity_type"), F.col("organisation"))).alias("niche_tags"))


# --- source 3 -------------------------------------------------------------------

def label_facts(nodes: Column) -> Column:
    """Label/value rows of the summary table, with the machine date where there is one."""
    boxes = F.filter(nodes, lambda n: dom.has_class(n, "opportunity__summary"))
    rows = once(boxes, lambda bs: F.filter(
        nodes, lambda n: dom.has_class(n, "govuk-table__row") & F.exists(bs, lambda b: dom.holds(b, n))))

    def parts(row: Column) -> Column:
        own = dom.subtree(nodes, row)
        return once(own, lambda ns: F.struct(
            dom.subtree(ns, dom.find(ns, lambda n: dom.is_tag(n, "dt"))).alias("name"),
            dom.subtree(ns, dom.find(ns, lambda n: dom.is_tag(n, "dd"))).alias("value")))

    def fact(part: Column) -> Column:
        stamp = dom.find(part["value"], lambda n: dom.is_tag(n, "time") & dom.attr(n, "datetime").isNotNull())
        return F.struct(
            F.lower(F.regexp_replace(squash(dom.text_in(part["name"])), ":+$", "")).alias("label"),
            squash(dom.text_in(part["value"])).alias("value"), dom.attr(stamp, "datetime").alias("stamp"))

    whole = F.filter(F.transform(rows, parts), lambda p: p["name"].isNotNull() & p["value"].isNotNull())
    return F.transform(whole, fact)


def fact_value(facts: Column, label: str) -> Column:
    """Value of the last row with that label."""
    return F.try_element_at(F.filter(facts, lambda f: f["label"] == label), F.lit(-1))["value"]


def fact_date(facts: Column, label: str) -> Column:
    """Day in the first row with that label."""
    row = F.get(F.filter(facts, lambda f: f["label"] == label), F.lit(0))
    return dates.cell_date(row["stamp"], row["value"])


def council_cards(pages: DataFrame) -> DataFrame:
    """Cards with a summary table; not yet normalised (see ``normalise.council_items``)."""
    nodes = F.col("nodes")
    cards = _cards(pages, lambda ns, n: dom.is_tag(n, "div") & dom.has_class(n, "opportunity"))
    link = dom.find(nodes, lambda n: dom.is_tag(n, "a") & dom.has_class(n, "ukri-funding-opp__link")
                    & dom.attr(n, "href").isNotNull())
    summary = squash(dom.text_of(nodes, dom.find(nodes, lambda n: dom.has_class(n, "entry-content"))))
    staged = cards.withColumns({"link": link, "facts": label_facts(nodes), "summary": summary})
    return staged.where(F.col("link").isNotNull()).select(
        F.col("url").alias("page_url"), "slot",
        urls.resolve(F.col("url"), dom.attr(F.col("link"), "href")).alias("source_url"),
        squash(dom.text_of(nodes, F.col("link"))).alias("title"),
        "summary", "facts",
        fact_date(F.col("facts"), "opening date").alias("opened_date"),
        fact_date(F.col("facts"), "closing date").alias("closes_date"),
        F.col("summary").alias("description"), F.lit(None).cast("string").alias("application_url"))


def council_details(pages: DataFrame) -> DataFrame:
    nodes = F.col("nodes")
    flat = dom.flatten(pages).withColumn("facts", label_facts(nodes))
    head = dom.find(nodes, lambda n: dom.is_tag(n, "h1") & dom.has_class(n, "main-area__page-title"))
    body = dom.find(nodes, lambda n: dom.has_class(n, "single-opportunity__entry-content"))
    start = dom.find(nodes, lambda n: dom.is_tag(n, "a") & (dom.attr(n, "id") == "analytics-start-application")
                     & dom.attr(n, "href").isNotNull())
    return flat.select(
        F.col("url").alias("source_url"),
        squash(F.replace(text_or_empty(dom.text_of(nodes, head)), F.lit(fv.TITLE_PREFIX), F.lit(""))).alias("title"),
        "facts",
        fact_date(F.col("facts"), "opening date").alias("opened_date"),
        fact_date(F.col("facts"), "closing date").alias("closes_date"),
        squash(dom.text_of(nodes, body, "\n")).alias("description"),
        urls.resolve(F.col("url"), dom.attr(start, "href")).alias("application_url"))


# --- any page -------------------------------------------------------------------

def page_text(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """Whole text of each page, white space collapsed."""
    flat = dom.flatten(pages)
    kept = [c for c in flat.columns if c != "nodes"]
    return flat.select(*kept, squash(dom.text_in(F.col("nodes"), separator)).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link: its text and absolute target."""
    nodes = F.col("nodes")
    flat = dom.flatten(pages)
    kept = [c for c in flat.columns if c != "nodes"]
    found = F.transform(
        F.filter(nodes, lambda n: dom.is_tag(n, "a") & dom.attr(n, "href").isNotNull()),
        lambda n: F.struct(dom.attr(n, "href").alias("href"), dom.text_of(nodes, n).alias("link_text")))
    rows = flat.select(*kept, F.posexplode(found).alias("slot", "link"))
    return rows.select(*kept, "slot", F.col("link.link_text").alias("link_text"),
                       urls.resolve(F.col("url"), F.col("link.href")).alias("target"))
