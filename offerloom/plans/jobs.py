"""The five sources as jobs: what a crawler landed in, items with their place in the crawl out.

Listing pages are rows (crawl, url, html), numbered ones with ``page_no``; answers are rows (crawl, page_no,
results) and more.  Each job reads its listing once, writes the cards, cuts the crawl
where a crawler would have stopped, joins the detail pages of the cards that are left, and
keeps the first listing of an id by (``page_no``, ``slot``).  An error is the job's own:
``ingest.gather`` turns it into that source's failed check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import urls
from ..operators import enrich, extract, normalise
from ..operators.merge import first_per_key
from ..session import by_shuffle, cut_lineage
from ..sources import landed

PLACE = ("page_no", "slot")


def first_listed(items: DataFrame) -> DataFrame:
    return first_per_key(items.where(F.col("id").isNotNull()), ["id"], list(PLACE))


def _read_pages(cards: DataFrame, pages: DataFrame) -> DataFrame:
    """Cards of the pages before a crawl's first page without any; ``pages`` has crawl, page_no and url."""
    sizes = cards.groupBy(F.col("page_url").alias("url")).agg(F.count("*").alias("cards"))
    sized = pages.select("crawl", "page_no", "url").join(by_shuffle(sizes), "url", "left")
    read = landed.crawled_pages(sized, "crawl", "page_no", F.coalesce("cards", F.lit(0)))
    # A page that two crawls reach counts once, by its first place.
    place = read.groupBy(F.col("url").alias("page_url")).agg(F.min("page_no").alias("page_no"))
    return cards.join(by_shuffle(place), "page_url")


def _followed(pages: DataFrame, starts: DataFrame, box_class: str | None) -> DataFrame:
    links = extract.next_links(pages.select("url", "html"), box_class).select("url", "next_url")
    return landed.by_next_link(links, starts)


def _asked(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """The detail pages that cards ask for, one per address."""
    asked = cards.select(F.col("source_url").alias("url")).where(F.col("url").isNotNull()).distinct()
    return first_per_key(pages.join(by_shuffle(asked), "url", "left_semi"), ["url"], [F.xxhash64("html")]).select("url", "html")


def competitions(pages: DataFrame) -> DataFrame:
    """Source 1: numbered listing pages up to the first empty one; details come later, by enrichment."""
    cards = cut_lineage(extract.competition_cards(pages.select("url", "html")), "cards")
    return normalise.to_items(first_listed(_read_pages(cards, pages)), PLACE)


def connections(pages: DataFrame, details: DataFrame, starts: DataFrame) -> DataFrame:
    """Source 2: listing pages by next link; every card needs its detail page, whose fields win."""
    cards = cut_lineage(extract.connect_cards(pages.select("url", "html")), "cards")
    listed = first_listed(_read_pages(cards, _followed(pages, starts, "pagination")))
    found = extract.connect_details(_asked(details, listed))
    return normalise.to_items(enrich.overlaid(listed, found, "source_url"), PLACE)


def councils(pages: DataFrame, details: DataFrame, starts: DataFrame, as_of) -> DataFrame:
    """Source 3: listing pages by next link; a card without a detail page stays as listed."""
    cards = cut_lineage(extract.council_cards(pages.select("url", "html")), "cards")
    read = enrich.council_listed(_read_pages(cards, _followed(pages, starts, None)))
    listed = first_per_key(read, ["source_url"], list(PLACE))
    full = enrich.council_with_detail(listed, extract.council_details(_asked(details, listed)))
    return first_listed(normalise.council_items(full, as_of, extra=PLACE))


def topics(answers: DataFrame, hits: DataFrame, rate: DataFrame, as_of, page_size: int = fv.PORTAL_PAGE_SIZE) -> DataFrame:
    """Source 4: answers up to an empty or short page; details are asked for once per identifier."""
    read = landed.crawled_pages(answers, "crawl", "page_no", F.size("results"), page_size=page_size)
    records = landed.explode_results(read).withColumn("identifier", normalise.record_identifier(F.col("metadata")))
    records = records.where(F.col("identifier").isNotNull())
    details = landed.best_hits(landed.ask_once(records, hits, "identifier"))
    merged = normalise.merge_listing_and_detail(records, details)
    return first_listed(normalise.portal_items(merged, rate, as_of, extra=PLACE))


def brokered(answers: DataFrame) -> DataFrame:
    """Source 5: answers until as many ids are seen as announced; offers of source 2 are left out."""
    read = landed.crawled_pages(answers, "crawl", "page_no", F.size("results"))
    records = landed.explode_results(read).where(~F.coalesce(urls.is_partner_link(F.col("fundingUrl")), F.lit(False)))
    items = normalise.broker_items(records, extra=("crawl", "total", *PLACE))
    seen = landed.until_complete(items.where(F.col("id").isNotNull()), "crawl", "page_no", "id", "total")
    return first_listed(seen).drop("crawl", "total")
