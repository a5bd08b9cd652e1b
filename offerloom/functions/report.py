"""Columns for reports and cards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .money import whole
from .text import squash, strip, text_or_empty


def closing_soon(status: Column, closes: Column, as_of: Column) -> Column:
    near = F.datediff(closes, as_of).between(0, fv.CLOSING_SOON_DAYS)
    return F.coalesce((status == "open") & near, F.lit(False))


def tag_list(sector_tags: Column, niche_tags: Column) -> Column:
    """Both comma lists as one array of trimmed tags."""
    def parts(column):
        filled = F.when(text_or_empty(column) != "", F.transform(F.split(column, ","), lambda t: strip(t)))
        return F.coalesce(filled, F.array().cast("array<string>"))

    return F.concat(parts(sector_tags), parts(niche_tags))


def clean_tags(tags: Column, label: Column) -> Column:
    """Codes and source names out, one prefix stripped, first few distinct tags."""
    own = F.lower(strip(text_or_empty(label)))

    def named(tag):
        low = F.lower(tag)
        return (low == own) | (low == fv.TAG_ALWAYS_DROPPED)

    trimmed = F.transform(tags, lambda t: strip(text_or_empty(t)))
    wanted = F.filter(trimmed, lambda t: (t != "") & ~t.rlike(fv.TAG_CODE_PATTERN) & ~named(t))
    bare = F.transform(wanted, lambda t: strip(F.regexp_replace(t, fv.TAG_PREFIX_PATTERN, "")))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: (t != "") & ~named(t))), 1, fv.TAG_LIMIT)


def word_chips(title: Column, summary: Column) -> Column:
    """Up to four longer words of title and summary, for rows without tags."""
    joined = F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(summary)))
    words = F.split(squash(F.regexp_replace(joined, fv.WORD_CHIP_BREAKS, " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= fv.WORD_CHIP_MIN_CHARS) & ~w.isin(*fv.WORD_CHIP_STOP))
    first = F.slice(F.array_distinct(kept), 1, fv.WORD_CHIP_LIMIT)
    return F.transform(first, lambda w: _first_letters_up(F.replace(w, F.lit("_"), F.lit(" "))))


def _first_letters_up(words: Column) -> Column:
    """Upper-case first letters of a lower-case text; unlike ``initcap``, sharp s becomes SS."""
    return F.array_join(F.transform(
        F.split(words, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def chips(title: Column, summary: Column, sector_tags: Column, niche_tags: Column, label: Column) -> Column:
    tags = clean_tags(tag_list(sector_tags, niche_tags), label)
    return F.when(F.size(tags) > 0, tags).otherwise(word_chips(title, summary))


def _span(low: Column, high: Column, unit: Column, no_low: str, no_high: str) -> Column:
    def shown(amount, text):
        return F.coalesce(F.concat(unit, F.lit(" "), whole(amount)), F.lit(text))

    return F.concat(shown(low, no_low), F.lit(" - "), shown(high, no_high))


def funding_text(currency: Column, low_native: Column, high_native: Column, low: Column, high: Column) -> Column:
    """Native range if there is one, else the converted range."""
    native = (text_or_empty(currency) != "") & (low_native.isNotNull() | high_native.isNotNull())
    plain = low.isNotNull() | high.isNotNull()
    return (
        F.when(native, _span(low_native, high_native, currency, "Not listed", "No upper limit"))
        .when(plain, _span(low, high, F.lit("GBP"), "Not listed", "No upper limit"))
        .otherwise(F.lit("Not listed")))


def converted_text(currency: Column, low_native: Column, high_native: Column, low: Column, high: Column) -> Column:
    """Second line under a range in another currency; null when there is none."""
    native = (text_or_empty(currency) != "") & (low_native.isNotNull() | high_native.isNotNull())
    shown_low = F.coalesce(F.concat(F.lit("approx GBP "), whole(low)), F.lit("approx GBP not listed"))
    shown_high = F.coalesce(F.concat(F.lit("GBP "), whole(high)), F.lit("GBP no upper limit"))
    return F.when(
        native & (currency != "GBP") & (low.isNotNull() | high.isNotNull()),
        F.concat(shown_low, F.lit(" - "), shown_high))


def eu_reference(source: Column, record_id: Column, *texts: Column) -> Column:
    """Call reference of an EU record: the first in its texts, else its id; empty for others."""
    bare = F.regexp_replace(record_id, "^horizon:", "")
    found = F.regexp_extract(F.concat_ws("\n", *[F.nullif(t, F.lit("")) for t in texts], bare), fv.EU_REFERENCE_PATTERN, 0)
    mine = (source == "horizon_europe") & record_id.startswith("horizon:")
    return F.when(mine, F.coalesce(F.nullif(found, F.lit("")), F.upper(bare))).otherwise(F.lit(""))
