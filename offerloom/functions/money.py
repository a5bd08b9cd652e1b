"""Amounts of money in free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from ..model import lookup
from .text import text_or_empty


def _amount(digits: Column, suffix: Column) -> Column:
    scale = lookup(F.lower(suffix), fv.MONEY_SCALE, F.lit(1.0))
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * scale


def first_amount(column: Column, pattern: str = fv.MONEY_PATTERN) -> Column:
    text = text_or_empty(column)
    return _amount(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))


def all_amounts(column: Column, pattern: str = fv.MONEY_PATTERN) -> Column:
    """Every amount, in text order; an empty array when there is none."""
    text = text_or_empty(column)
    digits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    suffixes = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.array_compact(F.zip_with(digits, suffixes, _amount))


def largest_amount(column: Column) -> Column:
    return F.array_max(all_amounts(column))


def pound_amount(column: Column) -> Column:
    return first_amount(column, fv.POUND_PATTERN)


def pound_range(column: Column) -> tuple[Column, Column]:
    amounts = all_amounts(column, fv.POUND_PATTERN)
    return F.array_min(amounts), F.array_max(amounts)


def convert(amount: Column, rate: Column) -> Column:
    """Amount in the other currency; null without an amount or with no (or zero) rate."""
    return amount * F.nullif(rate, F.lit(0.0))


def whole(amount: Column) -> Column:
    """Amount cut to whole units, with thousands separators."""
    return F.format_number(amount.cast("bigint"), 0)
