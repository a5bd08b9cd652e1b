"""Dates: the text forms the sources use, and rules that compare with a day."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import squash, text_or_empty

_API_STAMP = (
    r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{1,6}(Z|[+-]\d{2}:?\d{2})$"
)
_ISO_STAMP = (
    r"^\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d{1,6})?)?)?([+-]\d{2}:?\d{2}|Z)?$"
)


# A failed parse costs an exception per row, so the shape is tested first.
_SHAPES = {
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{3,} \d{4}$",
    "MMMM d yyyy": r"^[A-Za-z]{4,} \d{1,2} \d{4}$",
    "MMM d yyyy": r"^[A-Za-z]{3} \d{1,2} \d{4}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
}


def _as_date(column: Column, pattern: str) -> Column:
    return F.when(column.rlike(_SHAPES[pattern]), F.try_to_date(column, pattern))


def long_date(column: Column) -> Column:
    """``1 June 2026``."""
    return _as_date(squash(column), "d MMMM yyyy")


def slash_date(column: Column) -> Column:
    """First ``01/06/2026`` in a text."""
    return _as_date(F.regexp_extract(squash(column), r"\d{2}/\d{2}/\d{4}", 0), "dd/MM/yyyy")


def loose_date(column: Column) -> Column:
    """``Jun 1st 2026``, ``June 1 2026``, ``1 June 2026``, ``2026-06-01`` or an ISO stamp.

    A stamp keeps the day written in it, whatever its offset.
    """
    plain = F.regexp_replace(squash(column), fv.ORDINAL_PATTERN, "$1")
    forms = [_as_date(plain, p) for p in ("MMM d yyyy", "MMMM d yyyy", "d MMMM yyyy", "yyyy-M-d")]
    stamp = F.when(plain.rlike(_ISO_STAMP), _as_date(F.substring(plain, 1, 10), "yyyy-M-d"))
    return F.coalesce(*forms, stamp)


def cell_date(machine: Column, shown: Column) -> Column:
    """Machine-readable date if it is one, else ``1 June 2026`` in the shown text."""
    text = squash(shown)
    low = F.lower(text)
    withheld = F.contains(low, F.lit(fv.NO_DATE_WORDS[0])) | F.contains(low, F.lit(fv.NO_DATE_WORDS[1]))
    written = _as_date(F.regexp_extract(text, r"\b\d{1,2} [A-Za-z]+ \d{4}\b", 0), "d MMMM yyyy")
    return F.coalesce(
        _as_date(F.substring_index(text_or_empty(machine), "T", 1), "yyyy-M-d"),
        F.when(~withheld, written))


def api_date(column: Column) -> Column:
    """``2026-06-01T00:00:00.000+0000`` or ``2026-06-01``; the local day of the offset."""
    stamp = F.when(column.rlike(_API_STAMP), _as_date(F.substring(column, 1, 10), "yyyy-M-d"))
    return F.coalesce(stamp, _as_date(column, "yyyy-M-d"))


def deadlines(stamps: Column) -> Column:
    """Distinct valid days of an array of stamps, earliest first."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(stamps, api_date))))


def current_deadline(days: Column, as_of: Column) -> Column:
    """Next deadline from ``as_of`` on, else the last one."""
    return F.coalesce(F.array_min(F.filter(days, lambda d: d >= as_of)), F.array_max(days))


def status_on(opened: Column, closes: Column, as_of: Column, rolling: bool = True, expired: bool = True) -> Column:
    """Status on a day.  ``rolling``/``expired`` switch off two of the outcomes."""
    chain = F.when(opened > as_of, "upcoming")
    if expired:
        chain = chain.when(closes < as_of, "expired")
    if rolling:
        chain = chain.when(closes.isNull(), "rolling")
    return chain.otherwise("open")


def shown_date(column: Column) -> Column:
    return F.coalesce(F.date_format(column, "dd/MM/yyyy"), F.lit(fv.NO_DATE_TEXT))


def shown_stamp(column: Column) -> Column:
    return F.coalesce(
        F.concat(F.date_format(column, "d MMMM yyyy, HH:mm"), F.lit(" UTC")), F.lit(fv.NEVER_UPDATED_TEXT))


def lenient_stamp(column: Column) -> Column:
    """ISO date or time stamp to a timestamp; null when it is neither."""
    ok = column.rlike(_ISO_STAMP) | column.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(ok, F.try_to_timestamp(column))


def lenient_day(column: Column) -> Column:
    return _as_date(column, "yyyy-M-d")


def lenient_number(column: Column) -> Column:
    """Finite number or null."""
    number = column.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
