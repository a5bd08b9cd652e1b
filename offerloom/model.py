"""Catalogue schema and the per-source differences, kept as parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from . import fixed_values as fv
from .functions.text import strip

CATALOGUE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("opened_date", T.DateType()),
    T.StructField("closes_date", T.DateType()),
    T.StructField("funding_min", T.DoubleType()),
    T.StructField("funding_max", T.DoubleType()),
    T.StructField("funding_currency", T.StringType()),
    T.StructField("funding_min_native", T.DoubleType()),
    T.StructField("funding_max_native", T.DoubleType()),
    T.StructField("exchange_rate", T.DoubleType()),
    T.StructField("exchange_rate_date", T.DateType()),
    T.StructField("sector_tags", T.StringType()),
    T.StructField("niche_tags", T.StringType()),
    T.StructField("geographic_scope", T.StringType()),
    T.StructField("eligible_applicants", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("last_seen", T.TimestampType()),
])
CATALOGUE_COLUMNS = tuple(CATALOGUE.fieldNames())
LATE_COLUMNS = (
    "funding_currency", "funding_min_native", "funding_max_native", "exchange_rate",
    "exchange_rate_date", "geographic_scope", "eligible_applicants",
)
MONEY_COLUMNS = (
    "funding_currency", "funding_min_native", "funding_max_native", "exchange_rate", "exchange_rate_date",
)
METADATA = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def lookup(column: Column, table: dict[str, object], default: Column) -> Column:
    """Constant-table lookup that stays inside generated code."""
    if not table:
        return default
    chain = None
    for key, value in table.items():
        chain = F.when(column == key, F.lit(value)) if chain is None else chain.when(column == key, F.lit(value))
    return chain.otherwise(default)


@dataclass(frozen=True)
class SourceBook:
    """What is known about source names: keys, labels, aliases, order, priority."""

    labels: dict[str, str]
    keys: dict[str, str]
    aliases: dict[str, tuple[str, ...]]
    order: dict[str, int]
    priority: dict[str, int]
    core: tuple[str, ...]

    def key_of(self, column: Column) -> Column:
        name = strip(F.coalesce(column, F.lit("")))
        return lookup(name, self.keys, name)

    def label_of(self, column: Column) -> Column:
        return lookup(column, self.labels, F.initcap(F.replace(column, F.lit("_"), F.lit(" "))))

    def order_of(self, column: Column) -> Column:
        return lookup(column, self.order, F.lit(fv.UNRANKED))

    def priority_of(self, column: Column) -> Column:
        return lookup(column, self.priority, F.lit(fv.UNRANKED))

    def expand(self, names: list[str]) -> list[str]:
        """Stored spellings behind the names a caller asked for."""
        wanted: list[str] = []
        for name in names:
            name = (name or "").strip()
            if not name:
                continue
            key = self.keys.get(name, name)
            wanted.extend(self.aliases.get(key, (key,)))
        return wanted


DEFAULT_BOOK = SourceBook(
    labels=fv.SOURCE_LABELS, keys=fv.SOURCE_KEYS, aliases=fv.SOURCE_ALIASES,
    order=fv.SOURCE_ORDER, priority=fv.SOURCE_PRIORITY, core=fv.CORE_SOURCES,
)

_EVERYTHING = tuple(c for c in CATALOGUE_COLUMNS if c != "id")


@dataclass(frozen=True)
class SourceSpec:
    """How one source's batches are merged into the catalogue."""

    name: str
    stored_names: tuple[str, ...]
    update_columns: tuple[str, ...] = _EVERYTHING
    insert_columns: tuple[str, ...] = CATALOGUE_COLUMNS
    rolling: bool = True
    marks_stale: bool = True
    touch_stale: bool = False
    on_empty: str = "skip"
    keep_enriched_text: bool = False
    purge_closed: bool = False
    notes_check: bool = False  # a run leaves a note of how many items it found


def _without(columns: tuple[str, ...], *dropped: str) -> tuple[str, ...]:
    return tuple(c for c in columns if c not in dropped)


SPECS = {
    "innovate_uk": SourceSpec(
        "innovate_uk", ("innovate_uk", "Innovate UK"),
        update_columns=_without(_EVERYTHING, *MONEY_COLUMNS, "funding_min", "funding_max", "sector_tags", "niche_tags"),
        insert_columns=_without(CATALOGUE_COLUMNS, *MONEY_COLUMNS, "funding_min", "funding_max", "sector_tags", "niche_tags"),
        rolling=False, marks_stale=False, keep_enriched_text=True, purge_closed=True),
    "iuk_business_connect": SourceSpec(
        "iuk_business_connect", ("iuk_business_connect",),
        update_columns=_without(_EVERYTHING, *MONEY_COLUMNS),
        insert_columns=_without(CATALOGUE_COLUMNS, *MONEY_COLUMNS)),
    "ukri": SourceSpec("ukri", ("ukri",), touch_stale=True),
    "horizon_europe": SourceSpec("horizon_europe", ("horizon_europe",), touch_stale=True, on_empty="stale_all"),
    "konfer": SourceSpec(
        "konfer", ("konfer", "Konfer"),
        update_columns=_without(_EVERYTHING, *MONEY_COLUMNS),
        insert_columns=_without(CATALOGUE_COLUMNS, *MONEY_COLUMNS), on_empty="stale_all", notes_check=True),
}
