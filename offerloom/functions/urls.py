"""Link keys, ids from links, and link building.

``parse_url`` is too strict for scraped links (it rejects ``%zz``) and drops
ports, so hosts and paths are cut out with plain patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import none_if_empty, once, strip, text_or_empty

_WITH_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)"
_ORIGIN = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def host_of(column: Column) -> Column:
    return F.regexp_extract(text_or_empty(column), _WITH_HOST, 1)


def path_of(column: Column) -> Column:
    """Path without query, fragment and last-segment parameters."""
    text = text_or_empty(column)
    raw = F.when(text.rlike(_WITH_HOST), F.regexp_extract(text, _WITH_HOST, 2)).otherwise(
        F.regexp_extract(F.regexp_replace(text, _SCHEME, ""), r"^[^?#]*", 0))
    return F.regexp_replace(raw, r";[^/]*$", "")


def parts_of(column: Column) -> Column:
    """Host and path as a struct, for several rules over one link."""
    return F.struct(host_of(column).alias("host"), path_of(column).alias("path"))


def key_of_parts(parts: Column) -> Column:
    """Lower-case host and path without closing slashes; null without a host."""
    return F.when(parts["host"] != "", F.lower(F.concat(parts["host"], F.rtrim(parts["path"], F.lit("/")))))


def slug_of_path(path: Column) -> Column:
    return none_if_empty(F.lower(F.regexp_extract(path, r"(?:^|/)opportunities/+([^/]+)/*$", 1)))


def link_key(column: Column) -> Column:
    return once(parts_of(strip(column)), key_of_parts)


def competition_of(column: Column) -> Column:
    """Id between ``/competition/`` and the slash that has to follow."""
    return none_if_empty(F.regexp_extract(text_or_empty(column), fv.COMPETITION_PATTERN, 1))


def competition_in_path(column: Column) -> Column:
    """Path part after the first ``competition`` part; no closing slash needed."""
    return none_if_empty(F.regexp_extract(text_or_empty(column), r"(?:^|/)competition/([^/]*)", 1))


def offer_slug(column: Column) -> Column:
    return slug_of_path(path_of(column))


def last_part_or_host(column: Column) -> Column:
    last = F.regexp_extract(path_of(column), r"([^/]*)/*$", 1)
    return F.when(last != "", last).otherwise(host_of(column))


def id_from_link(column: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), last_part_or_host(column))


def competition_number(record_id: Column) -> Column:
    return none_if_empty(F.regexp_extract(strip(text_or_empty(record_id)), r"^ifs:(\d+)$", 1))


def competition_link(record_id: Column) -> Column:
    return F.concat(F.lit(f"{fv.COMPETITION_BASE}/competition/"), competition_number(record_id), F.lit("/overview"))


def host_ends_with(column: Column, suffix: str) -> Column:
    return F.lower(host_of(column)).endswith(suffix)


def is_partner_link(column: Column, host: str = fv.CONNECT_HOST) -> Column:
    return host_ends_with(column, host)


def is_generic_partner_link(column: Column, host: str = fv.CONNECT_HOST, path: str = fv.CONNECT_GENERIC_PATH) -> Column:
    return host_ends_with(column, host) & path_of(column).startswith(path)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` parts of an absolute path."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, part: F.when(part == ".", acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(part))))
    tail = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), tail)


def resolve(base: Column, link: Column) -> Column:
    """Link seen on page ``base`` made absolute."""
    return once(link, lambda plain: _resolved(base, plain))


def _resolved(base: Column, link: Column) -> Column:
    origin = F.regexp_extract(base, _ORIGIN, 0)
    base_path = F.regexp_extract(base, _WITH_HOST, 2)
    folder = F.regexp_extract(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"^.*/", 0)
    link_path = F.regexp_extract(link, r"^[^?#]*", 0)
    rest = F.substr(link, F.length(link_path) + 1)
    rooted = F.when(link.startswith("/"), link_path).otherwise(F.concat(folder, link_path))
    clean = F.when(rooted.rlike(r"/\.{1,2}(/|$)"), _without_dots(rooted)).otherwise(rooted)
    return (
        F.when(link.rlike(_SCHEME), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 0), link))
        .when(link == "", base)
        .when(link.startswith("?"), F.concat(origin, base_path, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), link))
        .otherwise(F.concat(origin, clean, rest)))


def query_value(column: Column) -> Column:
    """Value as it stands in a query string."""
    return F.replace(F.replace(F.url_encode(column), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def portal_link(identifier: Column, record_type: Column, record_url: Column) -> Column:
    """Topic page, or the calls search for the record kinds that have no page."""
    pairs = [
        ("order", F.lit("DESC")), ("pageNumber", F.lit("1")), ("pageSize", F.lit("50")),
        ("sortBy", F.lit("relevance")), ("keywords", query_value(identifier)), ("isExactMatch", F.lit("true")),
        ("status", query_value(F.lit(",".join(fv.PORTAL_STATUSES)))),
        ("programmePeriod", query_value(F.lit(fv.PORTAL_PERIOD))),
        ("frameworkProgramme", F.lit(fv.PORTAL_PROGRAMME)), ("type", F.lit(fv.PORTAL_CALLS_TYPE)),
    ]
    search = F.concat_ws("&", *[F.concat(F.lit(f"{name}="), value) for name, value in pairs])
    listed = (record_type == fv.PORTAL_CALLS_TYPE) | F.contains(text_or_empty(record_url), F.lit(fv.PORTAL_CALLS_MARK))
    return F.when(F.coalesce(listed, F.lit(False)), F.concat(F.lit(fv.PORTAL_BASE + fv.PORTAL_CALLS_PATH), search)).otherwise(
        F.concat(F.lit(fv.PORTAL_BASE + fv.PORTAL_TOPIC_PATH), identifier))
