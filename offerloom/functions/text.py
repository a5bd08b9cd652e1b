"""Text clean-up and phrase tests as column expressions."""

from __future__ import annotations

import html
from functools import reduce
from operator import or_
from typing import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

BLANKS = r"(?U)[\s\x1C-\x1F]+"
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` worked out a single time, however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def none_if_empty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def strip(column: Column) -> Column:
    """Without white space at either end, Unicode included."""
    return F.regexp_replace(column, f"^{BLANKS}|{BLANKS}$", "")


def squash(column: Column) -> Column:
    """Collapse every run of white space, Unicode included, to one blank."""
    return F.trim(F.regexp_replace(text_or_empty(column), BLANKS, " "))


def squash_lines(column: Column) -> Column:
    """``squash`` line by line; blank lines go, line breaks stay."""
    lines = F.transform(F.split(text_or_empty(column), LINE_BREAKS), squash)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


@F.pandas_udf(T.StringType())
def unescape(values: pd.Series) -> pd.Series:
    """Character references to characters; the table is the HTML standard's."""
    return values.map(lambda v: None if v is None else html.unescape(v))


def squash_unescaped(column: Column) -> Column:
    return squash(unescape(text_or_empty(column)))


def squash_markup(column: Column) -> Column:
    """Unescape, strip tags (comments, scripts and styles with their text), squash."""
    bare = F.regexp_replace(
        unescape(text_or_empty(column)), r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>|</?[a-z!][^>]*>", " ")
    return squash(unescape(bare))


def words_key(column: Column) -> Column:
    """Lower case, only a-z and 0-9 kept, single blanks: for titles and phrases."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(column)), "[^a-z0-9]+", " "))


def phrase_key(column: Column) -> Column:
    return words_key(F.replace(text_or_empty(column), F.lit("&"), F.lit(" and ")))


def phrase_literal(phrase: str) -> str:
    """``phrase_key`` of a constant, worked out once on the driver."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower().replace("&", " and "))
    return " ".join(kept.split())


def padded_key(column: Column) -> Column:
    """``phrase_key`` with a blank at both ends, so that whole words can be told."""
    return F.concat(F.lit(" "), phrase_key(column), F.lit(" "))


def has_phrase(keyed: Column, phrases) -> Column:
    """True where a keyed text holds any phrase, be it inside a word."""
    return reduce(or_, [F.contains(keyed, F.lit(phrase_literal(p))) for p in phrases])


def has_words(padded: Column, phrases) -> Column:
    """True where a padded key holds any phrase as whole words.

    Keyed text is a-z, 0-9 and single blanks, so this equals a word-boundary
    pattern and costs a plain byte search.
    """
    return reduce(or_, [F.contains(padded, F.lit(f" {phrase_literal(p)} ")) for p in phrases])


def join_filled(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither null nor empty."""
    return F.concat_ws(separator, *[none_if_empty(p) for p in parts])


def first_value(values: Column) -> Column:
    """First array element, an empty string included; null for an empty array."""
    return F.get(values, F.lit(0))


def first_n(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def head(column: Column, n: int) -> Column:
    return F.substring(column, 1, n)


def like_pattern(text: str, literal: bool = False) -> str:
    """Pattern for a "contains" test; ``%`` and ``_`` stay wild unless ``literal``."""
    body = text.strip().replace("\\", "\\\\")
    if literal:
        body = body.replace("%", "\\%").replace("_", "\\_")
    return f"%{body}%"


def contains_any_case(columns: list[Column], text: str, literal: bool = False) -> Column:
    pattern = F.lit(like_pattern(text, literal))
    return reduce(or_, [F.ilike(c, pattern, F.lit("\\")) for c in columns])
