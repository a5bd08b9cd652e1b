"""Where an offer applies and who may apply: ordered text rules as one expression.

The tests take a padded key (``functions.text.padded_key``) of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.text import has_phrase, has_words, none_if_empty, once, padded_key, phrase_key, strip, text_or_empty


def class_text(df: DataFrame, fields=fv.CLASS_TEXT_FIELDS) -> Column:
    """The classed fields the table has, one per line.

    Pass a shorter list to leave the transient fields out, so that a later
    re-classification of stored rows cannot differ from the first one.
    """
    have = set(df.columns)
    parts = [text_or_empty(F.col(f).cast("string")) for f in fields if f in have]
    return F.concat_ws("\n", *parts)


def _any_phrase(keyed: Column, phrases, pattern: str | None) -> Column:
    test = has_phrase(keyed, phrases)
    return test | keyed.rlike(pattern) if pattern else test


def _first_of(chain, otherwise: Column) -> Column:
    """First matching rule's value, from (test, value) pairs."""
    built = reduce(lambda acc, rule: (acc if acc is not None else F).when(rule[0], F.lit(rule[1])), chain, None)
    return built.otherwise(otherwise)


def place_of_words(location: Column) -> Column:
    """Place named in a location phrase; null when none is."""
    def place(keyed: Column) -> Column:
        rules = [(has_phrase(keyed, words), name) for name, words in fv.PLACE_WORDS]
        rules.append((keyed.rlike(fv.PLACE_EAST_PATTERN), "england_east"))
        rules.append((has_phrase(keyed, ("england",)), "england"))
        return _first_of(rules, F.lit(None).cast("string"))

    return once(phrase_key(location), place)


def stated_place(keyed: Column) -> Column:
    """Place after "based in" and the like; a pattern that names no place yields to the next."""
    found = F.coalesce(*[
        place_of_words(none_if_empty(F.regexp_extract(keyed, p, 1))) for p in fv.PLACE_EXPLICIT_PATTERNS])
    # Every pattern holds one of these marks; most texts hold none.
    return F.when(has_words(keyed, fv.PLACE_EXPLICIT_MARKS), found)


def place_by_phrase(keyed: Column, phrases=fv.PLACE_PHRASES) -> Column:
    """Place by the names of funders and funds, in order; the whole country otherwise."""
    return _first_of([(_any_phrase(keyed, p, rx), place) for place, p, rx in phrases], F.lit(fv.UK_WIDE))


def place_from_key(keyed: Column, source: Column, phrases=fv.PLACE_PHRASES) -> Column:
    fixed = F.lower(strip(text_or_empty(source))).isin(*fv.EU_SOURCES)
    by_phrase = place_by_phrase(keyed, phrases)
    return F.when(fixed, F.lit(fv.UK_WIDE)).when(F.trim(keyed) == "", F.lit(fv.UNKNOWN_PLACE)).otherwise(
        F.coalesce(stated_place(keyed), by_phrase))


def is_partnership(keyed: Column) -> Column:
    return has_words(keyed, fv.PARTNERSHIP_WORDS)


def is_personal(keyed: Column) -> Column:
    return has_words(keyed, fv.PERSONAL_WORDS)


def is_business_programme(keyed: Column) -> Column:
    return has_phrase(keyed, fv.BUSINESS_PHRASES)


def names_council(keyed: Column) -> Column:
    return has_phrase(keyed, fv.COUNCIL_NAMES)


def needs_academic_partner(keyed: Column) -> Column:
    return keyed.rlike(fv.PARTNER_NEEDED_PATTERN)


def applicant_set(values: Column) -> Column:
    """Values in fixed order, joined by commas; ``any`` when empty or among them."""
    ordered = F.filter(
        F.array(*[F.lit(v) for v in fv.APPLICANT_ORDER]), lambda v: F.array_contains(values, v))
    return F.when((F.size(values) == 0) | F.array_contains(values, fv.ANY_APPLICANT), F.lit(fv.ANY_APPLICANT)).otherwise(
        F.array_join(ordered, ","))


def stated_applicants(keyed: Column) -> Column:
    """Applicant kinds named in the text, if it speaks of applying at all."""
    kinds = [F.when(has_words(keyed, words), F.lit(kind)) for kind, words in fv.APPLICANT_WORDS]
    return F.when(has_words(keyed, fv.APPLICANT_GATE_WORDS), F.array_compact(F.array(*kinds))).otherwise(
        F.array().cast("array<string>"))


def applicants_from_key(keyed: Column, source: Column) -> Column:
    low = F.lower(strip(text_or_empty(source)))
    academic = dict(fv.APPLICANT_WORDS)["academic"]
    joint = has_words(keyed, academic) & has_words(keyed, fv.APPLICANT_GATE_WORDS) & needs_academic_partner(keyed)
    return (
        F.when((F.trim(keyed) == "") | low.isin(*fv.EU_SOURCES), F.lit(fv.ANY_APPLICANT))
        .when(is_partnership(keyed), F.lit("business,academic"))
        .when(is_personal(keyed), F.when(
            has_phrase(keyed, fv.PERSONAL_ACADEMIC_PHRASES), F.lit("academic,individual")).otherwise(F.lit("individual")))
        .when(low.isin(*fv.BUSINESS_SOURCES) | is_business_programme(keyed),
              F.when(joint, F.lit("business,academic")).otherwise(F.lit("business")))
        .otherwise(once(stated_applicants(keyed), lambda stated: (
            F.when(F.size(stated) > 0, applicant_set(stated))
            .when(names_council(keyed), F.lit("academic")).otherwise(F.lit(fv.ANY_APPLICANT))))))


def classify(df: DataFrame, fields=fv.CLASS_TEXT_FIELDS, keep_given: bool = False) -> DataFrame:
    """Set both class columns.  The text is keyed once and shared by all rules."""
    keyed = df.withColumn("_keyed", padded_key(class_text(df, fields)))
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    place = place_from_key(F.col("_keyed"), source)
    who = applicants_from_key(F.col("_keyed"), source)
    if keep_given:
        place = F.coalesce(F.nullif(F.col("geographic_scope"), F.lit("")), place)
        who = F.coalesce(F.nullif(F.col("eligible_applicants"), F.lit("")), who)
    return keyed.withColumns({"geographic_scope": place, "eligible_applicants": who}).drop("_keyed")


def reclassify(base: DataFrame, fields=fv.CLASS_TEXT_FIELDS) -> DataFrame:
    """Classify stored rows again.

    ``_place_changed`` and ``_who_changed`` mark the rows whose class of that kind
    differs, ``_changed`` those with either.
    """
    before = base.withColumns({"_old_place": F.col("geographic_scope"), "_old_who": F.col("eligible_applicants")})
    after = classify(before, fields)
    marked = after.withColumns({
        "_place_changed": ~F.col("_old_place").eqNullSafe(F.col("geographic_scope")),
        "_who_changed": ~F.col("_old_who").eqNullSafe(F.col("eligible_applicants"))})
    return marked.withColumn("_changed", F.col("_place_changed") | F.col("_who_changed")).drop("_old_place", "_old_who")


def reclassify_report(result: DataFrame, column: str = "geographic_scope") -> DataFrame:
    """Rows per class, and those that changed in this kind of class."""
    flag = {"geographic_scope": "_place_changed", "eligible_applicants": "_who_changed"}.get(column, "_changed")
    return result.groupBy(column).agg(
        F.count("*").alias("rows_seen"), F.count_if(F.col(flag)).alias("rows_changed"))
