"""Copies of one offer across sources.

Rows are ranked by (source priority, title, id).  Walking down that ranking, a row
that shares any key with an earlier *kept* row is a duplicate, and a duplicate's
other keys count for nothing.  This is the lexicographically first maximal
independent set of the "shares a key" graph, not its connected components.

It is worked out in rounds over (key, row) edges, never over pairs of rows
(Blelloch, Fineman, Shun: "Greedy sequential maximal independent set and matching
are parallel on average", SPAA 2012):

1. every key finds its lowest undecided rank,
2. an undecided row that is lowest on all of its keys is kept,
3. undecided rows on a kept row's keys are duplicates and leave with their edges,
4. until nothing is undecided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import urls
from ..functions.dates import status_on
from ..functions.text import once, text_or_empty, words_key
from ..model import DEFAULT_BOOK, SourceBook
from ..session import cut_lineage

HOT_SHARE = 1000


def canonical_keys(url: Column, description: Column, title: Column, closes: Column,
                   partner_host: str = fv.CONNECT_HOST, generic_path: str = fv.CONNECT_GENERIC_PATH) -> Column:
    """Distinct keys of a row: its links, ids inside them, and title with closing day."""
    both = F.concat_ws("\n", text_or_empty(url), text_or_empty(description))
    links = F.regexp_extract_all(both, F.lit(f"({fv.FREE_TEXT_URL_PATTERN})"), F.lit(1))

    def tagged(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f"{tag}:"), value)

    def keys_of(link: Column) -> Column:
        def keys(parts: Column) -> Column:
            generic = F.lower(parts["host"]).endswith(partner_host) & parts["path"].startswith(generic_path)
            return F.array(
                F.when(~generic, tagged("url", urls.key_of_parts(parts))),
                tagged("ifs", urls.competition_of(link)), tagged("iukbc", urls.slug_of_path(parts["path"])))

        return once(urls.parts_of(link), keys)

    own = F.array(
        tagged("ifs", urls.competition_of(url)), tagged("iukbc", urls.offer_slug(url)),
        F.when(text_or_empty(title) != "",
               F.concat(F.lit("title-close:"), words_key(title), F.lit(":"), closes.cast("string"))))
    return F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform(F.array_distinct(links), keys_of)), own)))


def shares_key(keys: Column, others) -> Column:
    """Whether a row's keys meet some given ones; false for a row without keys."""
    return F.coalesce(F.size(F.array_intersect(keys, F.array(*[F.lit(o) for o in others]))) > 0, F.lit(False))


def candidates(base: DataFrame, as_of) -> DataFrame:
    """Rows not closed on that day, whatever their status."""
    closes = F.col("closes_date")
    return base.where(closes.isNull() | (closes >= F.lit(as_of).cast("date")))


def ranked_keys(base: DataFrame, as_of, book: SourceBook = DEFAULT_BOOK, **key_options) -> DataFrame:
    """(id, rank, keys) of the candidates; ranks grow in (priority, title, id) order.

    A range-partitioned sort plus a partition-wise counter gives global ranks
    without a single-task window.  The result is written out, so the ranks cannot
    shift when a lost task is run again.
    """
    keyed = candidates(base, as_of).select(
        "id", book.priority_of(F.col("source")).alias("priority"), "title",
        canonical_keys(F.col("url"), F.col("description"), F.col("title"), F.col("closes_date"), **key_options).alias("keys"))
    # A range sort reads its input twice, once for the bounds: let that be a scan.
    ordered = cut_lineage(keyed, "keyed").orderBy("priority", "title", "id").select(
        "id", F.monotonically_increasing_id().alias("rank"), F.array_sort("keys").alias("keys"))
    return cut_lineage(ordered, "ranked")


def decide(ranked: DataFrame) -> DataFrame:
    """(id, rank, kept, owns_copy) for every (id, rank, keys) row of a written table.

    ``owns_copy`` marks a kept row that holds a key of a duplicate further down.
    Rounds go on until nothing is undecided.  They are few for any usual order but grow
    with the length of a chain of rows in bad order; each one decides at least the
    lowest undecided row of every connected group, so they end.
    """
    # Rows with one and the same key set share their fate after the first of them:
    # whichever row shuts that one out shuts them all out, else it does so itself.
    # Folding them (with map-side combine) takes whole groups of copies out early.
    folded = cut_lineage(
        ranked.where(F.size("keys") > 0).groupBy("keys").agg(
            F.min("rank").alias("rank"), F.max("rank").alias("top_rank"), F.count("*").alias("copies")), "folded")
    edges = folded.select("rank", F.explode("keys").alias("key"))

    # A key on one row only can shut nobody out.  Only shared keys go into the rounds.
    counts = edges.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = cut_lineage(counts, "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges")).first()["edges"]
    # Keys above a thousandth of the edges: at most a thousand of them exist, so
    # their table may be broadcast, and no task has to hold a hot key's edges.
    hot = shared.where(F.col("n") * HOT_SHARE > F.lit(total)).select("key")
    live = cut_lineage(_split(edges, shared, hot), "edges")

    held_parts, lost_parts = [], []
    while not live.isEmpty():
        lowest = live.groupBy("hot", "key").agg(F.min("rank").alias("low"))
        first = _with_key_value(live, lowest, "low").groupBy("rank").agg(
            F.bool_and(F.col("rank") == F.col("low")).alias("first"))
        flagged = cut_lineage(live.join(first, "rank"), "flagged")
        held = flagged.where("first").select("hot", "key", F.col("rank").alias("owner"))
        rest = flagged.where(~F.col("first")).drop("first")
        lost = _with_key_value(rest, held, "owner").groupBy("rank").agg(
            F.bool_or(F.col("owner").isNotNull()).alias("lost"))
        settled = cut_lineage(rest.join(lost, "rank"), "settled")
        held_parts.append(held.select("key", "owner"))
        lost_parts.append(settled.where("lost").select("rank").distinct())
        live = settled.where(~F.col("lost")).drop("lost")

    spark = ranked.sparkSession
    owners = _stack(spark, held_parts, "key string, owner bigint")
    losers = _stack(spark, lost_parts, "rank bigint")
    # A row set aside by the folding is a duplicate in any case: of its own first
    # copy if that one is kept, else of whoever shut the first copy out.
    first = folded.join(losers.withColumn("lost", F.lit(True)), "rank", "left").select(
        "keys", "rank", "top_rank", "copies", F.coalesce("lost", F.lit(False)).alias("lost"))
    own_copies = first.where(~F.col("lost") & (F.col("copies") > 1)).select("rank")
    lost_edges = first.where("lost").select("top_rank", F.explode("keys").alias("key"))
    below = lost_edges.groupBy("key").agg(F.max("top_rank").alias("top_rank"))
    others = owners.join(below, "key").where(F.col("top_rank") > F.col("owner")).select(F.col("owner").alias("rank"))
    with_copy = own_copies.union(others).distinct().withColumn("owns_copy", F.lit(True))
    first_kept = first.where(~F.col("lost")).select("rank", F.lit(True).alias("kept_first"))
    return (
        ranked.select("id", "rank", (F.size("keys") == 0).alias("_free"))
        .join(first_kept, "rank", "left").join(with_copy, "rank", "left")
        .select("id", "rank",
                (F.col("_free") | F.col("kept_first").isNotNull()).alias("kept"),
                F.coalesce("owns_copy", F.lit(False)).alias("owns_copy")))


def _stack(spark, parts: list[DataFrame], schema: str) -> DataFrame:
    whole = spark.createDataFrame([], schema)
    for part in parts:
        whole = whole.union(part)
    return whole


def _split(edges: DataFrame, shared: DataFrame, hot: DataFrame) -> DataFrame:
    """Edges of shared keys, with a mark for the (few) hot ones.

    The hot ones are found by a broadcast of bounded size and skip the shuffle.
    """
    marked = edges.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "key", "left")
    hot_edges = marked.where(F.col("_hot")).select(F.lit(True).alias("hot"), "key", "rank")
    cold = marked.where(F.col("_hot").isNull()).join(shared.select("key"), "key", "left_semi")
    return hot_edges.unionByName(cold.select(F.lit(False).alias("hot"), "key", "rank"))


def _with_key_value(edges: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Bring a per-key value to every edge; hot keys by broadcast, the rest by shuffle."""
    def part(flag: bool):
        return (edges.where(F.col("hot") == F.lit(flag)),
                values.where(F.col("hot") == F.lit(flag)).select("key", name))

    hot_edges, hot_values = part(True)
    cold_edges, cold_values = part(False)
    return hot_edges.join(F.broadcast(hot_values), "key", "left").unionByName(cold_edges.join(cold_values, "key", "left"))


def mark_duplicates(base: DataFrame, as_of, now, book: SourceBook = DEFAULT_BOOK, **key_options) -> DataFrame:
    """Duplicates become inactive; an inactive kept row that owns a duplicate is revived.

    ``_changed`` marks the rows whose status really changed.
    """
    fate = decide(ranked_keys(base, as_of, book, **key_options)).select(
        "id", F.when(~F.col("kept"), "duplicate").when(F.col("owns_copy"), "owner").alias("_fate"))
    inactive = F.col("status") == "inactive"
    shut = (F.col("_fate") == "duplicate") & ~inactive
    revived = (F.col("_fate") == "owner") & inactive
    again = status_on(F.col("opened_date"), F.col("closes_date"), F.lit(as_of).cast("date"), expired=False)
    changed = F.coalesce(shut | revived, F.lit(False))
    return base.join(fate.where(F.col("_fate").isNotNull()), "id", "left").withColumn("_changed", changed).withColumns({
        "status": F.when(F.col("_changed") & inactive, again).when(F.col("_changed"), F.lit("inactive"))
        .otherwise(F.col("status")),
        "last_seen": F.when(F.col("_changed"), F.lit(now).cast("timestamp")).otherwise(F.col("last_seen")),
    }).drop("_fate")


def shared_key_groups(ranked: DataFrame) -> DataFrame:
    """Every key on more than one row, with its row count and first rank."""
    return ranked.select("rank", F.explode("keys").alias("key")).groupBy("key").agg(
        F.count("*").alias("n"), F.min("rank").alias("first_rank")).where(F.col("n") > 1)
