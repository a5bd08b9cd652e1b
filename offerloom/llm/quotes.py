"""Quotation linking in message threads, in built-in functions only.

A line's quote level is the number of ``>`` marks at its start, with blanks between
them.  A run of lines of one level is a passage; blank lines split it into paragraphs.
A paragraph is normalised (lower case, runs of white space to one space) and hashed.
A quoted paragraph belongs to the earliest message of the same scope that wrote a
paragraph with that hash itself, if it was written before.  A message replies to the
original of its shallowest linked quotes; of several, to the one with most quoted
characters, then to the later one.  Replies give each message its root and depth.

``thread(messages)`` gives one row per (scope, order) pair: the key columns,
``own_text`` (the lines of level 0, without the line that announces a quote),
``n_quoted`` and ``n_linked`` (paragraphs), ``parent``, ``root``, ``depth``.  Sorted by
scope, root, depth and order it reads in the order of replies.

Null and empty texts have no paragraphs; such a message is its own root unless it
quotes.  A row whose scope or order is null is left out, as nothing can name it.  Of
rows with one (scope, order) the least text counts.  Only minima and maxima are grouped, and
per-message arrays hold one message's lines, so no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

# What announces a quote, and the marks used between levels while parsing.
ANNOUNCES = r"^\s*(?:On .* wrote|Le .* a écrit|Am .* schrieb.*|El .* escribió)\s*:\s*$"
QUOTE = r"^[ \t]*>"
NEXT, OPEN = "\ue000", "\ue001"


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, r"^((?:[ \t]*+>)*+)", 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _content(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:[ \t]*+>)++[ \t]?", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\r\\f\\x0b]+", " "))


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__lines``: array of (level, line, announces), announcing only right before a deeper line."""
    raw = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n"), lambda s: F.struct(_level(s).alias("level"), _content(s).alias("line")))
    rows = messages.withColumn("__lines", raw)
    size = F.size("__lines")
    # Announcements stand in the line before a deeper one, or before a blank line and a deeper one.
    beside = F.arrays_zip(
        F.col("__lines").alias("own"), F.concat(F.slice("__lines", 2, size), F.array(F.lit(None))).alias("next"),
        F.concat(F.slice("__lines", 3, size), F.array(F.lit(None), F.lit(None))).alias("after"))
    deeper = lambda z: (z["next"]["level"] > z["own"]["level"]) | ((F.trim(z["next"]["line"]) == "") & (z["after"]["level"] > z["own"]["level"]))
    return rows.withColumn("__lines", F.transform(beside, lambda z: F.struct(
        z["own"]["level"].alias("level"), z["own"]["line"].alias("line"),
        (F.coalesce(deeper(z), F.lit(False)) & z["own"]["line"].rlike(ANNOUNCES)).alias("announces"))))


def own_text(lines: str = "__lines") -> Column:
    return F.trim(F.array_join(F.transform(F.filter(lines, lambda z: (z["level"] == 0) & ~z["announces"]), lambda z: z["line"]), "\n"), F.lit("\n \t\r"))


def paragraphs(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, level, chars, hash): the normalised paragraphs of parsed messages."""
    lines = F.filter("__lines", lambda z: ~z["announces"])
    rows = messages.select(*keys, lines.alias("__told"))
    pair = F.arrays_zip(F.col("__told").alias("own"), F.concat(F.array(F.lit(None)), F.slice("__told", 1, F.size("__told"))).alias("before"))
    clean = lambda c: F.translate(c, NEXT + OPEN, "  ")
    # One string with a mark wherever a paragraph begins: another level, or a blank line before.
    marked = F.array_join(F.transform(pair, lambda z: F.when(z["own"].isNull(), "").otherwise(F.concat(
        F.when(z["before"].isNull() | (z["before"]["level"] != z["own"]["level"]) | (F.trim(z["before"]["line"]) == ""),
               F.concat(F.lit(NEXT), z["own"]["level"].cast("string"), F.lit(OPEN))).otherwise("\n"), clean(z["own"]["line"])))), "")
    parts = rows.select(*keys, F.explode(F.split(marked, NEXT)).alias("__part")).where(F.contains("__part", F.lit(OPEN)))
    parts = parts.select(*keys, F.substring_index("__part", OPEN, 1).cast("int").alias("level"), normalised(F.substring_index("__part", OPEN, -1)).alias("__norm"))
    return parts.where("__norm <> ''").select(*keys, "level", F.length("__norm").alias("chars"), F.md5("__norm").alias("hash"))


def thread(messages: DataFrame, scope: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    named = messages.where(F.col(scope).isNotNull() & F.col(order).isNotNull()).groupBy(scope, order).agg(F.min(text).alias("__text"))
    base = parsed(named, "__text")
    base = base.withColumn("own_text", own_text())
    told = cut_lineage(paragraphs(base, [scope, order]), "paragraphs")
    first = told.where("level = 0").groupBy(scope, "hash").agg(F.min(order).alias("__origin"))
    quoted = told.where("level > 0").join(first, [scope, "hash"], "left").withColumn("__origin", F.when(F.col("__origin") < F.col(order), F.col("__origin")))
    weight = quoted.groupBy(scope, order, "level", "__origin").agg(F.sum("chars").alias("__chars"), F.count("*").alias("__n"))
    best = F.struct((-F.col("level")).alias("l"), F.col("__chars"), F.col("__origin").alias("o"))
    linked = weight.groupBy(scope, order).agg(
        F.sum("__n").alias("n_quoted"), F.coalesce(F.sum(F.when(F.col("__origin").isNotNull(), F.col("__n"))), F.lit(0)).alias("n_linked"),
        F.max(F.when(F.col("__origin").isNotNull(), best))["o"].alias("parent"))
    told_of = cut_lineage(base.select(scope, order, "own_text").join(linked, [scope, order], "left"), "messages")
    # Roots and depths by pointers that reach twice as far each round; what has reached its root rests.
    up = told_of.where("parent is null").select(scope, order, F.col(order).alias("root"), F.lit(0).cast("bigint").alias("depth"))
    open_rows = told_of.where("parent is not null").select(scope, order, F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth"))
    while not open_rows.isEmpty():
        known = up.withColumn("__done", F.lit(True)).unionByName(open_rows.withColumn("__done", F.lit(False)))
        above = known.select(scope, F.col(order).alias("root"), F.col("root").alias("__top"), F.col("depth").alias("__more"), "__done")
        moved = cut_lineage(open_rows.join(above, [scope, "root"]).select(scope, order, F.col("__top").alias("root"), (F.col("depth") + F.col("__more")).alias("depth"), "__done"), "up")
        up = up.unionByName(moved.where("__done").drop("__done"))
        open_rows = moved.where("not __done").drop("__done")
    return told_of.join(up, [scope, order]).select(
        scope, order, "own_text", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent", "root", "depth")
