"""Merkle manifest of a dataset, with proofs that recompute the levels that are not kept.

A leaf is the digest of a row's ``FIELDS``, each ``-`` if null, else its UTF-8 byte count,
``:`` and the value.  Rows of one ``source`` make one tree, leaves ascending by key (null
first; rows with one key by leaf digest).  Every ``FAN`` consecutive nodes become the
digest of their digests, concatenated as hexadecimal text, until one node remains, the
subroot.  The subroots, by source (null first, then bytewise), make one more tree: its last
node is the root.  A lone leaf is its own subroot, a lone subroot the root.

Checkpoint and recompute: of each tree only the leaves and every ``LEVELS``-th level above
them are written.  A proof is made from the top down: the aligned subtree over up to
``FAN ** LEVELS`` stored nodes is built again from them in one task, gives each of them
the siblings on its way up, and is dropped.  What lies above a subtree is one row,
brought to it by a cogrouped join, so no proof is copied over a shuffle.

Texts are hashed by built-in functions before anything moves; what moves is about 150
bytes a row.  Places within a tree come from a range sort and counts per partition, so a
source that holds a third of all rows is spread over partitions like the rest, and tasks
hold one aligned subtree.  Only the root and the largest tree's size come to the driver.

``manifest(docs, path)`` writes the tables, ``Manifest.proofs()`` gives one row per input
row, ``fold`` computes the root from a leaf and its proof.  Empty tables have a null root
and no proofs.  Null keys, texts and sources are values of their own.  Repeated rows are
leaves of their own, each with its own proof; they are told apart by place only.  Other
columns than ``FIELDS`` and those asked for with ``carry`` are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import fresh_path

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
LEVELS = 3  # one level in so many is written

NODE = "tree string, position bigint, nodes bigint, digest string"
NODE_COLUMNS = ("tree", "position", "nodes", "digest")


def _field(value: Column) -> Column:
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf(fields: dict[str, Column] | None = None) -> Column:
    """The digest of a row; ``fields`` replaces some of its values."""
    return F.sha2(F.concat(*[_field((fields or {}).get(name, F.col(name))) for name in FIELDS]), 256)


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _grow(level: list[str], steps: int) -> list[list[str]]:
    """A subtree from its stored nodes: the levels below each of ``steps`` steps, and the last one."""
    levels = [level]
    for _ in range(steps):
        levels.append([_digest(levels[-1][i:i + FAN]) for i in range(0, len(levels[-1]), FAN)])
    return levels


def _steps(nodes: int, every: int) -> int:
    """Levels to the next stored one, or to the top if that comes first."""
    steps = 0
    while steps < every and nodes > 1:
        nodes, steps = -(-nodes // FAN), steps + 1
    return steps


def _raise(table: pa.Table, every: int) -> pa.Table:
    """The one node over an aligned subtree."""
    table = table.sort_by("position")
    nodes, span = table.column("nodes")[0].as_py(), FAN ** every
    top = _grow(table.column("digest").to_pylist(), _steps(nodes, every))[-1]
    return pa.table({"tree": table.column("tree").slice(0, 1), "position": [table.column("position")[0].as_py() // span], "nodes": [-(-nodes // span)], "digest": top})


def _siblings(levels: list[list[str]], place: int) -> bytes:
    """A proof's part within one subtree: per level the node's number in its run, how many siblings, and those."""
    out = []
    for level in levels[:-1]:
        run, own = place // FAN * FAN, place % FAN
        others = level[run:run + own] + level[run + own + 1:run + FAN]
        out.append(bytes((own, len(others))) + bytes.fromhex("".join(others)))
        place //= FAN
    return b"".join(out)


def _descend(rows: pa.Table, above: pa.Table, every: int) -> pa.Table:
    """Proofs of the stored nodes of one subtree, from the proof of the node over them."""
    rows = rows.drop_columns(["block"]).sort_by("position")
    levels = _grow(rows.column("digest").to_pylist(), _steps(rows.column("nodes")[0].as_py(), every))
    rest, subroot = above.column("proof")[0].as_py(), above.column("subroot")[0].as_py()
    proofs = [_siblings(levels, i) + rest for i in range(rows.num_rows)]
    rows = rows.append_column("subroot", pa.array([subroot] * rows.num_rows, pa.string()))
    return rows.append_column("proof", pa.array(proofs, pa.binary()))


def steps_of(proof: bytes):
    """Per level from the leaf up: the node's number in its run, and its siblings as hexadecimal digests."""
    at = 0
    while at < len(proof):
        own, count = proof[at], proof[at + 1]
        at += 2
        yield own, [proof[at + 32 * i:at + 32 * i + 32].hex() for i in range(count)]
        at += 32 * count


def fold(digest: str, proof: bytes) -> str:
    """The root that a leaf's digest leads to."""
    for own, others in steps_of(proof):
        digest = _digest([*others[:own], digest, *others[own:]])
    return digest


def siblings_digest(proof: bytes) -> str:
    """The digest of all siblings of a proof, from the leaf's run up, left to right."""
    return _digest([digest for _, others in steps_of(proof) for digest in others])


def _placed(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Rows with ``position`` and ``nodes`` of their tree, by the order of (tree, order)."""
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/rows")  # the range sort reads its input twice
    ordered = spark.read.parquet(f"{path}/rows").repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered.withColumn("__at", F.monotonically_increasing_id()).write.parquet(f"{path}/sorted")
    ordered = spark.read.parquet(f"{path}/sorted").withColumn("__part", F.shiftright("__at", 33))
    # One row per tree and partition: few, and each tree's stand in the order of partitions.
    parts = ordered.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy("tree")
    before = F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("tree", "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("nodes"))
    return ordered.join(parts, ["tree", "__part"]).withColumn("position", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before")


def _block(every: int) -> Column:
    return F.floor(F.col("position") / FAN ** every).alias("block")


def _stored(spark: SparkSession, nodes: DataFrame, path: str, every: int) -> int:
    """Write the levels of all trees of ``nodes``; returns how many there are."""
    nodes.write.parquet(f"{path}/level=0")
    level = 0
    while True:
        below = spark.read.parquet(f"{path}/level={level}")
        if (below.agg(F.max("nodes")).first()[0] or 0) < 2:
            return level + 1
        above = below.where("nodes > 1").select(*NODE_COLUMNS, _block(every))
        level += 1
        above.groupBy("tree", "block").applyInArrow(lambda rows: _raise(rows, every), NODE).write.parquet(f"{path}/level={level}")


def _proofs(spark: SparkSession, path: str, levels: int, every: int, tops: DataFrame, carry: list[str]) -> DataFrame:
    """Proofs of all leaves of the trees at ``path``; ``tops(tree, subroot, proof)`` holds those of the last nodes.

    ``carry`` names columns of the leaves' table that come along.
    """
    proofs = None
    for level in reversed(range(levels)):
        stored = spark.read.parquet(f"{path}/level={level}")
        stored = stored.select(*NODE_COLUMNS, *(carry if level == 0 else ()))
        found = stored.where("nodes = 1").join(tops, "tree").select(*stored.columns, "subroot", "proof")
        if proofs is not None:
            blocks = stored.where("nodes > 1").withColumn("block", _block(every)).groupBy("tree", "block")
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
            found = found.union(blocks.cogroup(proofs.groupBy("tree", "position")).applyInArrow(lambda rows, above: _descend(rows, above, every), schema))
        proofs = found
    return proofs


@dataclass
class Manifest:
    spark: SparkSession
    path: str
    every: int
    levels: int  # stored ones of the trees of the sources
    forest_levels: int  # and of the tree over them
    root: str | None

    def proofs(self, carry: tuple[str, ...] = ()) -> DataFrame:
        """``tree``, ``position``, ``leaf``, ``subroot``, ``root`` and ``proof`` of each row, and the columns carried along."""
        spark, root = self.spark, F.lit(self.root).cast("string")
        last = spark.createDataFrame([("", self.root, b"")], "tree string, subroot string, proof binary")
        forest = _proofs(spark, f"{self.path}/forest", self.forest_levels, self.every, last, ["source_tree"])
        tops = forest.select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "proof")
        found = _proofs(spark, f"{self.path}/trees", self.levels, self.every, tops, list(carry))
        return found.drop("nodes").withColumnRenamed("digest", "leaf").withColumn("root", root)


def manifest(docs: DataFrame, path: str | None = None, carry: dict[str, Column] | None = None, every: int = LEVELS) -> Manifest:
    """Write the manifest of ``docs`` under ``path``; ``carry`` adds columns to the leaves' table, ``every`` says which levels are written."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "manifest")
    key, source = FIELDS[0], F.col(FIELDS[1]).cast("string")
    tree = F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))  # null first, then bytewise
    leaves = docs.select(tree.alias("tree"), F.col(key).cast("bigint").alias("__key"), leaf().alias("digest"), *[c.alias(n) for n, c in (carry or {}).items()])
    levels = _stored(spark, _placed(leaves, ["__key", "digest"], f"{path}/leaves"), f"{path}/trees", every)
    tops = None
    for level in range(levels):
        own = spark.read.parquet(f"{path}/trees/level={level}").where("nodes = 1").select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest")
        tops = own if tops is None else tops.union(own)
    forest_levels = _stored(spark, _placed(tops, ["source_tree"], f"{path}/subroots"), f"{path}/forest", every)
    root = spark.read.parquet(f"{path}/forest/level={forest_levels - 1}").where("nodes = 1").select("digest").first()
    return Manifest(spark, path, every, levels, forest_levels, root and root[0])
