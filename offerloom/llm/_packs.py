"""Comparison of the rows of a group, pack against pack, so that no task holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PACK = 512


def forest(pairs, count: int, verified=None) -> list[tuple[int, int]]:
    """A spanning forest of pairs; with ``verified``, only of those it confirms."""
    root = list(range(count))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y and (verified is None or verified(a, b)):
            root[y] = x
            out.append((a, b))
    return out


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def edges(pairs: list[tuple[int, int]], names: np.ndarray) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"a": names[at[:, 0]], "b": names[at[:, 1]]}, EDGE)


def column(value, part: str) -> np.ndarray:
    """One field of the rows of a pack."""
    return value.values.field(part).to_numpy()


def pack_edges(rows: DataFrame, keys: list[str], columns: list[str], compare) -> DataFrame:
    """Edges from ``compare(columns of one pack, of another or None)`` over the packs of each group."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1")
    placed = rows.join(sizes, keys).withColumn("pack", F.pmod(F.xxhash64("name", F.lit(5)), F.ceil(F.col("members") / PACK)))
    packed = placed.groupBy(*keys, "pack").agg(F.collect_list(F.struct("name", *columns)).alias("pack_rows"), F.first("members").alias("members"))  # about PACK rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield compare(batch.column(0)[i], batch.column(1)[i] if batch.num_columns > 1 else None)

    own = packed.select("pack_rows").mapInArrow(run, "a bigint, b bigint")
    large = packed.where(F.col("members") > PACK).drop("members")
    across = large.join(large.withColumnsRenamed({"pack": "pack2", "pack_rows": "pack_rows2"}), keys).where("pack < pack2").select("pack_rows", "pack_rows2").mapInArrow(run, "a bigint, b bigint")
    return own.union(across)
