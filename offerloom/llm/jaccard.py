"""Jaccard join on word n-grams: a size-aware, heavy-light join, and the groups it links.

A text's set holds its distinct runs of ``size`` words (the whole text as one run if
it is shorter).  Texts with equal sets are one class, joined through one of them.

* Light sets, up to a boundary size, list all their subsets of the sizes that any
  partner must share; two light sets that link have one in common.
* Heavy sets go into inverted lists under their first elements only, in one global
  order with very frequent elements last; two sets that link share one of those.

The boundary is the size at which all subsets plus all postings are fewest.  Lists of
up to ``PAIRS_UP_TO`` sets give pairs, checked by size and by a parity bitmap whose
distance never exceeds the sets' difference; longer ones are checked pack against pack
and give spanning forests of what passes.  What is tied together forms clusters; a cluster's sets, in blocks of about
``BLOCK`` and bands of like size, are compared block against block with exact
intersections, and each comparison returns a spanning forest of its links.  So no task
holds a whole cluster, no pair table is made within a long list, and the components are
those of all links.

``link(docs)`` gives one row per input row: the columns named in ``keep``,
``n_shingles`` and ``component_id``, the least key reachable.  A null, empty or blank
text has no set and stands alone.  Rows are linked by their texts, so rows with one key
and different texts may lie in different components; a row without a key takes part and
gets the least key of its component, if there is one.  Ties need no order, as components
do not depend on one.  Sets go by 64-bit names, elements by 63-bit hashes, of
which 48 bits tell a cluster's elements apart.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, forget
from ._components import components
from ._packs import column, edges, forest, pack_edges
from ._words import Slice, byte_hashes, gram_hashes, gram_starts, mix, slices, words

BITMAP, FINE, LARGE = 512, 4096, 1000
MOST_LIGHT = 16  # the boundary is searched up to here, as subsets soon outnumber postings
PAIRS_UP_TO = 64
BLOCK = 256
FILTER_BITS = 1 << 25
MOST_FREQUENT = 200_000  # elements that the order puts last; any order gives the same links

_U64 = np.uint64
_LAST = _U64(1 << 63)


def least_overlap(percent: int, size: int) -> int:
    """What a partner must at least share with a set of ``size``."""
    return -(-percent * size // 100)


def most_different(percent: int, one, two):
    """The largest symmetric difference of linked sets of these sizes."""
    total = one + two
    return total - 2 * (-(-percent * total // (100 + percent)))


def _sets(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, by row, and the first of each row."""
    part = part.lowered()
    found = words(part)
    hashes, count = byte_hashes(part, found.starts, found.ends), np.diff(found.first)
    begins = gram_starts(found.first, size)
    rows, values = [found.rows()[begins]], [gram_hashes(hashes, begins, size)]
    for fewer in range(1, size):
        short = np.flatnonzero(count == fewer)
        rows.append(short)
        values.append(mix(gram_hashes(hashes, found.first[short], fewer) + _U64(fewer)))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(part) + 1))


def frequent(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Hashes of very frequent shingles, the most frequent last.

    Each slice of texts reports what occurs in two or more of its texts; Spark adds the
    reports, and those of 32 or more count.  At most ``MOST_FREQUENT`` come back.
    They only shape the order of elements, on which the result does not depend.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", 2 << 20):
            values, times = np.unique(_sets(part, size)[0], return_counts=True)
            often = times >= 2
            yield pa.RecordBatch.from_pydict({"shingle": values[often].view(np.int64), "times": times[often]})

    seen = docs.select(F.col(text).alias("__text")).mapInArrow(count, "shingle bigint, times bigint").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = seen.where(F.col("times") >= 32).orderBy(F.desc("times"), "shingle").limit(MOST_FREQUENT).select("shingle").collect()
    return np.array([r[0] for r in top], np.int64)[::-1].view(_U64)


class _Order:
    """Elements as keys in the global order; equal keys are equal elements."""

    def __init__(self, often: np.ndarray):
        by = np.argsort(often)
        self.values, self.place = often[by], by.astype(_U64)

    def keys(self, values: np.ndarray) -> np.ndarray:
        keys = values >> _U64(1)
        if len(self.values):
            at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
            late = self.values[at] == values
            keys[late] = _LAST + self.place[at[late]]
        return keys


def _ordered(part: Slice, size: int, order: _Order) -> tuple[np.ndarray, np.ndarray]:
    values, first = _sets(part, size)
    keys = order.keys(values)
    rows = np.repeat(np.arange(len(part)), np.diff(first))
    return keys[np.lexsort((keys, rows))], first


def _bitmaps(keys: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bit per cell, set when an odd number of elements falls into it; large sets have FINE cells."""
    row, cell = np.repeat(np.arange(len(sizes)), sizes), (mix(keys) & _U64(FINE - 1)).astype(np.int64)
    out: list[bytes] = [b""] * len(sizes)
    for large, cells in ((False, BITMAP), (True, FINE)):
        own = np.flatnonzero((sizes >= LARGE) == large)
        place = np.full(len(sizes), -1)
        place[own] = np.arange(len(own))
        taken = place[row] >= 0
        odd = np.bincount(place[row[taken]] * cells + cell[taken] % cells, minlength=len(own) * cells) & 1
        for i, m in zip(own.tolist(), np.packbits(odd.reshape(len(own), cells).astype(np.uint8), axis=1)):
            out[i] = m.tobytes()
    return out


class _Maps:
    """Bitmaps of several sets; fine ones also folded to the cells of the coarse ones."""

    def __init__(self, maps: list[bytes], sizes: np.ndarray):
        self.sizes, self.large = sizes, sizes >= LARGE
        self.coarse, self.fine = np.zeros((len(maps), BITMAP // 64), _U64), np.zeros((len(maps), FINE // 64), _U64)
        for i, m in enumerate(maps):
            whole = np.frombuffer(m, _U64)
            if self.large[i]:
                self.fine[i] = whole
            self.coarse[i] = np.bitwise_xor.reduce(whole.reshape(-1, BITMAP // 64), axis=0)

    def __getitem__(self, at):
        out = object.__new__(_Maps)
        out.sizes, out.large, out.coarse, out.fine = self.sizes[at], self.large[at], self.coarse[at], self.fine[at]
        return out


def _may_link(percent: int, one: _Maps, two: _Maps) -> np.ndarray:
    """Which sets, of like shape, are close enough in size and bitmap; never misses a link."""
    a, b = one.sizes, two.sizes
    most = most_different(percent, a, b)
    fits = (percent * np.maximum(a, b) <= 100 * np.minimum(a, b)) & (np.bitwise_count(one.coarse ^ two.coarse).sum(-1, dtype=np.int64) <= most)
    both = np.argwhere(fits & one.large & two.large)
    for at in range(0, len(both), 16384):
        where = tuple(both[at:at + 16384].T)
        left, right = (np.broadcast_to(x.fine, (*fits.shape, FINE // 64))[where] for x in (one, two))
        fits[where] = np.bitwise_count(left ^ right).sum(-1, dtype=np.int64) <= np.broadcast_to(most, fits.shape)[where]
    return fits


def subset_sizes(percent: int, size: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a light set lists, one for each size its larger partner may have."""
    return sorted({least_overlap(percent, m) for m in range(size, boundary + 1) if least_overlap(percent, m) <= size})


def best_boundary(percent: int, counts: dict[int, int]) -> int:
    """The light size up to which subsets and postings together are fewest; ``counts`` of sets by size up to MOST_LIGHT."""
    def cost(boundary: int) -> int:
        subsets = sum(n * sum(math.comb(s, k) for k in subset_sizes(percent, s, boundary)) for s, n in counts.items() if s <= boundary)
        postings = sum(n * (s - least_overlap(percent, s) + 1) for s, n in counts.items() if s >= least_overlap(percent, boundary + 1))
        return subsets + postings
    return min(range(0, MOST_LIGHT + 1), key=cost)


def _classes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit name per set, the same for equal sets; -1 marks an empty one."""
    total = np.concatenate([np.zeros(1, _U64), np.cumsum(mix(values))])
    other = np.concatenate([np.zeros(1, _U64), np.cumsum(mix(values + _U64(0x2545F4914F6CDD1D)))])
    name = mix((total[first[1:]] - total[first[:-1]]) ^ mix(other[first[1:]] - other[first[:-1]]) + np.diff(first).astype(_U64))
    return np.where(np.diff(first) > 0, (name >> _U64(1)).astype(np.int64), -1)


def link(docs: DataFrame, percent: int = 85, size: int = 4, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    order = _Order(frequent(docs, text, size))
    kept = [f for f in docs.schema.fields if f.name in keep and f.name != key]
    named = docs.select(*[F.col(f.name) for f in kept], F.col(key).cast("bigint").alias("__key"), F.col(text).alias("__text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            keys, first = _ordered(part, size, order)
            sizes, n = np.diff(first), len(part)
            maps = _bitmaps(keys, sizes)
            heads = [keys[a:a + (s if s <= MOST_LIGHT else s - least_overlap(percent, s) + 1)].tobytes() for a, s in zip(first[:-1].tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([
                *part.batch.columns[:-1], pa.array(sizes.astype(np.int64)), pa.array(_classes(keys, first)),
                pa.array(heads, pa.binary()), pa.array(maps, pa.binary())],
                names=[*part.batch.schema.names[:-1], "n_shingles", "node", "head", "bitmap"])

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "__key bigint, n_shingles bigint, node bigint, head binary, bitmap binary"])
    signed = cut_lineage(named.mapInArrow(sign, shape), "signatures")
    nodes = cut_lineage(signed.where("node >= 0").groupBy("node").agg(
        F.min("__key").alias("low_key"), F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap")), "nodes")
    counts = {r[0]: r[1] for r in nodes.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    boundary = best_boundary(percent, counts)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = least_overlap(percent, boundary + 1)
        for batch in batches:
            keys, node = [], []
            for a, n, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = np.frombuffer(head, _U64)
                listed = [own[:n - least_overlap(percent, n) + 1]] if n >= lowest else []
                if n <= boundary:
                    for k in subset_sizes(percent, n, boundary):
                        chosen = np.array(list(itertools.combinations(range(n), k)))
                        listed.append(mix(mix(own)[chosen].sum(1, dtype=_U64) + _U64(k)))
                for x in listed:
                    keys.append(x)
                    node.append(np.full(len(x), a))
            if keys:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys).view(np.int64), "node": np.concatenate(node)})

    heads, signed = signed, cut_lineage(signed.drop("head", "bitmap"), "names")

    # Copies of a set repeat its postings; a list counts only when it holds two different sets.
    postings = heads.where("node >= 0").select("node", "n_shingles", "head").mapInArrow(post, "key bigint, node bigint")
    lists = postings.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    members = cut_lineage(postings.join(lists, "key").distinct(), "members")
    forget(heads)
    sizes = members.groupBy("key").agg(F.count("*").alias("members"))
    members = cut_lineage(members.join(sizes, "key").join(nodes.select("node", "n"), "node"), "lists")
    few = members.where(F.col("members") <= PAIRS_UP_TO).select("key", "node", "n")
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("m"))
    pairs = few.join(other, "key").where("node < b").where(F.greatest("n", "m") * percent <= 100 * F.least("n", "m")).select(F.col("node").alias("a"), "b").distinct()
    maps = nodes.select("node", "n", "bitmap")
    pairs = pairs.join(maps.toDF("a", "na", "ma"), "a").join(maps.toDF("b", "nb", "mb"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                one, two = (_Maps(part.column(k + 2).to_pylist(), part.column(k).to_numpy()) for k in (2, 3))
                fits = pa.array(_may_link(percent, one, two))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(fits), part.column(1).filter(fits)], names=["a", "b"])

    def near_packs(one, two) -> pa.RecordBatch:
        packs = [p for p in (one, two) if p is not None]
        names = np.concatenate([column(p, "name") for p in packs])
        maps = [_Maps(p.values.field("bitmap").to_pylist(), column(p, "n")) for p in packs]
        hits = np.argwhere(_may_link(percent, maps[0][np.arange(len(maps[0].sizes))[:, None]], maps[-1][np.arange(len(maps[-1].sizes))[None]]))
        hits = hits[hits[:, 0] < hits[:, 1]] if two is None else hits + [0, len(maps[0].sizes)]
        return edges(forest(hits.tolist(), len(names)), names)

    tied = pairs.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(near, "a bigint, b bigint")
    many = members.where(F.col("members") > PAIRS_UP_TO).select("key", "node").join(maps, "node").select("key", F.col("node").alias("name"), "n", "bitmap")
    tied = tied.union(pack_edges(many, ["key"], ["n", "bitmap"], near_packs))
    tree = components(tied)
    forget(members)
    clusters = tree.union(tree.select(F.col("component").alias("node"), "component").distinct()).join(nodes.select("node", "n", "low_key"), "node")
    links = _compare(named, cut_lineage(clusters, "clusters"), order, percent, size)
    found = nodes.select("node", "low_key").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("low_key").alias("component_id"))
    named_groups = found.join(least, "component").select("node", "component_id")
    out = signed.join(named_groups, "node", "left")
    return out.select(F.col("__key").cast(docs.schema[key].dataType).alias(key), *[F.col(f.name) for f in kept], "n_shingles",
                      F.when(F.col("node") >= 0, F.col("component_id")).otherwise(F.col("__key")).cast(docs.schema[key].dataType).alias("component_id"))


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets."""
    out = np.zeros((len(one), len(two)), np.float32)
    a, b = np.concatenate(one), np.concatenate(two)
    shared, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    # Elements on one side only are in no intersection.
    both = (np.bincount(left, minlength=len(shared)) > 0) & (np.bincount(right, minlength=len(shared)) > 0)
    column = np.cumsum(both) - 1
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two))
    keep_a, keep_b = both[left], both[right]
    rows_a, col_a, rows_b, col_b = rows_a[keep_a], column[left[keep_a]], rows_b[keep_b], column[right[keep_b]]
    for low in range(0, int(both.sum()), 4096):
        grids = []
        for rows, cols, count in ((rows_a, col_a, len(one)), (rows_b, col_b, len(two))):
            inside = (cols >= low) & (cols < low + 4096)
            grid = np.zeros((count, 4096), np.float32)
            grid[rows[inside], cols[inside] - low] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def _short(keys: np.ndarray) -> bytes:
    """Elements as six bytes each, which tell a cluster's elements apart."""
    return mix(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(items: bytes) -> np.ndarray:
    out = np.zeros((len(items) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(items, np.uint8).reshape(-1, 6)
    return out.view(_U64).ravel()


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash over a column ``key``, of FILTER_BITS bits whatever the number of keys."""
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    words64 = keys.select(F.floor(place / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {FILTER_BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    got = words64.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(_U64)


def _compare(named: DataFrame, clusters: DataFrame, order: _Order, percent: int, size: int) -> DataFrame:
    """Links within clusters, as spanning forests of each comparison of two blocks.

    A filter of fixed size spares most texts without a cluster their second reading; what
    slips through it is dropped by the join.
    """
    # One block for a small cluster; else blocks by band of size, as a partner's size lies in the same band or the next.
    small = clusters.groupBy("component").agg((F.count("*") <= BLOCK).alias("small"))
    banded = clusters.join(small, "component").withColumn("band", F.when(F.col("small"), 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)))
    blocks = banded.groupBy("component", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = banded.join(blocks, ["component", "band"]).select("node", "component", "small", "band", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).alias("block"), "low_key")
    placed = cut_lineage(placed, "places")
    bits = _filter(placed.select(F.col("low_key").alias("key")).where("key is not null"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (bits[place // 64] >> (place % 64).astype(_U64)) & _U64(1) == 1
            for part in slices(iter([batch.filter(pa.array(hit))]), "__text"):
                keys, first = _ordered(part, size, order)
                yield pa.RecordBatch.from_arrays([
                    pa.array(_classes(keys, first)), pa.array(np.diff(first).astype(np.int64)), pa.array([_short(keys[a:b]) for a, b in zip(first[:-1], first[1:])], pa.binary()),
                    part.batch.column(1)], names=["node", "n", "items", "low_key"])

    # A text without a key has no place in the filter and goes through.
    place = F.pmod(F.xxhash64("__key"), F.lit(FILTER_BITS))
    keyed = named.where("__key is not null").select(place.alias("place"), F.col("__key"), "__text").mapInArrow(full, "node bigint, n bigint, items binary, low_key bigint")
    if placed.where("low_key is null").isEmpty():
        sets = keyed
    else:
        every = np.full(FILTER_BITS // 64, -1, np.int64).view(_U64)
        bits = bits | every
        sets = named.select(F.coalesce(place, F.lit(0)).cast("bigint").alias("place"), F.col("__key"), "__text").mapInArrow(full, "node bigint, n bigint, items binary, low_key bigint")
    sets = sets.join(placed.withColumnRenamed("low_key", "rep"), "node").where(F.col("low_key").eqNullSafe(F.col("rep")))
    packed = sets.groupBy("component", "small", "band", "block").agg(F.collect_list(F.struct("node", "n", "items")).alias("sets"))  # about BLOCK sets
    packed = cut_lineage(packed, "blocks")

    def links_of(one: list, two: list) -> pa.RecordBatch:
        lists = [[_long(x["items"]) for x in side] for side in (one, two)]
        common = _overlaps(*lists)
        total = np.array([x["n"] for x in one])[:, None] + np.array([x["n"] for x in two])[None]
        names, number = np.unique([x["node"] for x in one] + [x["node"] for x in two], return_inverse=True)
        hits = np.argwhere(100 * common >= percent * (total - common))
        hits[:, 1] += len(one)
        return edges(forest(number[hits].tolist(), len(names)), names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.column(0)[i].as_py()
                yield links_of(one, one if batch.num_columns == 1 else batch.column(1)[i].as_py())

    edge = "a bigint, b bigint"
    inside = packed.where("small").select("sets").mapInArrow(compare, edge)
    large = packed.where("not small").drop("small")
    place = large.select("component", "band", "block")
    meet = place.join(place.toDF("component", "band2", "block2"), "component").where("(band2 = band and block2 >= block) or band2 = band + 1")
    both = meet.join(large, ["component", "band", "block"]).join(large.toDF("component", "band2", "block2", "sets2"), ["component", "band2", "block2"])
    across = both.select("sets", "sets2").mapInArrow(compare, edge)
    return inside.union(across).where("a <> b")
