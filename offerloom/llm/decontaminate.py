"""Benchmark decontamination: items that a text holds, exactly or with some edits.

Texts and items are folded: A-Z lower-cased, every run of other ASCII than letters and
digits one blank.  A text holds an item when some stretch of it is within
``EDITS`` percent of the item's length in edit distance.

The CGK embedding walks over a string: step j writes the byte it stands on and moves on
or stays, as a random bit for (j, byte) says.  Strings at small edit distance fall into
step and write mostly the same bytes, so edit distance becomes Hamming distance.  A key
is a sample of ``SAMPLED`` of the first ``STEPS`` written bytes; ``REPEATS`` independent
walks and samples give a window several chances.  Windows start at every word of a text, at every character beside a
byte that is not ASCII, and within runs of ``LEAST`` bytes or more without a blank at places
their next bytes choose; an item is embedded from each such place of its own that leaves
room for the walk, so one clean stretch anywhere is enough; ``tests/llm`` measures the recall.  Windows drop out
of the walk as soon as no item has their sample so far.  A hit is checked by shared
5-grams, which loses nothing, then by the exact least edit distance between the item
and any stretch of the item-sized window around it.

Items are taken in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_BYTES``, and every
text is held against each block, so what is sent to the tasks is bounded.  A task holds
one slice of texts.

``matches(docs, items)`` gives one row per (text, item): the text's key, the item's id
and the distance.  Null and empty texts match nothing; items with fewer than ``LEAST``
folded bytes are found where the folded text holds them exactly, as whole words where
their ends are ASCII; items without letters match nothing.  Repeated rows each give their rows; items with
one text each match.  ``clean`` keeps the texts without a match, all columns, and adds none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._words import Slice, byte_hashes, slices

EDITS = 10
STEPS, SAMPLED, REPEATS = 32, 12, 4
LEAST = 32
GRAM, CELL_BITS = 5, 12
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
SEED = 20

_U64 = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("0"):ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)


def folded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts, each followed by a zero byte, and where each begins."""
    body, n = _FOLD[data], len(bounds) - 1
    keep = np.ones(len(body), bool)
    keep[1:] = (body[1:] != 32) | (body[:-1] != 32)
    inner = bounds[:-1][bounds[:-1] < len(body)]
    keep[inner] = body[inner] != 32  # no blank at the start of a text
    total = np.concatenate([[0], np.cumsum(keep)])[bounds]
    out = np.zeros(int(total[-1]) + n, np.uint8)
    row = np.repeat(np.arange(n), np.diff(total))
    out[np.arange(total[-1]) + row] = body[keep]
    return out, total + np.arange(n + 1)


def _begins(data: np.ndarray) -> np.ndarray:
    """Where a word of folded texts begins, or a character beside a byte that is not ASCII."""
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    edge = (before == 32) | (before == 0) | (before >= 128) | (data >= 128)
    return edge & (data != 0) & (data != 32) & ((data & 0xC0) != 0x80)


def _chosen(data: np.ndarray) -> np.ndarray:
    """One place in about eight, as the GRAM bytes from it on say."""
    return _cells(data) % 8 == 0


def _long_runs(data: np.ndarray) -> np.ndarray:
    """Which bytes lie in a run of LEAST or more bytes without a blank."""
    stops = np.concatenate([[-1], np.flatnonzero((data == 32) | (data == 0)), [len(data)]])
    return np.repeat(np.diff(stops) > LEAST, np.diff(stops))[:len(data)]


class _Walks:
    """Random bits and sampled steps of each repeat; the same everywhere, from one seed."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.moves = rng.integers(0, 2, (REPEATS, STEPS, 256)).astype(np.int64)
        self.moves[:, :, 0] = 0  # the end of a text is not passed
        self.sampled = [np.sort(rng.choice(STEPS, SAMPLED, replace=False)) for _ in range(REPEATS)]

    def keys(self, repeat: int, data: np.ndarray, starts: np.ndarray, allowed: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Keys of windows, the partial keys after each sampled byte, and which windows are left."""
        at, left = starts.copy(), np.arange(len(starts))
        key, partial = np.zeros(len(starts), _U64), []
        sampled = set(self.sampled[repeat].tolist())
        for step in range(int(self.sampled[repeat][-1]) + 1):
            byte = data[at]
            if step in sampled:
                key = (key ^ byte.astype(_U64) + _U64(1)) * _U64(0x9E3779B97F4A7C15)
                key ^= key >> _U64(29)
                if allowed is None:
                    partial.append(key)
                elif len(partial) % 2 == 1:
                    # A table of bits over part of the key; what it lets through wrongly goes out later.
                    fits = allowed[len(partial)][(key & _U64(0xFFFFF)).astype(np.int64)]
                    at, key, left, byte = at[fits], key[fits], left[fits], byte[fits]
                    partial.append(None)
                else:
                    partial.append(None)
            at += self.moves[repeat, step][byte]
        return key, partial, left


class _Items:
    """A block of items ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.walks, self.ids, self.texts = _Walks(), [], []
        self.short: dict[bytes, list[int]] = {}
        for ident, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            body, _ = folded(raw, np.array([0, len(raw)]))
            body = body[:-1].tobytes().strip(b" ")
            if len(body) >= LEAST:
                self.ids.append(ident)
                self.texts.append(body)
            elif body:
                self.short.setdefault(body, []).append(ident)
        self.sizes = sorted({len(t) for t in self.short})
        data = np.frombuffer(b"".join(t + b"\0" for t in self.texts), np.uint8)
        starts, owner, offset, base = [], [], [], 0
        for i, t in enumerate(self.texts):
            raw = np.frombuffer(t + b"\0", np.uint8)
            places = np.flatnonzero((_begins(raw) | _chosen(raw) & (raw != 32))[:len(t) - STEPS + 1])
            own = [0, *places[places > 0].tolist()]
            starts += [base + k for k in own]
            owner += [i] * len(own)
            offset += own
            base += len(t) + 1
        self.owner, self.offset = np.array(owner, np.int64), np.array(offset, np.int64)
        self.keys, self.orders, self.allowed = [], [], []
        for r in range(REPEATS):
            key, partial, _ = self.walks.keys(r, data, np.array(starts, np.int64)) if starts else (np.zeros(0, _U64), [np.zeros(0, _U64)] * SAMPLED, None)
            order = np.argsort(key, kind="stable")
            tables = []
            for p in partial:
                bits = np.zeros(1 << 20, bool)
                bits[(p & _U64(0xFFFFF)).astype(np.int64)] = True
                tables.append(bits)
            self.keys.append(key[order])
            self.orders.append(order)
            self.allowed.append(tables)
        self.edits = [EDITS * len(t) // 100 for t in self.texts]
        self.tables = [_table(t) for t in self.texts]
        self.marks = [_marks(t) for t in self.texts]

    def find(self, part: Slice) -> list[tuple[int, int, int]]:
        """(row, item id, distance) for each text of a slice and item it holds."""
        data, bounds = folded(part.data, part.bounds)
        if not len(data):
            return []
        begins = _begins(data)
        held = self._held(data, bounds, np.flatnonzero(begins))
        if not self.ids:
            return held
        starts = np.flatnonzero(begins | _long_runs(data) & _chosen(data) & (data != 0) & (data != 32))
        rows, items, places = [], [], []
        for r in range(REPEATS):
            key, _, left = self.walks.keys(r, data, starts, self.allowed[r])
            low, high = np.searchsorted(self.keys[r], key), np.searchsorted(self.keys[r], key, "right")
            hits = high - low
            which = np.repeat(np.arange(len(key)), hits)
            entry = self.orders[r][np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())]
            at = starts[left[which]]
            rows.append(np.searchsorted(bounds, at, "right") - 1)
            items.append(self.owner[entry])
            places.append(at - self.offset[entry])
        row, item, place = map(np.concatenate, (rows, items, places))
        # Hits on one item close to each other are one candidate.
        spot = (place + len(data)) // 16
        _, once = np.unique(np.stack([row, item, spot]), axis=1, return_index=True)
        once = once[np.argsort(item[once], kind="stable")]
        cells = _cells(data)
        best: dict[tuple[int, int], int] = {}
        for own in np.split(once, np.flatnonzero(np.diff(item[once])) + 1) if len(once) else ():
            k = int(item[own[0]])
            size, edits = len(self.texts[k]), self.edits[k]
            low = np.maximum(bounds[row[own]], place[own] - edits - 16)
            high = np.minimum(bounds[row[own] + 1] - 1, place[own] + size + edits + 16)
            # An edit spoils at most GRAM grams of the text's stretch, or leaves out one.
            least, wide = size - GRAM + 1 - (GRAM + 1) * edits, np.arange(size + 2 * edits + 32)
            for at in range(0, len(own), 1024):
                spots, end = low[at:at + 1024, None] + wide, high[at:at + 1024, None]
                shared = (self.tables[k][cells[np.minimum(spots, len(cells) - 1)]] & (spots < end)).sum(1)
                for j in (at + np.flatnonzero(shared >= least)).tolist():
                    found = least_distance(self.marks[k], size, data[low[j]:high[j]].tobytes(), edits)
                    if found <= edits:
                        r = int(row[own[j]])
                        best[r, k] = min(found, best.get((r, k), found))
        return held + [(r, self.ids[k], d) for (r, k), d in sorted(best.items())]

    def _held(self, data: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item id, 0) for each text and short item that stands in it exactly."""
        part, found = Slice(None, data, bounds), set()
        for size in self.sizes:
            texts = [t for t in self.short if len(t) == size]
            own = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.arange(1, len(texts) + 1) * size
            names = byte_hashes(Slice(None, own, np.array([0, len(own)])), ends - size, ends)
            at = starts[starts + size < len(data)]
            after = data[at + size]
            at = at[(after == 32) | (after == 0) | (after >= 128) | (data[at + size - 1] >= 128)]
            for place in at[np.isin(byte_hashes(part, at, at + size), names)].tolist():
                row = int(np.searchsorted(bounds, place, "right") - 1)
                found |= {(row, ident, 0) for ident in self.short.get(data[place:place + size].tobytes(), ())}
        return sorted(found)


def _cells(data: np.ndarray) -> np.ndarray:
    """A cell, of CELL_BITS bits, for the GRAM bytes from each place on."""
    wide = np.concatenate([data, np.zeros(GRAM - 1, np.uint8)]).astype(_U64)
    code = np.zeros(len(data), _U64)
    for i in range(GRAM):
        code = code << _U64(8) | wide[i:i + len(data)]
    return (code * _U64(0x9E3779B97F4A7C15) >> _U64(64 - CELL_BITS)).astype(np.int64)


def _table(item: bytes) -> np.ndarray:
    """Which cells an item's grams fall into."""
    table = np.zeros(1 << CELL_BITS, bool)
    table[_cells(np.frombuffer(item, np.uint8))[:len(item) - GRAM + 1]] = True
    return table


def _marks(item: bytes) -> dict[int, int]:
    marks: dict[int, int] = {}
    for i, c in enumerate(item):
        marks[c] = marks.get(c, 0) | 1 << i
    return marks


def least_distance(marks: dict[int, int], size: int, window: bytes, enough: int) -> int:
    """The least edit distance between an item and any stretch of a window, by bit sets of the table's steps."""
    full, top = (1 << size) - 1, 1 << size - 1
    up, down, score = full, 0, size
    best, get = size, marks.get
    for c in window:
        same = get(c, 0)
        across = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(across | up) & full, up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        # A match may begin anywhere, so the top row stays zero.
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(across | plus) & full, plus & across
    return best


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    told = items.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("body")).where("body is not null")
    count, size = told.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    base = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = docs.schema[key].dataType.simpleString()

    def search(rows: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Items(rows)
            for part in slices(batches, "__text"):
                found = block.find(part)
                at = pa.array([r for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.batch.column(0).take(at), pa.array([i for _, i, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.int64())],
                                                 names=[key, item, "distance"])
        return base.mapInArrow(run, f"`{key}` {kind}, `{item}` bigint, distance bigint")

    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in told.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b).orderBy("item", "body").collect()]  # one bounded block
        out = search(rows) if out is None else out.union(search(rows))
    return out


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts that hold no item; texts are told apart by key and content, so null and repeated keys do no harm."""
    names = docs.columns
    marked = docs.withColumn("__mark", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    leaks = matches(marked, items, "__mark", text).select("__mark").distinct()
    return marked.join(leaks, "__mark", "left_anti").select(*names)
