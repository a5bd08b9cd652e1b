"""Substring deduplication: words in windows that start twice or more anywhere are removed.

A window is ``size`` consecutive words of one text.  Its anchor is the least hash among
the runs of ``ANCHOR`` words inside it, so equal windows have equal anchors, and a text
has about one anchor place per ``(size - ANCHOR) / 2`` words.

1. Texts are packed into blocks of about ``BLOCK_BYTES``, written once.
2. Each block sends a sparse count-min sketch of its anchor places, one part per shard;
   a shard adds them up into counters and answers each block with one bit per anchor:
   counted twice or more in both counter rows, or not.  A window that starts at two
   places has its anchor at two places, so the estimate never falls short.
3. Only windows whose anchor is estimated to repeat go on.  Shards group them exactly,
   by 128 bits of hash, and answer again with one bit per window.
4. Each block marks the covered words and gives back its texts without them.

Within a block equal anchors and windows are sent once, so a passage that a third of
all texts share is one row entry per block, not per text.  Shards grow in number with
the data, so their memory does not: nothing is broadcast or collected.  The number of
shards changes only how the work is split.

One row per input row: the columns named in ``keep``, ``n_words``, ``n_removed`` and
``text`` (the kept words joined by one space).  A null or empty text has no words and
gives an empty text.  A text with fewer than ``size`` words keeps all of them.  Repeated
rows count as separate texts, so all of their windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from ._words import Slice, byte_hashes, covered, gram_hashes, mix, slices, words

ANCHOR = 16
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 16 << 20  # text per shard of the sketch
FINER = 4  # shards of the exact pass per shard of the sketch

_U64 = np.uint64


def _pack(kept: int):
    """Blocks of texts as compressed Arrow streams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in slices(batches, "__text", BLOCK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part.batch)
            yield pa.RecordBatch.from_pydict({"block": [number], "size": [len(part.data)], "body": [sink.getvalue().to_pybytes()]})
            number += 1
    return run


def _unpack(body: bytes) -> Slice:
    """The texts of a block; a block is one slice, as it was packed."""
    (batch,) = list(pa.ipc.open_stream(body))
    (part,) = list(slices(iter([batch]), "__text", 1 << 62))
    return part


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least (or greatest) of each run of ``width`` values, in log2(width) steps."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


class _Windows:
    """Anchor places and windows of a block, in an order that depends on its texts alone."""

    def __init__(self, part: Slice, size: int):
        self.part, self.words, self.size = part, words(part), size
        count = np.maximum(np.diff(self.words.first) - size + 1, 0)
        first = self.words.first[:-1]
        self.begins = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        self.hashes = byte_hashes(part, self.words.starts, self.words.ends)
        width = size - ANCHOR + 1
        if len(self.begins):
            grams = gram_hashes(self.hashes, np.arange(len(self.words) - ANCHOR + 1), ANCHOR)
            self.least = _slide(grams, width, np.minimum)[self.begins]
            # A place is an anchor if some window over it has just its hash as the least one.
            best = np.zeros(len(grams) + 2 * width, _U64)
            best[self.begins + width - 1] = self.least
            highest = _slide(best, width, np.maximum)[:len(grams)]
            self.anchors, times = np.unique(grams[highest == grams], return_counts=True)
            self.anchor_twice = times > 1
        else:
            self.least = self.anchors = np.zeros(0, _U64)
            self.anchor_twice = np.zeros(0, bool)

    def suspects(self, marked: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is marked."""
        return self.begins[marked[np.searchsorted(self.anchors, self.least)]] if len(self.begins) else self.begins

    def exact(self, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows among ``begins`` by two hashes: both, whether found twice here, and the window of each start."""
        one, two = (gram_hashes(self.hashes, begins, self.size, k) for k in (0, 1))
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        at = order[new]
        return one[at], two[at], np.bincount(back, minlength=len(at)) > 1, back


def _shard(values: np.ndarray, shards: int) -> np.ndarray:
    return (mix(values) % _U64(shards)).astype(np.int64)


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(bits: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)


def _fill(answers, shards: np.ndarray) -> np.ndarray:
    """One flag per value, from one answer per shard with the flags of that shard's values in order."""
    flags = np.zeros(len(shards), bool)
    for answer in answers or ():
        own = np.flatnonzero(shards == answer["shard"])
        flags[own] = _mask(answer["bits"], len(own))
    return flags


SENT = "shard bigint, block bigint, one binary, two binary, twice binary"


def _send(shards: np.ndarray, count: int, block: int, one: np.ndarray, two: np.ndarray | None, twice: np.ndarray) -> pa.RecordBatch:
    rows = {"shard": [], "block": [], "one": [], "two": [], "twice": []}
    order = np.argsort(shards, kind="stable")
    edges = np.searchsorted(shards[order], np.arange(count + 1))
    for k in range(count):
        own = order[edges[k]:edges[k + 1]]
        if len(own):
            for name, value in (("shard", k), ("block", block), ("one", one[own].tobytes()), ("two", b"" if two is None else two[own].tobytes()), ("twice", _bits(twice[own]))):
                rows[name].append(value)
    return pa.RecordBatch.from_pydict(rows, pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("twice", pa.binary())]))


def _answer(decide):
    """A shard's answer to each block: ``decide`` flags all values it was sent."""
    def run(table: pa.Table) -> pa.Table:
        ones = [np.frombuffer(x.as_py(), _U64) for x in table.column("one")]
        twos = [np.frombuffer(x.as_py(), _U64) for x in table.column("two")]
        twice = [_mask(x.as_py(), len(one)) for x, one in zip(table.column("twice"), ones)]
        flags = decide(np.concatenate(ones), np.concatenate(twos), np.concatenate(twice))
        cuts = np.cumsum([len(x) for x in ones])[:-1]
        parts = [(s.as_py(), b.as_py(), _bits(f)) for s, b, f in zip(table.column("shard"), table.column("block"), np.split(flags, cuts)) if f.any()]
        return pa.table({"block": [b for _, b, _ in parts], "shard": [s for s, _, _ in parts], "bits": [f for _, _, f in parts]},
                        pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("bits", pa.binary())]))
    return run


def _estimate(values: np.ndarray, _, twice: np.ndarray) -> np.ndarray:
    """Count-min with two rows: a value counts as repeated when both of its cells hold two or more."""
    width = 1 << max(10, int(4 * len(values)).bit_length())
    flags = np.ones(len(values), bool)
    for shift in (0, 32):
        cells = ((mix(values) >> _U64(shift)) & _U64(min(width, 1 << 32) - 1)).astype(np.int64)
        flags &= (np.bincount(cells, minlength=1) + np.bincount(cells, twice, 1))[cells] >= 2
    return flags


def _group(one: np.ndarray, two: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which windows were sent by two blocks, or found twice by one."""
    order = np.lexsort((two, one))
    same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    number = np.concatenate([[0], np.cumsum(~same)])
    hit = (np.bincount(number) > 1) | (np.bincount(number, twice[order]) > 0)
    flags = np.empty(len(one), bool)
    flags[order] = hit[number]
    return flags


def remove_repeated(docs: DataFrame, size: int = 35, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Texts without the words of repeated windows; with ``digest``, their SHA-256 as ``kept_sha256`` instead."""
    if size < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words at least")
    kept = [f for f in docs.schema.fields if f.name in keep]
    named = docs.select(*[F.col(f.name) for f in kept], F.col(text).alias("__text"))
    blocks = cut_lineage(named.mapInArrow(_pack(len(kept)), "block bigint, size bigint, body binary"), "blocks")
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0), batch.column(1)):
                own = _Windows(_unpack(body.as_py()), size)
                yield _send(_shard(own.anchors, shards), shards, block.as_py(), own.anchors, None, own.anchor_twice)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Windows(_unpack(row["body"]), size)
                one, two, twice, _ = own.exact(own.suspects(_fill(row["marks"], _shard(own.anchors, shards))))
                yield _send(_shard(one, FINER * shards), FINER * shards, row["block"], one, two, twice)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Windows(_unpack(row["body"]), size)
                begins = own.suspects(_fill(row["marks"], _shard(own.anchors, shards))) if row["marks"] else own.begins[:0]
                one, _, _, back = own.exact(begins)
                again = begins[_fill(row["repeats"], _shard(one, FINER * shards))[back]]
                yield _result(own, covered(len(own.words), again, size))

    def _result(own: _Windows, gone: np.ndarray) -> pa.RecordBatch:
        first, part = own.words.first, own.part
        body, texts = part.data.tobytes(), []
        starts, ends = own.words.starts.tolist(), own.words.ends.tolist()
        stay = ~gone
        for i in range(len(part)):
            a, b = int(first[i]), int(first[i + 1])
            picked = range(a, b) if stay[a:b].all() else (a + np.flatnonzero(stay[a:b])).tolist()
            joined = b" ".join([body[starts[k]:ends[k]] for k in picked])
            texts.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        removed = np.concatenate([[0], np.cumsum(gone)])[first]
        return pa.RecordBatch.from_arrays(
            [*part.batch.columns[:-1], pa.array(np.diff(first).astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), pa.array(texts, pa.string())],
            names=[*part.batch.schema.names[:-1], "n_words", "n_removed", "kept_sha256" if digest else "text"])

    reply = "block bigint, shard bigint, bits binary"
    gather = lambda answers, name: answers.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias(name))  # noqa: E731  at most one per shard
    marks = gather(cut_lineage(blocks.select("block", "body").mapInArrow(sketch, SENT).groupBy("shard").applyInArrow(_answer(_estimate), reply), "marks"), "marks")
    sent = blocks.join(marks, "block").select("block", "body", "marks").mapInArrow(suspect, SENT)
    repeats = gather(cut_lineage(sent.groupBy("shard").applyInArrow(_answer(_group), reply), "repeats"), "repeats")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words bigint, n_removed bigint", "kept_sha256 string" if digest else "text string"])
    return blocks.join(marks, "block", "left").join(repeats, "block", "left").select("block", "body", "marks", "repeats").mapInArrow(finish, schema)
