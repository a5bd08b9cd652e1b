"""Periodic runs of words, found over a Re-Pair grammar of the texts.

A run is a stretch of consecutive words of one text with smallest period q, at least
``TIMES`` periods and ``LEAST`` words long, that no neighbouring word extends.  All runs
are found, exactly, in the words ``[^\\x20\\x09-\\x0D]+`` as they stand.

1. Texts are taken in slices of about a megabyte (or one longer text).  Re-Pair replaces
   repeated pairs of neighbouring symbols by new symbols, in rounds: each round counts
   all pairs of the slice and replaces every pair that occurs twice or more wherever no
   overlapping pair is more frequent.  When no pair repeats, what is left of each text is
   paired up as a balanced tree.  So every text hangs under one symbol, and equal
   stretches share theirs.
2. For each symbol, once, the runs that cross its boundary are computed at one of its
   places: such a run has two whole periods on one side, so a period must agree with the
   words around the boundary; what passes these tests is extended to both sides by
   halving, on hashes modulo 2^61 - 1.  Of one stretch the smallest period counts.
3. These runs are moved to all places of the symbol in the derivation.  A run may be cut
   at a symbol's edge; the whole run crosses the boundary of a symbol further up.
   Stretches of one period that lie within another are merged into it.

``find(docs)`` gives, per input row, the columns in ``keep``, ``n_words``, ``runs``
(``start``, ``length``, ``period`` in words, by start, then period) and ``text`` without the
words that a run holds after its first period, joined by one space.  Null and empty texts
have no words, no runs and an empty text.  Texts do not depend on each other: repeated
rows have equal results.  No row is sent anywhere; memory goes by the slice or longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._words import mix, slices, word_hashes, words

TIMES, LEAST = 4, 6
CHUNK = 1 << 20  # periods tested at once

_U64 = np.uint64
_PRIME = (1 << 61) - 1
_BASE = 0x0F3A9C1D5B7E2468 % _PRIME


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of values below it."""
    low, mid30 = _U64((1 << 31) - 1), _U64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> _U64(31), a & low, b >> _U64(31), b & low
    mid = a1 * b0 + a0 * b1
    return _fold((a1 * b1 << _U64(1)) + (mid >> _U64(30)) + ((mid & mid30) << _U64(31)) + a0 * b0)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _U64(_PRIME)) + (x >> _U64(61))
    return np.where(x >= _U64(_PRIME), x - _U64(_PRIME), x)


class _Stretches:
    """Equal stretches of words, by a running sum of hashes modulo 2^61 - 1."""

    def __init__(self, ids: np.ndarray):
        self.powers = np.ones(1, _U64)
        step = np.full(1, _BASE, _U64)
        while len(self.powers) <= len(ids):
            self.powers = np.concatenate([self.powers, _times(self.powers, step)])
            step = _times(step, step)
        value = _times(_fold(mix(ids.astype(_U64) + _U64(0x51ED27))), self.powers[:len(ids)])
        low, high = np.cumsum(value & _U64(0xFFFFFFFF), dtype=_U64), np.cumsum(value >> _U64(32), dtype=_U64)
        self.sums = np.zeros(len(ids) + 1, _U64)
        self.sums[1:] = _fold(_times(_fold(high), np.full(1, 1 << 32, _U64)) + _fold(low))

    def _span(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _fold(self.sums[start + size] + _U64(_PRIME) - self.sums[start])

    def alike(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How far the words from ``at`` equal those ``period`` later, ``most`` at most; with ``back``, those before."""
        low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
        factor = self.powers[period]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            size = (low[open_] + high[open_] + 1) >> 1
            start = at[open_] - size if back else at[open_]
            same = _times(self._span(start, size), factor[open_]) == self._span(start + period[open_], size)
            low[open_] = np.where(same, size, low[open_])
            high[open_] = np.where(same, high[open_], size - 1)


class _Grammar:
    """Symbols with the words they span at one place (start, boundary, end), and all their places."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.spans, self.symbol, self.place = [], [], []
        self.count = int(ids.max()) + 1 if len(ids) else 0
        self.words = self.count
        at = np.arange(len(ids))
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        ends = first[1:][row] if len(ids) else at
        symbols = ids.astype(np.int64)
        while len(at) > 1:
            chosen, name = self._repeated_pairs(symbols, row)
            if not len(chosen):
                break
            symbols, at, row, ends = self._replace(symbols, at, row, ends, chosen, name)
        while len(at) > 1:
            inside = np.arange(len(at)) - np.searchsorted(row, row)
            chosen = np.flatnonzero((inside[:-1] % 2 == 0) & (row[:-1] == row[1:]))
            if not len(chosen):
                break
            symbols, at, row, ends = self._replace(symbols, at, row, ends, chosen, np.arange(len(chosen)))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.start, self.boundary, self.end = (join([s[k] for s in self.spans]) for k in range(3))
        self.symbol, self.place = join(self.symbol), join(self.place)

    def _repeated_pairs(self, symbols: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs are replaced in a round, and which pair each is."""
        key = symbols[:-1] * self.count + symbols[1:]
        key[row[:-1] != row[1:]] = -1
        _, pair, times = np.unique(key, return_inverse=True, return_counts=True)
        often = (times[pair] > 1) & (key >= 0)
        # More frequent pairs go first; among equally frequent ones a hash decides.
        rank = np.empty(len(times), np.int64)
        rank[np.lexsort((mix(np.arange(len(times))), times))] = np.arange(len(times))
        score = np.where(often, rank[pair], -1)
        left, right = np.concatenate([[-1], score[:-1]]), np.concatenate([score[1:], [-1]])
        # A symbol repeated many times makes a stretch of one pair: every second one is taken.
        begins = np.flatnonzero(score != left)
        inside = np.arange(len(score)) - begins[np.cumsum(score != left) - 1] if len(begins) else np.arange(len(score))
        chosen = np.flatnonzero(often & (inside % 2 == 0) & (score >= left) & (score >= right))
        return chosen, np.unique(pair[chosen], return_inverse=True)[1]

    def _replace(self, symbols, at, row, ends, chosen, name):
        bounds = np.where(np.concatenate([row[1:] == row[:-1], [False]]), np.concatenate([at[1:], [0]]), ends)  # where each symbol ends
        _, one = np.unique(name, return_index=True)
        own = chosen[one]
        self.spans.append((at[own], at[own + 1], bounds[own + 1]))
        self.symbol.append(name + (self.count - self.words))
        self.place.append(at[chosen])
        symbols = symbols.copy()
        symbols[chosen] = name + self.count
        self.count += len(one)
        stay = np.ones(len(at), bool)
        stay[chosen + 1] = False
        return symbols[stay], at[stay], row[stay], ends[stay]


def _crossing(ids: np.ndarray, grammar: _Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs over the boundary of each symbol, cut at its edges: symbol, start, end (in words at its place) and period."""
    equal, found = None, []
    size = grammar.end - grammar.start
    for after in (True, False):
        side = grammar.end - grammar.boundary if after else grammar.boundary - grammar.start
        most = np.where(size >= LEAST, np.minimum(size // TIMES, side // 2), 0)
        upto = np.cumsum(most)
        first = 0
        while first < len(most):
            # Some symbols with about CHUNK periods, or one symbol.
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + CHUNK, "right")))
            own = np.arange(first, last)[most[first:last] > 0]
            first = last
            if not len(own):
                continue
            symbol = np.repeat(own, most[own])
            period = np.arange(len(symbol)) - np.repeat(np.cumsum(most[own]) - most[own], most[own]) + 1
            b = grammar.boundary[symbol]
            # Two whole periods on one side, and one word more over the boundary.
            low = b if after else b - 2 * period
            for word in (lambda: low, lambda: low + period - 1, lambda: b - 1 if after else b - period):
                hit = np.flatnonzero(ids[word()] == ids[word() + period])
                symbol, period, b, low = symbol[hit], period[hit], b[hit], low[hit]
            if not len(symbol):
                continue
            equal = equal or _Stretches(ids)
            ahead = equal.alike(low, period, grammar.end[symbol] - low - period)
            back = equal.alike(low, period, low - grammar.start[symbol], back=True)
            start, end = low - back, low + period + ahead
            good = (end - start >= np.maximum(LEAST, TIMES * period)) & (start < b) & (b < end)
            found.append(tuple(x[good] for x in (symbol, start, end, period)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    symbol, start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, end, start, symbol))
    symbol, start, end, period = symbol[order], start[order], end[order], period[order]
    new = np.ones(len(order), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return symbol[new], start[new], end[new], period[new]


def runs_of(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of rows of words: start and end in the words of all rows, and period, by start, then period."""
    grammar = _Grammar(ids, first)
    symbol, start, end, period = _crossing(ids, grammar)
    # To all places of the symbol.
    order = np.argsort(grammar.symbol, kind="stable")
    places, edges = grammar.place[order], np.searchsorted(grammar.symbol[order], np.arange(len(grammar.start) + 1))
    count = edges[symbol + 1] - edges[symbol]
    which = np.repeat(np.arange(len(symbol)), count)
    place = places[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + edges[symbol][which]]
    move = place - grammar.start[symbol][which]
    start, end, period = start[which] + move, end[which] + move, period[which]
    # Of one period, what lies within another stretch goes.  Two texts share no word, so ends grow over texts.
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.maximum.accumulate(end + period * (len(ids) + 1)) if len(end) else end
    keep = np.ones(len(end), bool)
    keep[1:] = (end + period * (len(ids) + 1))[1:] > reach[:-1]
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name in keep]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            told = words(part)
            _, ids = np.unique(word_hashes(part, told.starts, told.ends), return_inverse=True)
            start, end, period = runs_of(ids, told.first)
            # A word goes if it lies in a run after its first period.
            n = len(told)
            gone = np.cumsum(np.bincount(start + period, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
            at = np.searchsorted(start, told.first)
            listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(start - told.first[np.searchsorted(told.first, start, "right") - 1]), pa.array(end - start), pa.array(period)], ["start", "length", "period"]))
            body, texts, stay = part.data.tobytes(), [], np.flatnonzero(~gone)
            starts, ends = told.starts[stay].tolist(), told.ends[stay].tolist()
            cuts = np.searchsorted(stay, told.first).tolist()
            for a, b in zip(cuts, cuts[1:]):
                texts.append(b" ".join([body[x:y] for x, y in zip(starts[a:b], ends[a:b])]).decode())
            yield pa.RecordBatch.from_arrays([*part.batch.columns[:-1], pa.array(np.diff(told.first).astype(np.int64)), listed, pa.array(texts, pa.string())],
                                             names=[*part.batch.schema.names[:-1], "n_words", "runs", "text"])

    return docs.select(*[F.col(f.name) for f in kept], F.col(text).alias("__text")).mapInArrow(run, shape)
