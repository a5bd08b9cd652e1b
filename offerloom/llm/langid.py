"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits; for each bit a binary classifier over
hashed byte n-grams says on which side a text lies.  The classifiers are naive Bayes:
their log-odds come from n-gram profiles per language, which Spark sums over all
training rows in one pass, so there is no sample and nothing iterates.  A text gets
the language whose codeword has the least loss over the bits, each bit weighted, per
language, by how well its classifier tells that language's side (from the profile's
mean and variance).  A small gap to the second codeword is flagged as ambiguous.

``fit(docs)`` learns from rows with a label and a text; a text without n-grams is
ignored.  ``predict(docs, model)`` gives one row per input row: the columns named in
``keep`` (but for clashing ones), ``lang_pred``, ``score`` (0 to 1), ``ambiguous``, ``second``.  A text that is
null, empty or has no letter is ``und`` with score 0; so is every text if nothing was
learned.  Ties go to the language first in byte order.  Repeated rows stay repeated;
columns that are not named are not read.

What reaches the driver is one profile per language (``BUCKETS`` numbers); more than
``max_languages`` languages raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._words import slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
CHUNK = 1 << 12
ROWS = 16
SCALE = 1 << 24  # profiles are summed as integers, so that their sum does not depend on the order
AMBIGUOUS = 0.15
SHARPNESS = 8.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def profiles(part) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of each row of a slice (rows x BUCKETS, float32) and their sums."""
    data, n = _FOLD[part.data].astype(np.uint32), len(part)
    sizes = np.diff(part.bounds)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, sizes)
    left = np.repeat(part.bounds[1:], sizes) - np.arange(len(data))
    cells, gram = [], np.zeros(len(data), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(data) < order:
            break
        gram = (gram[:len(data) - order + 1] << np.uint32(8)) | data[order - 1:]
        if order in ORDERS:
            # Runs of blanks and marks say nothing.
            blank = 0
            for _ in range(order):
                blank = blank << 8 | 32
            inside = (left[:len(gram)] >= order) & (gram != blank)
            hashed = ((gram ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B))
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0xC2B2AE35)
            cells.append((row[:len(gram)] + (hashed >> np.uint32(17)))[inside])
    counts, rows = np.zeros((n, BUCKETS), np.float32), [c // BUCKETS for c in cells]
    for a in range(0, n, ROWS):  # a few rows at a time: the counts of all in 64 bits would be the most of a task's memory
        some = min(ROWS, n - a)
        own = [c[slice(*np.searchsorted(r, (a, a + some)))] - a * BUCKETS for r, c in zip(rows, cells)]
        counts[a:a + some] = np.bincount(np.concatenate(own) if own else np.zeros(0, np.int64), minlength=some * BUCKETS).reshape(some, BUCKETS)
    return counts, counts.sum(1)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A +1/-1 matrix, one row per class: all splits for up to seven classes, else a random code of good distance."""
    if classes < 2:
        return np.ones((classes, 0), np.int8)
    if classes <= 7:
        bits = 2 ** (classes - 1) - 1
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(bits)] for i in range(classes)], np.int8)
    rng, bits = np.random.default_rng(seed), math.ceil(15 * math.log2(classes))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        code = code[:, np.abs(code.sum(1 - 1)) < classes]
        overlap = code.astype(np.float32) @ code.T.astype(np.float32)
        distance = (code.shape[1] - (overlap - 10 ** 6 * np.eye(classes)).max()) / 2
        if distance > far:
            best, far = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits, divided by each bit's usual margin
    trust: np.ndarray  # languages x bits, rows sum to 1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest and second codeword, score and gap for each row of margins."""
        loss = np.maximum(0, 1 - margins[:, None, :] * self.code[None]) if self.code.shape[1] else np.zeros((len(margins), *self.code.shape))
        total = (loss * self.trust[None]).sum(2)
        order = np.argsort(total, axis=1, kind="stable")
        best = order[:, 0]
        low = total[np.arange(len(total)), best]
        score = 1 / np.exp(-SHARPNESS * (total - low[:, None])).sum(1)
        if len(self.languages) < 2:
            return best, best, score, np.ones(len(total))
        return best, order[:, 1], score, total[np.arange(len(total)), order[:, 1]] - low


def fit(docs: DataFrame, label: str = "lang", text: str = "text", max_languages: int = 256) -> Model:
    """Profiles of all labelled rows, summed by Spark; classifiers from the sums."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, "__text", 1 << 18, 128):
            counts, sizes = profiles(part)
            share = np.rint(counts * (SCALE / np.maximum(sizes, 1))[:, None])
            labels = np.array(part.batch.column(0).to_pylist(), object)
            for name in set(labels):
                sums[name] = sums.get(name, 0) + share[labels == name].sum(0, dtype=np.float64).astype(np.int64)
                if len(sums) > max_languages:
                    raise ValueError(f"more than {max_languages} languages")
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict({"__label": [name] * (BUCKETS // CHUNK), "chunk": list(range(BUCKETS // CHUNK)), "sums": [total[i:i + CHUNK].tobytes() for i in range(0, BUCKETS, CHUNK)]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("sums"))
        return pa.table({"__label": table.column("__label")[:1], "chunk": table.column("chunk")[:1], "sums": [total.tobytes()]})

    shape = "__label string, chunk bigint, sums binary"
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("__label"), F.col(text).alias("__text"))
    ways = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    partial = rows.mapInArrow(count, shape).groupBy("__label", "chunk", F.pmod(F.spark_partition_id(), F.lit(ways)).alias("way"))
    summed = partial.applyInArrow(lambda t: add(t.select(["__label", "chunk", "sums"])), shape).groupBy("__label", "chunk").applyInArrow(add, shape)
    found: dict[str, np.ndarray] = {}
    for name, chunk, body in summed.collect():  # one profile per language
        found.setdefault(name, np.zeros(BUCKETS))[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(bytes(body), np.int64)
    found = {k: v for k, v in found.items() if v.sum() > 0}
    languages = sorted(found)
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    share = np.stack([found[k] / found[k].sum() for k in languages]) + 1e-2 / BUCKETS
    share /= share.sum(1, keepdims=True)
    weights, trust = np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape)
    for b in range(code.shape[1]):
        side = code[:, b] > 0
        odds = np.clip(np.log(share[side].mean(0) / share[~side].mean(0)), -4, 4)
        mean = share @ odds
        spread = np.sqrt(np.maximum(share @ odds ** 2 - mean ** 2, 1e-12))
        # Between the sides' means lies the threshold; half their distance is margin 1.
        up, down = mean[side].mean(), mean[~side].mean()
        half = max((up - down) / 2, 1e-9)
        weights[:, b] = (odds - (up + down) / 2) / half
        signal = (mean - (up + down) / 2) * code[:, b] / spread * math.sqrt(8)
        trust[:, b] = [0.5 * (1 + math.erf(max(x, 0.05) / math.sqrt(2))) - 0.5 for x in signal]
    trust /= np.maximum(trust.sum(1, keepdims=True), 1e-12)
    return Model(languages, code, weights.astype(np.float32), trust)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    added = ("lang_pred", "score", "ambiguous", "second")
    kept = [f for f in docs.schema.fields if f.name in keep and f.name not in added]
    told = text if any(f.name == text for f in kept) else "__text"  # the texts are sent to Python once
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double", "ambiguous boolean", "second string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, told, 1 << 18, 128):
            counts, sizes = profiles(part)
            known = np.full(len(part), bool(model.languages))
            letters = ((part.data | 32) >= 97) & ((part.data | 32) <= 122)
            for i in np.flatnonzero(part.sums(letters) == 0):
                known[i] &= _has_letter(part.text(i))
            if model.languages:
                best, second, score, gap = model.decode((counts @ model.weights).astype(np.float64) / np.maximum(sizes, 1)[:, None])
                names = np.array(model.languages, object)
                first, other = names[best], names[second]
            else:
                first = other = np.full(len(part), "und", object)
                score = gap = np.zeros(len(part))
            yield pa.RecordBatch.from_arrays([
                *part.batch.columns[:len(kept)], pa.array(np.where(known, first, "und"), pa.string()), pa.array(np.where(known, score, 0.0)),
                pa.array(~known | (gap < AMBIGUOUS)), pa.array(np.where(known, other, None), pa.string())],
                names=[*part.batch.schema.names[:len(kept)], "lang_pred", "score", "ambiguous", "second"])

    return docs.select(*[f.name for f in kept], *([F.col(text).alias(told)] if told != text else [])).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """The rows kept from training: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
