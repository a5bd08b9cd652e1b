"""Quality rules on tokeniser fertility, beside plain counts of words, marks and repeats.

Every word of a text is encoded, with one space before it, by two public vocabularies:
a byte-level BPE and a piece vocabulary with byte fallback.  Per text this gives
characters per token, the share of piece tokens that are single-byte fallbacks, and the
entropy in bits of its piece tokens.  A text is rejected when one of them lies far out
of the band of its group: more than ``FENCES`` interquartile ranges (and at least a
share ``LEAST_WIDTH`` of the median) beyond the quartiles of all texts of the group that pass
the plain rules.  The group is the language label, or the main script where there is no
label.  Every group has its own band, whatever its size; with n passing texts the band's
width grows by the share ``FEW`` / n, for the quartiles of a few texts say little.

``measure`` gives the numbers, ``verdicts`` the decision; each returns one row per input
row.  Null and empty texts have no words and fail the plain rules.  Quantiles are Spark's
mergeable ones (error 1 in ``ACCURACY``) over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from ._words import byte_hashes, covered, gram_hashes, gram_starts, later_copies, lines, repeated, slices, spaces, words

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words in repeated windows
FENCES = 3.0
LEAST_WIDTH = {"chars_per_token": 0.5, "chars_per_piece": 0.5, "fallback_share": 0.5, "entropy": 0.25}
EVENNESS = 0.75  # a short text has little entropy: it counts as low only under this share of the most its tokens could have
FEW = 10
ACCURACY = 1000
WAYS = 64
CACHE = 300_000  # words remembered by a task (memory bound, not a limit on input)

# Marks counted as symbols; lead bytes of UTF-8 by script.
SYMBOLS = b"#*$%&|<>"
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Indic", "other", "Kana-Han", "Hangul")
_SCRIPT = np.full(256, -1, np.int8)
_SCRIPT[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 0
_SCRIPT[[0xCD, 0xCE, 0xCF]] = 1
_SCRIPT[[0xD0, 0xD1, 0xD2, 0xD3]] = 2
_SCRIPT[[0xD6, 0xD7]] = 3
_SCRIPT[[0xD8, 0xD9, 0xDA, 0xDB]] = 4
_SCRIPT[0xE0] = 5
_SCRIPT[[0xE1, 0xE2, *range(0xF0, 0xF5)]] = 6
_SCRIPT[[0xE3, *range(0xE4, 0xEA)]] = 7
_SCRIPT[[0xEA, 0xEB, 0xEC, 0xED]] = 8

_MARK = np.zeros(256, bool)
_MARK[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Vocabularies:
    """Paths, at every executor, of a rank file with its pattern and of a piece model."""

    ranks: str
    pattern: str
    pieces: str


class _Fertility:
    """Token counts and piece ids of words, kept for words seen lately."""

    def __init__(self, use: Vocabularies):
        import base64

        import sentencepiece
        import tiktoken

        with open(use.ranks, "rb") as rows:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rows)}
        self.bytes_of = tiktoken.Encoding("ranks", pat_str=use.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.model = sentencepiece.SentencePieceProcessor(model_file=use.pieces)
        self.falls = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.slot: dict[int, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.starts, self.ids, self.filled = np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def look(self, hashes: np.ndarray, word) -> np.ndarray:
        """Slots of distinct words; ``word(i)`` gives the bytes of the i-th where it is new."""
        if len(self.slot) > CACHE:
            self.slot.clear()
            self.counts, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        slot, out, new = self.slot, np.empty(len(hashes), np.int64), []
        for i, h in enumerate(hashes.tolist()):
            at = slot.get(h)
            if at is None:
                at = slot[h] = len(slot)
                new.append(i)
            out[i] = at
        if new:
            texts = [word(i).decode("utf-8", "replace") for i in new]
            pieces = self.model.encode(texts, num_threads=1)
            self.counts = np.concatenate([self.counts, [len(self.bytes_of(" " + t)) for t in texts]])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(p) for p in pieces])])
            self.ids = np.concatenate([self.ids, np.fromiter((t for p in pieces for t in p), np.int64)])
        return out


def _entropy(rows: np.ndarray, tokens: np.ndarray, times: np.ndarray, count: int, kinds: int) -> np.ndarray:
    """Entropy in bits of the tokens of each of ``count`` rows; a token counts ``times`` over."""
    order = np.argsort(rows * kinds + tokens, kind="stable")
    key = (rows * kinds + tokens)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    each = np.add.reduceat(times[order], first).astype(np.float64) if len(key) else np.zeros(0)
    row = rows[order][first]
    total = np.bincount(row, each, count)
    return np.maximum(np.log2(np.maximum(total, 1)) - np.bincount(row, each * np.log2(np.maximum(each, 1)), count) / np.maximum(total, 1), 0)


MEASURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "script string, n_byte_tokens bigint, n_piece_tokens bigint, n_fallback bigint, entropy double")


def measure(docs: DataFrame, use: Vocabularies, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Fertility(use)
        for part in slices(batches, "__text", 1 << 19):
            n, found, space = len(part), words(part), spaces(part)
            rows, hashes = found.rows(), byte_hashes(part, found.starts, found.ends)
            chars = ~space & ((part.data & 0xC0) != 0x80)
            # Lines that hold a word, and those equal to an earlier one.
            split = lines(part)
            solid = np.concatenate([[0], np.cumsum(~space)])
            full = solid[split.ends] > solid[split.starts]
            copies = later_copies(split.rows()[full], byte_hashes(part, split.starts[full], split.ends[full]), n)
            # Words in windows found twice or more in their text.
            begins = gram_starts(found.first, WINDOW)
            twice = repeated(rows[begins], gram_hashes(hashes, begins, WINDOW))
            again = np.bincount(rows[covered(len(found), begins[twice], WINDOW)], minlength=n)
            # Tokens: distinct words of the slice are looked up, then spread to the texts they are in.
            distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            slot = known.look(distinct, lambda i: part.data[found.starts[at[i]]:found.ends[at[i]]].tobytes())
            pair, times = np.unique(rows * len(distinct) + back, return_counts=True) if len(distinct) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            row, which = pair // max(len(distinct), 1), slot[pair % max(len(distinct), 1)] if len(distinct) else np.zeros(0, np.int64)
            size = known.starts[which + 1] - known.starts[which]
            token = known.ids[np.repeat(known.starts[which] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            owner, weight = np.repeat(row, size), np.repeat(times, size)
            script = _SCRIPT[part.data]
            letters = np.stack([part.sums(script == k) for k in range(len(SCRIPTS))]) if len(part.data) else np.zeros((len(SCRIPTS), n), np.int64)
            names = np.array(SCRIPTS, object)[letters.argmax(0)]
            total = lambda r, w: np.bincount(r, w, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                *part.batch.columns[:-1], *(pa.array(x.astype(np.int64)) for x in (np.diff(found.first), part.sums(chars), part.sums(_MARK[part.data]), copies, again)),
                pa.array(np.where(letters.max(0) > 0, names, "none"), pa.string()), pa.array(total(row, times * known.counts[which])), pa.array(total(owner, weight)),
                pa.array(total(owner, weight * known.falls[token])), pa.array(_entropy(owner, token, weight, n, len(known.falls)))],
                names=[*part.batch.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", "n_byte_tokens", "n_piece_tokens", "n_fallback", "entropy"])

    return docs.select(*[f.name for f in kept], F.col(text).alias("__text")).mapInArrow(run, schema)


RATES = ("chars_per_token", "chars_per_piece", "fallback_share", "entropy")


def verdicts(measured: DataFrame, language: str = "lang") -> DataFrame:
    """Add the rates, ``base_failed``, ``kept`` and ``reason`` to measured rows."""
    label = F.col(language) if language in measured.columns else F.lit(None)
    rated = (measured
             .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
             .withColumn("chars_per_token", F.col("word_chars") / F.greatest("n_byte_tokens", F.lit(1)))
             .withColumn("chars_per_piece", F.col("word_chars") / F.greatest("n_piece_tokens", F.lit(1)))
             .withColumn("fallback_share", F.col("n_fallback") / F.greatest("n_piece_tokens", F.lit(1)))
             .withColumn("__group", F.coalesce(F.concat(F.lit("lang "), label), F.concat(F.lit("script "), F.col("script")))))
    rated = cut_lineage(rated, "fertility")
    good = rated.where(~F.col("base_failed"))
    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], ACCURACY).alias(f"__{c}") for c in RATES]
    own = good.groupBy("__group").agg(F.count("*").alias("__rows"), *quartiles)
    # One language may hold most texts: its texts are dealt over WAYS copies of its band.
    ways = F.explode(F.array(*[F.lit(i) for i in range(WAYS)]))
    out = rated.withColumn("__way", F.pmod(F.monotonically_increasing_id(), F.lit(WAYS)).cast("int")).join(own.withColumn("__way", ways), ["__group", "__way"], "left")
    reasons = []
    for c in RATES:
        band = F.col(f"__{c}")
        low, middle, high = F.get(band, 0), F.get(band, 1), F.get(band, 2)
        width = F.greatest(FENCES * (high - low), LEAST_WIDTH[c] * middle, F.lit(0.01)) * (1 + FEW / F.col("__rows"))
        floor = low - width
        if c == "entropy":
            floor = F.least(floor, EVENNESS * F.log2(F.greatest("n_piece_tokens", F.lit(1))))
        reasons.append(F.when(F.col(c) < floor, f"{c} low").when(F.col(c) > high + width, f"{c} high"))
    reason = F.when(F.col("base_failed"), "base").otherwise(F.coalesce(*reasons))
    return (out.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
            .drop("__group", "__way", "__rows", *[f"__{c}" for c in RATES]))
