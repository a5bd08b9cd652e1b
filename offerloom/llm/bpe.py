"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string, BPE ends in exactly one token.  If that token is
known for each prefix, the encoding of any prefix is read off backwards; bytes can be
appended without touching what is there; and after an edit only the stretch between
the edit and the place where the table agrees again is worked out anew.  A token t
follows the encoding that ends in token s exactly when BPE would leave the two as
they are if they stood alone, which is checked by undoing their merges side by side.

``encode_documents`` gives one row per input row: the given columns kept by ``keep``,
``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (binary).
A null or empty text has no tokens.  Repeated rows stay repeated; other columns are not
read.  Memory of a task: one text, its ids, and a cache of at most ``CACHE`` pieces.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHE = 400_000  # short pieces remembered by a task, twice at most (memory bound, not a limit on input)
LONG_PIECE = 48


class Vocabulary:
    """Ranks of a byte-level BPE, as tiktoken reads them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        # Finds all tokens in a text in one pass; bytes stand as the characters of that number.
        self._finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.halves(rank) is not None:
                self._finder.add_word(token.decode("latin-1"), rank)
        self._finder.make_automaton()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (t, t) for a byte; None if no merge reaches it."""
        if token not in self._halves:
            body = self.tokens[token]
            if len(body) == 1:
                self._halves[token] = (token, token)
            else:
                parts = [self.ranks[body[i:i + 1]] for i in range(len(body))]
                while len(parts) > 2:
                    joined = [self.ranks.get(self.tokens[a] + self.tokens[b], token) for a, b in zip(parts, parts[1:])]
                    low = min(joined)
                    if low >= token:
                        break
                    at = joined.index(low)
                    parts[at:at + 2] = [low]
                self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _stays(self, left: int, right: int) -> bool:
        """Whether BPE over the bytes of both tokens gives just these two."""
        body = self.tokens
        bound = len(body) + 1
        while True:
            joined = self.ranks.get(body[left] + body[right])
            if joined is not None and joined < bound:
                return False
            # Undo the later merge of the two; what it hid at the seam may have been joined before it.
            if left > right:
                bound, left = left, self.halves(left)[1]
                if left == bound:
                    bound, right = right + 1, self.halves(right)[0]
                    if right + 1 == bound:
                        return True
            else:
                bound, right = right + 1, self.halves(right)[0]
                if right + 1 == bound:
                    bound, left = left, self.halves(left)[1]
                    if left == bound:
                        return True

    def stays(self, left: int, right: int) -> bool:
        if len(self._pairs) >= 1_000_000:
            self._pairs.clear()
        good = self._pairs[left << 24 | right] = self._stays(left, right)
        return good

    def extend(self, text: bytes, last: list, upto: int | None = None) -> list:
        """Fill ``last`` (last[i]: the last token of the first i bytes) from where it ends to ``upto`` or the end."""
        end, begin = len(text) if upto is None else upto, max(len(last), 1)
        last.extend([None] * (end + 1 - len(last)))
        pairs, stays, sizes = self._pairs, self.stays, self.sizes
        # Tokens that end at or after ``begin`` start within reach of it.
        for stop, token in self._finder.iter(text.decode("latin-1"), max(0, begin - self.longest), end):
            stop += 1
            if stop < begin or last[stop] is not None:
                continue
            start = stop - sizes[token]
            if start == 0:
                last[stop] = token
            else:
                before = last[start]
                if before is None:
                    raise ValueError("the vocabulary lacks a byte")
                good = pairs.get(before << 24 | token)
                if good or good is None and stays(before, token):
                    last[stop] = token
        return last

    def read(self, last: list) -> list[int]:
        """The encoding, read backwards from the table of last tokens."""
        out, at, sizes = [], len(last) - 1, self.sizes
        while at > 0:
            out.append(last[at])
            at -= sizes[last[at]]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """As tiktoken encodes one match of the pattern: a whole token if it is one, else by merges."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        # extend() over an empty table and read(), in one go.
        last: list = [None] * (len(piece) + 1)
        sizes, good, stays = self.sizes, self._pairs.get, self.stays
        for stop, token in self._finder.iter(piece.decode("latin-1")):
            if last[stop + 1] is None:
                start = stop + 1 - sizes[token]
                if not start:
                    last[stop + 1] = token
                else:
                    before = last[start]
                    fits = good(before << 24 | token)
                    if fits or fits is None and stays(before, token):
                        last[stop + 1] = token
        return self.read(last)

    def splice(self, text: bytes, last: list, start: int, stop: int, new: bytes) -> tuple[bytes, list]:
        """Replace text[start:stop] and its table; works only until the old table fits again."""
        out = text[:start] + new + text[stop:]
        table, shift = last[:start + 1], len(new) - (stop - start)
        agree, at = 0, start + len(new)
        self.extend(out, table, at)
        while at < len(out) and agree < self.longest:
            at += 1
            self.extend(out, table, at)
            # The edit is out of reach once this many entries in a row are the old ones.
            agree = agree + 1 if at - shift > stop and table[at] == last[at - shift] else 0
        return out, table + last[at - shift + 1:]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


# The letters, numbers and white space below U+0250.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACES = "\t-\r \u0085\u00a0"


def splitter(pattern: str):
    """A function from a text to the matches of ``pattern``.

    A text without characters from U+0250 on goes through ``re`` with the classes
    written out, which gives the same matches in half the time.
    """
    import regex

    whole = regex.compile(pattern)
    if r"\s\p{L}\p{N}" not in pattern:
        return whole.findall
    written = pattern.replace(r"\s\p{L}\p{N}", _SPACES + _LETTERS + _NUMBERS)
    for name, members in ((r"\p{L}", f"[{_LETTERS}]"), (r"\p{N}", f"[{_NUMBERS}]"), (r"\s", f"[{_SPACES}]"), (r"\S", f"[^{_SPACES}]")):
        written = written.replace(name, members)
    western, beyond = re.compile(written).findall, re.compile("[\u0250-\U0010ffff]").search
    return lambda text: western(text) if beyond(text) is None else whole.findall(text)


class PieceCache(dict):
    """Ids of pieces as bytes, in two generations, so that frequent pieces stay when it is full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            ids = self.vocabulary.encode_piece(piece.encode())
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Encode and decode each text; with ``digest``, SHA-256 digests stand in for ids and decoded bytes.

    ``vocabulary`` is the path of a rank file at every executor, a public vocabulary.
    """
    kept = [f for f in docs.schema.fields if f.name in keep]
    tail = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint", tail])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = load_ranks(vocabulary)
        pieces, cache = splitter(pattern), PieceCache(table)
        lookup, body = cache.__getitem__, table.tokens.__getitem__
        show = (lambda x: hashlib.sha256(x).hexdigest()) if digest else (lambda x: x)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                counts, coded, decoded = [], [], []
                for value in part.column(part.num_columns - 1):
                    ids = b"".join(map(lookup, pieces(value.as_py() or "")))
                    counts.append(len(ids) // 4)
                    coded.append(show(ids))
                    decoded.append(show(b"".join(map(body, np.frombuffer(ids, "<u4").tolist()))))
                kind = pa.string() if digest else pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(coded, kind), pa.array(decoded, kind)],
                    names=[*part.schema.names[:-1], "n_tokens", "ids_sha256" if digest else "ids", "decoded_sha256" if digest else "decoded"])

    return docs.select(*[f.name for f in kept], F.col(text).alias("__text")).mapInArrow(run, schema)
