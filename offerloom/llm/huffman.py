"""Token ids in files: canonical length-limited Huffman codes, decoded by table from any block.

``write`` encodes texts with a public vocabulary of the tokenizers library, appends
``END`` to each, and writes all ids in the order of the key:

1. Ids of each row are written once as a table (two bytes an id where the vocabulary allows).
2. Ids are counted per task and summed by Spark: one row per id of the vocabulary comes to
   the driver, whatever the data.  Package merging gives code lengths of at most
   ``LONGEST`` bits (more only if the vocabulary needs them), canonical by (length, id).
3. Rows are range sorted by key and packed in that order into records of about
   ``RECORD_IDS`` ids, or one longer row, by Spark's text writer, ``RECORDS_PER_FILE`` a
   file, so files land and are committed wherever Spark can write.
4. ``index`` gives the ids before each sorted part; it is made from the records' heads.

A record (little endian): magic, crc32 of the code lengths, part, ids before it in the
part, ids, rows, blocks, bytes of the bits; then per row a null flag, the key and its number of
ids; per block of ``BLOCK`` ids the bit where it begins; then the bits, least significant
first.  ``codes/`` holds one record with the length of every id's code.  Blocks are independent: ``ids_between``
decodes a range of a record from the checkpoints around it, and ``read`` decodes all
blocks of a record in step, one table access per id.

``read`` gives per row the key, ``start`` (ids of all rows before it), ``n_tokens`` and ``ids`` (unsigned
32-bit little endian).  A null or empty text has the end id only.  Rows come by key, null first, rows with
one key by their ids.  An empty table gives files without records and no rows.  Other columns are not
read.  A record that is cut off or made with other codes raises an error.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage

END = 1
LONGEST = 16
BLOCK = 256
RECORD_IDS = 1 << 17
RECORDS_PER_FILE = 64
COUNTED = 1 << 20  # ids at once
CACHE, LONG_PIECE = 1_500_000, 64  # about 130 bytes a word

MAGIC, CODE_MAGIC = b"OLH1", b"OLHC"
_HEAD = struct.Struct("<4sIqqqqqq")
_U64 = np.uint64

# --- Ids of a text ---------------------------------------------------------------------

# How the vocabulary's file says that texts are split.  Texts of printable ASCII, blanks and
# letters of Latin-1 are then split here, the same way; everything else goes through the library, word by word.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_PLAIN = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")
_WORDS = re.compile("[^ \t-\r]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next free one from 256."""
    out, free = [], 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if shown else free))
        free += not shown
    return out


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= LONG_PIECE:
            if len(self) >= CACHE:
                self.clear()
            self[key] = found
        return found


class _Words(_Cache):
    """Ids of words and of their pieces, without blanks and in lower case; ``make`` gives those of one piece."""

    def __missing__(self, key: str) -> bytes:
        if key.isalpha():  # one piece
            found = self.make(key)
        elif key[:-1].isalpha():  # a word with one mark or digit after it
            found = self[key[:-1]] + self[key[-1]]
        else:
            pieces = _PIECES.findall(key)
            found = self.make(key) if len(pieces) == 1 else b"".join([self[p] for p in pieces])
        if len(key) <= LONG_PIECE:
            if len(self) >= CACHE:
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of whole texts, as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        added = told.get("added_tokens") or []
        self.split = (told.get("normalizer") == _NORMALIZER and told.get("pre_tokenizer") == _PRE_TOKENIZER and told.get("post_processor") is None
                      and told["model"]["type"] == "BPE" and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")))
        self.added = [t["content"] for t in added]
        letters, model = _byte_letters(), self.library.model
        packed, tokenize = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.size)], model.tokenize
        pack = lambda ids: b"".join([packed[i] for i in ids])

        def of_piece(piece: str) -> bytes:
            # Printable ASCII stands for itself.
            shown = piece if piece.isascii() and piece.isprintable() else "".join([letters[b] for b in piece.encode()])
            return b"".join([packed[t.id] for t in tokenize(shown)])

        self.lower = _Words(of_piece)
        self.words = _Cache(lambda word: self._plain(word) if self._is_plain(word) else pack(self.library.encode(word, add_special_tokens=False).ids))

    def _is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def _plain(self, text: str) -> bytes:
        # No piece holds a blank, and a plain text has no other blanks than those it is split at here.
        return b"".join(map(self.lower.__getitem__, text.lower().split()))

    def encode(self, text: str) -> bytes:
        if not self.split:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self._is_plain(text):
            return self._plain(text)
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One per worker, so that its cache outlives a task."""
    return Encoder(path)


# --- Codes -----------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Best code lengths of at most ``longest`` bits, 0 for ids that do not occur, by package merging."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    longest = max(longest, int(len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    packages, leaves = np.zeros(0, np.int64), []
    for _ in range(longest):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        leaves.append(order < len(weights))
        both = both[order][:len(both) // 2 * 2]
        packages = both[::2] + both[1::2]
    lengths, taken = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out[used] = lengths
    return out


class Code:
    """Canonical codes of given lengths, bits reversed as they stand in the file, and the decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.check = zlib.crc32(lengths.tobytes())
        self.longest = int(lengths.max()) if len(lengths) else 0
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        sizes = lengths[used].astype(np.int64)
        # The canonical code is the running sum of the shares 2 ** -length, in units of the longest.
        share = np.int64(1) << (self.longest - sizes)
        codes = (np.cumsum(share) - share) >> (self.longest - sizes)
        turned = np.zeros(len(used), np.int64)
        for bit in range(self.longest):
            turned |= np.where(bit < sizes, (codes >> bit & 1) << np.maximum(sizes - 1 - bit, 0), 0)
        self.codes = np.zeros(len(lengths), _U64)
        self.codes[used] = turned.astype(_U64)
        self.used, self.sizes, self.turned = used, sizes, turned

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For the next ``longest`` bits: the id and the length of its code."""
        ids, sizes = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, _U64)
        for size in np.unique(self.sizes).tolist():
            own = self.sizes == size
            at = self.turned[own][:, None] + (np.arange(1 << self.longest - size) << size)
            ids[at], sizes[at] = self.used[own][:, None].astype(np.uint32), size
        return ids, sizes

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids``, padded to a word and one word more, and where each block begins."""
        sizes, codes = self.lengths[ids].astype(np.int64), self.codes[ids]
        ends = np.cumsum(sizes)
        at = ends - sizes
        word, shift = at >> 6, (at & 63).astype(_U64)
        out = np.zeros((int(ends[-1]) + 63 >> 6) + 1 if len(ids) else 1, _U64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))  # no code is as long as a word, so each word has a first one
            out[word[first]] = np.bitwise_or.reduceat(codes << shift, first)
            over = np.flatnonzero((at & 63) + sizes > 64)
            out[word[over] + 1] |= codes[over] >> (_U64(64) - shift[over])
        return out.tobytes(), at[::BLOCK].astype(np.int64)

    def unpack(self, bits: bytes, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of blocks that begin at the given bits, all blocks in step."""
        out = np.zeros((len(begins), int(counts.max()) if len(counts) else 0), np.uint32)
        words = np.ndarray((max(len(bits) - 7, 0),), "<u8", bits, 0, (1,))
        ids, sizes = self.table
        at, mask, whole = begins.astype(_U64), _U64((1 << self.longest) - 1), bool((counts == out.shape[1]).all())
        for step in range(out.shape[1]):
            rows = slice(None) if whole else np.flatnonzero(counts > step)
            now = at[rows]
            spot = ((words[(now >> _U64(3)).astype(np.int64)] >> (now & _U64(7))) & mask).astype(np.int64)
            out[rows, step] = ids[spot]
            at[rows] = now + sizes[spot]
        return out[np.arange(out.shape[1]) < counts[:, None]]


# --- Records ---------------------------------------------------------------------------


def make_record(code: Code, part: int, before: int, keys: list[int | None], ids: list[np.ndarray]) -> bytes:
    whole = np.concatenate(ids)
    bits, begins = code.pack(whole)
    nulls = np.array([k is None for k in keys], np.uint8)
    return b"".join([
        _HEAD.pack(MAGIC, code.check, part, before, len(whole), len(keys), len(begins), len(bits)), nulls.tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([len(i) for i in ids], "<i8").tobytes(), begins.astype("<i8").tobytes(), bits])


class Record:
    """A view of one record at a byte of a file."""

    def __init__(self, data: memoryview, at: int):
        if len(data) < at + _HEAD.size:
            raise ValueError(f"the record at byte {at} is cut off")
        magic, self.check, self.part, self.before, self.ids, self.rows, self.blocks, self.bits = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no record at byte {at}")
        at += _HEAD.size
        self.end = at + 17 * self.rows + 8 * self.blocks + self.bits
        if self.end > len(data):
            raise ValueError("the last record is cut off")
        self.data, self.at = data, at

    def _numbers(self, at: int, count: int) -> np.ndarray:
        return np.frombuffer(self.data, "<i8", count, at)

    @property
    def keys(self) -> pa.Array:
        nulls = np.frombuffer(self.data, np.uint8, self.rows, self.at).astype(bool)
        return pa.array(self._numbers(self.at + self.rows, self.rows), pa.int64(), mask=nulls)

    @property
    def sizes(self) -> np.ndarray:
        return self._numbers(self.at + 9 * self.rows, self.rows)

    def ids_between(self, code: Code, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) of the record; only the blocks around them are decoded."""
        if code.check != self.check:
            raise ValueError("the record was made with other codes")
        if last <= first:
            return np.zeros(0, np.uint32)
        own = slice(first // BLOCK, -(-last // BLOCK))
        begins = self._numbers(self.at + 17 * self.rows, self.blocks)[own]
        counts = np.minimum(BLOCK, self.ids - BLOCK * np.arange(self.blocks)[own])
        bits = self.data[self.end - self.bits:self.end]
        return code.unpack(bits, begins, counts)[first - own.start * BLOCK:last - own.start * BLOCK]


def records(data) -> Iterator[Record]:
    """All records of a file; each is followed by a line break."""
    data, at = memoryview(data), 0
    while at < len(data):
        record = Record(data, at)
        yield record
        at = record.end + 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


def load_code(spark: SparkSession, path: str) -> Code:
    """The codes of the files under ``path``: a byte per id of the vocabulary."""
    data = b"".join(bytes(r.content) for r in _files(spark, f"{path}/codes").collect())
    if data[:4] != CODE_MAGIC:
        raise ValueError("no codes")
    (size,) = struct.unpack_from("<q", data, 4)
    return Code(np.frombuffer(data, np.uint8, size, 12))


def write(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all rows under ``path``; ``vocabulary`` is the path of its file at every executor."""
    spark = docs.sparkSession
    size, kind = _encoder(vocabulary).size, _encoder(vocabulary).kind
    size = max(size, END + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(vocabulary), np.array([END], kind).tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encoder.encode(t.as_py() or "") + end for t in part.column(1)], pa.binary())], names=["key", "ids"])

    coded = cut_lineage(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text)).mapInArrow(encode, "key bigint, ids binary"), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            _, ends, data = batch.column(0).buffers()
            at = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(batch.column(0).type) else np.int32)[batch.column(0).offset:][:batch.num_rows + 1]
            ids = np.frombuffer(data, kind, (int(at[-1]) - int(at[0])) // kind.itemsize, int(at[0])) if batch.num_rows else np.zeros(0, kind)
            for begin in range(0, len(ids), COUNTED):
                total += np.bincount(ids[begin:begin + COUNTED], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": at, "n": total[at]})

    counted = coded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row per id
    counts = np.zeros(size, np.int64)
    counts[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    code = Code(code_lengths(counts))
    told = CODE_MAGIC + struct.pack("<q", size) + code.lengths.tobytes()
    spark.createDataFrame([(bytearray(told),)], "value binary").select(F.col("value").cast("string")).coalesce(1).write.text(f"{path}/codes")
    lengths = code.lengths

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, before, keys, ids, held = Code(lengths), TaskContext.get().partitionId(), 0, [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([make_record(code, part, before, keys, ids)], pa.binary())], names=["value"])
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                ids.append(np.frombuffer(value.as_py(), kind))
                held += len(ids[-1])
                if held >= RECORD_IDS:
                    yield made()
                    before, keys, ids, held = before + held, [], [], 0
        if keys:
            yield made()

    ordered = coded.repartitionByRange("key").sortWithinPartitions("key", "ids").mapInArrow(pack, "value binary")
    ordered.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", RECORDS_PER_FILE).text(f"{path}/ids")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                found = [(r.part, r.ids, r.rows) for r in records(value.as_buffer())]
                at = np.array(found, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_pydict({"part": at[:, 0], "n_ids": at[:, 1], "n_rows": at[:, 2]})

    parts = _files(spark, f"{path}/ids").mapInArrow(heads, "part bigint, n_ids bigint, n_rows bigint").groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_rows").alias("n_rows"))
    # A row per sorted part, however many rows those hold.
    start = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.withColumn("start", start).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the files under ``path``: ``key``, ``start``, ``n_tokens``, ``ids``."""
    lengths = load_code(spark, path).lengths

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for value in batch.column(0):
                for record in records(value.as_buffer()):
                    sizes = record.sizes
                    ends = np.cumsum(sizes)
                    ids = record.ids_between(code, 0, record.ids).astype("<u4").tobytes()
                    cut = [ids[4 * (b - n):4 * b] for b, n in zip(ends.tolist(), sizes.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(record.rows, record.part)), record.keys, pa.array(record.before + ends - sizes), pa.array(sizes), pa.array(cut, pa.binary())],
                        names=["part", "key", "inside", "n_tokens", "ids"])

    rows = _files(spark, f"{path}/ids").mapInArrow(decode, "part bigint, key bigint, inside bigint, n_tokens bigint, ids binary")
    index = spark.read.parquet(f"{path}/index").select("part", F.col("start").alias("first"))
    return rows.join(index, "part").select("key", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids")
