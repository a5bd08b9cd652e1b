"""Ids against the library, codes against a plain search, files by a round trip."""

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from offerloom.llm import huffman, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = huffman.Encoder(PATH)
ODD = ["It's THE end", "don't we'LL 'S", "a\x85b\xa0c d", "é ́ x́́", "ΑΣ ΣΑ Σ", "İstanbul ǅ", "一二三 四五", "<|endoftext|> x<|startoftext|>y <|endoftext|", "×÷Àß'Ÿ", "1234½²", "\x00\x1f\x7f\x1c!",
       "...'s!?'t", "한국어 ﬁ ﷺ", "👩‍👩‍👧 🇫🇷", "a" * 300, "", " \n\t", "ſS K", "​﻿."]


def told(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_as_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == told(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n'stTÀé.,́\xa0Σ1"))))
def test_ids_of_any_text(text):
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == told(text)


@pytest.mark.parametrize("text", ["ß", "Straße aß", "aß! 'ß's 1ß é", "GROẞ groß\tßx", "Àß\u00a0x"])
def test_sharp_s_is_a_letter(text):
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == told(text)


@pytest.mark.parametrize("mark", [chr(c) for c in range(1, 0x180)])
def test_every_mark_of_latin(mark):
    text = f"a{mark}b {mark} '{mark} {mark}'s 1{mark} A {mark}{mark}\n{mark}x e{mark}"
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == told(text)


def test_words_and_pieces_share_a_cache():
    encoder = huffman.Encoder(PATH)
    assert np.frombuffer(encoder.encode("Word word, it's 1 a!?b"), "<u2").tolist() == told("Word word, it's 1 a!?b")
    assert set(encoder.lower) == {"word", "word,", ",", "it's", "it", "'s", "1", "a!?b", "a", "!?", "b"}


def least_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def test_code_lengths():
    rng = random.Random(3)
    for _ in range(50):
        counts = np.array([rng.choice([0, 1, 1, 2, 5, rng.randrange(1, 10 ** rng.randrange(1, 7))]) for _ in range(rng.randrange(2, 60))])
        if (counts > 0).sum() < 2:
            continue
        free, bound = huffman.code_lengths(counts, 40).astype(int), huffman.code_lengths(counts, 6).astype(int)
        assert (free * counts).sum() == least_cost(counts) <= (bound * counts).sum()
        for lengths in (free, bound):
            assert sum(2.0 ** -n for n in lengths[counts > 0]) == 1.0 and not lengths[counts == 0].any()
        assert bound.max() <= 6
    fib = [1, 1]
    while len(fib) < 20:
        fib.append(fib[-1] + fib[-2])
    # Brute force: of all length vectors of a full code with at most 6 bits, none is cheaper.
    small = np.array(fib[:8])
    best = min(sum(a * b for a, b in zip(sorted(v, reverse=True), small)) for v in vectors(8, 4))
    assert (huffman.code_lengths(small, 4).astype(int) * small).sum() == best
    assert huffman.code_lengths(np.array([0, 7]), 16).tolist() == [0, 1] and huffman.code_lengths(np.zeros(0, int)).tolist() == []
    assert huffman.code_lengths(np.ones(9, int), 3).max() == 4  # no code of three bits holds nine ids


def vectors(n, longest, least=1, room=1.0):
    if n == 0:
        if room == 0:
            yield []
        return
    for k in range(least, longest + 1):
        if 2.0 ** -k <= room:
            for rest in vectors(n - 1, longest, k, room - 2.0 ** -k):
                yield [k, *rest]


def test_codes_are_canonical_and_decode():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 1000, 50000):
        counts = (rng.zipf(1.3, n) % 100000).astype(np.int64) + 1
        code = huffman.Code(huffman.code_lengths(counts))
        order = sorted(range(n), key=lambda i: (code.lengths[i], i))
        bits = [format(int(code.codes[i]), f"0{code.lengths[i]}b")[::-1] for i in order]
        assert bits == sorted(bits) and all(a != b[:len(a)] for a, b in zip(bits, bits[1:]))
        ids = rng.integers(0, n, 5000)
        packed, begins = code.pack(ids)
        counts = np.minimum(huffman.BLOCK, len(ids) - huffman.BLOCK * np.arange(len(begins)))
        assert code.unpack(packed, begins, counts).tolist() == ids.tolist()


def test_ranges_of_a_record():
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 300, n) for n in (0, 1, 255, 256, 257, 3000, 0)]
    whole = np.concatenate(rows)
    code = huffman.Code(huffman.code_lengths(np.bincount(whole, minlength=300)))
    data = huffman.make_record(code, 3, 17, [None, 5, -6, 7, 8, 1 << 40, 9], rows)
    (record,) = huffman.records(data + b"\n")
    assert record.keys.to_pylist() == [None, 5, -6, 7, 8, 1 << 40, 9] and record.sizes.tolist() == [len(r) for r in rows] and (record.part, record.before) == (3, 17)
    for a, b in ((0, 3769), (0, 0), (255, 257), (256, 512), (1000, 1001), (3700, 3769)):
        assert record.ids_between(code, a, b).tolist() == whole[a:b].tolist()
    with pytest.raises(ValueError):
        list(huffman.records(data[:-1]))
    with pytest.raises(ValueError):
        record.ids_between(huffman.Code(np.array([1, 1], np.uint8)), 0, 1)


def plain(rows):
    ids = [(k, [*told(t or ""), 1]) for k, t in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    start = 0
    for k, own in ids:
        yield k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())
        start += len(own)


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i * 37 % 500, rng.choice([None, *ODD]) if i % 4 == 0 else " ".join(rng.choice(["Alpha", "beta,", "gamma", "Élan", "x9"]) for _ in range(rng.randrange(60)))) for i in range(500)]
    rows += [(None, "no key"), (3, "twice"), (3, "twice"), (900, "word " * 200_000)]
    path = str(tmp_path)
    spark.createDataFrame([(k, t, 0, 0, "p") for k, t in rows], "doc_id long, text string, start int, ids int, part string").repartition(6).write.parquet(f"{path}/documents.parquet")
    assert sorted(map(str, map(tuple, queries.QUERIES["op11_huffman_ids"](spark, path).collect()))) == sorted(map(str, plain(rows)))


def test_empty_tables_and_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    huffman.write(docs.limit(0), str(tmp_path / "none"), PATH)
    assert huffman.read(spark, str(tmp_path / "none")).collect() == []
    huffman.write(docs, str(tmp_path / "bare"), PATH)
    assert sorted((r.key, r.start, r.n_tokens, bytes(r.ids)) for r in huffman.read(spark, str(tmp_path / "bare")).collect()) == [(1, 0, 1, b"\1\0\0\0"), (2, 1, 1, b"\1\0\0\0")]
