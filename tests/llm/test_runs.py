"""Runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from offerloom.llm import queries, runs

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made(rng):
    """Words with runs within runs, over a small or large set of words."""
    letters = [chr(97 + i) for i in range(rng.choice([1, 2, 2, 3, 30]))]
    out = []
    for _ in range(rng.randrange(1, 7)):
        piece = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(3)):
            piece = piece * rng.randrange(1, 6) + [rng.choice(letters) for _ in range(rng.randrange(3))]
        out += piece * rng.randrange(1, 6)
    return out[:rng.randrange(1, 400)]


@pytest.mark.parametrize("seed", range(12))
def test_all_runs(seed):
    rng = random.Random(seed)
    rows = [made(rng) for _ in range(40)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, list("ab") * 100 + ["a"], list("aab") * 4]
    if seed % 2:
        rows += rows[:10]
    names = {}
    ids = np.array([names.setdefault(x, len(names)) for w in rows for x in w], np.int64)
    first = np.concatenate([[0], np.cumsum([len(w) for w in rows])])
    start, end, period = runs.runs_of(ids, first)
    at = np.searchsorted(first, start, "right") - 1
    got = [[] for _ in rows]
    for k, s, e, q in zip(at.tolist(), start.tolist(), end.tolist(), period.tolist()):
        got[k].append((s - int(first[k]), e - s, q))
    assert got == [plain_runs(w) for w in rows]


def test_words_of_few_letters_do_not_collide():
    """Two words of 1,024 letters that a sum of powers modulo 2^64 cannot tell apart."""
    import pyarrow as pa

    from offerloom.llm._words import slices, word_hashes, words

    even = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    odd = even.translate(str.maketrans("ab", "ba"))
    batch = pa.RecordBatch.from_pydict({"text": [f"{even} {odd} {even} abcdefgh abcdefgh\0 a a\0 x{even}", "", None]})
    (part,) = slices(iter([batch]))
    told = words(part)
    got = word_hashes(part, told.starts, told.ends).tolist()
    assert got[0] == got[2] and len(set(got)) == 7


def plain(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(told.encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(made(rng))) for i in range(150)] + [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(200)))) for i in range(150, 400)]
    rows += [(401, None), (402, ""), (403, " \n"), (None, "a " * 9), (404, "é x " * 8), (405, "ab " * 2_500), (405, "ab " * 2_500)]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, 0, "r") for i, t in rows], "doc_id long, text string, n_words int, runs string").repartition(4).write.parquet(f"{path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.QUERIES["op12_runs"](spark, path).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(*r)) for r in rows)
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
