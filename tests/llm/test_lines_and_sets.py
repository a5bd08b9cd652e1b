"""Operators that remove or link repeated text, each against a plain version of its rule."""

import collections
import hashlib
import random
import re

import pytest

from offerloom.llm import _packs, fuzzy_lines, jaccard, substrings

WORD = re.compile("[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "own", 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, head string, n_lines int, n_words string").repartition(3)


def roots(count):
    root = list(range(count))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    return root, top


# --- repeated windows --------------------------------------------------------------

def plain_windows(texts, size):
    told = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i:i + size]) for w in told for i in range(len(w) - size + 1))
    for w in told:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i:i + size])] > 1 for j in range(i, i + size)}
        yield len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_windows(spark):
    rng = random.Random(1)
    run = " ".join(f"w{i}" for i in range(36))
    texts = [None, "", " \n ", "x y z " * 13, "a " * 200, run + " " + run, "né " * 36, "y" * 20000] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(120))) for _ in range(60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeated(table(spark, texts), 35, digest=True).collect()}
    assert got == dict(enumerate(plain_windows(texts, 35)))


def test_windows_of_repeated_rows_and_none(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long), (1, long), (None, "short")], "doc_id long, text string")
    assert sorted((r.n_removed, r.text) for r in substrings.remove_repeated(docs).collect()) == [(0, "short"), (40, ""), (40, "")]
    assert substrings.remove_repeated(docs.limit(0)).collect() == []


# --- linked sets -------------------------------------------------------------------

def plain_links(texts, percent=85, size=4):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root, top = roots(len(sets))
    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


def linkable():
    rng = random.Random(5)
    texts = [None, "", "  \n", "a", "A", "a b", "a  B"]
    for length in (3, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 30):
        for k in range(12):
            w = [f"v{length}_{i}" for i in range(length + 3)] + ([f"z{k % 4}"] if k % 3 else [])
            w = w[1:] if k % 5 == 0 else w
            if k % 7 == 0:
                w[rng.randrange(len(w))] = "q"
            texts.append(" ".join(w))
    for _ in range(120):
        w = [f"u{i}" for i in range(150)]
        for _ in range(rng.randrange(8)):
            w[rng.randrange(150)] = "e%d" % rng.randrange(50)
        texts.append(" ".join(w))
    for _ in range(12):
        w = [f"l{i}" for i in range(1500)]
        for _ in range(rng.randrange(60)):
            w[rng.randrange(1500)] = "f"
        texts.append(" ".join(w))
    return texts


def test_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_UP_TO", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    monkeypatch.setattr(_packs, "PACK", 16)
    texts = linkable()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(table(spark, texts), 85, 4).collect()}
    assert got == plain_links(texts)


def test_components_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "one two three four five"), (7, "one two three four five"), (7, "one two three four five"), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in jaccard.link(docs).collect()) == [(-1, 7), (7, 7), (7, 7), (9, 9)]
    assert jaccard.link(docs.limit(0)).collect() == []


# --- near-equal lines ----------------------------------------------------------------

def plain_fold(line):
    """A line normalised, character by character."""
    out = []
    for c in line:
        if c.isascii():
            c = c.lower() if c.isalpha() else "0" if c.isdigit() else " "
        out.append(c)
    told = "".join(out)
    return " ".join((told if told.strip(" ") else line).replace("\t", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")).strip(" ").replace("  ", " ")


def squeezed(line):
    while "  " in line:
        line = line.replace("  ", " ")
    return line


def plain_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def plain_lines(rows, percent=90):
    """Every pair of different lines by its edit distance; no signature of any kind."""
    found = [(k, n, squeezed(plain_fold(s))) for k, t in rows for n, s in enumerate((t or "").split("\n"))]
    found = [f for f in found if f[2]]
    names = sorted({f[2] for f in found})
    at = {n: i for i, n in enumerate(names)}
    root, top = roots(len(names))
    for i, a in enumerate(names):
        for j in range(i):
            longer = max(len(a), len(names[j]))
            if abs(len(a) - len(names[j])) * 100 <= (100 - percent) * longer and 100 * plain_distance(a, names[j]) <= (100 - percent) * longer:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    first, gone = {}, collections.defaultdict(set)
    for k, n, line in sorted(found, key=lambda f: f[:2]):
        if first.setdefault(top(at[line]), (k, n)) != (k, n):
            gone[k].add(n)
    return {k: (0 if not t else t.count("\n") + 1, len(gone[k]), None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if n not in gone[k])) for k, t in rows}


def some_word(rng):
    return "".join(rng.choice(["er", "on", "the", "s", "ing", "a", "ti", "or", "de", "mu", "lo", "ka", "pre", "n", "vi", "ou"]) for _ in range(rng.randrange(1, 4)))


def test_lines(spark, monkeypatch):
    """Lines of every length with few edits, exact copies, marks, short lines: the same rows as all pairs by edit distance."""
    monkeypatch.setattr(_packs, "PACK", 32)
    monkeypatch.setattr(fuzzy_lines, "RUN", 8)
    rng = random.Random(4)
    base = [" ".join(some_word(rng) for _ in range(k)) for k in (1, 2, 3, 5, 8, 12, 20, 30, 60, 90)]
    texts = [None, "", "\n\n", "One, two three!\none two  three", "---\n---\n***", "7\n8\nx", "all rights reserved\nAll rights reserved.", " \t\r\n", "港の事務所は朝早く開き職員が手紙を分けた"] * 2
    for _ in range(90):
        own = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(1 + len(line) // 50)):
                line[rng.randrange(len(line))] = rng.choice("abcxyz ")
            own.append("".join(line) + rng.choice(["", ".", " !"]))
        texts.append("\n".join(own))
    rows = fuzzy_lines.dedup_lines(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in rows} == plain_lines(list(enumerate(texts)))
    assert fuzzy_lines.dedup_lines(table(spark, texts).limit(0)).collect() == []


def test_repeated_rows_keep_one_occurrence(spark):
    docs = spark.createDataFrame([(1, "first line here\n\nsecond line there"), (1, "first line here\n\nsecond line there"), (1, "first line here"), (None, "second line there"), (None, "second line there"), (2, None)],
                                 "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in fuzzy_lines.dedup_lines(docs).collect()]
    kept = collections.Counter(line for _, _, _, t in got for line in (t or "").split("\n") if line)
    # A null key comes first, so its line stays; of equal rows one keeps what it may.
    assert kept == {"first line here": 1, "second line there": 1} and len(got) == 6
    assert sorted(g[1:] for g in got if g[0] is None) == [(1, 0, "second line there"), (1, 1, "")] and (2, 0, 0, None) in got


def test_very_long_lines(spark):
    rng = random.Random(2)
    long = " ".join(some_word(rng) for _ in range(20_000))
    near = long.replace("ab", "ba")
    other = " ".join(some_word(rng) for _ in range(20_000))
    rows = fuzzy_lines.dedup_lines(spark.createDataFrame([(0, long), (1, other), (2, near), (3, "x" * 90_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {0: 0, 1: 0, 2: 1, 3: 0}


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(25))) for _ in range(2))
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            before = now
        assert fuzzy_lines.edit_distance(a, b, 99) == before[-1]
        assert fuzzy_lines.few_edits(a, b, 30) == before[-1] and (fuzzy_lines.few_edits(a, b, before[-1] - 1) is None or not before[-1])
    for edits in (0, 5, 39, 60):
        a = "".join(rng.choice("abcde ") for _ in range(1200))
        b = list(a)
        for k in rng.sample(range(1200), edits):
            b[k] = rng.choice(["", "x", "y" + b[k]])
        assert fuzzy_lines.edit_distance(a, "".join(b), 300) == plain_distance(a, "".join(b))


def test_nothing_similar_is_ruled_out():
    """Counts of trigrams and 5-grams let every similar pair through; edits word by word are never too few."""
    rng, alike = random.Random(9), 0
    for _ in range(600):
        words = [some_word(rng) for _ in range(rng.randrange(1, 40))]
        line = " ".join(words)
        near = list(line)
        for k in rng.sample(range(len(line)), min(len(line), rng.randrange(1 + len(line) // 8))):
            near[k] = rng.choice(["", "é", "q ", near[k] * 2])
        near = "".join(near)
        longer, distance = max(len(line), len(near)), plain_distance(line, near)
        most = 10 * longer // 100
        assert fuzzy_lines._word_by_word(line, near) >= distance
        assert fuzzy_lines.similar(line, near) == (distance <= most)
        if distance <= most:
            alike += 1
            assert abs(fuzzy_lines._trigram_counts(line) - fuzzy_lines._trigram_counts(near)).sum(dtype="int64") <= 6 * most
            assert fuzzy_lines._may_be_similar(line, near, fuzzy_lines._grams(line), fuzzy_lines._grams(near), 90)
    assert 100 < alike < 590


def test_recall_of_candidates(spark):
    """Pairs by edit similarity, with edits scattered over letters or in whole words: from 95 percent nine tenths meet at every length."""
    rng = random.Random(12)
    texts, kinds = [], []
    for words in (8, 16, 32, 64, 150):
        for edits in ("letters", "word"):
            count = collections.Counter()
            while min(count["over 95"], count["over 90"]) < 120:
                told = [some_word(rng) for _ in range(words)]
                line, rate = " ".join(told), rng.choice([0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.1, 0.12])
                if edits == "word":
                    for k in rng.sample(range(words), max(1, int(rate * words))):
                        told[k] = some_word(rng)
                    near = " ".join(told)
                else:
                    near = list(line)
                    for k in rng.sample(range(len(line)), max(1, int(rate * len(line)))):
                        near[k] = rng.choice(["", "q", rng.choice("abcdefgh") + near[k]])
                    near = squeezed("".join(near)).strip()
                if line != near and fuzzy_lines.similar(line, near):
                    band = "over 95" if fuzzy_lines.similar(line, near, 95) else "over 90"
                    if count[band] < 120:
                        count[band] += 1
                        texts += [line, near]
                        kinds.append((words, edits, band))
    met = collections.Counter()
    for r in fuzzy_lines.dedup_lines(table(spark, texts)).collect():
        met[kinds[r.doc_id // 2]] += r.n_removed
    for k, n in sorted(met.items()):
        print(*k, round(n / 120, 2))
    assert all(n >= 0.9 * 120 for k, n in met.items() if k[2] == "over 95") and sum(met.values()) >= 0.8 * len(kinds)


def test_unrelated_lines_of_one_language_spread_over_blocks(spark, monkeypatch):
    """What all lines share by their language does not gather them in few blocks, whose comparison grows with their square."""
    rng, largest, choose = random.Random(31), [], fuzzy_lines.candidates

    def counted(signed, *given):
        largest.append(max(fuzzy_lines._post(signed, turn).groupBy("bucket").count().agg({"count": "max"}).first()[0] for turn in range(3)))
        return choose(signed, *given)

    monkeypatch.setattr(fuzzy_lines, "candidates", counted)
    texts = [" ".join(some_word(rng) for _ in range(rng.randrange(50, 90))) for _ in range(1500)]
    near = texts[7][:-3] + "qqq"
    rows = {r.doc_id: r.n_removed for r in fuzzy_lines.dedup_lines(table(spark, [*texts, near])).collect()}
    assert largest[0] < 30 and [i for i, n in rows.items() if n] == [1500]


def test_short_lines_take_part(spark):
    """Exact copies at any length, near copies of short lines, marks only, and scripts without blanks."""
    texts = ["all rights reserved", "All rights reserved.", "---", "---", "***", "the colour of the ships", "the color of the ships", "港の事務所は朝早く開き職員が手紙を分けた", "港の事務所は朝早く開き職員が手紙も分けた", "7", "x"]
    rows = {r.doc_id: r.n_removed for r in fuzzy_lines.dedup_lines(table(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [0, 1, 0, 1, 0, 0, 1, 0, 1, 0, 0]


def test_what_lines_share_is_learnt_from_all_of_them(spark, monkeypatch):
    """One long text takes part with all its lines, not only with those at its start."""
    rng, largest, choose = random.Random(37), [], fuzzy_lines.candidates

    def counted(signed, *given):
        largest.append(max(fuzzy_lines._post(signed, turn).groupBy("bucket").count().agg({"count": "max"}).first()[0] for turn in range(3)))
        return choose(signed, *given)

    monkeypatch.setattr(fuzzy_lines, "candidates", counted)
    lines = [" ".join(some_word(rng) for _ in range(rng.randrange(50, 90))) for _ in range(1500)]
    rows = {r.doc_id: r.n_removed for r in fuzzy_lines.dedup_lines(table(spark, ["\n".join(lines), lines[7][:-3] + "qqq"])).collect()}
    assert largest[0] < 30 and rows == {0: 0, 1: 1}


def postings(count, sizes):
    """Rows of one bucket and of equal signatures, in a pack of Arrow."""
    import numpy as np
    import pyarrow as pa
    one = np.ones(count, np.int64)
    return {"name": pa.array(np.arange(count)), "size": pa.array(np.asarray(sizes, np.int32)), **{c: pa.array(one) for c in fuzzy_lines.SIGNS}}, pa.array(one.astype(np.int32))


def test_pairs_of_families_are_verified_within_a_cell():
    """Links leave a cell, not pairs; a pair that the nearest ones did not link is found."""
    import numpy as np
    import pyarrow as pa
    texts = [f"a common line of words number {'abcdefgh'[i % 8]}" if i < 150 else f"zzzz quite other letters qqqq jjj {'abcdefgh'[i % 8]}" for i in range(300)]
    columns, one = postings(300, [len(t) for t in texts])
    order = np.lexsort((np.arange(300), [len(t) for t in texts]))
    batch = pa.RecordBatch.from_pydict({"band": one, "p": one, "q": one, "part": one, "own": pa.array([True] * 300), **columns, "label": pa.array(range(300), pa.int64()), "line": texts}).take(pa.array(order))
    pairs = [p for b in fuzzy_lines._linker(90)(iter([batch])) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    assert len(pairs) == 298 and all((a < 150) == (b < 150) for a, b in pairs)


def test_lines_of_a_cell_meet_a_few_candidates(monkeypatch):
    """Each line with candidates comes, with as many pairs as lines at most; a line of a block over RUN comes in any case."""
    import pyarrow as pa

    def met(count):
        columns, one = postings(count, sorted(range(100, 100 + count)))
        batch = pa.RecordBatch.from_pydict({"band": one, "p": one, "q": one, "part": one, "own": pa.array([True] * count), **columns})
        return {p for b in fuzzy_lines._cells(90)(iter([batch.slice(0, 7), batch.slice(7)])) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())}

    pairs = met(200)
    assert {x for p in pairs for x in p} == set(range(200)) and len(pairs) <= 400
    assert all(100 * (100 + a) >= 90 * (100 + b) for a, b in pairs)
    monkeypatch.setattr(fuzzy_lines, "RUN", 8)
    monkeypatch.setattr(fuzzy_lines, "AHEAD", 2)
    pairs = met(200)
    assert {(i, i) for i in range(200)} <= pairs and max(b - a for a, b in pairs) <= 2


def test_bands_of_length_in_parts(spark, monkeypatch):
    """Bands that are dealt in parts, part against part, give the same rows as all pairs by edit distance."""
    monkeypatch.setattr(fuzzy_lines, "CELL", 12)
    rng = random.Random(8)
    base = [" ".join(some_word(rng) for _ in range(k)) for k in (9, 9, 10, 10, 11, 30)]
    texts = []
    for line in base * 12:
        near = list(line)
        near[rng.randrange(len(near))] = rng.choice("abcxyz")
        texts.append("".join(near) + rng.choice(["", "s"]))
    rows = fuzzy_lines.dedup_lines(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in rows} == plain_lines(list(enumerate(texts)))
