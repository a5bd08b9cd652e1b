import collections
import re

import public_tokenizers
import pytest

from offerloom.llm import fertility

USE = fertility.Vocabularies(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
WORD = re.compile("[^\x20\x09-\x0D]+")
GOOD = "The harbour office opened early and the clerks sorted letters while rain fell on %d boats near the old pier before noon came round"


def brute(text):
    text = text or ""
    words, seen, copies = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    count = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if count[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), copies, len(again)


@pytest.fixture(scope="module")
def table(spark):
    texts = [None, "", " \n\x0b\n", "a\n\na\na", "one # two <b>\n" * 9, "x y z " * 40, "é한 \x1c b c"] + [GOOD % i for i in range(150)]
    texts += ["Boats Boats Boats Boats Boats Boats Boats rain rain rain rain rain rain rain " * 1 + "pier pier pier pier pier pier pier office office office office office office office"]
    return texts, spark.createDataFrame([(i, t, "en" if i % 5 else None, "own") for i, t in enumerate(texts)], "doc_id long, text string, lang string, reason string").repartition(3)


def test_counts(table):
    texts, docs = table
    rows = {r.doc_id: r for r in fertility.measure(docs, USE).collect()}
    for i, text in enumerate(texts):
        assert tuple(rows[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(text)


def test_verdicts(table):
    texts, docs = table
    rows = {r.doc_id: r for r in fertility.verdicts(fertility.measure(docs, USE)).collect()}
    assert len(rows) == len(texts)
    assert all(rows[i].kept for i in range(7, 157)) and not any(rows[i].kept for i in range(6))
    assert rows[157].reason == "entropy low" and not rows[157].base_failed


def test_empty_table(table):
    assert fertility.verdicts(fertility.measure(table[1].limit(0), USE)).collect() == []


def test_small_groups_are_judged_by_their_own_band(spark):
    greek = "το γραφείο του λιμανιού άνοιξε νωρίς και οι υπάλληλοι ταξινόμησαν γράμματα ενώ η βροχή έπεφτε σε βάρκες κοντά στην παλιά προβλήτα πριν έρθει το μεσημέρι"
    texts = [(i, GOOD % i, "en") for i in range(150)] + [(200 + i, f"{greek} {i}", "el") for i in range(3)] + [(300, greek, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert all(r.kept for r in fertility.verdicts(fertility.measure(docs, USE)).collect())
