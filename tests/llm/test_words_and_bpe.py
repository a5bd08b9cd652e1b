import random

import public_tokenizers
import pytest
import tiktoken

from offerloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    letters = "ab é한ñ\n\t\x1c\x85\xa0  01!?#ªÀ×ɏɐ²¾٣\U0001f600theinger"
    return ["", " ", "a" * 5000, " " * 3000, "ab" * 3000, "it's we'll I'd", "<|endoftext|>"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]


def test_ids_and_round_trip(spark, reference):
    rows = [(i, t) for i, t in enumerate([None, *texts()])]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = reference.encode_ordinary(text or "")
        assert bytes(got[i].ids) == b"".join(t.to_bytes(4, "little") for t in want)
        assert got[i].n_tokens == len(want) and bytes(got[i].decoded) == (text or "").encode()


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")
    assert bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).count() == 2
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_appends_and_edits_agree_with_a_fresh_table(vocabulary):
    rng = random.Random(5)
    alphabet = b"abthe inger\xc3\xa9"
    for _ in range(300):
        body = bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        table = vocabulary.extend(body, [])
        more = body + bytes(rng.choice(alphabet) for _ in range(5))
        assert vocabulary.extend(more, list(table)) == vocabulary.extend(more, [])
        start = rng.randrange(len(body) + 1)
        stop, new = rng.randrange(start, len(body) + 1), bytes(rng.choice(alphabet) for _ in range(rng.randrange(6)))
        out, spliced = vocabulary.splice(body, table, start, stop, new)
        assert out == body[:start] + new + body[stop:] and spliced == vocabulary.extend(out, [])
