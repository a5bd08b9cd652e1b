"""Texts go to Python once, and counts of n-grams are made for a few rows at a time."""

import numpy as np
import pyarrow as pa

from offerloom.llm import langid
from offerloom.llm._words import slices


def test_text_is_sent_once(spark):
    docs = spark.createDataFrame([(1, "the house of the king", "en"), (2, "das haus des königs", "de"), (3, None, None)], "doc_id long, text string, lang string")
    found = langid.predict(docs, langid.fit(docs), keep=("doc_id", "text", "lang"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "__text" not in plan
    assert [tuple(r)[:4] for r in found.orderBy("doc_id").collect()] == [
        (1, "the house of the king", "en", "en"), (2, "das haus des königs", "de", "de"), (3, None, None, "und")]


def test_counts_are_made_for_a_few_rows(monkeypatch):
    made, count = [], np.bincount

    def watched(values, minlength=0):
        made.append(minlength)
        return count(values, minlength=minlength)

    texts = [f"row {i} " + "word " * (i % 5) for i in range(50)] + [""]
    part = next(slices(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    monkeypatch.setattr(np, "bincount", watched)
    counts, sizes = langid.profiles(part)
    assert max(made) <= langid.BUCKETS * 16 and len(counts) == 51
    for i in (0, 15, 16, 49, 50):
        alone, size = langid.profiles(next(slices(iter([pa.RecordBatch.from_pydict({"text": [texts[i]]})]))))
        assert (alone[0] == counts[i]).all() and size[0] == sizes[i]
