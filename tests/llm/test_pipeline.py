import random

import public_tokenizers

import corpus_pipeline
from offerloom.llm import bpe

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    # The same words but one, with other line breaks: no line stands in both, the whole texts meet as near copies.
    names = ["".join(random.Random(i).choices("aeinorst", k=6)) for i in range(60)]
    words = [f"the {names[i]} of" for i in range(60)]
    near = [*words[:30], "another short line", *words[31:]]
    broken = lambda told, n: "\n".join(" ".join(told[i:i + n]) for i in range(0, 60, n))
    line = "This longer line of nine words stands in two texts"
    more = spark.createDataFrame([
        (9000, broken(words, 20), "en", "own", 1), (9001, broken(near, 30), "en", "own", 1), (9002, "Own words stand here before " + item, "en", "own", 1),
        (9003, None, None, None, None), (9004, "12 34", "en", "own", 5), (9005, line, "en", "own", 9), (9006, "Some more.\n" + line, "en", "own", 9),
        (9007, "A short line stays once", "en", "own", 1), (9007, "A short line stays once", "en", "own", 1), (None, "An own line without any id", "en", "own", 1)], docs.schema)
    docs = docs.union(more)
    columns = docs.columns
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "tokens" or docs.columns == columns
    assert {9003, 9004}.isdisjoint(kept["language"]) and {9000, 9001, 9002, 9005, 9006} <= kept["language"]
    after = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(str(tmp_path / "1")).where("doc_id in (9005, 9006)").collect()}
    assert after == {9005: (line, 9), 9006: ("Some more.", 10)}
    assert 9000 in kept["near copies"] and 9001 not in kept["near copies"] and 9002 in kept["near copies"] and 9002 not in kept["benchmark"]
    assert kept["tokens"] == kept["benchmark"]
    assert None in kept["near copies"] and spark.read.parquet(str(tmp_path / "2")).where("doc_id = 9007").count() == 1
    vocabulary = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    import numpy as np
    for r in docs.limit(40).collect():
        assert vocabulary.decode(np.frombuffer(bytes(r.ids), "<u4").tolist()).decode() == (texts[r.doc_id] or "")


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text), (5, text), (3, text + " more"), (None, text), (None, text + " x"), (7, None), (7, None), (8, ""), (None, "alone here")], "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, docs, FOLDER).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(3, text + " more"), (7, None), (7, None), (8, ""), (None, "alone here")], docs.schema).collect()))


def test_empty_table_through_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.collect() == [] and (name == "tokens" or docs.columns == columns)
