"""The manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from offerloom.llm import merkle, queries


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text=None):
    told = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in told)


def plain_tree(leaves):
    """The last node, and for each leaf its siblings per level with its number among them."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = at[i] // 16 * 16
            path.append((at[i] - run, level[run:at[i]] + level[at[i] + 1:run + 16]))
            at[i] //= 16
        level = [digest(level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def plain(rows):
    trees = {}
    for row in sorted(rows, key=lambda r: ((r["doc_id"] is not None, r["doc_id"] or 0), plain_leaf(r))):
        trees.setdefault(row["source"], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: plain_tree([plain_leaf(r) for r in trees[s]]) for s in names}
    root, upper = plain_tree([built[s][0] for s in names])
    for s, over in zip(names, upper):
        for row, path in zip(trees[s], built[s][1]):
            path = path + over
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"]) if hit else None
            node = plain_leaf(row, lowered)
            for own, others in path:
                node = digest(others[:own] + [node] + others[own:])
            yield row["doc_id"], plain_leaf(row), built[s][0], root, digest(d for _, o in path for d in o), node, node == root


def rows_of(count, seed=1):
    rng = random.Random(seed)
    rows = [dict(doc_id=i * 7 % count, source=None if i % 31 == 0 else "hot" if i % 3 == 0 else rng.choice(["a", "A", "é", "lone" if i == 5 else "z", ""]),
                 lang=rng.choice(["en", None]), n_chars=rng.choice([None, i]), text=rng.choice([None, "", "no capitals", f"Text {i} Ünder", "x" * 5000])) for i in range(count)]
    return rows


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, tree string, proof int, __key string"


@pytest.mark.parametrize("count", [1, 17, 700])
def test_query_against_plain_tree(spark, tmp_path, count):
    rows = rows_of(count)
    path = str(tmp_path)
    spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "clash", 1, "clash") for r in rows], SHAPE).repartition(5).write.parquet(f"{path}/documents.parquet")
    got = queries.QUERIES["op13_merkle"](spark, path).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain(rows))
    assert got[0].asDict().keys() == {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"}


def test_null_keys_and_repeated_rows(spark):
    rows = [dict(doc_id=None, source="s", lang=None, n_chars=None, text="A")] * 3 + [dict(doc_id=4, source="s", lang="en", n_chars=1, text="A")] * 20 + [dict(doc_id=4, source="s", lang="en", n_chars=1, text="B")]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.manifest(docs)
    got = made.proofs().collect()
    assert sorted((r.leaf, r.subroot, r.root, merkle.siblings_digest(r.proof)) for r in got) == sorted(r[1:5] for r in plain(rows))
    assert all(merkle.fold(r.leaf, r.proof) == made.root for r in got) and sorted(r.position for r in got) == list(range(24))
    assert merkle.fold("0" * 64, got[0].proof) != made.root


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.manifest(docs)
    assert made.root is None and made.proofs().collect() == []


def test_only_some_levels_are_stored(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    made = merkle.manifest(docs, str(tmp_path / "m"))
    finer = merkle.manifest(docs, every=1).proofs().where("position % 1000 = 999")
    assert finer.union(made.proofs().where("position % 1000 = 999")).distinct().count() == 5
    sizes = [spark.read.parquet(f"{made.path}/trees/level={k}").count() for k in range(made.levels)]
    assert sizes == [5000, 2, 1]  # 313, 20 and 2 nodes in between are made again
    top, paths = plain_tree([plain_leaf(r.asDict()) for r in docs.collect()])
    assert top == made.root
    row = made.proofs().where("position = 4999").first()
    assert list(merkle.steps_of(row.proof)) == paths[4999]
