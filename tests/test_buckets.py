"""Changes by bucket: what they leave alone, two writers, repeated epochs."""

import threading

import pytest
from pyspark.sql import functions as F

from offerloom.sources import buckets, landed


def files(spark, root):
    return {p for path in buckets.newest(spark, root).paths(root) for p in [path]}


def rows_of(spark, root):
    return {r.id: r.title for r in buckets.read(spark, root).collect()}


def test_only_touched_buckets_are_written(spark, offers, tmp_path):
    root = str(tmp_path / "table")
    assert buckets.read(spark, root).isEmpty()
    buckets.change(spark, root, offers(*[dict(id=f"i{k}", title="old") for k in range(300)]), buckets.replaced)
    before = files(spark, root)
    buckets.change(spark, root, offers(dict(id="i7", title="new"), dict(id="z", title="added")), buckets.replaced)
    after = files(spark, root)
    assert 1 <= len(after - before) <= 2 and len(before & after) >= len(before) - 2
    told = rows_of(spark, root)
    assert len(told) == 301 and told["i7"] == "new" and told["z"] == "added" and told["i8"] == "old"
    buckets.change(spark, root, offers(dict(id="i7")), buckets.without)
    assert "i7" not in rows_of(spark, root) and buckets.newest(spark, root).version == 3


def test_an_epoch_counts_once(spark, offers, tmp_path):
    root = str(tmp_path / "table")
    add = lambda old, rows: old.unionByName(rows.select(*old.columns))  # noqa: E731  merging twice would show
    for epoch in (0, 0, 1, 1, 0):
        buckets.change(spark, root, offers(dict(id="a", title=str(epoch))), add, epoch=("stream", epoch))
    assert sorted(r.title for r in buckets.read(spark, root).collect()) == ["0", "1"]
    buckets.change(spark, root, offers(dict(id="a", title="other")), add, epoch=("another", 0))
    assert buckets.read(spark, root).count() == 3


def test_two_writers(spark, offers, tmp_path):
    root = str(tmp_path / "table")
    buckets.change(spark, root, offers(dict(id="a", title="1")), buckets.replaced)
    late = buckets.newest(spark, root)
    buckets.change(spark, root, offers(dict(id="b", title="2")), buckets.replaced)
    with pytest.raises(buckets.Conflict):
        buckets.commit(spark, root, buckets.Manifest(late.version + 1, late.buckets, late.parts, late.epochs))
    assert set(rows_of(spark, root)) == {"a", "b"}
    work = [threading.Thread(target=lambda k=k: buckets.change(spark, root, offers(dict(id=f"w{k}", title=str(k))), buckets.replaced)) for k in range(3)]
    for thread in work:
        thread.start()
    for thread in work:
        thread.join()
    assert set(rows_of(spark, root)) == {"a", "b", "w0", "w1", "w2"} and buckets.newest(spark, root).version == 5


def test_next_links_end(spark):
    chain = [(f"p{i}", f"p{i + 1}") for i in range(9)] + [("p9", None)]
    cycles = [("a", "b"), ("b", "c"), ("c", "a"), ("s", "s"), ("r0", "r1"), ("r1", "r2"), ("r2", "r1"), ("x", "gone"), ("y", "p8"), ("a", "z")]
    links = spark.createDataFrame(chain + cycles, "url string, next_url string")
    starts = spark.createDataFrame([(1, "p0"), (2, "a"), (3, "s"), (4, "r0"), (5, "x"), (6, "y"), (7, "nowhere"), (8, "p5")], "crawl int, url string")
    got = {}
    for r in landed.by_next_link(links, starts).collect():
        got.setdefault(r.crawl, {})[r.page_no] = r.url
    order = {c: [pages[n] for n in sorted(pages)] for c, pages in got.items()}
    assert order == {1: [f"p{i}" for i in range(10)], 2: ["a", "b", "c"], 3: ["s"], 4: ["r0", "r1", "r2"], 5: ["x"], 6: ["y", "p8", "p9"], 8: [f"p{i}" for i in range(5, 10)]}
    assert all(sorted(pages) == list(range(1, len(pages) + 1)) for pages in got.values())
    assert landed.by_next_link(links.limit(0), starts).collect() == []
