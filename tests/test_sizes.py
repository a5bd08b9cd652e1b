"""Jobs over pages whose tables repeat so well that their files look small: nothing of them goes through the driver."""

import pytest
from pyspark.sql import functions as F

from offerloom.plans import q_runs, registry
from offerloom.plans.sample import part_days
from offerloom.sources import buckets, landed

registry.load()


@pytest.fixture
def no_broadcast(spark):
    """Any broadcast fails, also one that is chosen at run time."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.fixture
def parts(spark, tmp_path):
    rows = [(k, f"name {k}", f"Brand#{k % 3}", "PROMO" if k % 5 == 0 else "SMALL", 50 if k in (13, 14) else k % 40 + 1, 900.0) for k in range(1, 41)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_broadcasts_do_fail(spark, no_broadcast):
    few = spark.range(3)
    with pytest.raises(Exception, match="(?i)broadcast"):
        spark.range(9).join(F.broadcast(few), "id").collect()


def test_crawls_by_next_link(spark, no_broadcast):
    links = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(40)], "url string, next_url string")
    starts = spark.createDataFrame([("c", "u0"), ("d", "u30")], "crawl string, url string")
    found = sorted(map(tuple, landed.by_next_link(links, starts).collect()))
    assert found == sorted([("c", f"u{i}", i + 1) for i in range(40)] + [("d", f"u{i}", i - 29) for i in range(30, 40)])


def test_places_of_parts(spark, parts, no_broadcast):
    kept = {r.p_partkey: r for r in q_runs.places(spark, parts).collect()}
    for brand in range(3):
        keys = [k for k in range(1, 41) if k % 3 == brand]
        assert [(kept[k].page_no, kept[k].next_key, kept[k].first_key) for k in keys] == [
            (n, keys[n] if n < len(keys) else keys[1], keys[0]) for n, k in enumerate(keys, 1)]
    assert "collect_list" not in q_runs.places(spark, parts)._jdf.queryExecution().toString()
    pages = part_days(spark, parts).select("p_partkey", F.lit("u").alias("url"), F.lit("h").alias("html"))
    assert q_runs.numbered(spark, parts, pages).count() == 40
    answers = q_runs.paged(part_days(spark, parts).select("p_partkey", "p_name"), spark, parts, 3)
    assert sorted(len(r.results) for r in answers.collect()) == [1, 1, 2, *[3] * 12]


def test_a_repeated_epoch_costs_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    first = buckets.change(spark, str(tmp_path), rows, buckets.replaced, schema=rows.schema, epoch=("s", 1))
    broken = spark.range(1).select(F.raise_error(F.lit("worked out again")).cast("string").alias("id"), F.lit(2).alias("n"))
    again = buckets.change(spark, str(tmp_path), broken, buckets.replaced, schema=rows.schema, epoch=("s", 1))
    assert again.version == first.version == 1


def test_written_rows_are_not_written_again_and_stay(spark, tmp_path):
    from offerloom.session import cut_lineage

    rows = cut_lineage(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"))
    buckets.change(spark, str(tmp_path), rows, buckets.replaced, schema=rows.schema)
    assert rows.count() == 2 and buckets.read(spark, str(tmp_path), rows.schema).count() == 2
