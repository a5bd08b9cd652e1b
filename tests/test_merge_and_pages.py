import datetime as dt

from pyspark.sql import functions as F

from conftest import AS_OF, NOW
from offerloom.functions import money, report
from offerloom.model import SPECS
from offerloom.operators import enrich, merge, normalise
from offerloom.sources import snapshots


def test_an_id_twice_in_a_batch_is_one_row(spark, offers):
    base = offers({"id": "ukri:old", "source": "ukri", "title": "Old"})
    batch = offers({"id": "ukri:1", "source": "ukri", "title": "B"}, {"id": "ukri:1", "source": "ukri", "title": "A"})
    rows = [r for r in merge.upsert_all(base, [(batch, SPECS["ukri"])], AS_OF, NOW).collect() if r["id"] == "ukri:1"]
    assert [(r["title"], r["_action"]) for r in rows] == [("A", "insert")]


def test_a_failed_write_does_not_block_the_next(spark, offers, tmp_path):
    root = str(tmp_path / "table")
    assert snapshots.write_snapshot(offers({"id": "a", "source": "ukri"}), root) == 1
    (tmp_path / "table" / f"{snapshots._PREFIX}{2:09d}").mkdir()  # what a broken write leaves
    assert snapshots.write_snapshot(offers({"id": "b", "source": "ukri"}), root) == 3
    assert [r["id"] for r in snapshots.read_snapshot(spark, root).collect()] == ["b"]


FACT = "array<struct<label:string,value:string,stamp:string>>"


def cards(spark, *rows):
    schema = f"source_url string, title string, facts {FACT}, opened_date date, closes_date date, description string, application_url string, summary string"
    return spark.createDataFrame([(u, t, [("funders", f, None)], None, dt.date(2026, 9, 1), d, "", "s") for u, t, f, d in rows], schema)


def test_card_survives_a_page_of_the_sole_funder(spark):
    listed = cards(spark, ("https://own.example/opportunity/x/", "Listed", "Some Council", "listing"))
    pages = cards(spark, ("https://own.example/opportunity/x/", "Page", "Innovate UK", "page")).drop("summary")
    both = enrich.council_with_detail(enrich.council_listed(listed), pages.union(pages))
    assert [(r["title"], r["description"]) for r in both.collect()] in ([("Listed", "listing")], [("Page", "page")])
    assert normalise.council_items(both, AS_OF).count() == 1
    assert enrich.council_listed(cards(spark, ("https://own.example/y", "T", "Innovate UK", "d"))).isEmpty()


def test_newest_rate_counts(spark):
    rate = spark.createDataFrame([(0.8, dt.date(2026, 1, 1)), (0.9, dt.date(2026, 5, 1))], "rate double, rate_date date")
    records = spark.createDataFrame([("s", "c", {"identifier": ["ABC-1"], "budgetOverview": ['{"budgetTopicActionMap":{"1":[{"minContribution":"100"}]}}']})], normalise.PORTAL_RECORD)
    row = normalise.portal_items(records, rate, AS_OF).first()
    assert (row["funding_min_native"], row["funding_min"]) == (100.0, 90.0)


def test_blanks_of_all_kinds(spark):
    row = spark.createDataFrame([("£2\u00a0million",)], "t string").select(
        money.first_amount(F.col("t")).alias("m"), report.clean_tags(F.array(F.lit("\tAI"), F.lit("AI")), F.lit("x")).alias("tags")).first()
    assert row.m == 2_000_000.0 and row.tags == ["AI"]
