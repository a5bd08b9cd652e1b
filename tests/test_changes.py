import datetime as dt

from conftest import AS_OF, NOW
from offerloom.model import SPECS
from offerloom.operators import merge


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def item(**kw):
    return dict(dict(title="T", url="https://e.com", status=None, last_seen=None), **kw)


OLD = dt.datetime(2026, 1, 1)


def test_partner_upsert_marks_stale(offers):
    base = offers(dict(id="iukbc:stale", source="iuk_business_connect", title="S", closes_date="2026-12-31", last_seen=OLD))
    batch = offers(item(id="iukbc:fresh", source="iuk_business_connect", opened_date="2026-05-29", closes_date="2026-07-08",
                        funding_min=2500, funding_max=2500, funding_currency="GBP"))
    result = merge.upsert(base, batch, SPECS["iuk_business_connect"], AS_OF, NOW)
    rows = by_id(result)
    assert rows["iukbc:fresh"]["status"] == "open" and rows["iukbc:fresh"]["_action"] == "insert"
    assert rows["iukbc:fresh"]["funding_currency"] is None
    assert rows["iukbc:stale"]["status"] == "inactive" and rows["iukbc:stale"]["last_seen"] == OLD
    assert merge.changed_rows(result).first()["changed"] == 2


def test_touching_sources_restamp_stale_rows(offers):
    base = offers(dict(id="ukri:x", source="ukri", last_seen=OLD), dict(id="konfer:y", source="Konfer", status="rolling", last_seen=OLD))
    batches = [(offers(item(id="ukri:new", source="ukri")), SPECS["ukri"]), (offers(item(id="konfer:n", source="konfer")), SPECS["konfer"])]
    rows = by_id(merge.upsert_all(base, batches, AS_OF, NOW))
    assert rows["ukri:x"]["last_seen"] == NOW and rows["konfer:y"]["last_seen"] == OLD
    assert rows["ukri:x"]["status"] == rows["konfer:y"]["status"] == "inactive"
    assert rows["ukri:new"]["status"] == "rolling"


def test_empty_crawl(offers):
    base = offers(dict(id="ukri:x", source="ukri"), dict(id="konfer:y", source="konfer"))
    empty = offers(item(id="q", source="ukri")).where("false")
    assert by_id(merge.upsert(base, empty, SPECS["ukri"], AS_OF, NOW))["ukri:x"]["status"] == "open"
    assert by_id(merge.upsert(base, empty, SPECS["konfer"], AS_OF, NOW))["konfer:y"]["status"] == "inactive"


def test_expired_items_are_not_seen(offers):
    base = offers(dict(id="ukri:x", source="ukri", closes_date="2026-05-01"))
    batch = offers(item(id="ukri:x", source="ukri", closes_date="2026-05-01"), item(id="ukri:ok", source="ukri"))
    rows = by_id(merge.upsert(base, batch, SPECS["ukri"], AS_OF, NOW))
    assert rows["ukri:x"]["status"] == "inactive"


def test_enriched_text_is_kept_and_closed_rows_go(offers):
    base = offers(
        dict(id="ifs:1234", source="innovate_uk", title="old", summary="One-line summary", description="Full enriched description",
             funding_max=5.0, closes_date="2026-07-01"),
        dict(id="ifs:plain", source="Innovate UK", summary="s", description="s"),
        dict(id="ifs:closed", source="Innovate UK", closes_date="2026-06-01"))
    batch = offers(
        item(id="ifs:1234", source="innovate_uk", title="new", summary="New summary", description="New summary", closes_date="2026-07-02"),
        item(id="ifs:plain", source="innovate_uk", summary="s2", description="s2"))
    result = merge.upsert(base, batch, SPECS["innovate_uk"], AS_OF, NOW)
    rows = by_id(result)
    assert "ifs:closed" not in rows
    kept = rows["ifs:1234"]
    assert (kept["title"], kept["summary"], kept["description"], kept["funding_max"]) == ("new", "New summary", "Full enriched description", 5.0)
    assert rows["ifs:plain"]["description"] == "s2" and rows["ifs:plain"]["status"] == "open"


def test_first_of_repeated_ids_wins_and_upsert_repeats_safely(offers, spark):
    from pyspark.sql import functions as F
    batch = offers(item(id="ukri:a", source="ukri", title="second"), item(id="ukri:a", source="ukri", title="first")).withColumn(
        "slot", F.when(F.col("title") == "first", 0).otherwise(1))
    base = offers(dict(id="other", source="konfer"))
    once = merge.upsert(base, batch, SPECS["ukri"], AS_OF, NOW, order=["slot"]).drop("_action")
    assert by_id(once)["ukri:a"]["title"] == "first"
    twice = merge.upsert(once, batch, SPECS["ukri"], AS_OF, NOW, order=["slot"]).drop("_action")
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_leading_rows_are_picked_on_the_map_side(offers):
    plan = merge.first_per_key(offers(item(id="a", source="s")), ["id"], ["title"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_expire_is_idempotent(offers):
    base = offers(dict(id="a", closes_date="2026-06-01"), dict(id="b", closes_date="2026-06-02"), dict(id="c"))
    once = merge.mark_expired(base, AS_OF, NOW)
    assert {r["id"] for r in once.where("_changed").collect()} == {"a"}
    assert merge.mark_expired(once.drop("_changed"), AS_OF, NOW).where("_changed").isEmpty()


def test_late_columns(spark):
    legacy = spark.createDataFrame([], "id string, source string, title string, url string, description string, status string, last_seen timestamp")
    for table in (legacy, merge.add_late_columns(legacy)):
        row = merge.migration_report(table).first()
        assert row["geographic_scope_present"] and row["eligible_applicants_present"]
        assert (row["total_rows"], row["geographic_scope_populated_rows"], row["eligible_applicants_populated_rows"]) == (0, 0, 0)


def test_metadata_upsert(spark):
    a = spark.createDataFrame([("k", "1"), ("l", "2")], "key string, value string")
    b = spark.createDataFrame([("k", None), ("m", "3")], "key string, value string")
    assert sorted(merge.upsert_metadata(a, b).collect()) == [("k", None), ("l", "2"), ("m", "3")]
