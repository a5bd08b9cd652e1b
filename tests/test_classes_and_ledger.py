import datetime as dt

import pytest

from conftest import AS_OF, NOW
from offerloom import fixed_values as fv
from offerloom.model import CATALOGUE, SPECS
from offerloom.operators import classify, ledger
from offerloom.plans import ingest
from offerloom.plans.q_classes import APPLICANTS, PLACES
from offerloom.sources import snapshots


@pytest.mark.parametrize("cases, column", [(PLACES, "geographic_scope"), (APPLICANTS, "eligible_applicants")])
def test_phrases_get_their_class(spark, cases, column):
    rows = [(i, source, text) for i, (_, source, text) in enumerate(cases)]
    got = {r["n"]: r[column] for r in classify.classify(spark.createDataFrame(rows, "n int, source string, description string")).collect()}
    assert got == {i: wanted for i, (wanted, _, _) in enumerate(cases)}


def test_rows_without_text(spark):
    row = classify.classify(spark.createDataFrame([(None,)], "title string")).first()
    assert (row["geographic_scope"], row["eligible_applicants"]) == ("unknown", "any")


def test_reclassify_twice_changes_nothing(offers):
    base = offers(dict(id="a", source="ukri", title="Business Wales fund"), dict(id="b", source="innovate_uk", geographic_scope="uk_wide", eligible_applicants="business"))
    once = classify.reclassify(base)
    assert {r["id"]: r["_changed"] for r in once.collect()} == {"a": True, "b": False}
    assert classify.reclassify(once.drop("_changed", "_place_changed", "_who_changed")).where("_changed").isEmpty()


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value string")


def health(spark, today, *pairs):
    return tuple(ledger.health(rows(spark, *pairs), today).first())


def test_health_after_success(spark):
    pairs = [("last_successful_ingest_at", "2026-06-02T06:04:00+00:00"), ("last_ingest_run", '{"checked_at": "2026-06-02T06:04:00+00:00", "status": "success"}')]
    assert health(spark, "2026-06-02", *pairs) == ("success", "Loaded successfully", "2 June 2026, 06:04 UTC")
    assert health(spark, "2026-06-03", *pairs)[:2] == ("today_pending", "Today's refresh pending")


def test_health_fallbacks(spark):
    state = lambda s, status: (f"source_status:{s}", '{"status": "%s"}' % status)
    assert health(spark, "2026-06-02")[0] == "unknown"
    assert health(spark, "2026-06-02", state("ukri", "failed"))[0] == "failed"
    assert health(spark, "2026-06-02", state("ukri", "failed"), state("konfer", "success"))[0] == "partial_success"
    assert health(spark, "2026-06-02", ("last_ingest_run", "[]"), state("konfer", "success"))[0] == "today_pending"


def test_source_health_shows_the_last_success(spark):
    table = rows(spark, ("source_status:horizon_europe", '{"checked_at": "2026-06-09T16:13:19+00:00", "error": "HTTP 500", '
                         '"last_successful_at": "2026-06-08T06:20:00+00:00", "source": "horizon_europe", "status": "failed"}'), ("source_status:ukri", "broken"))
    got = {r["source"]: r for r in ledger.source_health(table).collect()}
    assert len(got) == 5 and got["ukri"]["status"] == "unknown" and got["konfer"]["checked_at"] == "Not yet updated"
    assert (got["horizon_europe"]["last_successful_at"], got["horizon_europe"]["error"]) == ("8 June 2026, 06:20 UTC", "HTTP 500")


def test_check_note(spark):
    note = lambda v: [r["note"] for r in ledger.check_note(rows(spark, (fv.BROKER_CHECK_KEY, v))).collect()]
    assert note('{"checked_at": "2026-06-04T12:51:00+00:00", "non_duplicate_records": 0}') == [fv.ZERO_RESULT_TEXT]
    assert note('{"checked_at": "2026-06-04T12:51:00+00:00", "non_duplicate_records": 2}') == [None]
    assert note('{"checked_at": "soon", "non_duplicate_records": 0}') == [None]


def test_states_keep_the_earlier_success(spark):
    at = lambda d: dt.datetime(2026, 6, d)
    schema = ingest.CHECK
    first = ledger.source_states(spark.createDataFrame([("a", "success", at(1), 3, None), ("b", "success", at(1), 1, None)], schema))
    second = ledger.source_states(spark.createDataFrame([("a", "failed", at(2), None, "HTTP 500")], schema), first)
    got = {r["source"]: tuple(r)[1:] for r in second.collect()}
    assert got == {"a": ("failed", at(2), at(1), None, "HTTP 500"), "b": ("success", at(1), at(1), 1, None)}


def test_whole_run(spark, offers, tmp_path):
    root = str(tmp_path / "catalogue")
    old = dict(url="https://e.org/old", title="Old")
    snapshots.write_snapshot(offers(
        dict(old, id="konfer:gone", source="Konfer", status="rolling"), dict(old, id="ukri:late", source="ukri", title="Late", closes_date="2026-06-01")), f"{root}/offers")

    def broken(_):
        raise RuntimeError("HTTP 500")

    fresh = lambda s: s.createDataFrame([("konfer:new", "konfer", "New", "https://e.org/new", "d")], "id string, source string, title string, url string, description string")
    jobs = [ingest.SourceJob(SPECS["ukri"], broken), ingest.SourceJob(SPECS["konfer"], fresh)]
    checks = {r["source"]: r for r in ingest.run(spark, root, jobs, AS_OF, NOW).collect()}
    assert (checks["ukri"]["status"], checks["ukri"]["error"]) == ("failed", "HTTP 500")
    assert (checks["konfer"]["status"], checks["konfer"]["count"]) == ("success", 2)
    rows = {r["id"]: r for r in snapshots.read_snapshot(spark, f"{root}/offers").collect()}
    assert {i: r["status"] for i, r in rows.items()} == {"konfer:gone": "inactive", "ukri:late": "inactive", "konfer:new": "rolling"}
    assert rows["konfer:new"]["eligible_applicants"] == "any"
    metadata = snapshots.read_metadata(spark, f"{root}/ledger")
    assert ledger.health(metadata, AS_OF).first()["status"] == "partial_success"
    assert metadata.where("key = 'last_successful_ingest_at'").isEmpty()
    ingest.run(spark, root, jobs[1:], AS_OF, NOW)
    metadata = snapshots.read_metadata(spark, f"{root}/ledger")
    assert ledger.health(metadata, AS_OF).first()["status"] == "success"
    got = {r["source"]: r["status"] for r in ledger.source_health(metadata).collect()}
    assert (got["ukri"], got["konfer"]) == ("failed", "success")


def test_uncommitted_versions_are_not_read(spark, offers, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.read_snapshot(spark, root).isEmpty()
    snapshots.write_snapshot(offers(dict(id="a")), root)
    (tmp_path / "t" / "version=000000002").mkdir()
    assert snapshots.read_snapshot(spark, root).count() == 1
    assert snapshots.read_snapshot(spark, root).schema == CATALOGUE
