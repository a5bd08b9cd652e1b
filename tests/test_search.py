import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, ids
from offerloom.functions import report
from offerloom.operators import search as s

# Five offers of a made-up year: two closing this summer, one without an end, one not open yet, one over.
KELP = dict(id="ifs:41", source="Innovate UK", title="Kelp dryers", url="https://own.example/kelp", opened_date="2026-05-11", closes_date="2026-07-20",
            funding_min=20000, funding_max=90000, sector_tags="Seaweed", niche_tags="Drying", summary="Salt in the air ducts.", description="Racks, fans and a shed.", status="open")
BELL = dict(id="konfer:bell", source="Konfer", title="Bell towers", url="https://own.example/bell", opened_date="2025-02-03",
            funding_min=1000, funding_max=8000, sector_tags="Heritage", niche_tags="Ropes", description="Woodworm and oak.", status="rolling")
FERRY = dict(id="ifs:77", source="Innovate UK", title="Ferry batteries", url="https://own.example/ferry", opened_date="2026-10-05", closes_date="2027-01-31",
             funding_min=400000, funding_max=3000000, sector_tags="Shipping", niche_tags="Cells", description="Charging at the quay in 12%5 steps.", status="upcoming")
MOSS = dict(id="iukbc:moss", source="iuk_business_connect", title="Moss walls", url="https://own.example/moss", opened_date="2026-03-02", closes_date="2026-07-31", description="No sums named here.", status="open")
PAST = dict(id="ifs:9", source="Innovate UK", title="Kelp nets", url="https://own.example/past", opened_date="2026-02-01", closes_date="2026-06-01", description="Over yesterday.", status="open")

D = dt.date


@pytest.mark.parametrize("form, expected", [
    (dict(keyword="quay"), ["ifs:77"]),
    (dict(keyword=" WOODWORM  "), ["konfer:bell"]),
    (dict(keyword="ducts"), ["ifs:41"]),
    (dict(keyword="kelp"), ["ifs:41"]),  # the nets are over
    (dict(keyword="m_ss"), ["iukbc:moss"]),
    (dict(keyword="m_ss", literal=True), []),
    (dict(keyword="12%5", literal=True), ["ifs:77"]),
    (dict(keyword="\\quay"), []),
    (dict(sector_or_niche="ropes"), ["konfer:bell"]),
    (dict(sector_or_niche="shed"), ["ifs:41"]),
    (dict(sources=("Konfer",)), ["konfer:bell"]),
    (dict(opens_from=D(2026, 4, 1), closes_to=D(2026, 7, 25)), ["ifs:41"]),
    (dict(closes_from=D(2026, 7, 25)), ["iukbc:moss", "ifs:77"]),
    (dict(min_funding=95000.0), ["iukbc:moss", "ifs:77"]),
    (dict(max_funding=5000.0), ["iukbc:moss", "konfer:bell"]),
    (dict(sources=("innovate_uk",)), ["ifs:41", "iukbc:moss", "ifs:77"]),
    (dict(), ["ifs:41", "iukbc:moss", "konfer:bell", "ifs:77"]),
])
def test_search(offers, form, expected):
    df = offers(KELP, BELL, FERRY, MOSS, PAST)
    assert ids(s.search(df, s.SearchForm(**form), AS_OF)) == expected


def test_form_from_text():
    form = s.SearchForm.from_text(min_funding="nan", max_funding="1e3", opens_from="2026-13-01", closes_to="2026-10-01", source="ukri")
    assert (form.min_funding, form.max_funding, form.opens_from, form.closes_to) == (None, 1000.0, None, D(2026, 10, 1))
    assert form.sources == ("ukri",)


def test_facets_hold_core_sources(offers):
    rows = s.facets(offers(KELP, dict(KELP, id="X", source="new_source")), AS_OF).collect()
    assert [(r["value"], r["label"]) for r in rows] == [
        ("innovate_uk", "Innovate UK"), ("ukri", "UKRI"), ("horizon_europe", "Horizon Europe"),
        ("konfer", "Konfer"), ("new_source", "New Source")]


def test_group_counts_and_point_lookup(offers):
    df = offers(KELP, FERRY)
    assert [(r["status"], r["n"]) for r in s.group_counts(df).collect()] == [("open", 1), ("rolling", 0), ("upcoming", 1)]
    assert ids(s.by_id(df, "ifs:41")) == ["ifs:41"]
    assert ids(s.by_id(df, "none")) == []


def test_clean_tags(spark):
    """Codes and the source's own name go, one prefix is cut, a tag stays once."""
    tags = ["HORIZON-CL6-2027-FARM-03", "Soil Carbon", "Horizon Europe", "HORIZON Lump Sum Grants", "Soil Carbon"]
    got = spark.createDataFrame([(tags,)], "tags array<string>").select(report.clean_tags(F.col("tags"), F.lit("Horizon Europe")).alias("t")).first()["t"]
    assert got == ["Soil Carbon", "Lump Sum Grants"]


def test_cards(offers):
    df = offers(
        dict(KELP, closes_date="2026-06-10"),
        dict(KELP, id="horizon:abc", source="horizon_europe", sector_tags=None, niche_tags=None, funding_currency="EUR",
             funding_min_native=1000.9, funding_max_native=None, funding_min=860.5, title="The Big-Data pilot", summary="x"),
        dict(KELP, id="N", funding_min=None, funding_max=None, title="t"))
    got = {r["id"]: r for r in s.cards(df, AS_OF).collect()}
    assert got["ifs:41"]["closing_soon"] and not got["N"]["closing_soon"]
    assert got["ifs:41"]["funding_text"] == "GBP 20,000 - GBP 90,000"
    assert got["horizon:abc"]["funding_text"] == "EUR 1,000 - No upper limit"
    assert got["horizon:abc"]["converted_text"] == "approx GBP 860 - GBP 90,000"
    assert got["N"]["funding_text"] == "Not listed"
    assert got["horizon:abc"]["chips"] == ["Data", "Pilot"]
    assert got["ifs:41"]["chips"] == ["Seaweed", "Drying"]
    assert got["horizon:abc"]["reference"] == "ABC"


def test_live_filter_reaches_the_files(spark, offers, tmp_path):
    from offerloom.sources import snapshots
    root = str(tmp_path / "offers")
    snapshots.write_snapshot(offers(KELP, BELL, dict(KELP, id="X", status="inactive")), root)
    form = s.SearchForm(sources=("konfer",), min_funding=1.0)
    plan = s.search(snapshots.read_snapshot(spark, root), form, AS_OF).select("id")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = plan[plan.index("Scan parquet"):]
    assert "NOT (status" in scan.split("PartitionFilters")[1].split("\n")[0]
    pushed = scan.split("PushedFilters")[1].split("\n")[0]
    for part in ("closes_date", "funding_max", "In(source"):
        assert part in pushed
    read = scan.split("ReadSchema")[1].split("\n")[0]
    assert "description" not in read and "url" not in read


def test_names_in_any_spelling(spark, offers):
    wanted = spark.createDataFrame([("innovate_uk",), ("elsewhere",)], "source_key string")
    df = offers(KELP, BELL, MOSS, dict(KELP, id="E", source="elsewhere"))
    assert sorted(ids(s.in_any_spelling(df, wanted))) == ["E", "ifs:41", "iukbc:moss"]


def test_group_counts_of_every_value(offers):
    rows = offers({"id": "a", "source": "ukri"}, {"id": "b", "source": "ukri", "status": "rolling"}, {"id": "c", "source": None}, {"id": "d", "source": "other", "status": "inactive"})
    got = {(r.source, r.status): r.n for r in s.group_counts_by(rows, "source").collect()}
    assert len(got) == 9 and {k for k, n in got.items() if n} == {("ukri", "open"), ("ukri", "rolling"), (None, "open")}
    assert s.group_counts_by(rows.limit(0), "source").collect() == []
