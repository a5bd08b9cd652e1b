import random

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, NOW
from offerloom.operators import dedupe
from offerloom.session import cut_lineage


def by_id(df):
    return {r["id"]: r for r in df.collect()}


SITE = "https://apply-for-innovation-funding.service.gov.uk/competition"
PARTNER = "https://iuk-business-connect.org.uk/opportunities"


def test_an_id_inside_a_text_links_two_sources(offers):
    """The second text only mentions the competition of the first; the broker's link is the second's own page."""
    base = offers(
        dict(id="ifs:610", source="innovate_uk", title="Quiet tugboats", url=f"{SITE}/610/overview", closes_date="2026-10-02"),
        dict(id="iukbc:tugs", source="iuk_business_connect", title="Tugs that hum less", url=f"{PARTNER}/tugs/", description=f"See {SITE}/610/faq for terms", closes_date="2026-10-09"),
        dict(id="konfer:t", source="konfer", title="Harbour noise money", url=f"{PARTNER}/tugs", closes_date="2026-11-01"),
        dict(id="konfer:other", source="konfer", title="Harbour lights", url=f"{PARTNER}/lights", closes_date="2026-11-01"))
    result = dedupe.mark_duplicates(base, AS_OF, NOW)
    rows = by_id(result)
    kept = {i for i, r in rows.items() if r["status"] != "inactive"}
    assert kept == {"iukbc:tugs", "konfer:other"} and result.where("_changed").count() == 2


def test_title_counts_with_its_closing_day(offers):
    same = dict(title="Moss  Walls!", url="", description="d")
    base = offers(dict(same, id="ukri:m", source="ukri", closes_date="2026-12-01"), dict(same, id="konfer:m", source="konfer", title="moss walls", closes_date="2026-12-01"),
                  dict(same, id="konfer:later", source="konfer", closes_date="2026-12-02"))
    rows = by_id(dedupe.mark_duplicates(base, AS_OF, NOW))
    assert {i: r["status"] for i, r in rows.items()} == {"ukri:m": "open", "konfer:m": "inactive", "konfer:later": "open"}


def _links(*names):
    return " ".join(f"https://k.org/{n}" for n in names)


def _row(name, keys, **kw):
    return dict(dict(id=name, source="ukri", title=name, url="", description=_links(*keys)), **kw)


def test_chain_keeps_both_ends(offers):
    rows = by_id(dedupe.mark_duplicates(offers(_row("A", ["k1"]), _row("B", ["k1", "k2"]), _row("C", ["k2"])), AS_OF, NOW))
    assert [rows[i]["status"] for i in "ABC"] == ["open", "inactive", "open"]


def test_revive(offers):
    base = offers(_row("A", ["k1"], status="inactive", opened_date="2026-07-01"), _row("B", ["k1"]))
    result = dedupe.mark_duplicates(base, AS_OF, NOW)
    rows = by_id(result)
    assert (rows["A"]["status"], rows["B"]["status"]) == ("upcoming", "inactive")
    assert result.where("_changed").count() == 2


def test_no_revive_by_a_row_further_up(offers):
    rows = by_id(dedupe.mark_duplicates(
        offers(_row("A", ["k1"]), _row("B", ["k1", "k2"]), _row("C", ["k2"], status="inactive")), AS_OF, NOW))
    assert rows["C"]["status"] == "inactive"


def test_rows_without_keys_and_generic_links(offers):
    base = offers(_row("A", []), _row("B", []), *[
        _row(n, [], url="https://iuk-business-connect.org.uk/programme/x", closes_date=d) for n, d in (("C", "2026-07-01"), ("D", "2026-07-02"))])
    assert dedupe.mark_duplicates(base, AS_OF, NOW).where("_changed").isEmpty()


def _model(rows):
    """The ranking walked row by row, as plain Python."""
    owner, dups, owners = {}, set(), set()
    for rank, keys in rows:
        hit = {owner[k] for k in keys if k in owner}
        if hit:
            dups.add(rank)
            owners |= hit
        else:
            owner.update(dict.fromkeys(keys, rank))
    return dups, owners


@pytest.mark.parametrize("seed, hot_share", [(0, 1000), (1, 20), (50, 1)])
def test_rounds_match_the_ranking_rule(spark, monkeypatch, seed, hot_share):
    """Against the model: with all, some and no keys taken as hot."""
    monkeypatch.setattr(dedupe, "HOT_SHARE", hot_share)
    rng = random.Random(7 + seed)
    cases = []
    for case in range(12):
        keys = [f"c{case}-{i}" for i in range(rng.randint(2, 25))]
        # One key on about a third of the rows, the rest spread.
        cases.append([(n, sorted({rng.choice(keys) for _ in range(rng.randint(0, 3))} | ({keys[0]} if rng.random() < 0.33 else set())))
                      for n in range(rng.randint(5, 60))])
    rows, expected = [], {}
    for i, case in enumerate(cases):
        base = i * 1000
        dups, owners = _model([(base + n, k) for n, k in case])
        for n, k in case:
            rows.append((f"id{base + n}", base + n, k))
            expected[base + n] = (base + n not in dups, base + n in owners)
    ranked = cut_lineage(spark.createDataFrame(rows, "id string, rank bigint, keys array<string>"))
    got = {r["rank"]: (r["kept"], r["owns_copy"]) for r in dedupe.decide(ranked).collect()}
    assert got == expected


def test_long_chain_in_bad_order(spark):
    rows = [(f"r{i}", i, [f"k{i}", f"k{i + 1}"]) for i in range(24)]
    ranked = cut_lineage(spark.createDataFrame(rows, "id string, rank bigint, keys array<string>"))
    got = {r["rank"]: r["kept"] for r in dedupe.decide(ranked).collect()}
    assert got == {i: i % 2 == 0 for i in range(24)}


def test_link_ends_at_a_hard_blank(spark):
    row = spark.createDataFrame([("https://own.example/a\u00a0and more",)], "d string").select(
        dedupe.canonical_keys(F.lit(None).cast("string"), F.col("d"), F.lit(None).cast("string"), F.lit(None).cast("date")).alias("k")).first()
    assert row.k == ["url:own.example/a"]
