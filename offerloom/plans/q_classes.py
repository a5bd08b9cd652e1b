"""Place and applicant classes: known phrases per nation row, and whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import padded_key, phrase_literal
from ..operators import classify as cl
from .registry import query
from .sample import spread_table, table

# One text and source per nation key, with the class it has to get.
# Own sentences; only names of funds, councils and places, which the rules look for, are given.
PLACES = [
    ("uk_wide", "ukri", "Money for heat pumps in old terraces, any region."),
    ("uk_wide", "horizon_europe", "Peatland partners for Wales and its moors"),
    ("scotland", "konfer", "SMART: Scotland, round nine, opens after harvest"),
    ("scotland", "ukri", "Vouchers handed out by   Scottish Enterprise in spring"),
    ("scotland", "ukri", "Crofters may ask Highlands & Islands Enterprise"),
    ("scotland", "ukri", "Ferry electrification for Scotland"),
    ("wales", "ukri", "A loan book of the Development Bank of Wales"),
    ("wales", "ukri", "Slate tips: the Welsh-Government pays half"),
    ("wales", "ukri", "Tidal lagoon studies for Wales"),
    ("northern_ireland", "ukri", "Linen machinery, with Invest NI"),
    ("northern_ireland", "ukri", "Dairy sensors for Northern Ireland"),
    ("england_east_midlands,england_west_midlands", "ukri", "Equity out of the Midlands Engine Investment Fund"),
    ("england_north_east,england_north_west,england_yorkshire", "ukri", "Second close of the Northern Powerhouse Investment Fund"),
    ("england_south_west", "ukri", "Marine loans: South West Investment Fund"),
    ("england_yorkshire", "ukri", "A seed pot, the Yorkshire & Humber Investment Fund"),
    ("england_east", "ukri", "Fenland drainage, East of England Investment Fund"),
    ("england_london", "ukri", "Rehearsal rooms for organisations based in London"),
    ("england", "ukri", "Ten acres and more, businesses registered in England"),
    ("wales", "ukri", "Casting sand: companies based in Wales that Scottish Enterprise once helped"),
    ("scotland", "ukri", "Looms for companies located in Europe that Scottish Enterprise backs"),
    ("england_east", "ukri", "Seed trays, SMEs located in the East of England"),
    ("england_yorkshire", "ukri", "Cranes for companies based in Hull and the Humber"),
    ("uk_wide", "Horizon Europe ", "Glass recycling with Invest NI"),
    ("uk_wide", "ukri", "Corks for companies based in France"),
    ("northern_ireland", "ukri", "Ports plan to invest nine weeks"),
]
APPLICANTS = [
    ("academic", "ukri", "EPSRC call on quiet propellers. Bids must be signed by universities."),
    ("business,academic", "ukri", "Knowledge Transfer Partnerships for bakeries"),
    ("business,academic", "innovate_uk", "AKTP places, autumn intake"),
    ("business", "innovate_uk", "Smart grants. Companies that build boats apply by post."),
    ("any", "horizon_europe", "A fellowship at sea"),
    ("any", "konfer", "Ideas for warmer barns"),
    ("individual", "ukri", "Prizes for early career botanists"),
    ("academic,individual", "ukri", "Doctoral stipends, paid by a university"),
    ("academic,individual", "ukri", "A PhD hardship fund at each university"),
    ("business,academic", "innovate_uk", "Rail trials, open to universities, must include one academic partner"),
    ("business", "konfer", "Collaborative R&D on kelp for universities"),
    ("business,academic", "konfer", "A loan fund open to universities that requires a university partner"),
    ("business,research_org", "konfer", "Eligible: companies that rent Catapults"),
    ("public_sector,charity", "konfer", "Open to charities, hospices of the NHS, and not-for-profits"),
    ("any", "konfer", "Charities in the news"),
    ("academic", "konfer", "Moss surveys by the Natural Environment Research Council"),
    ("individual", "konfer", "Apply as researchers, one form each"),
    ("business", "iuk_business_connect", "How SBRI works, a webinar"),
    ("business", "Innovate UK", "Lanterns"),
    ("any", "konfer", "Scanning the horizon for moths"),
    ("business,academic,research_org,public_sector,charity,individual", "konfer",
     "Applicants: enterprises, HEIs, RTOs, local authorities, charity, individuals"),
    ("academic", "konfer", "Telescope time, STFC"),
    ("individual", "konfer", "ESRC, its New  Investigator round"),
    ("business", "konfer", "Accelerators in old mills, for students"),
    ("any", "konfer", "Small sums for village halls"),
]


def _by_nation(column, values):
    chain = None
    for key, value in enumerate(values):
        chain = (chain if chain is not None else F).when(column == key, F.lit(value))
    return chain


def _case(values, column="c_nationkey"):
    quoted = [v.replace("'", "''") for v in values]
    return f"case {column} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(quoted)) + " end"


def offers(spark, folder, cases):
    """Customers as offers whose text goes by their nation."""
    key = F.col("c_nationkey")
    return table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", _by_nation(key, [s for _, s, _ in cases]).alias("source"),
        F.col("c_name").alias("title"), _by_nation(key, [t for _, _, t in cases]).alias("description"))


def keyed(df):
    return df.withColumn("k", padded_key(cl.class_text(df)))


@query("k01_place", f"select c_custkey, {_case([p for p, _, _ in PLACES])} as place from customer")
def _(spark, folder):
    return cl.classify(offers(spark, folder, PLACES)).select("c_custkey", F.col("geographic_scope").alias("place"))


@query("k05_applicants", f"select c_custkey, {_case([a for a, _, _ in APPLICANTS])} as applicants from customer")
def _(spark, folder):
    return cl.classify(offers(spark, folder, APPLICANTS)).select("c_custkey", F.col("eligible_applicants").alias("applicants"))


# --- the same rules as SQL over keyed text, for whole documents ---------------------

DOC_KEY = "trim(regexp_replace(lower(replace('ukri' || chr(10) || text, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


def _holds(phrases):
    return "(" + " or ".join(f"contains(k, '{phrase_literal(p)}')" for p in phrases) + ")"


def _like(pattern):
    return f"regexp_matches(k, '{pattern}')"


def _place_words_sql(expression):
    rules = [f"when {' or '.join(f'''contains(w, '{w}')''' for w in words)} then '{place}'" for place, words in fv.PLACE_WORDS]
    return f"(select case {' '.join(rules)} when regexp_matches(w, '{fv.PLACE_EAST_PATTERN}') then 'england_east' when contains(w, 'england') then 'england' end from (select {expression} as w))"


PLACE_SQL = "coalesce(" + ", ".join(_place_words_sql(f"regexp_extract(k, '{p}', 1)") for p in fv.PLACE_EXPLICIT_PATTERNS) + ", case " + " ".join(
    f"when {_holds(p)}{' or ' + _like(rx) if rx else ''} then '{place}'" for place, p, rx in fv.PLACE_PHRASES) + " else 'uk_wide' end)"
def _words(words):
    return _like(r"\b(?:" + "|".join(words) + r")\b")


GATE, STATED = _words(fv.APPLICANT_GATE_WORDS), {kind: _words(w) for kind, w in fv.APPLICANT_WORDS}
STATED_SQL = "concat_ws(',', " + ", ".join(f"case when {GATE} and {test} then '{kind}' end" for kind, test in STATED.items()) + ")"
APPLICANT_SQL = f"""case when {_words(fv.PARTNERSHIP_WORDS)} then 'business,academic'
 when {_words(fv.PERSONAL_WORDS)} then case when {_holds(fv.PERSONAL_ACADEMIC_PHRASES)} then 'academic,individual' else 'individual' end
 when {_holds(fv.BUSINESS_PHRASES)} then case when {GATE} and {STATED['academic']} and {_like(fv.PARTNER_NEEDED_PATTERN)} then 'business,academic' else 'business' end
 when {STATED_SQL} <> '' then {STATED_SQL} when {_holds(fv.COUNCIL_NAMES)} then 'academic' else 'any' end"""


def documents(spark, folder):
    df = spread_table(spark, folder, "documents").select("doc_id", F.lit("ukri").alias("source"), F.col("text").alias("description"))
    return df


@query("k01_place_documents", f"select doc_id, {PLACE_SQL} as place from (select doc_id, {DOC_KEY} as k from documents)")
def _(spark, folder):
    return cl.classify(documents(spark, folder)).select("doc_id", F.col("geographic_scope").alias("place"))


@query("k05_applicants_documents", f"select doc_id, {APPLICANT_SQL} as applicants from (select doc_id, {DOC_KEY} as k from documents)")
def _(spark, folder):
    return cl.classify(documents(spark, folder)).select("doc_id", F.col("eligible_applicants").alias("applicants"))


@query("k02_stated_place", f"select c_custkey, place from (select c_custkey, case c_nationkey when 16 then 'england_london' when 17 then 'england' when 18 then 'wales' when 20 then 'england_east' when 21 then 'england_yorkshire' end as place from customer)")
def _(spark, folder):
    return keyed(offers(spark, folder, PLACES)).select("c_custkey", cl.stated_place(F.col("k")).alias("place"))


@query("k03_place_words", """select c_custkey, case when c_mktsegment = 'MACHINERY' then 'scotland' when c_mktsegment = 'FURNITURE' then 'england_west_midlands'
 when c_mktsegment = 'HOUSEHOLD' then 'england_east' when c_mktsegment = 'BUILDING' then 'england' end as place from customer""")
def _(spark, folder):
    words = F.create_map(*[F.lit(v) for pair in (
        ("MACHINERY", "Wales and SCOTLAND"), ("FURNITURE", "the West-Midlands, England"), ("HOUSEHOLD", "East England"), ("BUILDING", "Eastern England")) for v in pair])
    return table(spark, folder, "customer").select("c_custkey", cl.place_of_words(F.try_element_at(words, F.col("c_mktsegment"))).alias("place"))


FUND_PLACES = [
    "uk_wide", "wales", "scotland", "scotland", "scotland", "scotland", "wales", "wales", "wales", "northern_ireland", "northern_ireland",
    "england_east_midlands,england_west_midlands", "england_north_east,england_north_west,england_yorkshire", "england_south_west",
    "england_yorkshire", "england_east", "uk_wide", "uk_wide", "scotland", "scotland", "uk_wide", "uk_wide", "northern_ireland", "uk_wide",
    "northern_ireland"]


@query("k04_fund_phrases", f"select c_custkey, {_case(FUND_PLACES)} as place from customer")
def _(spark, folder):
    df = keyed(offers(spark, folder, PLACES))
    unstated = cl.place_by_phrase(F.col("k"))
    return df.select("c_custkey", unstated.alias("place"))


@query("k06_stated_applicants", "select c_custkey, " + _case([
    "academic", "", "", "business", "", "", "", "", "", "academic", "academic", "academic", "business,research_org", "public_sector,charity", "", "", "individual", "", "", "",
    "business,academic,research_org,public_sector,charity,individual", "", "", "individual", ""]) + " as kinds from customer")
def _(spark, folder):
    return keyed(offers(spark, folder, APPLICANTS)).select("c_custkey", F.array_join(cl.stated_applicants(F.col("k")), ",").alias("kinds"))


@query("k07_topic_tests", """select c_custkey, c_nationkey in (1, 2) as partnership, c_nationkey in (4, 6, 7, 8, 22) as personal, c_nationkey in (2, 3, 9, 10, 11, 17, 18, 23) as business from customer""")
def _(spark, folder):
    k = F.col("k")
    return keyed(offers(spark, folder, APPLICANTS)).select(
        "c_custkey", cl.is_partnership(k).alias("partnership"), cl.is_personal(k).alias("personal"), cl.is_business_programme(k).alias("business"))


@query("k08_council_names", "select c_custkey, c_nationkey in (0, 15, 21, 22) as council from customer")
def _(spark, folder):
    return keyed(offers(spark, folder, APPLICANTS)).select("c_custkey", cl.names_council(F.col("k")).alias("council"))


@query("k09_partner_needed", "select c_custkey, c_nationkey in (9, 11) as needed from customer")
def _(spark, folder):
    return keyed(offers(spark, folder, APPLICANTS)).select("c_custkey", cl.needs_academic_partner(F.col("k")).alias("needed"))


@query("k10_applicant_set", """select c_custkey, case when c_acctbal < 0 then 'any' when c_mktsegment = 'BUILDING' then 'any' else 'business,charity' || case when c_nationkey < 10 then ',individual' else '' end end as applicants from customer""")
def _(spark, folder):
    values = F.array_compact(F.array(F.when(F.col("c_nationkey") < 10, "individual"), F.lit("charity"), F.lit("business"), F.when(F.col("c_acctbal") < 0, "any")))
    none = F.slice(values, 1, 0)
    return table(spark, folder, "customer").select(
        "c_custkey", cl.applicant_set(F.when(F.col("c_mktsegment") == "BUILDING", none).otherwise(values)).alias("applicants"))


@query("k11_class_text", "select c_custkey, " + _case([s for _, s, _ in PLACES]) + " || chr(10) || c_name || chr(10) || " + _case([t for _, _, t in PLACES]) + " as text from customer")
def _(spark, folder):
    df = offers(spark, folder, PLACES)
    return df.select("c_custkey", cl.class_text(df).alias("text"))
