"""Page extraction: pages are written out of part rows, so the answer is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dom, extract, normalise
from .registry import query
from .sample import AS_OF, fill, long_day, part_days, shown, spread_table, table


def pages_of(spark, folder, template: str, url: str = "https://site.example.org/list/{p_partkey}", **values):
    """One page per part, from a template over the part's columns."""
    return part_days(spark, folder).select("p_partkey", fill(url).alias("url"), fill(template, **values).alias("html"))


def part_key():
    return F.regexp_extract("page_url", r"(\d+)$", 1).cast("bigint").alias("p_partkey")


def with_key(df, column="url"):
    return df.withColumn("p_partkey", F.regexp_extract(column, r"(\d+)/?$", 1).cast("bigint"))


COMPETITION_LIST = """<html><head><title>x</title><style>li{{}}</style></head><body><ul class="nav"><li><h2><a class="govuk-link" href="/competition/1/x">no</a></h2></li></ul>
<ul class="big govuk-list"><li><h2><a class="govuk-link" href=" /competition/{p_partkey}/overview?a=1&amp;b=2"> {p_name}
 <b>{p_type}</b> &amp; co</a></h2><div class="wysiwyg-styles"><p>Size&nbsp;{p_size}</p><!-- c --><p>£&pound;</p></div>
<dl class="date-definition-list"><dt>Opened:</dt><dd> {opens_text} </dd><dt>Closes:</dt><dd>{ends_text}</dd></dl></li>
<li><h2><a class="govuk-link" href="https://other.example.org/competition/x{p_partkey}">Second</a></h2><dl class="date-definition-list"><dd>soon</dd></dl></li>
<li><h2><a class="govuk-link" href="/about">no number</a></h2></li><li><h2><a href="/competition/9/x">no class</a></h2></li><li>plain</ul></body></html>"""
COMPETITION_LIST = COMPETITION_LIST.replace("{{}}", "")


@query("b01_competition_cards", """select p_partkey, 'ifs:' || cast(p_partkey as string) as id, 'innovate_uk' as source, p_name || ' ' || p_type || ' & co' as title,
 'https://apply-for-innovation-funding.service.gov.uk/competition/' || cast(p_partkey as string) || '/overview?a=1&b=2' as url,
 'Size' || chr(160) || cast(p_size as string) || ' ££' as summary, opens as opened_date, ends as closes_date from parts
 union all select p_partkey, 'ifs:x' || cast(p_partkey as string), 'innovate_uk', 'Second', 'https://other.example.org/competition/x' || cast(p_partkey as string), '', null, null from parts""")
def _(spark, folder):
    pages = pages_of(spark, folder, COMPETITION_LIST, opens_text=long_day(F.col("opens")), ends_text=long_day(F.col("ends")))
    return extract.competition_cards(pages.select("url", "html")).select(
        part_key(), "id", "source", "title", "url", "summary", "opened_date", "closes_date")


CONNECT_LIST = """<a href="/opportunities/outside/"><h3>outside the list</h3></a><div id="search-filter-results-366"><div class="grid">
<a class="group" href="/opportunities/{slug}-{p_partkey}/"><h3>{p_name}:  Round
 {p_size}</h3><p><b>Opens:</b> {opens_text}</p><p><b>Closes:</b> {ends_text}</p><div class="x line-clamp-5">A {p_type} grant of &pound;2,500.</div></a>
<a href="/opportunities/none/">no heading</a><a href="/news/"><h3>news</h3></a></div>
<div class="pagination"><a href="?sf_paged=1">Prev</a>{next}</div></div>"""


def next_parts():
    """Kinds of next link by part size: marked by rel, by class, by word, none."""
    return (F.when(F.col("p_size") < 10, fill('<a href="/a">other next</a><a rel="nofollow next" href="/opportunities/?sf_paged={p_size}">More</a>'))
            .when(F.col("p_size") < 20, fill('<a class="page next" href="?sf_paged={p_size}">More</a>'))
            .when(F.col("p_size") < 30, fill('<a href="https://x.org/p/{p_size}">NEXT &gt;</a>')).otherwise(""))


def connect_pages(spark, folder):
    slash = lambda c: F.date_format(c, "dd/MM/yyyy")
    return pages_of(spark, folder, CONNECT_LIST, opens_text=slash("opens"), ends_text=F.when(F.col("p_size") > 45, "tbc").otherwise(slash("ends")),
                    slug=F.replace("p_name", F.lit(" "), F.lit("-")), next=next_parts())


@query("b02_connect_cards", """select p_partkey, 'iukbc:' || replace(p_name, ' ', '-') || '-' || cast(p_partkey as string) as id, p_name || ': Round ' || cast(p_size as string) as title,
 'https://site.example.org/opportunities/' || replace(p_name, ' ', '-') || '-' || cast(p_partkey as string) || '/' as url, 'A ' || p_type || ' grant of £2,500.' as description,
 opens as opened_date, case when p_size <= 45 then ends end as closes_date from parts""")
def _(spark, folder):
    return extract.connect_cards(connect_pages(spark, folder).select("url", "html")).select(
        part_key(), "id", "title", "url", "description", "opened_date", "closes_date")


@query("b04_next_page", """select p_partkey, case when p_size < 10 then 'https://site.example.org/opportunities/?sf_paged=' || cast(p_size as string)
 when p_size < 20 then 'https://site.example.org/list/' || cast(p_partkey as string) || '?sf_paged=' || cast(p_size as string)
 when p_size < 30 then 'https://x.org/p/' || cast(p_size as string) end as next_url from part""")
def _(spark, folder):
    return with_key(extract.next_links(connect_pages(spark, folder).select("url", "html"))).select("p_partkey", "next_url")


COUNCIL_LIST = """<div class="opportunity"><h3><a class="ukri-funding-opp__link" href="/opportunity/call-{p_partkey}/">{p_name} call</a></h3>
<div class="entry-content"><p>Apply for {p_type} funding.</p></div><dl class="opportunity__summary">
<div class="govuk-table__row"><dt>Opportunity status: </dt><dd><span>Open</span></dd></div><div class="govuk-table__row"><dt>Funders:</dt><dd>{funders}</dd></div>
<div class="govuk-table__row"><dt>Funding  type:</dt><dd>Grant</dd></div><div class="govuk-table__row"><dt>Only a label</dt></div>
<div class="govuk-table__row"><dt>{money_label}:</dt><dd>£{p_size},000 - £2 million</dd></div><div class="govuk-table__row"><dt>Total fund:</dt><dd>£9m</dd></div>
<div class="govuk-table__row"><dt>Opening date:</dt><dd><time datetime="{opens}T09:00:00">someday</time></dd></div>
<div class="govuk-table__row"><dt>Closing date:</dt><dd>{ends_text} 4:00pm</dd></div></dl></div>
<div class="opportunity"><h3>no link</h3></div><a class="next page-numbers" href="/opportunity/page/2/">Next</a>"""


@query("b04_next_page_anywhere", "select p_partkey, 'https://site.example.org/opportunity/page/2/' as next_url from part")
def _(spark, folder):
    return with_key(extract.next_links(pages_of(spark, folder, COUNCIL_LIST, ends_text=long_day(F.col("ends")), funders=F.lit("none"), money_label=F.lit("Award")).select("url", "html"), box_class=None)).select("p_partkey", "next_url")


def council_cards(spark, folder):
    kind = F.col("p_type")
    return extract.council_cards(pages_of(
        spark, folder, COUNCIL_LIST, ends_text=long_day(F.col("ends")),
        funders=F.when(kind == "PROMO", "<a>Innovate UK</a>, innovate uk").otherwise(fill("Council of {p_type}, <a>Innovate UK</a>")),
        money_label=F.when(F.col("p_size") < 20, "Award range").when(F.col("p_size") < 35, "Minimum award").otherwise("Maximum award")).select("url", "html"))


COUNCIL_MONEY = """case when p_size < 35 then cast(p_size * 1000 as double) end as low, case when p_size < 20 then 2000000.0 when p_size < 35 then 9000000.0 else cast(p_size * 1000 as double) end as high,
 case when p_size < 20 then 'Award range' when p_size < 35 then 'Minimum award' else 'Maximum award' end || ': £' || cast(p_size as string) || ',000 - £2 million' as note"""


@query("b03_council_cards", f"""select p_partkey, 'ukri:call-' || cast(p_partkey as string) as id, p_name || ' call' as title, opens as opened_date, ends as closes_date, low as funding_min, high as funding_max,
 'GBP' as funding_currency, date '1998-06-01' as exchange_rate_date, 'Council of ' || p_type || ', Innovate UK' as sector_tags, 'Grant, Open' as niche_tags,
 'Funders: Council of ' || p_type || ', Innovate UK' || chr(10) || chr(10) || 'Funding type: Grant' || chr(10) || chr(10) || note || chr(10) || chr(10) || 'Total fund: £9m' || chr(10) || chr(10)
 || 'Source page: https://site.example.org/opportunity/call-' || cast(p_partkey as string) || '/' || chr(10) || chr(10) || 'Apply for ' || p_type || ' funding.' as description
 from (select *, {COUNCIL_MONEY} from parts) where p_type <> 'PROMO'""")
def _(spark, folder):
    items = normalise.council_items(council_cards(spark, folder), AS_OF, extra=("page_url",))
    return items.select(part_key(), "id", "title", "opened_date", "closes_date", "funding_min", "funding_max", "funding_currency",
                        "exchange_rate_date", "sector_tags", "niche_tags", "description")


@query("b07_label_facts", """select p_partkey, 'Open' as status, case when p_type = 'PROMO' then 'Innovate UK , innovate uk' else 'Council of ' || p_type || ', Innovate UK' end as funders,
 'Grant' as kind, opens as opened_date, 'opportunity status|funders|funding type|' || case when p_size < 20 then 'award range' when p_size < 35 then 'minimum award' else 'maximum award' end
 || '|total fund|opening date|closing date' as labels from parts""")
def _(spark, folder):
    facts = F.col("facts")
    funders = extract.fact_value(facts, "funders")
    return council_cards(spark, folder).select(
        part_key(), extract.fact_value(facts, "opportunity status").alias("status"),
        funders.alias("funders"), extract.fact_value(facts, "funding type").alias("kind"),
        extract.fact_date(facts, "opening date").alias("opened_date"),
        F.array_join(F.transform(facts, lambda f: f["label"]), "|").alias("labels"))


COMPETITION_PAGE = """<html><body><nav>Home £1</nav><div class="govuk-main-wrapper">outer {p_brand} £2<main{main_id}><h1>{p_name}</h1><p>Navigation text £3.</p>
<div class="govuk-breadcrumbs">Crumbs £4 <h2>Funding crumbs</h2><p>x</p></div>{body}<script>var a = "£5";</script></main></div></body></html>"""
WITH_SECTIONS = """<h2>Description</h2>bare text<div class="wysiwyg-styles"><p>Develop  {p_type}
 parts.</p><p>More</p></div><h3>Other things</h3><p>Ignore £6.</p><h2>Who can apply</h2><nav>£7</nav><ul><li>One {p_brand}</li><li>Two</li></ul>
<h2>Funding</h2><p>Between £{p_size},000 and £2 million.</p>"""
WITH_BLOCKS = """<div class="wysiwyg-styles">First {p_brand}</div><p class="govuk-body">Costs of £{p_size} thousand</p>"""


def competition_pages(spark, folder):
    body = F.when(F.col("p_size") < 25, fill(WITH_SECTIONS)).when(F.col("p_size") < 40, fill(WITH_BLOCKS)).otherwise(fill("<p>Only {p_name}</p>"))
    return pages_of(spark, folder, COMPETITION_PAGE, url="https://site.example.org/competition/{p_partkey}", body=body,
                    main_id=F.when(F.col("p_type") == "SMALL", ' id="main-content"').otherwise(""))


BR = "chr(10)"
COMPETITION_TEXT = f"""'Source page: https://site.example.org/competition/' || cast(p_partkey as string) || case
 when p_size < 25 then {BR} || {BR} || 'Description' || {BR} || 'Develop  ' || p_type || {BR} || 'parts.' || {BR} || 'More' || {BR} || {BR} || 'Who can apply' || {BR} || 'One ' || p_brand || {BR} || 'Two' || {BR} || {BR} ||
  'Funding' || {BR} || 'Between £' || cast(p_size as string) || ',000 and £2 million.'
 when p_size < 40 then {BR} || {BR} || 'First ' || p_brand || {BR} || {BR} || 'Costs of £' || cast(p_size as string) || ' thousand' else '' end""".replace("'Develop  '", "'Develop '")


@query("b05_competition_details", f"""select p_partkey, {COMPETITION_TEXT} as description, case when p_size < 25 then p_size * 1000.0 when p_size < 40 then p_size * 1000.0 end::double as funding_min,
 case when p_size < 25 then 2000000.0 when p_size < 40 then p_size * 1000.0 end::double as funding_max from part""")
def _(spark, folder):
    details = extract.competition_details(competition_pages(spark, folder).select("url", "html"))
    return with_key(details).select("p_partkey", "description", "funding_min", "funding_max")


CONNECT_PAGE = """<head><meta name="description" content=" Meta  {p_name} "></head><h1>x</h1><div><h5>Opportunity Type</h5><hr><div><span>Funding</span></div></div>
<div><h5> award </h5><hr><div>{award}</div></div><div class="c"><h5>Organisation</h5><hr><div>Body {p_brand}</div><div>organisation</div><div>Second</div></div>
<div><h5>Sector</h5><div>{sector}</div></div><a href="/about">About</a><a href="/apply/{p_partkey}">{link_text}</a><a href="https://x.org/r">Register here</a>{article}"""


def connect_details(spark, folder):
    return extract.connect_details(pages_of(
        spark, folder, CONNECT_PAGE, url="https://site.example.org/opportunities/o/{p_partkey}",
        award=F.when(F.col("p_size") < 20, fill("&pound;{p_size},500 each")).when(F.col("p_size") < 40, fill("Up to £{p_size}k")).otherwise("none stated"),
        sector=F.when(F.col("p_type") == "SMALL", "Plain sector").otherwise(fill('<a href="/s">{p_type}</a>, <a>Agri</a><a> </a>')),
        link_text=F.when(F.col("p_size") > 30, "Find out more").otherwise("Find out more and APPLY"),
        article=F.when(F.col("p_size") > 10, fill('<article class="single_opportunities"><div class="prose"><p>Text on {p_name}.</p><ul><li>Item</li></ul></div></article>'))
        .otherwise("")).select("url", "html"))


@query("b06_connect_details", f"""select p_partkey, award, opportunity_type, organisation, sector_tags, niche_tags, url, funding_min, funding_max, 'Award: ' || award || {BR} || {BR} ||
  'Source page: https://site.example.org/opportunities/o/' || cast(p_partkey as string) || {BR} || {BR} || case when p_size > 10 then 'Text on ' || p_name || '. Item' else 'Meta ' || p_name end as description
 from (select p_partkey, p_size, p_name, case when p_size < 20 then '£' || cast(p_size as string) || ',500 each' when p_size < 40 then 'Up to £' || cast(p_size as string) || 'k' else 'none stated' end as award,
 'Funding' as opportunity_type, 'Body ' || p_brand || ', Second' as organisation, case when p_type = 'SMALL' then 'Plain sector' else p_type || ', Agri' end as sector_tags,
 'Funding, Body ' || p_brand || ', Second' as niche_tags, case when p_size > 30 then 'https://x.org/r' else 'https://iuk-business-connect.org.uk/apply/' || cast(p_partkey as string) end as url,
 case when p_size < 20 then p_size * 1000.0 + 500 end::double as funding_min, case when p_size < 20 then p_size * 1000.0 + 500 when p_size < 40 then p_size * 1000.0 end::double as funding_max from part)""")
def _(spark, folder):
    return with_key(connect_details(spark, folder), "source_url").select(
        "p_partkey", "award", "opportunity_type", "organisation", "sector_tags", "niche_tags", "url", "funding_min", "funding_max", "description")


@query("b11_section_blocks", """select p_partkey, 'Body ' || p_brand || ', Second' as body_text, case when p_type = 'SMALL' then '' else p_type || '|Agri' end as links, cast(null as string) as missing from part""")
def _(spark, folder):
    nodes = F.col("nodes")
    pages = pages_of(spark, folder, CONNECT_PAGE, award=F.lit("x"), article=F.lit(""), link_text=F.lit("y"),
                     sector=F.when(F.col("p_type") == "SMALL", "Plain sector").otherwise(fill('<a href="/s">{p_type}</a>, <a>Agri</a><a> </a>')))
    flat = dom.flatten(pages)
    return flat.select(
        "p_partkey", extract.block_text(extract.block_under(nodes, "ORGANISATION"), "organisation").alias("body_text"),
        F.array_join(extract.block_links(extract.block_under(nodes, "Sector")), "|").alias("links"),
        extract.block_text(extract.block_under(nodes, "Absent"), "Absent").alias("missing"))


@query("b12_apply_link", """select p_partkey, case when p_size < 20 then 'https://iuk-business-connect.org.uk/go/' || cast(p_partkey as string) when p_size < 40 then 'https://x.org/register' end as link from part""")
def _(spark, folder):
    links = (F.when(F.col("p_size") < 20, fill('<a href="/go/{p_partkey}">How to <b>Apply</b></a><a href="https://x.org/register">Register</a>'))
             .when(F.col("p_size") < 40, '<a>apply</a><a href="https://x.org/register">Register now</a>').otherwise('<a href="/apply">Go</a>'))
    flat = dom.flatten(pages_of(spark, folder, "<p>{links}</p>", links=links))
    return flat.select("p_partkey", extract.apply_link(F.col("nodes")).alias("link"))


COUNCIL_PAGE = """<h1 class="main-area__page-title"><span>Funding opportunity: </span>{p_name}  internships</h1><dl class="opportunity__summary">
<div class="govuk-table__row"><dt>Funders:</dt><dd>First</dd></div><div class="govuk-table__row"><dt>Funders:</dt><dd>Council {p_type}</dd></div>
<div class="govuk-table__row"><dt>Opening date:</dt><dd><time datetime="{opens}T09:00:00">x</time></dd></div><div class="govuk-table__row"><dt>Closing date:</dt><dd>{closing}</dd></div></dl>{start}
<div class="single-opportunity__entry-content"><div><p>An opportunity for {p_brand}</p><p>students.</p></div></div>"""


def council_pages(spark, folder, url="https://site.example.org/opportunity/{p_partkey}/"):
    return pages_of(spark, folder, COUNCIL_PAGE, url=url,
                    closing=F.when(F.col("p_size") > 40, "No closing date, 1 May 1998").otherwise(long_day(F.col("ends"))),
                    start=F.when(F.col("p_size") < 25, fill('<a id="analytics-start-application" href="/apply/{p_partkey}">Start</a>')).otherwise(""))


@query("b08_council_details", """select p_partkey, p_name || ' internships' as title, 'Council ' || p_type as funders, opens as opened_date, case when p_size <= 40 then ends end as closes_date,
 'An opportunity for ' || p_brand || ' students.' as description, case when p_size < 25 then 'https://site.example.org/apply/' || cast(p_partkey as string) end as application_url from parts""")
def _(spark, folder):
    details = extract.council_details(council_pages(spark, folder).select("url", "html"))
    return with_key(details, "source_url").select(
        "p_partkey", "title", extract.fact_value(F.col("facts"), "funders").alias("funders"), "opened_date", "closes_date", "description", "application_url")


@query("b09_main_part", """select p_partkey, case when p_size < 10 then 'main-content' when p_size < 20 then 'main' when p_size < 30 then 'wrapper' when p_size < 40 then 'body' else '' end as part,
 case when p_size < 40 then p_name else 'a ' || p_name end as text from part""")
def _(spark, folder):
    page = (F.when(F.col("p_size") < 10, fill('<body>a<main>b</main><div id="main-content">{p_name}</div></body>'))
            .when(F.col("p_size") < 20, fill('<body>a<div class="govuk-main-wrapper">b</div><main>{p_name}</main></body>'))
            .when(F.col("p_size") < 30, fill('<body>a<div class="govuk-main-wrapper wide">{p_name}</div></body>'))
            .when(F.col("p_size") < 40, fill("<title>a</title><body>{p_name}</body>")).otherwise(fill("<p>a</p>{p_name}")))
    nodes = F.col("nodes")
    main = extract.main_part(nodes)
    flat = dom.flatten(pages_of(spark, folder, "{page}", page=page))
    kind = F.coalesce(F.nullif(dom.attr(main, "id"), F.lit("")), F.when(dom.has_class(main, "govuk-main-wrapper"), "wrapper"), main["tag"], F.lit(""))
    return flat.select("p_partkey", kind.alias("part"), dom.text_in(extract.main_nodes(nodes)).alias("text"))


@query("b10_sections", f"""select p_partkey, case when p_size < 25 then p_name || '=Navigation text £3.' || '|Description=Develop ' || p_type || {BR} || 'parts.' || {BR} || 'More|Other things=Ignore £6.|Who can apply=One ' || p_brand || {BR} || 'Two|Funding=Between £' || cast(p_size as string) || ',000 and £2 million.'
 when p_size < 40 then p_name || '=Navigation text £3.' || {BR} || 'First ' || p_brand || {BR} || 'Costs of £' || cast(p_size as string) || ' thousand' else p_name || '=Navigation text £3.' || {BR} || 'Only ' || p_name end as sections from part""")
def _(spark, folder):
    sections = extract.page_sections(competition_pages(spark, folder).select("url", "html"))
    return with_key(sections).select("p_partkey", F.array_join(F.transform(
        "sections", lambda s: F.concat_ws("=", s["heading"], s["body"])), "|").alias("sections"))


PAGE_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'),
 '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g'))"""


@query("b13_page_text", f"select page_id, md5({PAGE_TEXT}) as digest from pages")
def _(spark, folder):
    return extract.page_text(spread_table(spark, folder, "pages")).select("page_id", F.md5("text").alias("digest"))


@query("b13_page_links", r"""select page_id, count(*) as n, md5(string_agg(link, '|' order by link)) as digest from (select page_id, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as link from pages) group by page_id""")
def _(spark, folder):
    links = extract.page_links(spread_table(spark, folder, "pages")).select("page_id", "target")
    # A page's links are as many as the page is long, so this group is bounded by a row.
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("target")), "|")).alias("digest"))


@query("b14_first_value", """select p_partkey, case when p_size < 10 then null when p_size < 20 then '' else p_name end as first_one from part""")
def _(spark, folder):
    from ..functions.text import first_value
    values = F.when(F.col("p_size") < 5, F.lit(None).cast("array<string>")).when(F.col("p_size") < 10, F.array().cast("array<string>")).when(
        F.col("p_size") < 20, F.array(F.lit(""), F.col("p_name"))).otherwise(F.array("p_name", "p_type"))
    return table(spark, folder, "part").select("p_partkey", first_value(values).alias("first_one"))


def budgets(spark, folder):
    """Budget payloads of a part: two good ones and a broken one."""
    good = fill('{{"budgetTopicActionMap":{{"1":[{{"expectedGrants":{p_size},"minContribution":"{low}","maxContribution":{high},"budgetYearMap":{{"1998":{p_size}000000.0,"1999":"1500.5","2000":"n/a"}}}}],"2":null}}}}'
                .replace("{{", "\x01").replace("}}", "\x02"), low=F.when(F.col("p_size") < 10, "0").otherwise(F.col("p_size").cast("string")), high=F.col("p_size") * 1000)
    good = F.translate(good, "\x01\x02", "{}")
    flat = F.lit('{"budgetTopicActionMap":{"7":[{"expectedGrants":0,"maxContribution":20000,"budgetYearMap":{}},{"minContribution":25}]}}')
    return spread_table(spark, folder, "part").withColumn("payloads", F.array(good, F.lit("{broken"), flat))


@query("b15_budget", """select p_partkey, case when p_size < 10 then 25.0 else least(cast(p_size as double), 25.0) end as low, greatest(p_size * 1000.0, 20000.0)::double as high,
 'Topic budget: EUR ' || cast(p_size as string) || ',001,500|Expected grants: ' || cast(p_size as string) as notes from part""")
def _(spark, folder):
    df = budgets(spark, folder).withColumn("actions", normalise.budget_actions(F.col("payloads")))
    low, high = normalise.budget_range(F.col("actions"))
    return shown(df.select("p_partkey", low.alias("low"), high.alias("high"), normalise.budget_notes(F.col("actions")).alias("notes")))


@query("g07_year_total", "select p_partkey, cast(p_size * 1000000 + 1500.5 as double) as total from part")
def _(spark, folder):
    df = budgets(spark, folder).withColumn("action", F.get(normalise.budget_actions(F.col("payloads")), F.lit(0)))
    return df.select("p_partkey", normalise.year_total(F.col("action.budgetYearMap")).alias("total"))
