"""What pages declare and answer: directives, alternates, engagement, required facts, visitors' questions.

The page corpus has neither directives nor alternates, shops nor price
pages, so pages are dressed with such markup alike in both engines; the rules read
only address, markup and header.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlight.functions import markup as M
from crawlight.functions import rendering as N
from crawlight.functions import text as T
from crawlight.functions import urls as U
from crawlight.plans import rubrics as R
from crawlight.queries.registry import Area, once, sql_in, sql_list
from crawlight.queries.sqlbits import CLASSED, NETLOC, VISIBLE
from crawlight.sources.tables import table

area = Area()
q = area.query

#: Address, markup and header of the dressed pages, read alike by both engines.
URL = """case page_id % 8 when 0 then 'https://' || {host} || '/pricing' when 1 then 'https://' || {host} || '/products/p' || page_id
 when 2 then 'https://' || {host} || '/docs/d' || page_id when 3 then 'https://' || {host} || '/blog/b' || page_id else url end"""
HTML = """case page_id % 8
 when 0 then '<meta name="robots" content="Index, Follow;max-snippet:5"><p>Plans of the pro tier, billed per month or per year</p>'
 when 1 then '<META content="noindex" name="ROBOTS"><h2>Stock and <b>price</b></h2><p>Return within days, shipping and delivery, discounts </p><a class="big Btn-x" href="/cart">Buy</a>'
 when 2 then '<!-- <meta name="robots" content="none"> --><link rel="alternate" hreflang="en-UK" href="/uk"><link rel="alternate" hreflang="x-default" href="/"><p>Error message, code samples, response output</p>'
 when 3 then '<link rel="stylesheet" hreflang="jp" href="/x"><link hreflang=JP rel=Alternate href=/jp><h2></h2><p>Summary by the author, with statistics</p><a role="button" href="/read">Read</a>'
 when 4 then '<meta name="robots" content="none"><meta name="robots" content="all"><h1>Two <i>parts</i><h2>Within</h2>'
 when 5 then '<link rel="alternate" hreflang="en-GB" href="/gb"><a class="cta">No address</a><noscript><a role=Button href=/n>N</a></noscript>'
 else '' end || html"""
HEADER = "case page_id % 10 when 0 then 'googlebot: none' when 5 then 'nofollow' else '' end"

_CLEAN = f"regexp_replace(regexp_replace(html, '{N.RAW}', '', 'g'), '{N.COMMENT}', '', 'g')"
_TAGS = f"regexp_extract_all(regexp_replace(regexp_replace(html, '{N.RAW}', ' ', 'g'), '{N.COMMENT}', ' ', 'g'), '{N.STARTS}')"


def _attribute(x: str, name: str) -> str:
    forms = [r'"([^"]*)"', r"''([^'']*)''", r"""([^\s"''>]+)"""]
    return "coalesce(" + ", ".join(rf"nullif(regexp_extract({x}, '(?is)\s{name}\s*=\s*{form}', 1), '')" for form in forms) + ", '')"


_PAGES = f"given as (select page_id, {URL.format(host=NETLOC)} as url, {HTML} as html, {HEADER} as header from pages), {CLASSED.replace('from pages', 'from given')}, shown as (select *, {_TAGS} as tags from classed join (select page_id, header from given) using (page_id))"


def shown(spark, d):
    """page_id, url, html, header, site and page type of the dressed pages."""
    raw = table(spark, d, "pages")
    p = raw.withColumn("host", U.netloc(F.col("url"))).select("page_id", F.expr(URL.format(host="host")).alias("url"), F.expr(HTML).alias("html"), F.expr(HEADER).alias("header"))
    url = F.col("url")
    return p.select("page_id", "url", "html", "header", U.netloc(url).alias("site"), U.page_class(url, T.title(F.col("html")))["page_type"].alias("page_type"))


_DIRECTIVES = rf"""{_PAGES}, directives as (
    select page_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce({_attribute("(list_filter(tags, lambda t: regexp_matches(t, '" + M.META + "') and lower(" + _attribute("t", "name") + ") = 'robots'))[-1]", "content")}, '') || ' ' || header), '{M.SEPARATORS}'), lambda w: w <> ''))) as words from shown
)"""


@q("o137_page_directives", f"with {_DIRECTIVES} select page_id, array_to_string(words, ' ') as directives, list_has_any(words, {sql_list(M.EXCLUDING)}) as excluded from directives")
def o137(spark, d):
    """Directives that meta tag and header of a page declare."""
    words = shown(spark, d).select("page_id", M.robots_directives(F.col("html"), F.col("header")).alias("words"))
    return once(words, "page_id", "words").select("page_id", F.array_join("words", " ").alias("directives"), M.excluded(F.col("words")).alias("excluded"))


@q("r06_page_noindex", f"with {_DIRECTIVES} select page_id, 'NOINDEX_EXCLUSION' as id, 'critical' as severity, array_to_string(list_sort(list_intersect(words, {sql_list(M.EXCLUDING)})), ', ') as evidence from directives where list_has_any(words, {sql_list(M.EXCLUDING)})")
def r06(spark, d):
    """Pages that exclude indexers, with the directives that do."""
    words = once(shown(spark, d).select("page_id", M.robots_directives(F.col("html"), F.col("header")).alias("words")), "page_id", "words")
    evidence = F.array_join(F.array_sort(F.array_intersect("words", F.array(*map(F.lit, M.EXCLUDING)))), ", ")
    return words.where(M.excluded(F.col("words"))).select("page_id", F.lit("NOINDEX_EXCLUSION").alias("id"), F.lit("critical").alias("severity"), evidence.alias("evidence"))


_CODES = rf"""{_PAGES}, codes as (
    select page_id, unnest(list_transform(list_filter(tags, lambda t: regexp_matches(t, '{M.LINK}') and lower({_attribute("t", "rel")}) = 'alternate'), lambda t: trim(lower({_attribute("t", "hreflang")})))) as code from shown
), wrong as (
    select page_id, code from codes where code not in ('', 'x-default') and (string_split(code, '-')[1] in {sql_in(M.WRONG_LANGUAGES)} or upper(string_split(code, '-')[2]) = '{M.WRONG_REGION}')
)"""


@q("o135_page_hreflang", f"with {_CODES} select page_id, code from wrong")
def o135(spark, d):
    """Language codes of a page's alternate links that do not exist."""
    return shown(spark, d).select("page_id", F.explode(M.hreflangs(F.col("html"))).alias("code")).where(M.wrong_hreflang(F.col("code")))


@q("r07_page_locale", f"with {_CODES} select page_id, 'LOCALE_MISCONFIGURATION' as id, 'medium' as severity, count(*) as codes from wrong group by page_id")
def r07(spark, d):
    """Pages with wrong language codes, and how many."""
    wrong = once(shown(spark, d).select("page_id", F.size(F.filter(M.hreflangs(F.col("html")), M.wrong_hreflang)).cast("long").alias("codes")), "page_id", "codes")
    return wrong.where("codes > 0").select("page_id", F.lit("LOCALE_MISCONFIGURATION").alias("id"), F.lit("medium").alias("severity"), "codes")


def _headings(level: int) -> str:
    inner = f"regexp_replace(regexp_replace(h, '{M.LEAD}', ''), '{M.LEVEL}', '')"
    found = f"list_filter(regexp_extract_all({_CLEAN}, '{M.HEADING}'), lambda h: regexp_extract(h, '{M.LEVEL}', 1) = '{level}')"
    pieces = f"list_filter(list_transform({found}, lambda h: list_filter(regexp_split_to_array({inner}, '<[^>]+>'), lambda p: p <> '')), lambda p: len(p) > 0)"
    return f"list_transform({pieces}, lambda p: trim(array_to_string(list_transform(p, lambda x: trim(x)), ' ')))"


_ACTS = "(lower(" + _attribute("t", "role") + ") = 'button' or " + " or ".join(f"contains(lower({_attribute('t', 'class')}), '{c}')" for c in M.ACTION_CLASSES) + ")"
_ANCHORS = f"list_filter(tags, lambda t: regexp_matches(t, '{M.ANCHOR}') and {_attribute('t', 'href')} <> '')"


@q("o054h_engagement_view", f"with {_PAGES} select page_id, array_to_string({_headings(1)}, ' | ') as h1, array_to_string({_headings(2)}, ' | ') as h2, len({_ANCHORS}) as hrefs, array_to_string(list_transform(list_filter({_ANCHORS}, lambda t: {_ACTS}), lambda t: {_attribute('t', 'href')}), ' ') as ctas, len(regexp_extract_all({VISIBLE}, '\\S+')) as words from shown")
def o054h(spark, d):
    """What a page offers its visitor: headings, addresses, actions, words.  One row's expressions, no shuffle."""
    html = F.col("html")
    return shown(spark, d).select(
        "page_id", F.array_join(M.headings(html, 1), " | ").alias("h1"), F.array_join(M.headings(html, 2), " | ").alias("h2"), F.size(M.anchors(html)).cast("long").alias("hrefs"),
        F.array_join(M.actions(html), " ").alias("ctas"), T.split_words(T.visible_text(html)).cast("long").alias("words"),
    )


_FACTS = ", ".join(f"('{kind}', {place}, '{fact}', '{R.FACT_PATTERNS[fact]}')" for kind, facts in R.REQUIRED_FACTS.items() for place, fact in enumerate(facts) if fact in R.FACT_PATTERNS)


@q("o150_page_facts", f"with {_PAGES}, facts(page_type, place, fact, pattern) as (values {_FACTS}) select page_id, page_type, string_agg(fact, ',' order by place) as missing from shown join facts using (page_type) where not regexp_matches(lower({VISIBLE}), pattern) group by all")
def o150(spark, d):
    """Facts that a page's type requires and its text lacks."""
    p = shown(spark, d).where(F.col("page_type").isin(list(R.REQUIRED_FACTS)))
    lacks = p.select("page_id", "page_type", R.missing_facts(T.visible_text(F.col("html")), F.col("page_type")).alias("m"))
    return once(lacks, "page_id", "page_type", "m").where("size(m) > 0").select("page_id", "page_type", F.array_join("m", ",").alias("missing"))


_STEMS = ", ".join(f"('{c}', '{k}', {n}, '{part}', '{s}')" for c, k, parts in R.RUBRICS for n, part in enumerate(parts) for s in R.stems(part))
_RANK = "case " + " ".join(f"when page_type in {sql_in(kinds)} then {k}" for k, (_, kinds) in enumerate(R.CATEGORIES)) + f" else {len(R.CATEGORIES)} end"
_COVERAGE = f"""{_PAGES}, stems(category, type, place, component, stem) as (values {_STEMS}), read as (select site, page_type, lower(substr({VISIBLE}, 1, {R.READ})) as low from shown),
sites as (select site, {sql_list([c for c, _ in R.CATEGORIES] + [R.OTHER])}[min({_RANK}) + 1] as category from read group by site),
hits as (select distinct site, stem from read join (select distinct stem from stems) s on contains(low, stem)),
answers as (select site, category, type, place, component, count(hits.stem) > 0 as answered from sites join stems using (category) left join hits using (site, stem) group by all),
coverage as (select site, category, type, count(*) as components, coalesce(string_agg(component, ', ' order by place) filter (not answered), '') as missing, count(*) filter (answered) * 1.0 / count(*) as covered from answers group by all)"""


def coverage(spark, d):
    return R.rubric_coverage(shown(spark, d).select("site", "page_type", T.visible_text(F.col("html")).alias("text")))


@q("o134_rubric_packs", f"with {_COVERAGE} select site, category, type, components, missing, round_even(covered, 4) as coverage from coverage")
def o134(spark, d):
    """How far each site answers the questions of its category."""
    return coverage(spark, d).select("site", "category", "type", "components", F.array_join("missing", ", ").alias("missing"), F.bround("coverage", 4).alias("coverage"))


@q("r61_rubric_packs", f"with {_COVERAGE} select site, 'PROACTIVE.GEO.QUERY_RUBRIC.' || category || '.' || upper(type) as id, array_to_string(string_split(missing, ', ')[1:3], ', ') as missing from coverage where covered < {R.LEAST_COVERAGE} and missing <> ''")
def r61(spark, d):
    """Questions that a site leaves open."""
    return R.open_questions(coverage(spark, d))


QUERIES, SQL = area.queries, area.sql
