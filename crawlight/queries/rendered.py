"""Rules that read a page's own markup: rendering gaps, content signals by page type, gates, canonical hosts.

The page corpus has no application shells, JSON state, schema blocks or store
pages, so every twelfth page is dressed with one of these in the same way in
both engines.  The rules read only the markup and the address.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlight.functions import rendering as N
from crawlight.functions import text as T
from crawlight.functions import urls as U
from crawlight.plans import archetypes as A
from crawlight.plans import catalogue as C
from crawlight.plans import report as P
from crawlight.queries.dom import THIRD_PARTY
from crawlight.queries.registry import Area, once, sql_list
from crawlight.queries.sqlbits import CLASSED, TITLE, VISIBLE
from crawlight.queries.structured import _BODY as _BODY_SQL
from crawlight.queries.urls_pages import _FETCHES
from crawlight.sources.tables import fetches, table

area = Area()
q = area.query

_HOST = "https://site' || (page_id % 40) || '.example"
#: Address and markup of the dressed pages, read alike by both engines.
DRESSED_URL = f"""case page_id % 12 when 0 then '{_HOST}/blog/post-' || page_id when 1 then '{_HOST}/blog/post-' || page_id when 2 then '{_HOST}/blog/post-' || page_id
 when 5 then '{_HOST}/products/p' || page_id when 6 then '{_HOST}/products/p' || page_id when 7 then '{_HOST}/stores/find' || page_id when 8 then '{_HOST}/stores/find' || page_id
 else '{_HOST}/x/' || page_id end"""
DRESSED_HTML = """case page_id % 12
 when 0 then html || '<p>See <a href="https://doi.org/10.1/x">the source</a></p><span class="byline">Someone</span><p>Published on Monday, 5 min read</p><script type="application/ld+json">{"@type":"BreadcrumbList","name":"path"}</script>'
 when 1 then html || '<h2>What is it?</h2><p>An answer.</p><p>By Jane Roe, PhD</p>'
 when 2 then html || '<script type="application/ld+json">{"@graph":[{"@type":"FAQPage","name":"all"},{"@type":"Organization","@id":"https://site3.example/#org","name":"' || case when page_id % 24 = 2 then 'Monday' else 'Nobody' end || '","sameAs":["https://site' || (page_id % 50) || '.example/","https://site' || ((page_id + 10) % 40) || '.example/blog/post-' || (page_id + 10) || '","ftp://no"]}]}</script><a href="https://blog.example.org/y">more</a>'
 when 3 then '<!DOCTYPE html><html><head><title>App</title></head><body><div id="root"></div><noscript>You need to enable JavaScript to run this app.</noscript><script src="/static/a.js"></script><script src="/static/b.js"></script></body></html>'
 when 4 then '<html><head></head><body><div class="x"></div><script src="/bundle.js"></script><script src="https://www.googletagmanager.com/gtag/js"></script></body></html>'
 when 5 then replace(replace(html, '<ul', '<div'), '</ul', '</div') || '<p>Price $19.99 per month. In stock, free shipping.</p><script type="application/ld+json">[{"@type":["Product","Thing"],"name":"P"}]</script>'
 when 6 then html || '<p>Price $' || page_id || '.50</p><a href="/cart">Buy <b>now</b></a>'
 when 7 then html || '<div class="store-locator"><form><input type="search" name="q"> search by post code</form></div>'
 when 8 then html || '<form><input type="text" name="q"></form><a href="/stores/12">One of the shops</a>'
 when 9 then html || '<script type="application/json">{"long key of words":"' || repeat('word pair ', page_id % 400) || '","n":[1,{"s":"two words"}],"one":"word"}</script>'
 when 10 then html || '<script src="/scripts/aem.js"></script><div class="cards"></div><div class="hero"></div><div class="cards other"></div><nav><a href="https://site' || (page_id % 50) || '.example/">Partner</a><a href="https://unseen.example/' || page_id || '">New</a></nav>'
 else html || '<link rel="canonical" href="https://elsewhere.example/' || page_id || '">' end"""


def dressed(spark, d):
    """page_id, url, html, host, path and page type of the dressed pages."""
    p = table(spark, d, "pages").select("page_id", F.expr(DRESSED_URL).alias("url"), F.expr(DRESSED_HTML).alias("html"))
    url = F.col("url")
    return p.select("page_id", "url", "html", U.netloc(url).alias("host"), F.lower(U.path(url)).alias("path"), U.page_class(url, T.title(F.col("html")))["page_type"].alias("page_type"))


def _list(html: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({html}, '{pattern}', {group})"


_STARTS = lambda html: _list(f"regexp_replace(regexp_replace({html}, '{N.RAW}', ' ', 'g'), '{N.COMMENT}', ' ', 'g')", N.STARTS)
_ANY = lambda items, condition: f"len(list_filter({items}, lambda x: {condition})) > 0"
_HAS = lambda column, parts: "(" + " or ".join(f"contains({column}, '{p}')" for p in parts) + ")"
_DRESSED = CLASSED.replace("from pages", "from dressed0")
_PAGES = f"dressed0 as (select page_id, {DRESSED_URL} as url, {DRESSED_HTML} as html from pages), {_DRESSED}, dressed as (select page_id, url, html, site as host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) as path, page_type from classed)"
_PLAIN = "b"
for _escape, _sign in N.JSON_ESCAPES:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_escape}', '{_sign}', 'g')"
_JSON_WORDS = f"""list_sum([0] || list_filter(list_transform(list_filter(flatten(list_transform(list_filter(list_transform({_list('html', N.JSON_SCRIPT, 1)} || {_list('html', N.STATE_SCRIPT, 1)}, lambda b: trim(b)), lambda b: json_valid(b)),
    lambda b: {_list(_PLAIN, N.JSON_STRING)})), lambda s: not ends_with(s, ':')), lambda s: len(regexp_extract_all(substr(s, 2, length(s) - 2), '\\S+'))), lambda n: n >= 2))"""
_SHELL = _ANY(_STARTS("html"), f"(regexp_matches(x, '{N.CONTAINER}') and (regexp_matches(x, '{N.SHELL_ID}') or regexp_matches(x, '{N.SHELL_CLASS}'))) or regexp_matches(x, '{N.SHELL_ELEMENT}') or (not regexp_matches(x, '{N.CONTAINER}') and regexp_matches(x, '{N.SHELL_ATTRIBUTE}'))")
_BODY = f"regexp_replace(regexp_extract(html, '{N.BODY}', 1), '{N.AFTER_BODY}', '')"
_CLEAN = f"regexp_replace(regexp_replace(html, '{N.RAW}', ' ', 'g'), '{N.NOSCRIPT}', ' ', 'g')"
_RENDER = rf"""{_PAGES}, shown as (
    select page_id, host, html, len(regexp_extract_all({VISIBLE}, '\S+'))::int as visible, {_SHELL} as shell, {_ANY(_list('html', N.NOSCRIPT), f"regexp_matches(x, '{N.NOTICE}')")} as notice, {_JSON_WORDS}::int as state,
           len({_list('html', N.EDGE_BLOCK)})::int as blocks, regexp_matches(html, '{N.EDGE_SCRIPT}') as edge, len({_list('html', N.SCRIPT_SOURCE)}) as sources,
           len(list_filter({_list('html', N.SCRIPT_SOURCES, 1)}, lambda s: not regexp_matches(s, '(?i){THIRD_PARTY}'))) as app_scripts, len(list_filter({_STARTS(_BODY)}, lambda t: not regexp_matches(t, '{N.NO_CONTENT_TAG}'))) as elements,
           regexp_matches({_CLEAN}, '{N.HEADING_TEXT}') and regexp_matches({_CLEAN}, '{N.PARAGRAPH_TEXT}') as structured
    from dressed
), render as (
    select *, visible + case when edge and blocks > 0 then greatest(state, blocks * {N.BLOCK_WORDS}) when (shell or notice) and visible < 100 and sources >= 2 then greatest(state, {N.SHELL_WORDS}) else state end as rendered from shown
), rates as (
    select *, case when rendered > 0 then round_even(visible * 100.0 / rendered, 0)::int else 100 end as rate, rendered - visible as missing from render
)"""


def rates(spark, d):
    """Visible and rendered words, static rate and missing words of the dressed pages, with the shell signals."""
    html = F.col("html")
    shown = once(
        dressed(spark, d).select(
            "page_id", "host", "html", T.split_words(T.visible_text(html)).alias("visible"), N.is_shell(html).alias("shell"), N.asks_for_scripts(html).alias("notice"),
            N.app_scripts(html, THIRD_PARTY).alias("app_scripts"), N.body_elements(html).alias("elements"),
        ),
        "page_id", "host", "html", "visible", "shell", "notice", "app_scripts", "elements",
    )
    r = shown.withColumn("rendered", F.col("visible") + N.client_words(html, F.col("visible"))).withColumn("semantic", N.has_semantic_content(html, F.col("visible")))
    rate = F.when(F.col("rendered") > 0, F.bround(F.col("visible") * 100.0 / F.col("rendered"), 0).cast("int")).otherwise(100)
    return r.select("page_id", "host", "visible", "shell", "notice", "app_scripts", "elements", "semantic", "rendered", rate.alias("rate"), (F.col("rendered") - F.col("visible")).alias("missing"))


@q("o081_static_rate", f"with {_RENDER} select page_id, visible as visible_words, rendered as rendered_words, rate as static_rate, missing as missing_words from rates")
def o081(spark, d):
    return rates(spark, d).select("page_id", F.col("visible").alias("visible_words"), F.col("rendered").alias("rendered_words"), F.col("rate").alias("static_rate"), F.col("missing").alias("missing_words"))


_C1 = "case when rate < 50 and missing > 100 then case when rate < 25 then 'critical' else 'high' end when rate < 80 and missing > 50 then 'medium' end"


@q("r11_static_deficit", f"with {_RENDER}, f as (select page_id, {_C1} as severity, rate from rates) select page_id, 'STATIC_HTML_HYDRATION_DEFICIT' as id, severity, rate from f where severity is not null")
def r11(spark, d):
    return rates(spark, d).withColumn("severity", F.expr(_C1)).where("severity is not null").select("page_id", F.lit("STATIC_HTML_HYDRATION_DEFICIT").alias("id"), "severity", "rate")


@q("r12_rendered_gap", f"with {_RENDER}, f as (select page_id, case when visible < 25 and (shell or notice) then 'high' when visible < 12 and app_scripts >= 1 and elements <= 3 and not (structured or visible >= 15) and not shell then 'medium' end as severity from rates) select page_id, 'RENDERED_CONTENT_GAP' as id, severity from f where severity is not null")
def r12(spark, d):
    """An application shell with little text, or a bundle with neither text nor structure."""
    severity = F.expr("case when visible < 25 and (shell or notice) then 'high' when visible < 12 and app_scripts >= 1 and elements <= 3 and not semantic and not shell then 'medium' end")
    return rates(spark, d).withColumn("severity", severity).where("severity is not null").select("page_id", F.lit("RENDERED_CONTENT_GAP").alias("id"), "severity")


_TEXT = rf"regexp_replace(regexp_replace(html, '{N.RAW}', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_HEADS = f"list_transform({_list(f'regexp_replace(html, ' + chr(39) + N.RAW + chr(39) + ', chr(32), ' + chr(39) + 'g' + chr(39) + ')', N.HEADINGS, 1)}, lambda h: trim(h))"
_AUTHORITIES = "|".join(x.replace(".", r"\.") for x in T.AUTHORITY_DOMAINS + T.AUTHORITY_SUFFIXES)
_URL_HOST = "lower(regexp_extract(x, '(?i)^https?://([^/?#]*)', 1))"


def _typed(names: list[str]) -> str:
    """Whether a JSON-LD block x has a node of one of these types at the top, in a list, or in a graph."""
    wanted, paths = sql_list(names), ("$[*].\"@type\"", "$.\"@graph\"[*].\"@type\"")
    return f"json_valid(x) and (coalesce(list_contains({wanted}, json_extract_string(x, '$.\"@type\"')), false) or " + " or ".join(f"list_has_any(coalesce(json_extract_string(x, '{p}'), []), {wanted})" for p in paths) + ")"


_SIGNALS = rf"""{_PAGES}, signals as (
    select page_id, page_type, len(regexp_extract_all({_TEXT}, '{T.WORD}'))::int as words,
           {_ANY(_list('html', N.HTTP_LINKS, 1), f"{_URL_HOST} <> host and not ends_with({_URL_HOST}, '.' || host) and regexp_matches(lower(x), '{_AUTHORITIES}')")} as authority,
           {_ANY(_list('html', N.LD_SCRIPT, 1), _typed(N.FAQ_TYPES))} as faq_schema, {_ANY(_HEADS, f"regexp_matches(lower(x), '{N.FAQ_HEADING}')")} as faq_headings, {_ANY(_HEADS, f"regexp_matches(x, '{N.QUESTION_HEADING}')")} as questions,
           regexp_matches({_TEXT}, '(?i)\b(?:{T.CREDENTIALS})') or {_ANY(_STARTS('html'), f"regexp_matches(x, '{N.AUTHOR}')")} as author,
           {_ANY(_STARTS('html'), "regexp_matches(x, '(?i)^<(?:table|ul|ol|dl)[\\s>/]')")} as tabular
    from dressed
)"""


def signals(spark, d):
    """Content signals of the dressed pages, each evaluated once."""
    html, text = F.col("html"), F.regexp_replace(F.regexp_replace(F.col("html"), N.RAW, " "), "<[^>]+>", " ")
    heads = N.heading_texts(html)
    s = dressed(spark, d).select(
        "page_id", "page_type", T.word_count(text).alias("words"), N.cites_authority(html, F.col("host")).alias("authority"), N.has_schema(html, N.FAQ_TYPES).alias("faq_schema"),
        F.exists(heads, lambda h: F.lower(h).rlike(U.as_sql_reads(N.FAQ_HEADING))).alias("faq_headings"), F.exists(heads, lambda h: h.rlike(U.as_sql_reads(N.QUESTION_HEADING))).alias("questions"),
        (T.has_credentials(text) | N.has_byline(html)).alias("author"), F.exists(N.start_tags(html), lambda t: t.rlike(r"(?i)^<(?:table|ul|ol|dl)[\s>/]")).alias("tabular"),
    )
    return once(s, *s.columns)


#: Content rules by page type: name, id, condition (the same in both engines).
RULES = [
    ("r53_authority", "PROACTIVE.GEO.AUTHORITY_CITATIONS.001", "page_type = 'article' and words > 200 and not authority"),
    ("r54_faq", "PROACTIVE.GEO.FAQ_QUESTION_ANSWER.001", "not faq_schema and not faq_headings and words > 200"),
    ("r55_credentials", "PROACTIVE.GEO.AUTHOR_CREDENTIALS.001", "page_type = 'article' and words > 150 and not author"),
    ("r56_question_headings", "PROACTIVE.GEO.QUESTION_HEADINGS.001", "page_type = 'article' and not questions and words > 150"),
    ("r57_structured_tables", "PROACTIVE.GEO.STRUCTURED_TABLES.001", "page_type = 'product_detail' and not tabular"),
]


def _rule(name: str, rule_id: str, condition: str) -> None:
    @q(name, f"with {_SIGNALS} select page_id, '{rule_id}' as id, words from signals where {condition}")
    def run(spark, d):
        return signals(spark, d).where(condition).select("page_id", F.lit(rule_id).alias("id"), "words")


for _name, _id, _condition in RULES:
    _rule(_name, _id, _condition)


@q("r08_canonical", f"with {_PAGES}, c as (select page_id, host, regexp_extract(regexp_extract(html, '{N.CANONICAL}', 1), '(?i)^https?://([^/?#]*)', 1) as canonical from dressed) select page_id, 'CANONICAL_FRAGMENTATION' as id, 'medium' as severity from c where canonical <> '' and canonical <> host")
def r08(spark, d):
    """The canonical link of the markup leads to another host."""
    host = F.regexp_extract(N.canonical(F.col("html")), "(?i)^https?://([^/?#]*)", 1)
    p = dressed(spark, d).where((host != "") & (host != F.col("host")))
    return p.select("page_id", F.lit("CANONICAL_FRAGMENTATION").alias("id"), F.lit("medium").alias("severity"))


_GATED = f"""({_HAS('path', N.STORE_PATHS)} or regexp_matches(html, '{N.STORE_BLOCK}') or (contains(lower(html), 'find a location') and contains(lower(html), 'search')))
 and (regexp_matches(html, '{N.FORM_INPUT}') or regexp_matches(html, '{N.FORM_TEXT}') or (contains(lower(html), 'post code') and contains(lower(html), 'search')))
 and not {_ANY(_list('html', N.HREFS, 1), f"{_HAS('lower(x)', N.STORE_LINKS)} and not ends_with(regexp_replace(x, '/+$', ''), regexp_replace(path, '/+$', ''))")} and not {_HAS('html', N.LOCAL_SCHEMAS)}"""


@q("r10_form_gated", f"with {_PAGES} select page_id, 'FORM_GATED_CORE_ENTITIES' as id, 'medium' as severity from dressed where {_GATED}")
def r10(spark, d):
    p = dressed(spark, d).where(N.is_form_gated(F.col("html"), F.col("path")))
    return p.select("page_id", F.lit("FORM_GATED_CORE_ENTITIES").alias("id"), F.lit("medium").alias("severity"))


@q("r20_entity_ambiguity", f"with {_PAGES} select page_id, case when {TITLE} = '' then 'finding' else 'recommendation' end as kind from dressed where not ({_ANY(_list('html', N.LD_SCRIPT, 1), _typed(N.ORGANIZATIONS))})")
def r20(spark, d):
    """Pages without an organisation in their schema: a finding only if the title is silent too."""
    html = F.col("html")
    return dressed(spark, d).where(~N.has_schema(html, N.ORGANIZATIONS)).select("page_id", F.when(T.title(html) == "", "finding").otherwise("recommendation").alias("kind"))


@q("r22_speakable_breadcrumb", f"with {_PAGES} select page_id, 'BREADCRUMB_MISSING' as id from dressed where len({_list('html', N.LD_SCRIPT, 1)}) > 0 and not ({_ANY(_list('html', N.LD_SCRIPT, 1), _typed(['BreadcrumbList']))})")
def r22(spark, d):
    """Pages with schema blocks of which none is a breadcrumb list."""
    html = F.col("html")
    return dressed(spark, d).where(html.rlike(N.LD_SCRIPT) & ~N.has_schema(html, ["BreadcrumbList"])).select("page_id", F.lit("BREADCRUMB_MISSING").alias("id"))


_ANCHORS = f"lower(array_to_string(list_transform({_list('html', N.ANCHOR_TEXT, 1)}, lambda a: regexp_replace(a, '<[^>]+>', '', 'g')), ' '))"


_MISMATCH = f"regexp_matches({VISIBLE}, '{T.PRICE}') and not regexp_matches({_ANCHORS}, '{'|'.join(N.CALLS_TO_ACTION)}')"


def _mismatched(html):
    return T.visible_text(html).rlike(T.PRICE) & ~N.anchor_texts(html).rlike("|".join(N.CALLS_TO_ACTION))


@q("r70_intent_mismatch", f"with {_PAGES} select page_id, 'INTENT_TO_LANDING_MISMATCH' as id, 'medium' as severity from dressed where {_MISMATCH}")
def r70(spark, d):
    """Pages that show a price without a call to action among their anchors."""
    return dressed(spark, d).where(_mismatched(F.col("html"))).select("page_id", F.lit("INTENT_TO_LANDING_MISMATCH").alias("id"), F.lit("medium").alias("severity"))


_SITE = f"""{_RENDER}, found as (
    select host, 'C1:' || page_id as finding, {_C1} as severity, 'discoverability' as domain from rates where {_C1} is not null
), lost as (select host, sum(case severity when 'critical' then 40 when 'high' then 25 else 15 end) as lost, count(*) as findings from found group by host),
home as (select host, arg_min(rate, page_id) as rate from rates group by host),
site as (select host as site, greatest(0, greatest(0, 100 - coalesce(lost, 0)) - case when rate < 90 then floor((100 - rate) * 0.4)::int else 0 end)::int as score, coalesce(findings, 0) as findings, rate from home left join lost using (host))"""


@q("o083_static_penalty", f"with {_SITE} select site, score, findings, rate from site")
def o083_penalty(spark, d):
    """Discoverability of each site: its rendering findings, then the penalty for its first page's static rate."""
    r = rates(spark, d)
    f = r.withColumn("severity", F.expr(_C1)).where("severity is not null")
    f = f.select(F.col("host").alias("site"), F.concat(F.lit("C1:"), F.col("page_id").cast("string")).alias("finding"), "severity", F.array(F.lit("C1")).alias("check_ids"))
    home = r.groupBy(F.col("host").alias("site")).agg(F.min_by("rate", "page_id").alias("rate"))
    scores = P.domain_scores(f, C.catalogue(spark), coverage=home).where("domain = 'discoverability'")
    return home.join(scores, "site").select("site", "score", "findings", "rate")


@q("o132_credentials", rf"with t as (select doc_id, text from documents), h as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines, regexp_extract_all(text, '(?i)https?://[^\s<>\x22\x27]+') as links, text from t) select doc_id, regexp_matches(text, '(?i)\b(?:{T.CREDENTIALS})') as credentials, {_ANY('links', f"regexp_matches(lower(x), '{_AUTHORITIES}')")} as authority, {_ANY('lines', f"regexp_matches(lower(x), '{N.QUESTION_HEADING}')")} as question from h")
def o132(spark, d):
    """Credentials anywhere, an authority among the addresses, a question among the lines."""
    text = F.col("text")
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    links = F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s<>\x22\x27]+"), 0)
    return table(spark, d, "documents").select(
        "doc_id", T.has_credentials(text).alias("credentials"), F.exists(links, T.has_authority).alias("authority"), F.exists(lines, lambda x: F.lower(x).rlike(U.as_sql_reads(N.QUESTION_HEADING))).alias("question"),
    )


#: Fixed locators that the artifacts below are asked for.
LOCATORS = ["text", "response body", "source.canonicals", "source.names[1]", "sections[0].lines[1]", "sections[4].lines[0]", "source.text.deep", "1bad"]


@q("o147_locator_paths", rf"""with a as (
    select doc_id, list_extract({sql_list(LOCATORS)}, (doc_id % {len(LOCATORS)})::int + 1) as locator, coalesce(text, '') as text, coalesce(source, '') as source, coalesce(lang, '') as lang from documents
), j as (
    select *, json_object('text', text, 'source', json_object('names', [lang, source], 'canonicals', [source || '/a', source || '/b']), 'sections', [json_object('lines', [string_split(text, ' ')[1], source])]) as artifact,
           case doc_id % 3 when 0 then left(text, 12) when 1 then source else source || '/a | ' || source || '/b' end as quote from a
), r as (
    select *, regexp_full_match(locator, '{C.LOCATOR}') or locator = 'response body' as grammatical, json_extract(artifact, case when locator = 'response body' then '$.text' when regexp_full_match(locator, '{C.LOCATOR}') then '$.' || locator else '$.none' end) as selected from j
), h as (select *, case when json_type(selected) = 'VARCHAR' then json_extract_string(selected, '$') else selected::varchar end as haystack from r)
select doc_id, locator, case when quote = '' then 'quote_missing' when not grammatical then 'locator_grammar' when haystack is null then 'locator_unresolved'
    when contains(haystack, quote) or (locator = 'source.canonicals' and len(list_filter(string_split(quote, ' | '), lambda x: not contains(haystack, x))) = 0) then 'kept' else 'quote_not_found' end as outcome from h""")
def o147(spark, d):
    """Locators as paths into artifacts, quotes found where they point to; canonicals may be quoted one by one."""
    text, source, lang = (F.coalesce(c, F.lit("")) for c in ("text", "source", "lang"))
    artifact = F.to_json(F.struct(text.alias("text"), F.struct(F.array(lang, source).alias("names"), F.array(F.concat(source, F.lit("/a")), F.concat(source, F.lit("/b"))).alias("canonicals")).alias("source"), F.array(F.struct(F.array(F.split(text, " ")[0], source).alias("lines"))).alias("sections")))
    locator = F.element_at(F.array(*map(F.lit, LOCATORS)), (F.col("doc_id") % len(LOCATORS) + 1).cast("int"))
    quote = F.when(F.col("doc_id") % 3 == 0, F.left(text, F.lit(12))).when(F.col("doc_id") % 3 == 1, source).otherwise(F.concat(source, F.lit("/a | "), source, F.lit("/b")))
    rows = table(spark, d, "documents").select("doc_id", locator.alias("locator"), quote.alias("quote"), artifact.alias("artifact"))
    return rows.select("doc_id", "locator", F.coalesce(P.evidence_fault(F.col("artifact"), F.col("locator"), F.col("quote")), F.lit("kept")).alias("outcome"))


@q("o143_offer_nodes", f"with b as (select p_partkey as page_id, {_BODY_SQL} as body from part), t as (select page_id, unnest(regexp_extract_all(body, '{N.TYPE_VALUE}', 1)) as type from b where json_valid(body)) select page_id, count(*) as found from t where regexp_matches(lower(type), '{N.OFFER_TYPE}') group by page_id")
def o143(spark, d):
    """Product and offer nodes at any depth: an object has one type, so types are counted wherever they stand in valid JSON."""
    b = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.expr(_BODY_SQL).alias("body")).where("try_parse_json(body) is not null")
    t = b.select("page_id", F.size(F.filter(F.regexp_extract_all("body", F.lit(N.TYPE_VALUE), 1), lambda x: F.lower(x).rlike(N.OFFER_TYPE))).cast("long").alias("found"))
    return t.where("found > 0")


_IDS = _list("array_to_string(" + _list("html", N.LD_SCRIPT, 1) + ", ' ')", N.NODE_ID, 1)
_ROOT = lambda host: f"array_to_string(string_split({host}, '.')[-2:], '.')"


@q("r05_cross_host_identity", f"with {_PAGES}, i as (select page_id, host, unnest({_IDS}) as node_id from dressed), h as (select distinct page_id, host, lower(regexp_extract(node_id, '(?i)^https?://([^/?#]*)', 1)) as node_host from i) select page_id, node_host as host, {_ROOT('node_host')} as root, 'medium' as severity from h where {_ROOT('node_host')} <> {_ROOT('host')}")
def r05(spark, d):
    """Nodes whose id lives under another registered name than their page."""
    ids = F.regexp_extract_all(F.array_join(F.regexp_extract_all("html", F.lit(N.LD_SCRIPT), 1), " "), F.lit(N.NODE_ID), 1)
    n = dressed(spark, d).select("page_id", "host", F.explode(ids).alias("node_id"))
    n = n.select("page_id", "host", F.lower(F.regexp_extract("node_id", "(?i)^https?://([^/?#]*)", 1)).alias("node_host")).distinct()
    root = U.registered_root(F.col("node_host"))
    return n.where(root != U.registered_root(F.col("host"))).select("page_id", F.col("node_host").alias("host"), root.alias("root"), F.lit("medium").alias("severity"))


_STATUS = f"{_FETCHES}, probed as (select url, max_by(status, event_id) as status from fetches where agent = 0 group by url)"
_NAVIGATION = f"{_PAGES}, {_STATUS}, nav as (select distinct host as site, unnest({_list('array_to_string(' + _list('html', N.NAVIGATION, 1) + ', chr(32))', N.HREFS, 1)}) as href from dressed where regexp_matches(html, '{N.NAVIGATION}')), linked as (select site, href, status from nav left join probed on probed.url = nav.href where starts_with(href, 'http'))"


def probed(spark, d):
    """The last status that a browser got from each address."""
    return fetches(spark, d).where("agent = 0").groupBy("url").agg(F.max_by("status", "event_id").alias("status"))


def linked(spark, d):
    """Absolute navigation targets of each site with their probed status, null where nobody asked."""
    hrefs = F.regexp_extract_all(F.array_join(F.regexp_extract_all("html", F.lit(N.NAVIGATION), 1), " "), F.lit(N.HREFS), 1)
    nav = dressed(spark, d).select(F.col("host").alias("site"), F.explode(hrefs).alias("href")).where(F.col("href").startswith("http")).distinct()
    return nav.join(probed(spark, d).withColumnRenamed("url", "href"), "href", "left").select("site", "href", "status")


@q("o064_link_status", f"with {_NAVIGATION} select site, href, coalesce(status, 0) as status, status is not null as probed from linked")
def o064_status(spark, d):
    return linked(spark, d).select("site", "href", F.coalesce("status", F.lit(0)).alias("status"), F.col("status").isNotNull().alias("probed"))


@q("r09_dead_navigation", f"with {_NAVIGATION} select site, href, 'NAV_DEAD_END_' || status as id, 'high' as severity from linked where status in (404, 410) or status >= 500")
def r09(spark, d):
    """Navigation targets whose probe gave 404, 410 or a server error."""
    n = linked(spark, d).where("status in (404, 410) or status >= 500")
    return n.select("site", "href", F.concat(F.lit("NAV_DEAD_END_"), F.col("status").cast("string")).alias("id"), F.lit("high").alias("severity"))


_PROFILES = f"{_PAGES}, {_STATUS}, blocks0 as (select page_id, unnest({_list('html', N.LD_SCRIPT, 1)}) as b from dressed), orgs as (select page_id, unnest(from_json(json_extract(b, '$.\"@graph\"'), '[\"json\"]')) as o from blocks0 where json_valid(b) and json_type(b, '$.\"@graph\"') = 'ARRAY'), profiles as (select distinct page_id, lower(json_extract_string(o, '$.name')) as brand, unnest(json_extract_string(o, '$.sameAs[*]')) as link from orgs where json_extract_string(o, '$.\"@type\"') = 'Organization'), anchors as (select * from profiles where regexp_matches(link, '^https?://'))"
_ORGANIZATIONS = "array<struct<`@type`:string,name:string,sameAs:array<string>>>"


def profiles(spark, d):
    """page_id, brand and link: where the organisations of a page's graph say they are also to be found."""
    b = dressed(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit(N.LD_SCRIPT), 1)).alias("b"))
    o = b.select("page_id", F.explode(F.from_json(F.get_json_object("b", "$.@graph"), _ORGANIZATIONS)).alias("o")).where(F.col("o.`@type`") == "Organization")
    return o.select("page_id", F.lower("o.name").alias("brand"), F.explode("o.sameAs").alias("link")).where(F.col("link").rlike("^https?://")).distinct()


@q("r41_broken_anchors", f"with {_PROFILES} select page_id, link, case when status is null then 'inconclusive' else 'broken' end as class from anchors left join probed on probed.url = link where status is null or status <> 200")
def r41(spark, d):
    """Anchors that did not answer 200; one that nobody asked is inconclusive, not broken."""
    p = profiles(spark, d).join(probed(spark, d).withColumnRenamed("url", "link"), "link", "left").where("status is null or status != 200")
    return p.select("page_id", "link", F.when(F.col("status").isNull(), "inconclusive").otherwise("broken").alias("class"))


@q("r42_corroboration_gap", f"with {_PROFILES}, w as (select url, lower({TITLE}) as title, lower({VISIBLE}) as body from dressed) select page_id, link, bool_or(contains(title, brand) or contains(body, brand)) as corroborated from anchors join w on w.url = link group by all")
def r42(spark, d):
    """Whether the linked page of the corpus names the brand, in title or text; only texts of pages that are linked move."""
    wanted = profiles(spark, d)
    linked = wanted.select(F.col("link").alias("url")).distinct()
    w = dressed(spark, d).join(linked, "url", "left_semi").select(F.col("url").alias("link"), F.lower(T.title(F.col("html"))).alias("title"), F.lower(T.visible_text(F.col("html"))).alias("body"))
    met = wanted.join(w, "link").select("page_id", "link", (F.contains("title", F.col("brand")) | F.contains("body", F.col("brand"))).alias("named"))
    return met.groupBy("page_id", "link").agg(F.bool_or("named").alias("corroborated"))


def _types(html):
    """Type names in all JSON-LD blocks of a page: at the top, in lists, in graphs."""
    named = lambda b: F.regexp_extract_all(F.concat_ws(" ", *(F.get_json_object(b, p) for p in ("$.@type", "$[*].@type", "$.@graph[*].@type"))), F.lit("[A-Za-z]+"), 0)
    return F.flatten(F.transform(F.regexp_extract_all(html, F.lit(N.LD_SCRIPT), 1), named))


_QUOTED = lambda x: x.replace("'", "''")
_TYPE_NAMES = f"flatten(list_transform(list_filter({_list('html', N.LD_SCRIPT, 1)}, lambda x: json_valid(x)), lambda x: regexp_extract_all(concat_ws(' ', json_extract(x, '$.\"@type\"')::varchar, array_to_string(json_extract(x, '$[*].\"@type\"')::varchar[], ' '), array_to_string(json_extract(x, '$.\"@graph\"[*].\"@type\"')::varchar[], ' ')), '[A-Za-z]+')))"


def _archetype_sql() -> str:
    rows = []
    for c in A.CATEGORIES:
        labels = " + ".join(f"contains(low, '{_QUOTED(x)}')::int" for x in A.LABELS[c])
        rows.append(f"{{'category': '{c}', 'family': 'url_path', 'points': regexp_matches(path, '{'|'.join(A.PATHS[c])}')::int}}")
        rows.append(f"{{'category': '{c}', 'family': 'label_cues', 'points': 3 * (({labels}) >= {A.LEAST_LABELS})::int}}")
        rows.append(f"{{'category': '{c}', 'family': 'schema_org', 'points': 4 * len(list_filter(types, lambda t: regexp_matches(lower(t), '{'|'.join(x.lower() for x in A.SCHEMAS[c])}')))::int}}")
        if c in A.PAGE_TYPES:
            rows.append(f"{{'category': '{c}', 'family': 'inventory_type', 'points': 2 * (page_type in ({', '.join(repr(x) for x in A.PAGE_TYPES[c])}))::int}}")
    places = "case category " + " ".join(f"when '{c}' then {k}" for k, c in enumerate(A.CATEGORIES)) + " end"
    return f"""with {_PAGES}, content as (select host as site, path, page_type, lower({TITLE} || ' ' || array_to_string({_HEADS}, ' ') || ' ' || left({VISIBLE}, {A.LABEL_CHARS})) as low, {_TYPE_NAMES} as types from dressed),
e as (select site, unnest([{', '.join(rows)}]) as x from content union all select host, {{'category': 'ECOMMERCE', 'family': 'specialist_checks', 'points': 1}} from dressed where {_MISMATCH}),
scored as (select site, x.category as category, sum(x.points) as score, list_sort(list(distinct x.family)) as families from e where x.points > 0 group by all),
ranked as (select *, row_number() over (partition by site order by score desc, {places}) as k from scored where score >= {A.LEAST_SCORE} and len(families) >= {A.LEAST_FAMILIES})
select s.site, coalesce(max(category) filter (k = 1), 'GENERIC') as primary, coalesce(string_agg(category, ',' order by k) filter (k in (2, 3)), '') as secondary,
    case when max(k) is null then 'low' when max(score) filter (k = 1) >= 10 and max(len(families)) filter (k = 1) >= 3 then 'high' else 'medium' end as confidence, coalesce(max(array_to_string(families, ',')) filter (k = 1), '') as families
from (select distinct site from content) s left join ranked r on r.site = s.site group by s.site"""


@q("o082_site_archetype", _archetype_sql())
def o082(spark, d):
    """Five families of evidence (O-067, O-082) in one pass: paths, labels, schema types, page types, and checks of findings."""
    html = F.col("html")
    content = F.concat_ws(" ", T.title(html), F.array_join(N.heading_texts(html), " "), F.left(T.visible_text(html), F.lit(A.LABEL_CHARS)))
    p = dressed(spark, d).select(F.col("host").alias("site"), "path", "page_type", content.alias("content"), _types(html).alias("types"), _mismatched(html).alias("mismatched"))
    p = once(p, "site", "path", "page_type", "content", "types", "mismatched")
    check = F.when(F.col("mismatched"), A.check_item(F.lit(C.CAUSES["INTENT_TO_LANDING_MISMATCH"])))
    found = F.concat(A.page_evidence(F.col("path"), F.col("content"), F.col("types"), F.col("page_type")), F.array_compact(F.array(check)))
    return A.archetypes(None, p.select("site", F.explode_outer(found).alias("x")).select("site", "x.*"))


_CENTROID_ROWS = ", ".join(f"({i}, '{k}', '{w}', {x})" for i, (k, ws) in enumerate(A.CENTROIDS.items()) for w, x in ws.items())


@q("o08b_cosine_type", f"""with {_PAGES}, w as (select host as site, unnest(regexp_extract_all(lower({TITLE} || ' ' || url), '[a-z]{{3,}}')) as word from dressed), tf as (select site, word, count(*)::double as n from w group by all), nd as (select site, sqrt(sum(n * n)) as norm from tf group by site),
c(place, kind, word, x) as (values {_CENTROID_ROWS}), nc as (select place, kind, sqrt(sum(x::double * x::double)) as norm from c group by all), s as (select site, place, kind, round_even(sum(n * x::double) / (any_value(nd.norm) * any_value(nc.norm)), 6) as score from tf join c using (word) join nd using (site) join nc using (place, kind) group by all),
r as (select *, row_number() over (partition by site order by score desc, place) as k from s where score > {A.LEAST_SIMILARITY}) select nd.site, coalesce(kind, '{A.ANY_TYPE}') as kind, coalesce(score, 0.0)::double as score from nd left join r on r.site = nd.site and k = 1""")
def o08b(spark, d):
    """Words of a site's titles and addresses against the centroids of four site types."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", T.title(F.col("html")), "url")), F.lit("[a-z]{3,}"), 0)
    terms = dressed(spark, d).select(F.col("host").alias("site"), F.explode(words).alias("word")).groupBy("site", "word").agg(F.count("*").alias("n"))
    return A.site_types(terms)


QUERIES, SQL = area.queries, area.sql
