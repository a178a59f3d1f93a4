"""What a site's structured data says of identity, voice and hierarchy; manifests; passages; metrics of a site.

The page corpus has no such blocks, so pages are dressed with them alike in
both engines; the rules read only address, markup and status.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlight.functions import rendering as N
from crawlight.functions import text as T
from crawlight.functions import urls as U
from crawlight.operators import json_walk as W
from crawlight.operators import structured as S
from crawlight.operators import tokens as K
from crawlight.queries.answers import _CODES, _DIRECTIVES, _PAGES, r06, r07, shown
from crawlight.queries.content import DEPTH, WORDS
from crawlight.queries.registry import Area, sql_in
from crawlight.queries.sqlbits import NETLOC, TOKENS, VISIBLE
from crawlight.sources.tables import table

area = Area()
q = area.query

_BLOCK = '<script type="application/ld+json">{}</script>'
#: Markup of the dressed pages; the last block is broken.
_MARKUP = "case page_id % 7 " + " ".join(
    f"when {k} then '{_BLOCK.format(body)}'"
    for k, body in enumerate(
        [
            """{"@type":"WebPage","mainEntity":{"@type":["Product","Thing"],"name":"P","@id":"https://shop.other.test/p' || page_id || '","url":"https://www.example.com/x","offers":[{"@type":"AggregateOffer","url":"http://pay.elsewhere.org/1"},{"@type":"Person","url":"https://not.one.org/"},[{"@type":"Offer","@id":"#local"}]]}}""",
            """{"@type":"BreadcrumbList","name":"way","speakable":{"cssSelector":["h1"]}}""",
            """[{"@type":"product","@id":"https://small.letters.org/a"},7,"text",{"@type":"Offer","@id":"HTTPS://UPPER.test/a","url":"https://only.one"}]""",
            """{"@graph":[{"@type":"Organization","url":"https://far.away.net/"},{"@type":"SpeakableSpecification"}]}""",
            """{"@type":"Product","name":"Kit ' || page_id % 3 || '","description":"of parts","offers":{"@type":"Offer","price":"' || (10 + page_id % 4) || '","availability":"InStock"}}""",
            """{"@type":"IndividualProduct","url":"https://a.b.example.com:81/x","isRelatedTo":{"@type":"Product","name":"Kit ' || page_id % 3 || '","offers":{"price":"10"}}}""",
            """{"@type":"Product","@id":"https://lost.org/" """,
        ]
    )
) + " end"
_MARKED = f"""{_PAGES}, marked as (select page_id, site, page_type, html || {_MARKUP} as html from shown),
blocks as (select page_id, site, page_type, unnest(regexp_extract_all(html, '{N.LD_SCRIPT}', 1)) as body from marked), parsed as (select page_id, site, page_type, try_cast(trim(body) as json) as j from blocks where json_valid(body)),
items as (select page_id, site, unnest(case json_type(j) when 'ARRAY' then json_extract(j, '$[*]') else [j] end) as item from parsed),
entities as (select page_id, site, node, case json_type(node, '$."@type"') when 'ARRAY' then json_extract_string(node, '$."@type"[*]') else [json_extract_string(node, '$."@type"')] end as types from (select page_id, site, unnest(case when json_exists(item, '$."@graph"') then json_extract(item, '$."@graph"[*]') else [item] end) as node from items) where json_type(node) = 'OBJECT')"""


def marked(spark, d):
    """page_id, site, page type and html of the dressed pages."""
    return shown(spark, d).select("page_id", "site", "page_type", F.concat("html", F.expr(_MARKUP)).alias("html"))


def _blocks(pages, *kept):
    return pages.select(*kept, F.explode(F.regexp_extract_all("html", F.lit(N.LD_SCRIPT), 1)).alias("body"))


def _entities(pages):
    """page_id as (page_id, site), pos and node of the pages' blocks."""
    return S.nodes(_blocks(pages, F.struct("page_id", "site").alias("page_id")))


_ROOT = lambda host: f"array_to_string(string_split({host}, '.')[-2:], '.')"


@q("r05_product_identity", f"""with {_MARKED}, tree as (select p.page_id as page, p.site as host, t.value as node from parsed p, json_tree(p.j) t where t.type = 'OBJECT'),
typed as (select page, host, node, case json_type(node, '$."@type"') when 'ARRAY' then json_extract_string(node, '$."@type"[*]') else [json_extract_string(node, '$."@type"')] end as types from tree),
said as (select page, lower(host) as host, unnest({W.IDENTITIES}) as property, unnest([json_extract_string(node, '$."@id"'), json_extract_string(node, '$.url')]) as target from typed where list_has_any(types, {W.IDENTIFIED_TYPES})),
roots as (select *, {_ROOT("lower(regexp_extract(target, '^https?://([^/?#]*)', 1))")} as root from said where regexp_matches(target, '^https?://'))
select page as page_id, property, target, root, 'E3' as check_id, 'medium' as severity from roots where root <> '' and root <> {_ROOT('host')}""")
def r05(spark, d):
    """Products and offers, at any depth of a page's blocks, that live under another registered name than the page."""
    v = _blocks(marked(spark, d), "page_id", F.lower("site").alias("host")).select("page_id", "host", F.try_parse_json("body").alias("v"))
    i = W.identities(W.objects(v, "v"))
    root = U.registered_root(F.lower(F.regexp_extract("target", "^https?://([^/?#]*)", 1)))
    i = i.select("page_id", "host", "property", "target", root.alias("root")).where((F.col("root") != "") & (F.col("root") != U.registered_root(F.col("host"))))
    return i.select("page_id", "property", "target", "root", F.lit("E3").alias("check_id"), F.lit("medium").alias("severity"))


@q("r22_site_readiness", f"""with {_MARKED}, found as (select site, bool_or(json_exists(node, '$.speakable') or list_contains(list_transform(types, lambda x: lower(x)), 'speakablespecification')) as speakable, bool_or(list_contains(list_transform(types, lambda x: lower(x)), 'breadcrumblist')) as breadcrumbs from entities group by site),
sites as (select site, count(*) as pages from marked group by site), s as (select site, pages, coalesce(speakable, false) as speakable, coalesce(breadcrumbs, false) as breadcrumbs from sites left join found using (site))
select site, pages, 'SPEAKABLE_MISSING' as id, 'observation' as kind from s where not speakable union all select site, pages, 'BREADCRUMB_MISSING', 'recommendation' from s where not breadcrumbs and pages > 1""")
def r22(spark, d):
    """Sites whose blocks name nothing to be spoken, and sites of several pages without a breadcrumb list."""
    p = marked(spark, d)
    types = F.transform(S.texts("node", "$['@type']"), F.lower)
    speaks = F.expr("try_variant_get(node, '$.speakable', 'variant')").isNotNull() | F.array_contains(types, "speakablespecification")
    found = _entities(p).select("page_id.site", F.coalesce(speaks, F.lit(False)).alias("s"), F.coalesce(F.array_contains(types, "breadcrumblist"), F.lit(False)).alias("b"))
    found = found.groupBy("site").agg(F.bool_or("s").alias("s"), F.bool_or("b").alias("b"))
    sites = p.groupBy("site").agg(F.count("*").alias("pages")).join(found, "site", "left").na.fill(False, ["s", "b"])
    says = lambda missing, name, kind: F.when(missing, F.struct(F.lit(name).alias("id"), F.lit(kind).alias("kind")))
    each = F.array_compact(F.array(says(~F.col("s"), "SPEAKABLE_MISSING", "observation"), says(~F.col("b") & (F.col("pages") > 1), "BREADCRUMB_MISSING", "recommendation")))
    return sites.select("site", "pages", F.inline(each))


#: Addresses and statuses of the inventory: some are manifests, some only look like one.
_ADDRESS = """case page_id % 9 when 0 then 'https://' || {host} || '/llms.txt' when 1 then 'https://' || {host} || '/docs/llms.txt//' when 2 then 'https://' || {host} || '/llms.txt.bak' when 3 then 'https://' || {host} || '/LLMS.txt' else url end as url"""
_STATUS = "case page_id % 4 when 0 then 404 when 1 then 301 else 200 end as status"


@q("r18_manifest", f"with i as (select page_id, {NETLOC} as site, {_ADDRESS.format(host=NETLOC)}, {_STATUS} from pages), s as (select site, count(*) as pages, arg_min(status, page_id) filter (ends_with(rtrim(url, '/'), '/llms.txt')) as status from i group by site) select site, pages, status, 'LLMS_TXT_MISSING' as id, 'informational' as role from s where status is null or status <> 200")
def r18(spark, d):
    """Sites whose first manifest in the inventory is none or did not answer 200."""
    i = table(spark, d, "pages").withColumn("host", U.netloc(F.col("url"))).selectExpr("page_id", "host as site", _ADDRESS.format(host="host"), _STATUS)
    manifest = F.expr("rtrim('/', url)").endswith("/llms.txt")
    s = i.groupBy("site").agg(F.count("*").alias("pages"), F.min_by(F.when(manifest, F.col("status")), F.when(manifest, F.col("page_id"))).alias("status"))
    return s.where("status is null or status != 200").select("site", "pages", "status", F.lit("LLMS_TXT_MISSING").alias("id"), F.lit("informational").alias("role"))


_PASSAGES = f"""{TOKENS}, n as (select *, sum(case when kind = 'start' and tag = 'p' then 1 else 0 end) over (partition by page_id order by pos rows between unbounded preceding and current row) as n from governed),
closed as (select distinct page_id, n from n where kind = 'end' and tag = 'p'),
paragraphs as (select page_id, string_agg(trim(tok), ' ' order by pos) as text from n semi join closed using (page_id, n) where kind = 'text' and current_tag = 'p' and trim(tok) <> '' group by page_id, n),
lengths as (select page_id, {WORDS} as words from paragraphs),
spread as (select page_id, count(*) as passages, count(*) filter (words > 250) as long, count(*) filter (words < 45) as short, round_even(avg(words), 4) as avg_words from lengths where words >= 20 group by page_id having count(*) >= 2),
totals as (select page_id, {WORDS} as total from (select page_id, {VISIBLE} as text from pages))"""


@q("r60_page_passages", f"with {_PASSAGES} select page_id, 'PROACTIVE.GEO.PASSAGE_CHUNK_LENGTH.001' as id, case when long > passages * 0.5 then 'dense' else 'fragmented' end as kind, passages, avg_words from spread join totals using (page_id) where long > passages * 0.5 or (short > passages * 0.7 and total > 200)")
def r60(spark, d):
    """Pages whose paragraphs of twenty words and more are mostly too long, or mostly too short."""
    pages = table(spark, d, "pages")
    n = K.paragraphs(pages).select("page_id", T.word_count(F.col("text")).alias("words")).where("words >= 20")
    s = n.groupBy("page_id").agg(F.count("*").alias("passages"), F.count_if(F.col("words") > 250).alias("long"), F.count_if(F.col("words") < 45).alias("short"), F.bround(F.avg("words"), 4).alias("avg_words"))
    s = s.where("passages >= 2 and (long > passages * 0.5 or short > passages * 0.7)")
    total = pages.select("page_id", T.word_count(T.visible_text(F.col("html"))).alias("total"))
    met = s.join(total, "page_id").where("long > passages * 0.5 or total > 200")
    return met.select("page_id", F.lit("PROACTIVE.GEO.PASSAGE_CHUNK_LENGTH.001").alias("id"), F.when(F.col("long") > F.col("passages") * 0.5, "dense").otherwise("fragmented").alias("kind"), "passages", "avg_words")


#: Page types that must answer a buyer, and those that must explain.
SELLING, EXPLAINING = ["pricing", "product_detail"], ["article", "blog", "product_detail"]
_PRICE = "coalesce(json_extract_string(node, '$.offers[0].price'), json_extract_string(node, '$.offers.price'))"
_AVAILABLE = "coalesce(json_extract_string(node, '$.offers[0].availability'), json_extract_string(node, '$.offers.availability'))"
_METRICS = f"""{_MARKED}, {_DIRECTIVES.split(_PAGES + ', ')[1]}, {_CODES.split(_PAGES + ', ')[1]},
products as (select page_id, site, json_extract_string(node, '$.name') as name, {_PRICE} as price, {_PRICE} is not null and {_AVAILABLE} is not null and json_exists(node, '$.description') as complete from entities where list_contains(list_transform(types, lambda x: lower(x)), 'product')),
answered as (select page_id, bool_or(complete) as complete from products group by page_id),
conflicts as (select site, count(*) as n from (select site, name from products where name is not null and price is not null group by all having count(distinct price) > 1) group by site),
read as (select page_id, site, page_type, {VISIBLE} as text from marked), depths as (select page_id, ({DEPTH}) / {len(T.MECHANISMS)}.0 as depth from read),
worst as (select site, max(case when list_has_any(words, ['noindex', 'none']) then 2 when page_id in (select page_id from wrong) then 1 else 0 end) as w from marked join directives using (page_id) group by site),
s as (select m.site, count(*) as pages, round_even(avg(coalesce(complete, false)::int) filter (page_type in {sql_in(SELLING)}), 4) as answerability_index, round_even(avg(depth) filter (page_type in {sql_in(EXPLAINING)}), 4) as geo_readiness_score from marked m left join answered using (page_id) join depths using (page_id) group by m.site)"""


@q("o08c_site_metrics", f"with {_METRICS} select site, pages, answerability_index, geo_readiness_score, coalesce(n, 0) as contradiction_index, case when w = 2 then 'critical' when w = 1 or n > 0 then 'needs_work' else 'good' end as overall_health from s join worst using (site) left join conflicts using (site)")
def o08c(spark, d):
    """Per site: share of selling pages with price, availability and description, depth of explaining pages, conflicting prices of one product, and health."""
    p = marked(spark, d)
    e = S.entities(_entities(p)).where(S.has_type(F.col("types"), "product"))
    e = e.select("page_id.page_id", "page_id.site", "name", "price", (F.col("price").isNotNull() & F.col("availability").isNotNull() & F.col("description").isNotNull()).alias("complete"))
    answered = e.groupBy("page_id").agg(F.bool_or("complete").alias("complete"))
    conflicts = e.where("name is not null and price is not null").groupBy("site", "name").agg(F.min("price").alias("low"), F.max("price").alias("high")).where("low != high").groupBy("site").agg(F.count("*").alias("n"))
    grave = r06(spark, d).select("page_id", F.lit(2).alias("w")).unionByName(r07(spark, d).select("page_id", F.lit(1).alias("w"))).groupBy("page_id").agg(F.max("w").alias("w"))
    depth = T.depth_score(T.visible_text(F.col("html"))) / float(len(T.MECHANISMS))
    rows = p.select("page_id", "site", "page_type", F.when(F.col("page_type").isin(EXPLAINING), depth).alias("depth")).join(answered, "page_id", "left").join(grave, "page_id", "left")
    s = rows.groupBy("site").agg(
        F.count("*").alias("pages"), F.bround(F.avg(F.when(F.col("page_type").isin(SELLING), F.coalesce("complete", F.lit(False)).cast("int"))), 4).alias("answerability_index"), F.bround(F.avg("depth"), 4).alias("geo_readiness_score"), F.max("w").alias("w"),
    )
    s = s.join(conflicts, "site", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    health = F.when(F.col("w") == 2, "critical").when((F.col("w") == 1) | (F.col("n") > 0), "needs_work").otherwise("good")
    return s.select("site", "pages", "answerability_index", "geo_readiness_score", F.col("n").alias("contradiction_index"), health.alias("overall_health"))


QUERIES, SQL = area.queries, area.sql
