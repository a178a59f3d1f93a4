"""Sources, projections, filters, sampling and set operations over page URLs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.functions import urls as U
from crawlight.operators import redirects as Rd
from crawlight.operators.frontier import PRIORITY
from crawlight.operators.redirects import MOST_HOPS
from crawlight.queries.registry import Area, sql_in
from crawlight.queries.sqlbits import CLASSED, NETLOC, TITLE, URLS, VISIBLE
from crawlight.sources.tables import INVENTORY, fetches, inventory_pages, pages, table

area = Area()
q = area.query
PER_TEMPLATE, MOST_PAGES = 3, 27


@q("o002_pages", f"with {CLASSED} select page_id, site, url, 200 as status, page_type, confidence as page_type_confidence, template as logical_template, locale, title, len(regexp_extract_all({VISIBLE}, '\\S+'))::int as word_count from classed")
def o002(spark, d):
    return pages(spark, d).drop("html")


@q("o001_inventory", f"with {URLS} select site, url, title from logical")
def o001(spark, d):
    """Inventories as JSON texts of at most 1000 pages of a site, read back under the declared schema (files go through read_inventory)."""
    page = F.struct(F.col("url").alias("url"), T.title(F.col("html")).alias("title"), F.lit(200).alias("status"))
    texts = table(spark, d, "pages").groupBy(U.netloc(F.col("url")).alias("site"), F.floor(F.col("page_id") / 1000)).agg(F.collect_list(page).alias("pages")).select(F.to_json(F.struct("site", "pages")).alias("body"))
    inventory = texts.select(F.from_json("body", INVENTORY).alias("i")).select("i.*")
    return inventory_pages(inventory).select("site", "url", "title")


@q("o010_emit_json", f"with {CLASSED} select to_json({{'page_id': page_id, 'page_type': page_type, 'locale': locale}})::varchar as payload from classed")
def o010(spark, d):
    """A payload row as JSON, as ``.write.text`` or ``.write.json`` emit it (O-010, O-011)."""
    return pages(spark, d).select(F.to_json(F.struct("page_id", "page_type", "locale")).alias("payload"))


@q("o012_state_upsert", "select user_id, max_by(event_type, struct_pack(t := ts, i := event_id)) as state, count(*) as changes from events group by user_id")
def o012(spark, d):
    """What upserts of all events by user leave: the latest state of each key."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("changes"))


_FETCHES = """fetches as (
    select 'https://site' || (user_id % 50) || '.example/' as url, (event_id % 5)::int as agent,
           (case when event_type = 'error' then case when value < 50 then 403 when value < 100 then 404 else 500 end when event_type = 'signup' then 301 else 200 end)::int as status, ts, event_id
    from events
)"""


@q("o006_status_probe", f"with {_FETCHES}, h as (select url, max_by(status, event_id) as status from fetches where agent = 0 group by url), g as (select url, max_by(status, event_id) as status from fetches where agent <> 0 group by url) select url, coalesce(case when h.status not in (403, 405, 501) then h.status end, g.status) as status from g left join h using (url)")
def o006(spark, d):
    """HEAD results are agent 0's, GET results the others'; GET answers where HEAD is refused."""
    f = fetches(spark, d)
    latest = lambda rows, name: rows.groupBy("url").agg(F.max_by("status", "event_id").alias(name))
    out = latest(f.where("agent != 0"), "get").join(latest(f.where("agent = 0"), "head"), "url", "left")
    return out.select("url", F.coalesce(F.when(~F.col("head").isin(403, 405, 501), F.col("head")), "get").alias("status"))


@q("o020_normalize_target", "select page_id, regexp_extract(url, '^https?://([^/]*)', 1) as domain, regexp_extract(url, '^(https?://[^/]*)', 1) as base, 'https://' || regexp_extract(regexp_extract(url, '^https?://(.*)$', 1), '^([^/]*)', 1) as bare_base from pages")
def o020(spark, d):
    base = U.base_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.regexp_extract(base, "://(.*)$", 1).alias("domain"), base.alias("base"), U.base_url(F.regexp_extract(F.col("url"), "^https?://(.*)$", 1)).alias("bare_base"))


@q("o021_locale_template", f"with {URLS} select page_id, locale, logical_path from logical")
def o021(spark, d):
    return table(spark, d, "pages").select("page_id", U.locale(F.col("url")).alias("locale"), U.logical_path(F.col("url")).alias("logical_path"))


@q("o022_classify_page", f"with {CLASSED} select page_id, page_type, confidence, template, locale from classed")
def o022(spark, d):
    return table(spark, d, "pages").select("page_id", U.page_class(F.col("url"), T.title(F.col("html"))).alias("c")).select("page_id", "c.*")


@q("o023_html_response", "select page_id, case when page_id % 5 = 0 then false when page_id % 5 = 1 then true else regexp_matches(lower(substr(trim(html), 1, 200)), '<!doctype html|<html') end as is_html from pages")
def o023(spark, d):
    kind = F.when(F.col("page_id") % 5 == 0, "application/json").when(F.col("page_id") % 5 == 1, "text/html; charset=utf-8").otherwise("text/plain")
    return table(spark, d, "pages").select("page_id", U.is_html_response(F.create_map(F.lit("Content-Type"), kind), F.col("html")).alias("is_html"))


@q("o024_same_domain", f"with s as (select distinct {NETLOC} as a from pages), o as (select a, unnest(['www.' || a, array_to_string(string_split(a, '.')[-2:], '.'), 'shop.' || a, 'other.org', '']) as b from s), n as (select a, b, replace(lower(a), 'www.', '') as x, replace(lower(b), 'www.', '') as y from o) select distinct a, b, x <> '' and y <> '' and (x = y or ends_with(x, '.' || y) or ends_with(y, '.' || x)) as same from n")
def o024(spark, d):
    """Every host against five that link targets could have."""
    a = F.col("a")
    others = F.array(F.concat(F.lit("www."), a), U.registered_root(a), F.concat(F.lit("shop."), a), F.lit("other.org"), F.lit(""))
    s = table(spark, d, "pages").select(U.netloc(F.col("url")).alias("a")).distinct().select("a", F.explode(others).alias("b"))
    return s.select("a", "b", U.same_domain(a, F.col("b")).alias("same")).distinct()


@q("o025_non_html_url", f"with u as (select page_id, url || x as url from pages, unnest(['', '.pdf', '/sitemap', '.XML.gz?x=1', '/a.png#top']) t(x)), c as (select *, regexp_extract(lower(url), '^([^?#]*)', 1) as low from u) select page_id, url, regexp_matches(low, '\\.(?:{'|'.join(e.replace('.', chr(92) + '.') for e in U.NON_HTML_EXTENSIONS)})$') or regexp_matches(low, 'sitemap|feed\\.xml|rss\\.xml|robots\\.txt') as non_html from c")
def o025(spark, d):
    shapes = F.array(*map(F.lit, ["", ".pdf", "/sitemap", ".XML.gz?x=1", "/a.png#top"]))
    return table(spark, d, "pages").select("page_id", F.explode(F.transform(shapes, lambda x: F.concat(F.col("url"), x))).alias("url")).select("page_id", "url", U.is_non_html(F.col("url")).alias("non_html"))


_HOSTS = ["8.8.8.8", "10.1.2.3", "127.0.0.1", "169.254.169.254", "172.20.0.1", "192.168.1.1", "100.64.3.4", "224.0.0.1", "::1", "[::ffff:10.0.0.1]", "fe80::1", "localhost", "example.com", "", "256.1.1.1", "172.32.0.1"]
_NUMBER = "(string_split(h, '.')[1]::bigint * 16777216 + string_split(h, '.')[2]::bigint * 65536 + string_split(h, '.')[3]::bigint * 256 + string_split(h, '.')[4]::bigint)"
_V4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@q("o026_unsafe_host", rf"with hosts as (select unnest({[*_HOSTS]}) as host union all select distinct {NETLOC} from pages), c as (select host, regexp_replace(lower(host), '^\[?(?:::ffff:)?([^\]]*)\]?$', '\1') as h from hosts) select host, case when regexp_full_match(h, '{_V4}') then {' or '.join(f'{_NUMBER} between {a} and {b}' for a, b in U.unsafe_ranges())} else h = '' or (regexp_full_match(h, '::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*|ff[0-9a-f:]*') and contains(h, ':')) or regexp_matches(h, '^localhost$|\.localhost$|\.internal$|\.local$') end as unsafe from c")
def o026(spark, d):
    hosts = spark.createDataFrame([(h,) for h in _HOSTS], "host string").unionByName(table(spark, d, "pages").select(U.netloc(F.col("url")).alias("host")).distinct())
    return hosts.select("host", U.is_unsafe_host(F.col("host")).alias("unsafe"))


@q("o027_visible_words", f"select page_id, len(regexp_extract_all({VISIBLE}, '\\S+'))::int as words from pages")
def o027(spark, d):
    return table(spark, d, "pages").select("page_id", T.split_words(T.visible_text(F.col("html"))).alias("words"))


@q("o028_title", f"select page_id, {TITLE} as title from pages")
def o028(spark, d):
    return table(spark, d, "pages").select("page_id", T.title(F.col("html")).alias("title"))


@q("o029_homepage_links", rf"with l as (select page_id, regexp_extract(url, '^(https?://[^/]*)', 1) as base, unnest(regexp_extract_all(html, '(?i)href=[\x22\x27]((?:https?:/)?/[^\x22\x27]+)', 1)) as href from pages), c as (select page_id, regexp_replace(case when starts_with(href, '/') then base || href else href end, '[#?].*$', '') as link from l) select page_id, link, count(*) as times from c group by all")
def o029(spark, d):
    found = table(spark, d, "pages").select("page_id", U.base_url(F.col("url")).alias("base"), F.explode(F.regexp_extract_all("html", F.lit(r"(?i)href=[\x22\x27]((?:https?:/)?/[^\x22\x27]+)"), 1)).alias("href"))
    link = F.regexp_replace(F.when(F.col("href").startswith("/"), F.concat("base", "href")).otherwise(F.col("href")), "[#?].*$", "")
    return found.groupBy("page_id", link.alias("link")).agg(F.count("*").alias("times"))


@q("o030_brand", f"with t as (select page_id, {TITLE} || ' - Example | Shop' as title from pages) select page_id, trim(string_split(replace(title, ' - ', '|'), '|')[1]) as brand from t")
def o030(spark, d):
    return table(spark, d, "pages").select("page_id", T.brand_of_title(F.concat(T.title(F.col("html")), F.lit(" - Example | Shop"))).alias("brand"))


@q("o031_octets")
def o031(spark, d):
    from crawlight.operators.robots import octets_udf

    return table(spark, d, "pages").select("page_id", octets_udf(F.concat(U.path(F.col("url")), F.lit("%7euser/ü%2f?x=%41"))).alias("octets"))


@q("o032_redact", rf"select page_id, regexp_replace(url || case when contains(url, '?') then '&' else '?' end || 'api_key=K' || page_id || '&token=a%20b#f', '(?i)([?&](?:{T.SECRET_KEYS})=)[^&#\s]*', '\1[REDACTED]', 'g') as url from pages")
def o032(spark, d):
    with_secret = F.concat(F.col("url"), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("api_key=K"), F.col("page_id").cast("string"), F.lit("&token=a%20b#f"))
    return table(spark, d, "pages").select("page_id", T.redacted(with_secret).alias("url"))


@q("o033_canonical_hash", f"select page_id, sha256(html) as html_sha256, sha256('{{\"site\":\"' || {NETLOC} || '\",\"url\":\"' || url || '\"}}') as row_sha256 from pages")
def o033(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html"), 256).alias("html_sha256"), F.sha2(F.to_json(F.struct(U.netloc(F.col("url")).alias("site"), F.col("url").alias("url"))), 256).alias("row_sha256"))


@q("o034_url_dedup", "with u as (select page_id, regexp_replace(url, '[?#].*$', '') as clean from pages), r as (select *, row_number() over (partition by rtrim(clean, '/') order by page_id) as k from u) select page_id, clean from r where k = 1")
def o034(spark, d):
    clean = table(spark, d, "pages").select("page_id", F.regexp_replace(F.col("url"), "[?#].*$", "").alias("clean"))
    return clean.groupBy(F.rtrim("clean", F.lit("/")).alias("key")).agg(F.min_by(F.struct("page_id", "clean"), "page_id").alias("x")).select("x.*")


@q("o040_html_pages", "select page_id from pages where not regexp_matches(lower(regexp_extract(url, '^([^?#]*)', 1)), '\\.(?:xml|xml\\.gz|txt|json|pdf)$') and not regexp_matches(html, '^\\s*<\\?xml|<urlset|<sitemapindex')")
def o040(spark, d):
    low = F.lower(F.regexp_extract(F.col("url"), "^([^?#]*)", 1))
    return table(spark, d, "pages").where(~low.rlike(r"\.(?:xml|xml\.gz|txt|json|pdf)$") & ~F.col("html").rlike(r"^\s*<\?xml|<urlset|<sitemapindex")).select("page_id")


@q("o041_homepage", f"with {CLASSED}, r as (select *, row_number() over (partition by site order by (page_type = 'homepage') desc, page_id) as k from classed) select site, page_id, url, page_type from r where k = 1")
def o041(spark, d):
    """The first homepage of a site, else its first page: one aggregate, no sort."""
    best = F.min_by(F.struct("page_id", "url", "page_type"), F.struct(F.col("page_type") != "homepage", "page_id"))
    return pages(spark, d).groupBy("site").agg(best.alias("x")).select("site", "x.*")


_GEO_TYPES = ["product_detail", "article", "pricing", "about", "homepage"]


@q("o042_target_pages", f"with {CLASSED}, t as (select site, page_id, page_type in {sql_in(_GEO_TYPES)} as wanted, row_number() over (partition by site order by page_id) as k from classed), n as (select *, bool_or(wanted) over (partition by site) as any_wanted from t) select site, page_id from n where wanted or (not any_wanted and k <= 3)")
def o042(spark, d):
    """Pages of the five types; a site without any gives its first three."""
    p = pages(spark, d).select("site", "page_id", F.col("page_type").isin(_GEO_TYPES).alias("wanted"))
    rest = p.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))).where("k <= 3")
    rest = rest.join(p.where("wanted").select("site").distinct(), "site", "left_anti")
    return p.where("wanted").select("site", "page_id").unionByName(rest.select("site", "page_id"))


@q("o08a_page_type_histogram", f"with {CLASSED} select page_type, count(*) as pages, count(distinct site) as sites from classed group by page_type")
def o08a(spark, d):
    return pages(spark, d).groupBy("page_type").agg(F.count("*").alias("pages"), F.count_distinct("site").alias("sites"))


@q("o090_stratified_sample", f"with {CLASSED}, p as (select *, list_position([{', '.join(repr(t) for t in PRIORITY)}], page_type) as rank from classed), k as (select *, row_number() over (partition by site, page_type, template order by page_id) as k from p where rank is not null), o as (select *, row_number() over (partition by site order by rank, template, page_id) as place from k where k <= {PER_TEMPLATE}) select site, page_id, page_type, template, place from o where place <= {MOST_PAGES}")
def o090(spark, d):
    """At most three pages of a type and template, types by priority, 27 a site; homepages are not sampled."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("page_type"))
    p = pages(spark, d).select("site", "page_id", "page_type", F.col("logical_template").alias("template"), rank.alias("rank")).where("rank > 0")
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("site", "page_type", "template").orderBy("page_id"))).where(f"k <= {PER_TEMPLATE}")
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("rank", "template", "page_id"))).where(f"place <= {MOST_PAGES}")
    return p.select("site", "page_id", "page_type", "template", F.col("place").cast("long").alias("place"))


@q("o136_canonical_host", f"with c as (select page_id, {NETLOC} as host, case when page_id % 3 = 0 then 'https://www.' || {NETLOC} || '/' else 'https://canonical.example:8443/x' end as canonical from pages) select page_id, regexp_extract(canonical, '^[a-z]+://([^/?#]*)', 1) as canonical_host, regexp_extract(canonical, '^[a-z]+://([^/?#]*)', 1) <> host as differs from c")
def o136(spark, d):
    host = U.netloc(F.col("url"))
    canonical = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www."), host, F.lit("/"))).otherwise("https://canonical.example:8443/x")
    return table(spark, d, "pages").select("page_id", U.netloc(canonical).alias("canonical_host"), (U.netloc(canonical) != host).alias("differs"))


@q("o141_registered_root", f"with h as (select distinct {NETLOC} as host from pages) select host, array_to_string(string_split(host, '.')[-2:], '.') as root from h")
def o141(spark, d):
    return table(spark, d, "pages").select(U.netloc(F.col("url")).alias("host")).distinct().select("host", U.registered_root(F.col("host")).alias("root"))


_UNSAFE_TO = "https://10.0.0.1/in"
_SEEN = f"""seen as (select 'https://h' || user_id || '.example/' as url, event_id as seen_at, case when event_id % 11 = 0 then '{_UNSAFE_TO}' when event_id % 13 = 0 then 'ftp://h1.example/' when event_id % 5 = 0 then 'https://h' || user_id || '.example/' when event_id % 3 = 0 then 'https://end.example/' || event_id % 7 else 'https://h' || ((user_id * 7 + event_id % 4) % 997) || '.example/' end as target
    from events where event_type in ('signup', 'click') and user_id % 4 <> 0)"""
_CHAINS = rf"""with recursive {_SEEN}, edges as (select url, max_by(target, struct_pack(a := seen_at, t := target)) as target from seen group by url),
walk(url, here, hops, been, stop) as (
    select url, url, 0, [url], null::varchar from edges
    union all
    select w.url, e.target, w.hops + 1, list_append(w.been, e.target), case when not regexp_matches(e.target, '^https?://') or contains(e.target, '//10.') then 'unsafe' when list_contains(w.been, e.target) then 'loop' end
    from walk w join edges e on e.url = w.here where w.stop is null and w.hops < {MOST_HOPS} + 1
), ends as (select url, max_by(struct_pack(here := here, hops := hops, stop := stop), hops) as x from walk group by url),
judged as (select url, x.here as here, x.hops as n, case when x.hops > {MOST_HOPS} then 'too_many' else coalesce(x.stop, 'ok') end as outcome from ends)"""


@q("o005_redirect_chains", f"{_CHAINS} select url, case when outcome = 'ok' then here end as final, (case when outcome in ('unsafe', 'loop') then n - 1 else least(n, {MOST_HOPS}) end)::int as hops, outcome from judged")
def o005(spark, d):
    """Where each address ends: redirects made of events, an address being a user's; every hop is checked, five are followed."""
    e = table(spark, d, "events").where("event_type in ('signup', 'click') and user_id % 4 != 0")
    host = lambda n: F.concat(F.lit("https://h"), n.cast("string"), F.lit(".example/"))
    i, u = F.col("event_id"), F.col("user_id")
    target = (
        F.when(i % 11 == 0, _UNSAFE_TO).when(i % 13 == 0, "ftp://h1.example/").when(i % 5 == 0, host(u)).when(i % 3 == 0, F.concat(F.lit("https://end.example/"), (i % 7).cast("string")))
        .otherwise(host((u * 7 + i % 4) % 997))
    )
    return Rd.chains(Rd.latest(e.select(host(u).alias("url"), target.alias("target"), i.alias("at"))))


QUERIES, SQL = area.queries, area.sql
