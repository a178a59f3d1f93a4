"""Robots files, access decisions and sitemaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlight.functions import urls as U
from crawlight.operators import frontier as Fr
from crawlight.operators import robots as R
from crawlight.operators import sitemaps as S
from crawlight.queries.registry import Area
from crawlight.queries.sqlbits import CLASSED, NETLOC
from crawlight.sources.tables import ROBOTS, table

area = Area()
q = area.query

_TEXT = ROBOTS.replace("'", "''")
#: Every third host serves a page instead of a robots file; others have a stray line more.
_ROBOTS = f"robots as (select distinct {NETLOC} as site, case when length({NETLOC}) % 3 = 0 then '<!DOCTYPE html><html></html>' else '{_TEXT}' || 'Allow' || chr(10) || 'Foo: bar' || chr(10) end as text from pages)"
_LINES = rf"""{_ROBOTS}, raw_lines as (select site, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, trim(regexp_replace(unnest(string_split(text, chr(10))), '#.*$', '')) as clean from robots),
lines as (select site, line::int as line, lower(trim(regexp_extract(clean, '^([^:]*):', 1))) as field, trim(regexp_extract(clean, '^[^:]*:(.*)$', 1)) as value, contains(clean, ':') as has_colon from raw_lines where clean <> ''),
known as (select *, case when field = 'user-agent' and coalesce(lag(field) over (partition by site order by line), 'allow') <> 'user-agent' then 1 else 0 end as begins from lines where field in ('user-agent', 'allow', 'disallow', 'crawl-delay')),
grouped as (select *, sum(begins) over (partition by site order by line)::bigint as group_id from known)"""
_RULES = rf"""{_LINES}, rules as (
    select site, group_id, line, field = 'allow' or value = '' as is_allow, value as pattern, strlen(regexp_replace(replace(regexp_replace(value, '\$$', ''), '*', ''), '%[0-9A-Fa-f]{{2}}', 'x', 'g'))::int as specificity,
           '^' || replace(regexp_replace(regexp_replace(value, '\$$', ''), '([\\.+?^$|(){{}}\[\]])', '\\\1', 'g'), '*', '.*') || case when ends_with(value, '$') then '$' else '' end as regex
    from grouped where field in ('allow', 'disallow') and group_id > 0 and not (field = 'allow' and value = '')
), agents as (select distinct site, group_id, lower(value) as agent from grouped where field = 'user-agent' and group_id > 0)"""
_BOTS = ", ".join(f"('{a}', '{r}')" for a, r in R.AGENTS)
_DECISIONS = rf"""{_RULES}, bots(bot, role) as (values {_BOTS}), asked as (select distinct site, bot, role from robots, bots),
applied as (select k.site, k.bot, g.group_id from asked k join agents g on g.site = k.site and g.agent = lower(k.bot)
    union all select k.site, k.bot, g.group_id from asked k join agents g on g.site = k.site and g.agent = '*' where not exists (select 1 from agents o where o.site = k.site and o.agent = lower(k.bot))),
delay as (select site, bot, max(value::double) as crawl_delay from applied join grouped using (site, group_id) where field = 'crawl-delay' group by all),
targets as (select distinct {NETLOC} as site, case when contains(url, '?') then regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) else regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) end as path from pages union select distinct {NETLOC}, '/' from pages),
met as (select t.site, t.path, a.bot, r.*exclude (site) from targets t join applied a on a.site = t.site join rules r on r.site = a.site and r.group_id = a.group_id where pattern = '' or regexp_matches(path, regex)),
best as (select site, path, bot, max_by(struct_pack(is_allow := is_allow, pattern := pattern), struct_pack(s := specificity, a := is_allow::int, l := -line)) as best from met group by all),
decisions as (select t.site, t.path, k.bot, k.role, coalesce(best.is_allow, true) as allowed, best.pattern as pattern, coalesce(crawl_delay, 0.0) as crawl_delay, best is null as is_default
    from targets t join asked k on k.site = t.site left join best b on b.site = t.site and b.path = t.path and b.bot = k.bot left join delay x on x.site = t.site and x.bot = k.bot)"""


def robots(spark, d):
    host = U.netloc(F.col("url"))
    text = F.when(F.length("site") % 3 == 0, "<!DOCTYPE html><html></html>").otherwise(ROBOTS + "Allow\nFoo: bar\n")
    return table(spark, d, "pages").select(host.alias("site")).distinct().withColumn("text", text)


def bots(spark):
    return spark.createDataFrame(R.AGENTS, "bot string, role string")


def decisions(spark, d):
    host, url = U.netloc(F.col("url")), F.col("url")
    p = table(spark, d, "pages").select(host.alias("site"), F.regexp_extract(url, "^[a-z]+://[^/?#]*([^#]*)", 1).alias("path"))
    targets = p.unionByName(p.select("site", F.lit("/").alias("path"))).distinct()
    return R.decisions(robots(spark, d), targets, bots(spark)).join(F.broadcast(bots(spark)), "bot")


@q("o009_robots_lines", f"with {_LINES} select site, line, field, value from lines")
def o009(spark, d):
    return R.lines(robots(spark, d)).select("site", "line", "field", "value")


@q("o070_robots_groups", f"with {_LINES} select site, group_id, count(*) filter (field = 'user-agent') as agents, count(*) filter (field in ('allow', 'disallow')) as rules from grouped group by all")
def o070(spark, d):
    return R.groups(robots(spark, d)).groupBy("site", "group_id").agg(F.count_if(F.col("field") == "user-agent").alias("agents"), F.count_if(F.col("field").isin("allow", "disallow")).alias("rules"))


@q("o066_applied_rules", f"with {_DECISIONS} select site, bot, count(*) as rules, max(specificity) as longest from applied join rules using (site, group_id) group by all")
def o066(spark, d):
    r = robots(spark, d)
    owned = R.agents(r).select("site", "agent", "group_id").distinct()
    asked = r.select("site").join(F.broadcast(bots(spark).select("bot")))
    exact = asked.withColumn("agent", F.lower("bot")).join(owned, ["site", "agent"])
    rest = asked.join(exact.select("site", "bot").distinct(), ["site", "bot"], "left_anti").join(owned.where("agent = '*'"), "site")
    every = exact.select("site", "bot", "group_id").unionByName(rest.select("site", "bot", "group_id"))
    return every.join(R.rules(r), ["site", "group_id"]).groupBy("site", "bot").agg(F.count("*").alias("rules"), F.max("specificity").alias("longest"))


@q("o071_robots_decisions", f"with {_DECISIONS} select site, path, bot, allowed, pattern, crawl_delay, is_default from decisions")
def o071(spark, d):
    return decisions(spark, d).drop("role")


@q("o043_crawl_gate", f"with {_DECISIONS} select site, bot, path from decisions where allowed")
def o043(spark, d):
    return decisions(spark, d).where("allowed").select("site", "bot", "path")


@q("o072_role_rollup", f"with {_DECISIONS} select site, role, count(*) filter (not allowed) as blocked, coalesce(string_agg(bot, ',' order by bot) filter (not allowed), '') as bots, max(crawl_delay) > 5 as slow from decisions where path = '/' group by all")
def o072(spark, d):
    """Agents blocked at the root by role; roles have ten agents together."""
    return decisions(spark, d).where("path = '/'").groupBy("site", "role").agg(
        F.count_if(~F.col("allowed")).alias("blocked"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("allowed"), F.col("bot")))), ",").alias("bots"), (F.max("crawl_delay") > 5).alias("slow")
    )


@q("r15_retrieval_blocked", f"with {_DECISIONS} select site, 'AI_RETRIEVAL_BLOCKED' as id, 'critical' as severity, count(*) as bots from decisions where path = '/' and role = 'retrieval' and not allowed group by site")
def r15(spark, d):
    blocked = decisions(spark, d).where("path = '/' and role = 'retrieval' and not allowed")
    return blocked.groupBy("site", F.lit("AI_RETRIEVAL_BLOCKED").alias("id"), F.lit("critical").alias("severity")).agg(F.count("*").alias("bots"))


@q("r16_observations", f"with {_DECISIONS} select site, bot, case when not allowed and role = 'training' then 'training_opt_out' when not allowed then 'user_fetch_blocked' else 'slow_crawl' end as kind from decisions where path = '/' and ((not allowed and role <> 'retrieval') or (role = 'retrieval' and crawl_delay > 5))")
def r16(spark, d):
    seen = decisions(spark, d).where("path = '/' and ((not allowed and role != 'retrieval') or (role = 'retrieval' and crawl_delay > 5))")
    kind = F.when(~F.col("allowed") & (F.col("role") == "training"), "training_opt_out").when(~F.col("allowed"), "user_fetch_blocked").otherwise("slow_crawl")
    return seen.select("site", "bot", kind.alias("kind"))


@q("r14_robots_html", f"with {_ROBOTS} select site, 'ROBOTS_TXT_HTML_ERROR' as id, 'critical' as severity from robots where regexp_matches(text, '(?i)<(?:!doctype\\s+html|html|body|head)\\b')")
def r14(spark, d):
    return R.errors(robots(spark, d)).where("error = 'html_response'").select("site", F.lit("ROBOTS_TXT_HTML_ERROR").alias("id"), F.lit("critical").alias("severity"))


_HTML = r"select site, 1 as line, 'html_response' as error from robots where regexp_matches(text, '(?i)<(?:!doctype\s+html|html|body|head)\b')"


@q("o138_o139_robots_errors", rf"""with {_LINES}, e as (select l.site, l.line, case when not l.has_colon then 'missing_colon' when not regexp_full_match(l.field, '{R.DIRECTIVES}') then 'unknown_directive' when l.field in ('allow', 'disallow', 'crawl-delay') and g.group_id = 0 then 'rule_before_agent' when l.field = 'crawl-delay' and try_cast(l.value as double) is null then 'invalid_crawl_delay' when l.field = 'sitemap' and not regexp_matches(l.value, '^https?://') then 'relative_sitemap' end as error from lines l left join grouped g on g.site = l.site and g.line = l.line) select site, line, error from e where error is not null union all {_HTML}""")
def o139(spark, d):
    return R.errors(robots(spark, d))


@q("o151_declared_sitemaps", f"with {_LINES}, s as (select site, value as url, min(line) as line from lines where field = 'sitemap' and value <> '' group by all) select site, url, line, row_number() over (partition by site order by line)::int as place from s")
def o151(spark, d):
    return R.sitemaps(robots(spark, d)).select("site", "url", "line", "place")


def sitemap_bodies(spark, d):
    """Sitemaps of a host's pages, 50000 page numbers each; some have a DTD, a bad date or no root."""
    p = table(spark, d, "pages").select(U.netloc(F.col("url")).alias("site"), "page_id", F.regexp_replace("url", "[?#].*$", "").alias("loc"))
    bad = F.col("page_id") % 11 == 0
    entry = F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc>"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<lastmod>"), F.when(bad, "yesterday").otherwise("2024-01-02"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    s = p.groupBy("site", F.floor(F.col("page_id") / 50_000).alias("n")).agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("es"))
    head = F.when(F.length("site") % 5 == 0, '<?xml version="1.0"?><!DOCTYPE x><urlset>').when(F.length("site") % 5 == 1, "<list>").otherwise('<?xml version="1.0"?><urlset>')
    tail = F.when(F.length("site") % 5 == 1, "</list>").otherwise("</urlset>")
    return s.select(F.concat(F.lit("https://"), "site", F.lit("/sitemap-"), F.col("n").cast("string"), F.lit(".xml")).alias("url"), F.concat(head, F.array_join(F.col("es.e"), ""), tail).alias("body"))


_BODIES = rf"""entries0 as (select {NETLOC} as site, page_id, '<url><loc>' || regexp_replace(url, '[?#].*$', '') || '</loc>' || case when page_id % 3 <> 0 then '<lastmod>' || case when page_id % 11 = 0 then 'yesterday' else '2024-01-02' end || '</lastmod>' else '' end || '</url>' as e from pages),
bodies as (select 'https://' || site || '/sitemap-' || (page_id // 50000) || '.xml' as url, case when length(site) % 5 = 0 then '<?xml version="1.0"?><!DOCTYPE x><urlset>' when length(site) % 5 = 1 then '<list>' else '<?xml version="1.0"?><urlset>' end || string_agg(e, '' order by page_id) || case when length(site) % 5 = 1 then '</list>' else '</urlset>' end as body from entries0 group by site, page_id // 50000),
parsed as (select url, body, case when regexp_matches(body, '(?i)<sitemapindex\b') then 'sitemapindex' when regexp_matches(body, '(?i)<urlset\b') then 'urlset' else 'unknown' end as kind, regexp_extract_all(body, '(?is)<loc>\s*(.*?)\s*</loc>', 1) as locs, regexp_extract_all(body, '(?is)<lastmod>\s*(.*?)\s*</lastmod>', 1) as mods from bodies),
validated as (select url, kind, len(locs)::int as entry_count, len(mods) > 0 as has_lastmod,
    concat_ws(',', case when strlen(body) > {S.MOST_BYTES} then 'too_large' end, case when regexp_matches(body, '(?i)<!DOCTYPE|<!ENTITY') then 'dtd' end, case when kind = 'unknown' then 'no_root' end, case when len(locs) = 0 then 'empty' end, case when len(locs) > {S.MOST_ENTRIES} then 'too_many' end, case when len(list_filter(locs, lambda x: not regexp_matches(x, '(?i)^https?://[^/]'))) > 0 then 'relative_loc' end) as errors,
    concat_ws(',', case when len(mods) = 0 then 'missing_lastmod' end, case when len(list_filter(mods, lambda x: not regexp_matches(x, '{S.LASTMOD}'))) > 0 then 'bad_lastmod' end) as warnings from parsed)"""


@q("o140_sitemap_validation", f"with {_BODIES} select url, kind, entry_count, has_lastmod, errors = '' as valid, errors, warnings from validated")
def o140(spark, d):
    return S.validated(sitemap_bodies(spark, d))


@q("o008_sitemap_entries", f"with {_BODIES}, l as (select url, unnest(locs) as loc from parsed where kind <> 'none'), k as (select url, loc, regexp_matches(loc, '\\.xml(?:\\.gz)?$') or contains(lower(loc), 'sitemap') as is_sitemap from l) select * from k where loc <> ''")
def o008(spark, d):
    return S.children(sitemap_bodies(spark, d))


@q("o140_gzip_sitemaps")
def o140_gzip(spark, d):
    """The same bodies as bytes: plain ones pass through the reader that unpacks gzip."""
    b = sitemap_bodies(spark, d)
    return S.validated(b.select("url", S.gunzipped(F.col("body").cast("binary")).alias("body")))


@q("r17_sitemap_errors", f"with {_BODIES} select url, case when errors <> '' then 'SITEMAP_PROTOCOL_ERROR' else 'SITEMAP_VALID' end as id, case when errors <> '' then 'high' end as severity, errors from validated")
def r17(spark, d):
    v = S.validated(sitemap_bodies(spark, d))
    return v.select("url", F.when(F.col("valid"), "SITEMAP_VALID").otherwise("SITEMAP_PROTOCOL_ERROR").alias("id"), F.when(~F.col("valid"), "high").alias("severity"), "errors")


@q("r18_missing_llms_txt", f"with s as (select distinct {NETLOC} as site from pages), l as (select distinct {NETLOC} as site from pages where regexp_matches(url, '/(?:llms\\.txt|1[0-9])') ) select site, 'LLMS_TXT_MISSING' as id from s anti join l using (site)")
def r18(spark, d):
    """Sites without a manifest; pages 10 to 19 stand for one."""
    p = table(spark, d, "pages").select(U.netloc(F.col("url")).alias("site"), "url")
    return p.select("site").distinct().join(p.where(F.col("url").rlike(r"/(?:llms\.txt|1[0-9])")).select("site").distinct(), "site", "left_anti").select("site", F.lit("LLMS_TXT_MISSING").alias("id"))


#: Sitemaps of each host's pages: twelve lists behind two indexes that name each other, a foreign one and one that is gone.
_LISTS = 12


def crawl_homes(spark, d):
    """A host and its first page as homepage; every host whose name's length leaves 1 declares six sitemaps, others none."""
    p = table(spark, d, "pages").select(U.netloc(F.col("url")).alias("site"), "page_id", "html")
    homes = p.groupBy("site").agg(F.min_by("html", "page_id").alias("html")).withColumn("base_url", F.concat(F.lit("https://"), "site"))
    declared = F.concat(*(F.concat(F.lit("Sitemap: "), "base_url", F.lit(f"/sitemap-{k}.xml\n")) for k in (3, 0)), F.lit("sitemap: https://elsewhere.example/sitemap.xml\n"), *(F.concat(F.lit("SITEMAP:"), "base_url", F.lit(f"/{name}\n")) for name in ("gone.xml", "index-2.xml", "sitemap-7.xml")))
    return homes.withColumns({"status": F.lit(200), "text": F.when(F.length("site") % 3 == 1, declared).otherwise("User-agent: *\n")})


def crawl_bodies(spark, d):
    """url, status and body of every host's sitemaps, made of its pages."""
    p = table(spark, d, "pages").select(U.netloc(F.col("url")).alias("site"), "page_id", "url")
    k, i = F.col("page_id") % 6, F.col("page_id").cast("string")
    made = F.when(k == 1, F.concat(F.lit("/products/"), i)).when(k == 2, F.concat(F.lit("/en/blog/"), i)).when(k == 3, F.concat(F.lit("/pricing/"), i)).when(k == 4, F.concat(F.lit("/docs/"), i))
    base = F.concat(F.lit("https://"), "site")
    loc = F.coalesce(F.concat(base, made), F.col("url"))
    entry = lambda x: F.concat(F.lit("<url><loc> "), x, F.lit(" </loc></url>"))
    more = F.concat(F.when(F.col("page_id") % 5 == 0, entry(F.concat(base, F.lit("/file-"), i, F.lit(".pdf")))).otherwise(""), F.when(F.col("page_id") % 7 == 0, entry(F.lit("https://elsewhere.example/x"))).otherwise(""), F.when(F.col("page_id") % 4 == 0, entry(loc)).otherwise(""))
    lists = p.withColumn("n", F.col("page_id") % _LISTS).groupBy("site", "n").agg(F.array_sort(F.collect_list(F.struct("page_id", F.concat(entry(loc), more).alias("e")))).alias("es"))
    name = F.concat(F.lit("https://"), "site", F.lit("/sitemap-"), F.col("n").cast("string"), F.lit(".xml"))
    out = lists.select(name.alias("url"), F.when(F.col("n") == 5, 500).otherwise(200).alias("status"), F.concat(F.lit("<urlset>"), F.array_join("es.e", ""), F.lit("</urlset>")).alias("body"))
    child = lambda names: F.concat(*(F.concat(F.lit("<sitemap><loc>"), base if x.startswith("/") else F.lit(""), F.lit(x), F.lit("</loc></sitemap>")) for x in names))
    hosts = p.select("site").distinct()
    for at, names in _INDEXES:
        out = out.unionByName(hosts.select(F.concat(base, F.lit(at)).alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<sitemapindex>"), child(names), F.lit("</sitemapindex>")).alias("body")))
    return out


_INDEXES = [
    ("/sitemap.xml", ["/sitemap-0.xml", "https://elsewhere.example/sitemap.xml", "/index-2.xml", "/sitemap-1.xml", "/sitemap-0.xml"]),
    ("/index-2.xml", ["/sitemap.xml", "/sitemap-5.xml", "/index-3.xml", "/sitemap-2.xml"]),
    ("/index-3.xml", [f"/sitemap-{k}.xml" for k in range(2, _LISTS)]),
]
_HOMES = rf"""homes as (select {NETLOC} as site, min_by(html, page_id) as html, 'https://' || {NETLOC} as base_url from pages group by {NETLOC}),
starts as (select site, case when length(site) % 3 = 1 then [base_url || '/sitemap-3.xml', base_url || '/sitemap-0.xml', 'https://elsewhere.example/sitemap.xml', base_url || '/gone.xml', base_url || '/index-2.xml'] else [base_url || '/sitemap.xml'] end as queue from homes)"""
_LOC = "case page_id % 6 when 1 then 'https://' || site || '/products/' || page_id when 2 then 'https://' || site || '/en/blog/' || page_id when 3 then 'https://' || site || '/pricing/' || page_id when 4 then 'https://' || site || '/docs/' || page_id else url end"
_SAME = lambda a, b: f"(replace(lower({a}), 'www.', '') = replace(lower({b}), 'www.', '') or ends_with(replace(lower({a}), 'www.', ''), '.' || replace(lower({b}), 'www.', '')) or ends_with(replace(lower({b}), 'www.', ''), '.' || replace(lower({a}), 'www.', '')))"
_HOST_OF = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_NON_HTML = rf"(regexp_matches(regexp_extract(lower(u), '^([^?#]*)', 1), '\.(?:{'|'.join(e.replace('.', chr(92) + '.') for e in U.NON_HTML_EXTENSIONS)})$') or regexp_matches(lower(u), 'sitemap|feed\.xml|rss\.xml|robots\.txt'))"
_CRAWL = rf"""{_HOMES}, placed as (select {NETLOC} as site, page_id, url, page_id % {_LISTS} as n from pages),
bodies as (
    select 'https://' || site || '/sitemap-' || n || '.xml' as url, case when n = 5 then 500 else 200 end as status,
        '<urlset>' || string_agg('<url><loc> ' || {_LOC} || ' </loc></url>' || case when page_id % 5 = 0 then '<url><loc> https://' || site || '/file-' || page_id || '.pdf </loc></url>' else '' end || case when page_id % 7 = 0 then '<url><loc> https://elsewhere.example/x </loc></url>' else '' end || case when page_id % 4 = 0 then '<url><loc> ' || {_LOC} || ' </loc></url>' else '' end, '' order by page_id) || '</urlset>' as body
    from placed group by site, n
    union all select base_url || suffix, 200, '<sitemapindex>' || array_to_string(list_transform(names, lambda x: '<sitemap><loc>' || case when starts_with(x, '/') then base_url else '' end || x || '</loc></sitemap>'), '') || '</sitemapindex>' from homes, (values {", ".join(f"('{at}', {names})" for at, names in _INDEXES)}) as i(suffix, names)
), resources as materialized (
    select url, list_filter(locs, lambda u: regexp_matches(u, '\.xml(?:\.gz)?$') or contains(lower(u), 'sitemap')) as sitemaps, list_filter(locs, lambda u: not (regexp_matches(u, '\.xml(?:\.gz)?$') or contains(lower(u), 'sitemap')) and not {_NON_HTML}) as page_urls
    from (select url, list_filter(regexp_extract_all(body, '(?is)<loc>\s*(.*?)\s*</loc>', 1), lambda u: u <> '') as locs from bodies where status = 200 and body <> '')
), walk(site, round, read, queue) as (
    select site, 0, []::varchar[], queue from starts
    union all
    select site, round + 1, any_value(read), flatten(list(coalesce(sitemaps, []) order by i))
    from (
        select site, round, list_concat(read, batch) as read, unnest(batch) as url, unnest(range(len(batch))) as i
        from (select *, list_filter(allowed, lambda x, k: list_position(allowed, x) = k)[1:8 - len(read)] as batch from (select *, list_filter(queue, lambda u: {_SAME(_HOST_OF.format('u'), 'site')} and not list_contains(read, u)) as allowed from walk where round < 8))
    ) asked left join resources using (url) group by site, round
), walked as materialized (
    select site, max_by(read, round) as read from walk group by site
), listed as (
    select site, k, j, u as url from (select site, k, unnest(page_urls) as u, unnest(range(len(page_urls))) as j from (select site, unnest(read) as url, unnest(range(len(read))) as k from walked) join resources using (url)) where {_SAME(_HOST_OF.format('u'), 'site')}
), hrefs as (
    select site, base_url, unnest(h) as href, unnest(range(len(h))) as j from (select *, regexp_extract_all(html, '(?i)href=[\x22\x27](https?://[^\x22\x27]+|/[^\x22\x27]+)', 1) as h from homes where site not in (select site from listed group by site having count(*) >= 10))
), linked as (
    select site, 8 as k, j, u as url from (select *, case when starts_with(href, '//') then 'https:' || regexp_replace(href, '[#?].*$', '') when starts_with(href, '/') then base_url || regexp_replace(href, '[#?].*$', '') else regexp_replace(href, '[#?].*$', '') end as u from hrefs) where {_SAME(_HOST_OF.format('u'), 'site')} and not {_NON_HTML}
), candidates as materialized (
    select * from listed union all select * from linked
)"""


def crawl(spark, d):
    """Homes, parsed sitemaps, walks and addresses of all hosts."""
    homes, resources = crawl_homes(spark, d), Fr.links(crawl_bodies(spark, d))
    walked = Fr.walk(Fr.starts(homes), resources)
    return homes, resources, walked, Fr.candidates(walked, resources, homes)


@q("o007_sitemap_bfs", f"with recursive {_CRAWL} select site, unnest(range(len(read)))::int as place, unnest(read) as url from walked")
def o007(spark, d):
    """The sitemaps that each site's bounded walk reads, in order."""
    return crawl(spark, d)[2].select("site", F.posexplode("read").alias("place", "url"))


_SELECTED = f"""{_CRAWL}, pages_ as (select row_number() over () as page_id, site, url, k, j, '' as html from (select site, url, p.k as k, p.j as j from (select site, url, min(struct_pack(k := k, j := j)) as p from candidates group by site, url))), {CLASSED.replace("from pages", "from (select page_id, url, html from pages_)").replace("urls as (", "urls as (", 1)},
typed as (select c.page_type, c.template, c.locale, p.site, p.url, p.k, p.j, list_position({Fr.PRIORITY}, c.page_type) as rank from classed c join pages_ p using (page_id) join homes h on h.site = p.site where rtrim(p.url, '/') <> h.base_url),
few as (select *, first_value(k) over w as fk, first_value(j) over w as fj from typed where rank is not null window w as (partition by site, page_type, template order by k, j) qualify row_number() over w <= 3),
selected as (select site, row_number() over (partition by site order by rank, fk, fj, k, j)::int as place, url, page_type, template, locale from few qualify place <= 27
    union all select site, 0, base_url || '/', 'homepage', '/', 'default' from homes)"""


@q("o007_inventory", f"with recursive {_SELECTED} select * from selected")
def o007_inventory(spark, d):
    """The pages that each site's acquisition selects: homepage first, then by type and template."""
    homes, _, _, urls = crawl(spark, d)
    return Fr.sample(urls, homes)


@q("o007_acquisition", f"with recursive {_SELECTED}, n as (select site, count(*) as urls_extracted, count(distinct url) as same_origin_urls from candidates group by site), s as (select site, count(*) as pages_selected, count(distinct page_type) as page_types from selected group by site), g as (select site, count(*) as sitemaps_processed from (select site, unnest(read) as url from walked) join resources using (url) group by site) select site, len(read) as sitemaps_found, coalesce(sitemaps_processed, 0) as sitemaps_processed, coalesce(urls_extracted, 0) as urls_extracted, coalesce(same_origin_urls, 0) as same_origin_urls, pages_selected, page_types from walked left join g using (site) left join n using (site) join s using (site)")
def o007_acquisition(spark, d):
    """What each site's acquisition found, read and selected."""
    homes, resources, walked, urls = crawl(spark, d)
    return Fr.statistics(walked, resources, urls, Fr.sample(urls, homes))


QUERIES, SQL = area.queries, area.sql
