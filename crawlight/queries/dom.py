"""Views over the HTML token stream: structure, sections, paragraphs, links, challenge signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.functions import urls as U
from crawlight.operators import tokens as K
from crawlight.queries.registry import Area, once
from crawlight.queries.sqlbits import NETLOC, TITLE, TOKENS, VISIBLE
from crawlight.sources.tables import pages, table

area = Area()
q = area.query
_START = "kind = 'start'"
#: Traces of a challenge page; two of them, or the title, give it away.
CHALLENGE = ["verify you are human", "checking your browser", "cf-challenge", "captcha", "enable javascript and cookies", "ddos protection", "attention required", "access denied", "unusual traffic"]
CHALLENGE_TITLE = "just a moment|attention required|access denied|are you a robot|security check"
THIRD_PARTY = r"googletagmanager\.com|google-analytics\.com|analytics\.js|gtag/js|gtm\.js|clarity\.ms|hotjar\.com|intercom\.io|facebook\.net|fbevents\.js|segment\.com|stripe\.com|recaptcha|polyfill\.io|fontawesome|typekit|fonts\.googleapis\.com|cloudflareinsights\.com|cookiebot\.com|onetrust\.com|trustarc\.com|hubspot\.com|hs-scripts\.com|datadoghq"


@q("o050_tokens", f"with {TOKENS} select page_id, kind, tag, count(*) as tokens from tokens group by all")
def o050_tokens(spark, d):
    return K.tokens(table(spark, d, "pages")).groupBy("page_id", "kind", "tag").agg(F.count("*").alias("tokens"))


@q("o050h_dom_summary", f"""with {TOKENS}, c as (
    select page_id, count(*) filter ({_START}) as start_tags, count(*) filter (kind = 'end') as end_tags, count(*) filter ({_START} and tag = 'a') as anchors, count(*) filter ({_START} and tag = 'h1') as h1_tags,
           count(*) filter ({_START} and tag in ('main', 'nav')) as landmarks, count(*) filter ({_START} and tag in ('ul', 'ol', 'dl')) as lists, count(*) filter ({_START} and tag = 'table') as tables, count(*) filter (kind = 'raw') as raw_elements
    from tokens group by page_id
), t as (
    select page_id, count(*) filter (regexp_matches(current_tag, '^h[1-6]$')) as heading_nodes, count(*) filter (current_tag in ('p', 'article', 'li', 'span')) as paragraph_nodes, sum(len(regexp_extract_all(text, '\\S+')))::bigint as words from text_nodes group by page_id
) select c.*, coalesce(heading_nodes, 0) as heading_nodes, coalesce(paragraph_nodes, 0) as paragraph_nodes, coalesce(words, 0) as words from c left join t using (page_id)""")
def o050h(spark, d):
    return K.dom_summary(table(spark, d, "pages"))


@q("o051h_entity_text", f"with {TOKENS} select page_id, sum(len(regexp_extract_all(text, '\\S+')))::bigint as words from text_nodes where coalesce(current_tag, '') not in ('title', 'h1', 'h2', 'h3') group by page_id")
def o051h(spark, d):
    """Text outside title and upper headings."""
    t = K.text_nodes(K.tokens(table(spark, d, "pages"))).where("coalesce(current_tag, '') not in ('title', 'h1', 'h2', 'h3')")
    return t.groupBy("page_id").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).cast("long").alias("words"))


@q("o052h_sections", f"with {TOKENS}, s as (select *, coalesce(last_value(case when regexp_matches(current_tag, '^h[1-4]$') then text end ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and current row), 'General') as section from text_nodes) select page_id, section, count(*) as texts, sum(length(text))::bigint as chars from s where not coalesce(regexp_matches(current_tag, '^h[1-4]$'), false) group by all")
def o052h(spark, d):
    return K.sections(table(spark, d, "pages")).groupBy("page_id", "section").agg(F.count("*").alias("texts"), F.sum(F.length("text")).cast("long").alias("chars"))


@q("o053h_paragraphs", f"""with {TOKENS}, n as (select *, sum(case when {_START} and tag = 'p' then 1 else 0 end) over (partition by page_id order by pos rows between unbounded preceding and current row) as n from governed),
    closed as (select distinct page_id, n from n where kind = 'end' and tag = 'p')
    select page_id, n::bigint as paragraph, string_agg(trim(tok), ' ' order by pos) as text from n semi join closed using (page_id, n) where kind = 'text' and current_tag = 'p' and trim(tok) <> '' group by all""")
def o053h(spark, d):
    return K.paragraphs(table(spark, d, "pages"))


_LINKS = rf"""{TOKENS}, a as (
    select *, sum(case when {_START} and tag = 'a' then 1 else 0 end) over w as a,
           last_value(case when tag = 'a' and kind in ('start', 'end') then kind = 'start' end ignore nulls) over w as inside,
           sum(case when tag in ('nav', 'header') and kind = 'start' then 1 when tag in ('nav', 'header') and kind = 'end' then -1 else 0 end) over w as nav
    from tokens window w as (partition by page_id order by pos rows between unbounded preceding and current row)
), links as (
    select o.page_id, o.pos, coalesce(nullif(regexp_extract(o.tok, '(?is)\shref\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(o.tok, '(?is)\shref\s*=\s*''([^'']*)''', 1), ''), nullif(regexp_extract(o.tok, '(?is)\shref\s*=\s*([^\s"''>]+)', 1), ''), '') as href, o.nav > 0 as in_nav, coalesce(t.label, '') as label
    from (select * from a where {_START} and tag = 'a') o left join (select page_id, a, string_agg(trim(tok), ' ' order by pos) as label from a where kind = 'text' and inside group by page_id, a) t using (page_id, a)
)"""


@q("o054h_anchor_texts", f"with {_LINKS} select page_id, count(*) as anchors, count(*) filter (label <> '') as labelled, count(distinct href) as hrefs from links group by page_id")
def o054h(spark, d):
    return K.links(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("anchors"), F.count_if(F.col("label") != "").alias("labelled"), F.count_distinct("href").alias("hrefs"))


@q("o055h_nav_links", f"with {_LINKS} select links.page_id, pos::int as pos, href, label from links join pages using (page_id) where in_nav and (starts_with(href, '/') or regexp_extract(href, '^https?://([^/?#]*)', 1) = {NETLOC})")
def o055h(spark, d):
    """Links inside nav or header to the page's own host."""
    l = K.links(table(spark, d, "pages")).where("in_nav").join(table(spark, d, "pages").select("page_id", U.netloc(F.col("url")).alias("host")), "page_id")
    return l.where(F.col("href").startswith("/") | (U.netloc(F.col("href")) == F.col("host"))).select("page_id", "pos", "href", "label")


_LD = r"(?is)<script[^>]*type=[\x22\x27]application/ld\+json[\x22\x27][^>]*>(.*?)</script>"
_LD_SCRIPT = '<script type="application/ld+json">{"@type":"Thing"}</script>'


@q("o056h_jsonld_bodies", f"select page_id, len(regexp_extract_all(html || '{_LD_SCRIPT}', '{_LD}', 1))::int as bodies from pages")
def o056h(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(F.concat("html", F.lit(_LD_SCRIPT)), F.lit(_LD), 1)).alias("bodies"))


def challenge_score(html):
    low = F.lower(html)
    return sum((low.contains(c).cast("int") for c in CHALLENGE), F.lit(0))


_CHALLENGED = "(select page_id, url, html || case when page_id % 7 = 0 then '<p>Verify you are human: captcha</p>' else '' end as html from pages)"
_SCORE = " + ".join(f"contains(lower(html), '{c}')::int" for c in CHALLENGE)


@q("o057_challenge_indicators", f"select page_id, {_SCORE} as indicators, ({_SCORE}) >= 2 or regexp_matches(lower({TITLE}), '{CHALLENGE_TITLE}') as challenged from {_CHALLENGED}")
def o057(spark, d):
    html = F.concat("html", F.when(F.col("page_id") % 7 == 0, "<p>Verify you are human: captcha</p>").otherwise(""))
    n = challenge_score(html)
    return table(spark, d, "pages").select("page_id", n.alias("indicators"), ((n >= 2) | F.lower(T.title(html)).rlike(CHALLENGE_TITLE)).alias("challenged"))


@q("o058_empty_links", rf"""with l as (select page_id, unnest(regexp_extract_all(replace(html, 'href="/t', 'href="#" data-x="'), '(?is)<a\b[^>]*href=["'']#?["''][^>]*>([^<]*)</a>', 1)) as label from pages), k as (select page_id, trim(label) as label, count(*) as times from l where length(trim(label)) >= 3 and not regexp_full_match(trim(label), '[0-9]+') group by all), r as (select *, row_number() over (partition by page_id order by label) as place from k) select page_id, label, times, place from r where place <= 10""")
def o058(spark, d):
    """Labelled anchors that lead nowhere, ten a page; the data's links are emptied where they begin with t."""
    html = F.replace(F.col("html"), F.lit('href="/t'), F.lit('href="#" data-x="'))
    label = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*href=[\x22\x27]#?[\x22\x27][^>]*>([^<]*)</a>"), 1))
    k = table(spark, d, "pages").select("page_id", label.alias("label")).withColumn("label", F.trim("label")).where((F.length("label") >= 3) & ~F.col("label").rlike("^[0-9]+$")).groupBy("page_id", "label").agg(F.count("*").alias("times"))
    return k.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("label")).cast("long")).where("place <= 10")


@q("o047_first_party_scripts", rf"with s as (select page_id, unnest(['https://www.googletagmanager.com/gtm.js', '/static/app.' || page_id || '.js', 'https://cdn.' || {NETLOC} || '/main.js', 'https://js.stripe.com/v3']) as src from pages) select page_id, src from s where not regexp_matches(src, '(?i)(?:{THIRD_PARTY})')")
def o047(spark, d):
    src = F.array(F.lit("https://www.googletagmanager.com/gtm.js"), F.concat(F.lit("/static/app."), F.col("page_id").cast("string"), F.lit(".js")), F.concat(F.lit("https://cdn."), U.netloc(F.col("url")), F.lit("/main.js")), F.lit("https://js.stripe.com/v3"))
    return table(spark, d, "pages").select("page_id", F.explode(src).alias("src")).where(~F.col("src").rlike(f"(?i)(?:{THIRD_PARTY})"))


@q("o064_nav_status", f"with {_LINKS}, s as (select distinct {NETLOC} as site, rtrim(regexp_replace(url, '[?#].*$', ''), '/') as target from pages), n as (select distinct {NETLOC} as site, rtrim(regexp_extract(url, '^(https?://[^/]*)', 1) || href, '/') as target from links join pages using (page_id) where in_nav and starts_with(href, '/')) select n.site, n.target, s.target is not null as known from n left join s using (site, target)")
def o064(spark, d):
    """Navigation targets against the corpus, trailing slash aside."""
    p = table(spark, d, "pages")
    known = p.select(U.netloc(F.col("url")).alias("site"), F.rtrim(F.regexp_replace("url", "[?#].*$", ""), F.lit("/")).alias("target")).distinct().withColumn("known", F.lit(True))
    nav = K.links(p).where("in_nav").where(F.col("href").startswith("/")).join(p.select("page_id", "url"), "page_id")
    nav = nav.select(U.netloc(F.col("url")).alias("site"), F.rtrim(F.concat(U.base_url(F.col("url")), "href"), F.lit("/")).alias("target")).distinct()
    return nav.join(known, ["site", "target"], "left").select("site", "target", F.coalesce("known", F.lit(False)).alias("known"))


@q("o091_first_nav_links", f"with {_LINKS}, r as (select page_id, href, min(pos) as pos from links where in_nav group by all), k as (select *, row_number() over (partition by page_id order by pos) as place from r) select page_id, href, place from k where place <= 12")
def o091(spark, d):
    """The first twelve distinct navigation targets (O-091, O-103)."""
    r = K.links(table(spark, d, "pages")).where("in_nav").groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("long")).where("place <= 12").select("page_id", "href", "place")


@q("o089_scope_coverage", f"with {TOKENS}, w as (select page_id, len(regexp_extract_all({VISIBLE}, '\\S+')) as words from pages), h as (select page_id, count(*) filter ({_START} and tag = 'h1') > 0 as h1, count(*) filter ({_START} and tag = 'nav') > 0 as nav from tokens group by page_id) select count(*) as pages, round_even(avg(words), 2) as avg_words, count(*) filter (h1) as pages_with_h1, count(*) filter (nav) as pages_with_nav from w join h using (page_id)")
def o089(spark, d):
    p = table(spark, d, "pages")
    h = K.tokens(p).groupBy("page_id").agg((F.count_if((F.col("kind") == "start") & (F.col("tag") == "h1")) > 0).alias("h1"), (F.count_if((F.col("kind") == "start") & (F.col("tag") == "nav")) > 0).alias("nav"))
    w = p.select("page_id", T.split_words(T.visible_text(F.col("html"))).alias("words"))
    return w.join(h, "page_id").agg(F.count("*").alias("pages"), F.bround(F.avg("words"), 2).alias("avg_words"), F.count_if("h1").alias("pages_with_h1"), F.count_if("nav").alias("pages_with_nav"))


@q("o135_invalid_hreflang", "with h as (select page_id, unnest(['en-GB', 'eng', 'jp', 'de', 'en-UK', 'fr-' || upper(substr(url, 9, 2))]) as tag from pages) select page_id, tag from h where lower(string_split(tag, '-')[1]) in ('eng', 'jp') or upper(string_split(tag, '-')[2]) = 'UK'")
def o135(spark, d):
    tags = F.array(*map(F.lit, ["en-GB", "eng", "jp", "de", "en-UK"]), F.concat(F.lit("fr-"), F.upper(F.substring("url", 9, 2))))
    parts = F.split("tag", "-")
    return table(spark, d, "pages").select("page_id", F.explode(tags).alias("tag")).where(F.lower(parts[0]).isin("eng", "jp") | F.coalesce(F.upper(F.try_element_at(parts, F.lit(2))) == "UK", F.lit(False)))


@q("o137_robots_tokens", "with m as (select page_id, 'Index, Follow;' || case when page_id % 6 = 0 then ' NOINDEX' else ' max-snippet:5' end || ',follow' as content from pages), t as (select page_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '[,;\\s]+'), lambda x: x <> ''))) as tokens from m) select page_id, array_to_string(tokens, ' ') as tokens, list_has_any(tokens, ['noindex', 'none']) as excluded from t")
def o137(spark, d):
    content = F.concat(F.lit("Index, Follow;"), F.when(F.col("page_id") % 6 == 0, " NOINDEX").otherwise(" max-snippet:5"), F.lit(",follow"))
    t = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(content), r"[,;\s]+"), lambda x: x != "")))
    return table(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.array_join("t", " ").alias("tokens"), (F.size(F.array_intersect("t", F.array(F.lit("noindex"), F.lit("none")))) > 0).alias("excluded"))


QUERIES, SQL = area.queries, area.sql
