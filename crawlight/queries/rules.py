"""Finding rules over pages, fetches and navigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.functions import urls as U
from crawlight.operators import tokens as K
from crawlight.operators.names import mentions
from crawlight.queries.dom import _LINKS, CHALLENGE_TITLE, _SCORE, challenge_score
from crawlight.queries.registry import Area, once
from crawlight.queries.sqlbits import CLASSED, NETLOC, TITLE, TOKENS, VISIBLE
from crawlight.queries.urls_pages import _FETCHES
from crawlight.sources.tables import fetches, pages, table

area = Area()
q = area.query


def finding(df, key: str, rule: str, severity, *more):
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(key, F.lit(rule).alias("id"), severity.alias("severity"), *more)


_LATEST = f"{_FETCHES}, latest as (select url, agent, max_by(status, event_id) as status from fetches group by all)"


def latest(spark, d):
    """The last status of each address and agent: agent 0 is a browser, the others are bots."""
    return fetches(spark, d).groupBy("url", "agent").agg(F.max_by("status", "event_id").alias("status"))


@q("r01_root_blocked", f"with {_LATEST} select url, 'AI_RETRIEVAL_BLOCKED' as id, 'critical' as severity, status from latest where agent = 0 and status >= 400")
def r01(spark, d):
    return finding(latest(spark, d).where("agent = 0 and status >= 400"), "url", "AI_RETRIEVAL_BLOCKED", "critical", "status")


@q("r02_waf_differential", f"with {_LATEST} select b.url, 'AI_RETRIEVAL_BLOCKED' as id, 'critical' as severity, count(*) as agents from latest b join latest n on n.url = b.url and n.agent = 0 where b.agent <> 0 and n.status = 200 and b.status in (401, 403, 503) group by b.url")
def r02(spark, d):
    """One pass: an address's statuses side by side instead of a self join."""
    by = latest(spark, d).groupBy("url").agg(F.max(F.when(F.col("agent") == 0, F.col("status"))).alias("normal"), F.count_if((F.col("agent") != 0) & F.col("status").isin(401, 403, 503)).alias("agents"))
    return finding(by.where("normal = 200 and agents > 0"), "url", "AI_RETRIEVAL_BLOCKED", "critical", "agents")


_CHALLENGED = "(select page_id, html || case when page_id % 7 = 0 then '<p>Verify you are human: captcha</p>' else '' end as html from pages)"


@q("r03_challenge", f"select page_id, 'CHALLENGE_INTERSTITIAL' as id, 'critical' as severity from {_CHALLENGED} where ({_SCORE}) >= 2 or regexp_matches(lower({TITLE}), '{CHALLENGE_TITLE}')")
def r03(spark, d):
    html = F.concat("html", F.when(F.col("page_id") % 7 == 0, "<p>Verify you are human: captcha</p>").otherwise(""))
    p = table(spark, d, "pages").where((challenge_score(html) >= 2) | F.lower(T.title(html)).rlike(CHALLENGE_TITLE))
    return finding(p, "page_id", "CHALLENGE_INTERSTITIAL", "critical")


_DEAD = r"""(?is)<a\b[^>]*href=["'']#?["''][^>]*>([^<]*)</a>"""


@q("r04_empty_navigation", f"with l as (select page_id, len(list_filter(regexp_extract_all(replace(html, 'href=\"/t', 'href=\"#\" data-x=\"'), '{_DEAD}', 1), lambda x: length(trim(x)) >= 3)) as links from pages) select page_id, 'EMPTY_NAV_LINKS' as id, 'medium' as severity, links::int as links from l where links > 0")
def r04(spark, d):
    html = F.replace(F.col("html"), F.lit('href="/t'), F.lit('href="#" data-x="'))
    n = F.size(F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*href=[\x22\x27]#?[\x22\x27][^>]*>([^<]*)</a>"), 1), lambda x: F.length(F.trim(x)) >= 3))
    return finding(table(spark, d, "pages").withColumn("links", n).where("links > 0"), "page_id", "EMPTY_NAV_LINKS", "medium", "links")


@q("r06_noindex", "select page_id, 'NOINDEX_EXCLUSION' as id, 'critical' as severity from pages where page_id % 6 = 0 or page_id % 10 = 0")
def r06(spark, d):
    """Directives of meta tag and header together; both are made from the page's number."""
    meta = F.when(F.col("page_id") % 6 == 0, "index, NOINDEX").otherwise("index;follow")
    header = F.when(F.col("page_id") % 10 == 0, "none").otherwise("")
    t = F.split(F.lower(F.concat_ws(",", meta, header)), r"[,;\s]+")
    return finding(table(spark, d, "pages").where(F.arrays_overlap(t, F.array(F.lit("noindex"), F.lit("none")))), "page_id", "NOINDEX_EXCLUSION", "critical")


@q("r07_locale", "select page_id, 'LOCALE_MISCONFIGURATION' as id, 'medium' as severity from pages where page_id % 4 = 1")
def r07(spark, d):
    tag = F.when(F.col("page_id") % 4 == 1, "en-UK").otherwise("en-GB")
    parts = F.split(tag, "-")
    bad = F.lower(parts[0]).isin("eng", "jp") | (F.upper(F.try_element_at(parts, F.lit(2))) == "UK")
    return finding(table(spark, d, "pages").where(bad), "page_id", "LOCALE_MISCONFIGURATION", "medium")


_SUMMARY = rf"""{TOKENS}, c as (select page_id, count(*) filter (kind = 'start' and tag = 'h1') as h1, count(*) filter (kind = 'start' and tag in ('main', 'nav')) as landmarks, count(*) filter (kind = 'start' and tag = 'a') as anchors from tokens group by page_id), t as (select page_id, sum(len(regexp_extract_all(text, '\S+')))::bigint as words, count(*) filter (regexp_matches(current_tag, '^h[1-6]$')) as heads from text_nodes group by page_id)"""


@q("r13_landmarks", f"with {_SUMMARY} select page_id, 'SEMANTIC_LANDMARKS_ABSENT' as id, 'medium' as severity from c join t using (page_id) where words >= 25 and (h1 = 0 or (heads = 0 and landmarks = 0))")
def r13(spark, d):
    s = K.dom_summary(table(spark, d, "pages")).where("words >= 25 and (h1_tags = 0 or (heading_nodes = 0 and landmarks = 0))")
    return finding(s, "page_id", "SEMANTIC_LANDMARKS_ABSENT", "medium")


@q("r71_missing_h1", f"with {TOKENS} select page_id, 'MISSING_H1' as id from tokens group by page_id having count(*) filter (kind = 'start' and tag = 'h1') = 0")
def r71(spark, d):
    return K.dom_summary(table(spark, d, "pages")).where("h1_tags = 0").select("page_id", F.lit("MISSING_H1").alias("id"))


_ENTITIES = f"entities as (select site, unnest(list_filter(string_split(title, ' ')[1:3], lambda x: length(x) > 2)) as entity from (select {NETLOC} as site, lower(min_by({TITLE}, page_id)) as title from pages group by {NETLOC}))"


@q("r72_information_scent", f"with {TOKENS}, {_ENTITIES}, h as (select page_id, lower(string_agg(text, ' ' order by pos)) as h1 from text_nodes where current_tag = 'h1' group by page_id), p as (select page_id, {NETLOC} as site from pages), named as (select distinct page_id from p join entities using (site) join h using (page_id) where contains(h1, entity)) select page_id, 'LOW_INFORMATION_SCENT' as id, 'medium' as severity from p where site in (select site from entities) and page_id not in (select page_id from named)")
def r72(spark, d):
    """No entity of the page's site (first three words of its first page's title) is named in the page's h1; all names are found in one scan."""
    h = K.headings(table(spark, d, "pages")).where("level = 'h1'").groupBy("page_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")).alias("h1"))
    raw = table(spark, d, "pages").select("page_id", U.netloc(F.col("url")).alias("site"), T.title(F.col("html")).alias("title"))
    first = raw.groupBy("site").agg(F.slice(F.split(F.lower(F.min_by("title", "page_id")), " "), 1, 3).alias("words"))
    entities = first.select("site", F.explode("words").alias("entity")).where("length(entity) > 2").distinct()
    found = mentions(h, "page_id", "h1", entities, "entity").withColumnRenamed("name", "entity")
    p = raw.select("page_id", "site").join(entities.select("site").distinct(), "site", "left_semi")
    named = found.join(p, "page_id").join(entities, ["site", "entity"], "left_semi").select("page_id").distinct()
    return finding(p.join(named, "page_id", "left_anti"), "page_id", "LOW_INFORMATION_SCENT", "medium")


@q("o150_intent_facts", "with f(fact, pattern) as (values ('price', '[$€£]|price'), ('contact', '@|contact'), ('license', 'licen[sc]e'), ('date', '[0-9]{4}')), m as (select doc_id, fact from documents, f where not regexp_matches(lower(text), pattern)) select doc_id, string_agg(fact, ',' order by fact) as missing from m group by doc_id")
def o150(spark, d):
    """Required facts that a text lacks."""
    required = {"contact": "@|contact", "date": "[0-9]{4}", "license": "licen[sc]e", "price": "[$€£]|price"}
    low = F.lower("text")
    missing = F.concat_ws(",", *(F.when(~low.rlike(p), name) for name, p in required.items()))
    return table(spark, d, "documents").select("doc_id", missing.alias("missing")).where("missing != ''")


_HOST = f"with {CLASSED}, {TOKENS}, c as (select page_id, count(*) filter (kind = 'start' and tag = 'h1') as h1 from tokens group by page_id), t as (select page_id, sum(len(regexp_extract_all(text, '\\S+')))::bigint as words from text_nodes group by page_id), f as (select site, case when h1 = 0 then 'high' when words < 100 then 'medium' else 'none' end as severity from classed join c using (page_id) left join t using (page_id))"


@q("flagship_site_findings", f"{_HOST} select site, count(*) as pages, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium from f group by site")
def flagship(spark, d):
    """Pages to tokens to findings to a severity summary per site."""
    s = K.dom_summary(table(spark, d, "pages"))
    severity = F.when(F.col("h1_tags") == 0, "high").when(F.col("words") < 100, "medium").otherwise("none")
    f = pages(spark, d).select("site", "page_id").join(s, "page_id").select("site", severity.alias("severity"))
    return f.groupBy("site").agg(F.count("*").alias("pages"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))


QUERIES, SQL = area.queries, area.sql
