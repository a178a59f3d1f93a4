"""Inventory acquisition: a bounded walk over sitemaps and a stratified sample, for all sites at once.

A site's walk is one row: what it has read and what it would read next.  A
round asks for the next sitemaps of all sites in one join, in order and up to
the site's quota; as a round reads all that the quota allows, MOST_SITEMAPS
rounds are enough for any chain of indexes.  Bodies are parsed once and do not
go through the rounds: only the addresses of child sitemaps do, and of each
body no more than the quota, which no later address can displace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.functions import urls as U
from crawlight.operators.sitemaps import LOC

#: Quotas of a site: declared and read sitemaps, addresses under which the homepage's links count too, pages.
MOST_DECLARED, MOST_SITEMAPS, FEW_URLS, MOST_PAGES, PER_TEMPLATE = 5, 8, 10, 28, 3
# Page types in the order in which they are sampled.
PRIORITY = ["product_detail", "product_listing", "subscription_flow", "pricing", "category", "about", "contact", "location", "documentation", "article", "other"]

_NO_URLS = "array<string>"


def starts(robots: DataFrame) -> DataFrame:
    """site, queue of (site, base_url, status, text): the first declared sitemaps, else the usual address."""
    lines = F.filter(F.split(F.when(F.col("status") == 200, F.col("text")), r"\r\n|\n|\r"), lambda x: F.lower(x).startswith("sitemap:"))
    declared = F.slice(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1))), 1, MOST_DECLARED)
    usual = F.array(F.concat("base_url", F.lit("/sitemap.xml")))
    return robots.select("site", F.when(F.size(declared) > 0, declared).otherwise(usual).alias("queue"))


def links(bodies: DataFrame) -> DataFrame:
    """url, sitemaps and page_urls, in order, of the (url, status, body) that were read well."""
    locs = F.filter(F.regexp_extract_all("body", F.lit(LOC), 1), lambda x: x != "")
    read = bodies.where((F.col("status") == 200) & (F.col("body") != "")).select("url", locs.alias("locs"))

    def is_sitemap(x: Column) -> Column:
        return x.rlike(r"\.xml(?:\.gz)?$") | F.lower(x).contains("sitemap")

    return read.select("url", F.filter("locs", is_sitemap).alias("sitemaps"), F.filter("locs", lambda x: ~is_sitemap(x) & ~U.is_non_html(x)).alias("page_urls"))


def _next(queue: Column, read: Column, site: Column) -> Column:
    """The addresses of a queue that may be read, once each."""
    return F.array_distinct(F.filter(queue, lambda x: ((U.netloc(x) == "") | U.same_domain(U.netloc(x), site)) & ~F.array_contains(read, x)))


def walk(queues: DataFrame, resources: DataFrame, most: int = MOST_SITEMAPS) -> DataFrame:
    """site, read: the sitemaps that each site's walk reads, in order.

    ``queues`` has one row a site, ``resources`` (url, sitemaps) one a sitemap.
    """
    state = queues.select("site", "queue", F.array().cast(_NO_URLS).alias("read"))
    resources = resources.select("url", "sitemaps")
    for _ in range(most):
        batch = F.slice(_next(F.col("queue"), F.col("read"), F.col("site")), F.lit(1), F.lit(most) - F.size("read"))
        asked = state.withColumn("batch", batch).select("site", F.concat("read", "batch").alias("seen"), F.posexplode_outer("batch").alias("pos", "url"))
        met = asked.join(resources, "url", "left")
        found = F.slice(_next(F.coalesce("sitemaps", F.array().cast(_NO_URLS)), F.col("seen"), F.col("site")), 1, most)
        # at most ``most`` rows a site, of at most ``most`` addresses
        state = met.groupBy("site").agg(F.any_value("seen").alias("read"), F.array_sort(F.collect_list(F.struct("pos", found.alias("found")))).alias("found"))
        state = state.select("site", "read", F.flatten("found.found").alias("queue"))
    return state.select("site", "read")


def candidates(walked: DataFrame, resources: DataFrame, homes: DataFrame) -> DataFrame:
    """site, url, place: every address of a site in the order in which it came up, repeats included.

    ``homes`` has (site, base_url, html); the links of a homepage count where sitemaps gave fewer than FEW_URLS.
    """
    read = walked.select("site", F.posexplode("read").alias("k", "sitemap"))
    listed = read.join(resources.select(F.col("url").alias("sitemap"), "page_urls"), "sitemap").select("site", "k", F.posexplode("page_urls").alias("j", "url"))
    listed = listed.where(U.same_domain(U.netloc(F.col("url")), F.col("site"))).select("site", "url", F.struct("k", "j").alias("place"))
    rich = listed.groupBy("site").count().where(F.col("count") >= FEW_URLS)
    poor = homes.join(rich, "site", "left_anti").select("site", "base_url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)href=[\x22\x27](https?://[^\x22\x27]+|/[^\x22\x27]+)"), 1)).alias("j", "href"))
    plain = F.regexp_replace("href", "[#?].*$", "")
    scheme = F.regexp_extract("base_url", "^([a-z]+:)", 1)
    full = F.when(plain.startswith("//"), F.concat(scheme, plain)).when(plain.startswith("/"), F.concat("base_url", plain)).otherwise(plain)
    linked = poor.select("site", full.alias("url"), F.struct(F.lit(MOST_SITEMAPS).alias("k"), "j").alias("place"))
    return listed.unionByName(linked.where(U.same_domain(U.netloc(F.col("url")), F.col("site")) & ~U.is_non_html(F.col("url"))))


def sample(urls: DataFrame, homes: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """site, place, url, page_type, template, locale: the homepage, then at most PER_TEMPLATE addresses of a type and template, types by priority.

    Templates go by their first address.  Addresses are one where they differ in a last slash only from the homepage.
    """
    c = U.page_class(F.col("url"), F.lit(""))
    once = urls.groupBy("site", "url").agg(F.min("place").alias("seen"))
    once = once.join(homes.select("site", "base_url"), "site").where(F.rtrim("url", F.lit("/")) != F.rtrim("base_url", F.lit("/")))
    typed = once.select("site", "url", "seen", c.alias("c")).select("site", "url", "seen", "c.page_type", "c.template", "c.locale")
    typed = typed.withColumn("rank", F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("page_type"))).where("rank > 0")
    template = Window.partitionBy("site", "page_type", "template").orderBy("seen")
    few = typed.withColumn("k", F.row_number().over(template)).where(F.col("k") <= PER_TEMPLATE)
    few = few.withColumn("first", F.first("seen").over(template))
    # a site has three addresses a template here; only the first ``most`` - 1 leave a task
    chosen = few.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("rank", "first", "seen"))).where(F.col("place") < most)
    home = F.concat("base_url", F.lit("/"))
    h = homes.select("site", F.lit(0).alias("place"), home.alias("url"), U.page_class(home, T.title(F.col("html"))).alias("c")).select("site", "place", "url", "c.page_type", "c.template", "c.locale")
    return chosen.select("site", "place", "url", "page_type", "template", "locale").unionByName(h)


def statistics(walked: DataFrame, resources: DataFrame, urls: DataFrame, selected: DataFrame) -> DataFrame:
    """site and counts: sitemaps found and read well, addresses with and without repeats, pages selected."""
    good = walked.select("site", F.explode("read").alias("url")).join(resources.select("url"), "url").groupBy("site").agg(F.count("*").alias("sitemaps_processed"))
    seen = urls.groupBy("site", "url").agg(F.count("*").alias("times")).groupBy("site").agg(F.sum("times").alias("urls_extracted"), F.count("*").alias("same_origin_urls"))
    pages = selected.groupBy("site").agg(F.count("*").alias("pages_selected"), F.count_distinct("page_type").alias("page_types"))
    out = walked.select("site", F.size("read").cast("long").alias("sitemaps_found"))
    for counts in (good, seen, pages):
        out = out.join(counts, "site", "left")
    return out.na.fill(0)
