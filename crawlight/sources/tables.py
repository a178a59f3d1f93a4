"""Page corpora and crawl tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.functions import urls as U

INVENTORY = """site string, base_url string,
pages array<struct<url string, status int, resource_type string, content_type string, page_type string, page_type_confidence string,
  logical_template string, locale string, title string, word_count int, html string, headers map<string,string>, rendered_words int>>,
robots struct<status int, text string>, robots_txt string, sitemaps array<struct<url string, status int>>, limitations array<string>"""

FINDING = """category string, title string, severity string, confidence string, root_cause string, cause_family string, id string, cause_id string,
check_id string, related_check_ids array<string>, impact string, evidence string,
suggested_action struct<summary string, technical_fix string, creative_fix string, priority string, verification string>"""

#: A robots file for hosts that have none in the data.
ROBOTS = """User-agent: *
Disallow: /private/
Disallow: /*?ref=
Allow: /private/open
Crawl-delay: 2

User-agent: GPTBot
User-agent: CCBot
Disallow: /

User-agent: OAI-SearchBot
Disallow: /de/
Allow: /de/1
Crawl-delay: 7.5
# comment
User-agent: PerplexityBot
Disallow:
Sitemap: https://example.com/sitemap.xml
Sitemap: https://example.com/news-sitemap.xml
Sitemap: https://example.com/sitemap.xml
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory files; one that cannot be parsed gives a row of nulls."""
    return spark.read.schema(INVENTORY).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def inventory_pages(inventory: DataFrame) -> DataFrame:
    return inventory.select("site", F.posexplode("pages").alias("pos", "page")).select("site", "pos", "page.*")


def read_findings(spark: SparkSession, glob: str) -> DataFrame:
    """Findings of sensor outputs, at top level or one level below."""
    raw = spark.read.option("wholetext", True).text(glob).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))
    flat = raw.where("try_variant_get(v, '$.findings') is not null").select("file", F.lit(None).cast("string").alias("block"), "v")
    entries = raw.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", F.col("key").alias("block"), F.col("value").alias("v"))
    below = entries.where("try_variant_get(v, '$.findings') is not null")
    every = flat.unionByName(below)
    kind = f"array<struct<{', '.join(_fields(FINDING))}>>"
    return every.select("file", "block", F.explode(F.from_json(F.to_json(F.expr("try_variant_get(v, '$.findings')")), kind)).alias("f")).select("file", "block", "f.*")


def _fields(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page corpus in the inventory's shape: one site per host, status 200."""
    raw = table(spark, sf_dir, "pages")
    url, html = F.col("url"), F.col("html")
    title = T.title(html)
    return raw.select(
        U.netloc(url).alias("site"), "page_id", "url", F.lit(200).alias("status"), U.page_class(url, title).alias("c"), title.alias("title"), T.split_words(T.visible_text(html)).alias("word_count"), "html",
    ).select("site", "page_id", "url", "status", "c.page_type", F.col("c.confidence").alias("page_type_confidence"), F.col("c.template").alias("logical_template"), "c.locale", "title", "word_count", "html")


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch results made of events: an event is a fetch of one of 50 pages by one of five agents."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", F.when(F.col("value") < 50, 403).when(F.col("value") < 100, 404).otherwise(500)).when(F.col("event_type") == "signup", 301).otherwise(200)
    return e.select(F.concat(F.lit("https://site"), F.pmod("user_id", F.lit(50)), F.lit(".example/")).alias("url"), F.pmod("event_id", F.lit(5)).cast("int").alias("agent"), status.cast("int").alias("status"), "ts", "event_id")
