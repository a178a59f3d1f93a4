"""Robots files: line records, groups, errors and access decisions.

The decision for a path and an agent is the longest matching pattern, allow
before disallow, then the earliest line; groups of one agent merge, and the
wildcard group answers only for agents without a group of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from crawlight.functions.text import octets
from crawlight.operators.rule_trie import DECIDED, decide

# Evaluated agents and their roles.
AGENTS = [
    ("OAI-SearchBot", "retrieval"), ("Claude-SearchBot", "retrieval"), ("PerplexityBot", "retrieval"), ("Claude-User", "user_fetch"), ("Perplexity-User", "user_fetch"),
    ("ChatGPT-User", "user_fetch"), ("GPTBot", "training"), ("ClaudeBot", "training"), ("Applebot-Extended", "training"), ("CCBot", "training"),
]
DIRECTIVES = "user-agent|allow|disallow|crawl-delay|sitemap"


def lines(robots: DataFrame) -> DataFrame:
    """site, line, field and value of (site, text); comments are cut, empty lines left out."""
    out = robots.select("site", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("k", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    out = out.select("site", (F.col("k") + 1).alias("line"), clean.alias("clean")).where("clean != ''")
    return out.select("site", "line", F.lower(F.trim(F.regexp_extract("clean", "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("clean", "^[^:]*:(.*)$", 1)).alias("value"), F.col("clean").contains(":").alias("has_colon"))


def groups(robots: DataFrame) -> DataFrame:
    """Lines with their group: one begins at an agent line after any rule or delay."""
    w = Window.partitionBy("site").orderBy("line")
    known = lines(robots).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    agent = F.col("field") == "user-agent"
    begins = (agent & (F.coalesce(F.lag("field").over(w), F.lit("allow")) != "user-agent")).cast("int")
    return known.withColumn("group_id", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def agents(robots: DataFrame) -> DataFrame:
    return groups(robots).where("field = 'user-agent' and group_id > 0").select("site", "group_id", F.lower("value").alias("agent"), "line")


def rules(robots: DataFrame) -> DataFrame:
    """Allow and disallow lines; an empty disallow allows all, an empty allow says nothing."""
    r = groups(robots).where(F.col("field").isin("allow", "disallow") & (F.col("group_id") > 0) & ~((F.col("field") == "allow") & (F.col("value") == "")))
    plain = F.regexp_replace(F.regexp_replace("value", r"\$$", ""), r"\*", "")
    size = F.octet_length(F.regexp_replace(plain, "%[0-9A-Fa-f]{2}", "x"))
    return r.select("site", "group_id", "line", ((F.col("field") == "allow") | (F.col("value") == "")).alias("is_allow"), F.col("value").alias("pattern"), size.alias("specificity"))


def delays(robots: DataFrame) -> DataFrame:
    return groups(robots).where("field = 'crawl-delay' and group_id > 0").select("site", "group_id", F.col("value").try_cast("double").alias("crawl_delay")).dropna()


def sitemaps(robots: DataFrame) -> DataFrame:
    """Declared sitemaps once each, in order."""
    found = lines(robots).where("field = 'sitemap' and value != ''").groupBy("site", F.col("value").alias("url")).agg(F.min("line").alias("line"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("line")))


def errors(robots: DataFrame) -> DataFrame:
    """site, line and error: markup instead of text, lines without colon, unknown fields, rules before any agent, bad delays, relative sitemaps."""
    l = groups(robots).select("site", "line", "group_id")
    every = lines(robots).join(l, ["site", "line"], "left")
    kind = (
        F.when(~F.col("has_colon"), "missing_colon").when(~F.col("field").rlike(f"^(?:{DIRECTIVES})$"), "unknown_directive")
        .when(F.col("field").isin("allow", "disallow", "crawl-delay") & (F.col("group_id") == 0), "rule_before_agent")
        .when((F.col("field") == "crawl-delay") & F.col("value").try_cast("double").isNull(), "invalid_crawl_delay")
        .when((F.col("field") == "sitemap") & ~F.col("value").rlike("^https?://"), "relative_sitemap")
    )
    html = robots.where(F.col("text").rlike(r"(?i)<(?:!doctype\s+html|html|body|head)\b")).select("site", F.lit(1).alias("line"), F.lit("html_response").alias("error"))
    return every.select("site", "line", kind.alias("error")).where("error is not null").unionByName(html)


#: Paths of a site that one stream answers, about; a larger site is split, its rules go to each part.
STREAM = 100_000


def decisions(robots: DataFrame, targets: DataFrame, bots: DataFrame, stream: int = STREAM) -> DataFrame:
    """site, path, bot, allowed, pattern, crawl_delay, is_default of (site, path) targets; ``bots`` is a small table.

    Rules and paths of a site come together in one stream, rules first: they become a trie, and every path descends
    it once.  No path meets the rules one by one, and no site's paths are gathered.
    """
    owned = agents(robots).select("site", "agent", "group_id").distinct()
    asked = robots.select("site").distinct().crossJoin(F.broadcast(bots.select("bot")))
    own = asked.join(owned, (asked["site"] == owned["site"]) & (F.lower("bot") == owned["agent"]), "left").select(asked["site"], "bot", "group_id")
    star = owned.where("agent = '*'").select("site", F.col("group_id").alias("star_id"))
    applied = own.join(star, "site", "left").select("site", "bot", F.coalesce("group_id", "star_id").alias("group_id")).distinct()
    delay = applied.join(delays(robots), ["site", "group_id"]).groupBy("site", "bot").agg(F.max("crawl_delay").alias("crawl_delay"))
    heads = applied.join(delay, ["site", "bot"], "left").withColumn("kind", F.lit(0))
    body = rules(robots).withColumn("kind", F.lit(1))
    normal = F.when(F.col("path").rlike(r"^[A-Za-z0-9/%*?$&=:+,;@!~'()._-]*$") & ~F.col("path").contains("%"), F.col("path")).otherwise(octets_udf(F.col("path")))
    paths = targets.select("site", "path", normal.alias("octets"), F.lit(2).alias("kind"))
    # sites of several streams are fewer than targets / STREAM
    large = targets.groupBy("site").agg(F.ceil(F.count("*") / stream).cast("int").alias("salts")).where("salts > 1")
    salts = lambda df: df.join(F.broadcast(large), "site", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    every = lambda df: salts(df).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = every(heads).unionByName(every(body), allowMissingColumns=True)
    rows = rows.unionByName(salts(paths).withColumn("salt", F.pmod(F.xxhash64("path"), F.col("salts")).cast("int")), allowMissingColumns=True)
    columns = ["site", "salt", "kind", "bot", "group_id", "line", "is_allow", "pattern", "specificity", "crawl_delay", "path", "octets"]
    out = rows.select(*columns).repartition("site", "salt").sortWithinPartitions("site", "salt", "kind").mapInArrow(decide, DECIDED)
    return out.select("site", "path", "bot", F.coalesce("is_allow", F.lit(True)).alias("allowed"), "pattern", F.coalesce("crawl_delay", F.lit(0.0)).alias("crawl_delay"), F.col("is_allow").isNull().alias("is_default"))


@F.arrow_udf(StringType())
def octets_udf(paths):
    """Only paths with escapes or characters beyond the plain ones come here."""
    import pyarrow as pa

    return pa.array([None if p is None else octets(p) for p in paths.to_pylist()])
