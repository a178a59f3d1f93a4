"""HTML as a token stream: one row per tag, text or declaration, without Python.

Raw elements (script, style) are one token, so markup inside them is never
read as tags.  Every derived view numbers tokens by ``pos`` and works with
windows per page; pages are the unit of distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TOKEN = r"(?is)(<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<[^>]+>|[^<]+)"


def so_far() -> WindowSpec:
    """A page's tokens up to the current one."""
    return Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind (decl, raw, end, start, text), tag and tok."""
    out = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), 1)).alias("pos", "tok"))
    tok = F.col("tok")
    kind = F.when(tok.rlike("^<[!?]"), "decl").when(tok.rlike(r"(?i)^<(?:script|style)\b"), "raw").when(tok.startswith("</"), "end").when(tok.startswith("<"), "start").otherwise("text")
    return out.select("page_id", "pos", kind.alias("kind"), F.lower(F.regexp_extract(tok, "^</?([A-Za-z][A-Za-z0-9-]*)", 1)).alias("tag"), "tok")


def attribute(tok: Column, name: str) -> Column:
    """An attribute's value, with or without quotes; empty if it is absent."""
    return F.coalesce(*(F.nullif(F.regexp_extract(tok, rf"(?is)\s{name}\s*=\s*{quoted}", 1), F.lit("")) for quoted in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")), F.lit(""))


def _governing() -> Column:
    """A start tag governs what follows; any end tag, a self-closing one too, ends that."""
    opens = (F.col("kind") == "start") & ~F.col("tok").endswith("/>")
    return F.when(F.col("kind").isin("start", "end", "raw"), F.when(opens, F.col("tag")).otherwise(""))


def text_nodes(t: DataFrame) -> DataFrame:
    """Texts with the tag that governs them: the last start tag, none after an end tag."""
    last = F.last(_governing(), True).over(so_far())
    return t.withColumn("current_tag", F.nullif(last, F.lit(""))).where("kind = 'text' and trim(tok) != ''").select("page_id", "pos", F.trim("tok").alias("text"), "current_tag")


def depth(t: DataFrame, *tags: str) -> Column:
    """How many of these elements are open at a token."""
    change = F.when(F.col("tag").isin(*tags) & (F.col("kind") == "start"), 1).when(F.col("tag").isin(*tags) & (F.col("kind") == "end"), -1).otherwise(0)
    return F.sum(change).over(so_far())


def dom_summary(pages: DataFrame) -> DataFrame:
    """Counts of one page's structure (rendering and landmark rules build on it)."""
    t = tokens(pages)
    start = F.col("kind") == "start"
    counts = t.groupBy("page_id").agg(
        F.count_if(start).alias("start_tags"), F.count_if(F.col("kind") == "end").alias("end_tags"), F.count_if(start & (F.col("tag") == "a")).alias("anchors"),
        F.count_if(start & (F.col("tag") == "h1")).alias("h1_tags"), F.count_if(start & F.col("tag").isin("main", "nav")).alias("landmarks"),
        F.count_if(start & F.col("tag").isin("ul", "ol", "dl")).alias("lists"), F.count_if(start & (F.col("tag") == "table")).alias("tables"), F.count_if(F.col("kind") == "raw").alias("raw_elements"),
    )
    texts = text_nodes(t).groupBy("page_id").agg(
        F.count_if(F.col("current_tag").rlike("^h[1-6]$")).alias("heading_nodes"), F.count_if(F.col("current_tag").isin("p", "article", "li", "span")).alias("paragraph_nodes"),
        F.sum(F.regexp_count("text", F.lit(r"\S+"))).cast("long").alias("words"),
    )
    return counts.join(texts, "page_id", "left").na.fill(0)


def headings(pages: DataFrame) -> DataFrame:
    """page_id, pos, level and text of each text node inside a heading."""
    return text_nodes(tokens(pages)).where(F.col("current_tag").rlike("^h[1-6]$")).select("page_id", "pos", F.col("current_tag").alias("level"), "text")


def sections(pages: DataFrame) -> DataFrame:
    """Texts outside headings with the last heading before them (h1 to h4), General at first."""
    t = text_nodes(tokens(pages))
    head = F.col("current_tag").rlike("^h[1-4]$")
    section = F.coalesce(F.last(F.when(head, F.col("text")), True).over(so_far()), F.lit("General"))
    return t.withColumn("section", section).where(~F.coalesce(head, F.lit(False))).select("page_id", "pos", "section", "text")


def paragraphs(pages: DataFrame) -> DataFrame:
    """Texts directly in p, one row per paragraph; what stands in or after inline children is not part of it."""
    t = tokens(pages)
    number = F.sum(F.when((F.col("kind") == "start") & (F.col("tag") == "p"), 1).otherwise(0)).over(so_far())
    last = F.last(_governing(), True).over(so_far())
    texts = t.withColumn("n", number).withColumn("current_tag", last).where("kind = 'text' and current_tag = 'p' and trim(tok) != ''")
    closed = t.withColumn("n", number).where("kind = 'end' and tag = 'p'").select("page_id", "n").distinct()
    joined = texts.groupBy("page_id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("tok").alias("x")))), lambda s: s["x"]), " ").alias("text"))
    return joined.join(closed, ["page_id", "n"], "left_semi").select("page_id", F.col("n").cast("long").alias("paragraph"), "text")


def links(pages: DataFrame) -> DataFrame:
    """Anchors with href, text and whether they stand in navigation (nav or header still open)."""
    t = tokens(pages).withColumn("a", F.sum(F.when((F.col("kind") == "start") & (F.col("tag") == "a"), 1).otherwise(0)).over(so_far()))
    inside = F.last(F.when(F.col("tag").isin("a") & F.col("kind").isin("start", "end"), F.col("kind") == "start"), True).over(so_far())
    t = t.withColumn("inside", inside).withColumn("nav", depth(t, "nav", "header"))
    opened = t.where("kind = 'start' and tag = 'a'").select("page_id", "a", "pos", attribute(F.col("tok"), "href").alias("href"), (F.col("nav") > 0).alias("in_nav"))
    label = t.where("kind = 'text' and inside").groupBy("page_id", "a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("tok").alias("x")))), lambda s: s["x"]), " ").alias("label"))
    return opened.join(label, ["page_id", "a"], "left").select("page_id", "pos", "href", "in_nav", F.coalesce("label", F.lit("")).alias("label"))
