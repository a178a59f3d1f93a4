"""Sitemap validation and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from crawlight.functions.urls import is_non_html

LOC = r"(?is)<loc>\s*(.*?)\s*</loc>"
LASTMOD = r"^\d{4}(?:-\d{2}(?:-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?)?)?$"
MOST_BYTES, MOST_ENTRIES, SAMPLES = 50 * 1024 * 1024, 50_000, 5


def entries(sitemaps: DataFrame) -> DataFrame:
    """url, pos, loc and lastmod of every url or sitemap element of (url, body)."""
    element = F.regexp_extract_all("body", F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)
    e = sitemaps.select("url", F.posexplode(element).alias("pos", "element"))
    return e.select("url", "pos", F.regexp_extract("element", LOC, 1).alias("loc"), F.nullif(F.regexp_extract("element", r"(?is)<lastmod>\s*(.*?)\s*</lastmod>", 1), F.lit("")).alias("lastmod"))


def validated(sitemaps: DataFrame) -> DataFrame:
    """One row per sitemap: kind, entries, errors and warnings (joined, in a fixed order)."""
    body = F.col("body")
    kind = F.when(body.rlike(r"(?i)<sitemapindex\b"), "sitemapindex").when(body.rlike(r"(?i)<urlset\b"), "urlset").otherwise("unknown")
    locs = F.regexp_extract_all(body, F.lit(LOC), 1)
    mods = F.regexp_extract_all(body, F.lit(r"(?is)<lastmod>\s*(.*?)\s*</lastmod>"), 1)
    say = lambda condition, what: F.when(condition, what)
    errors = F.array_compact(F.array(
        say(F.octet_length(body) > MOST_BYTES, "too_large"), say(body.rlike(r"(?i)<!DOCTYPE|<!ENTITY"), "dtd"), say(kind == "unknown", "no_root"), say(F.size(locs) == 0, "empty"),
        say(F.size(locs) > MOST_ENTRIES, "too_many"), say(F.exists(locs, lambda x: ~x.rlike("(?i)^https?://[^/]")), "relative_loc"),
    ))
    warnings = F.array_compact(F.array(say(F.size(mods) == 0, "missing_lastmod"), say(F.exists(mods, lambda x: ~x.rlike(LASTMOD)), "bad_lastmod")))
    out = sitemaps.select("url", kind.alias("kind"), F.size(locs).alias("entry_count"), (F.size(mods) > 0).alias("has_lastmod"), errors.alias("e"), warnings.alias("w"))
    return out.select("url", "kind", "entry_count", "has_lastmod", (F.size("e") == 0).alias("valid"), F.array_join("e", ",").alias("errors"), F.array_join("w", ",").alias("warnings"))


def children(sitemaps: DataFrame) -> DataFrame:
    """url, loc and whether it is a further sitemap; other non-HTML targets are left out."""
    e = entries(sitemaps)
    sub = F.col("loc").rlike(r"\.xml(?:\.gz)?$") | F.lower("loc").contains("sitemap")
    return e.select("url", "loc", sub.alias("is_sitemap")).where("loc != ''").where(F.col("is_sitemap") | ~is_non_html(F.col("loc")))


@F.arrow_udf(StringType())
def gunzipped(payloads):
    """Text of plain or gzip bytes, null if they cannot be read; at most MOST_BYTES are unpacked."""
    import zlib

    import pyarrow as pa

    def text(raw):
        if raw is None:
            return None
        try:
            if raw[:2] == b"\x1f\x8b":
                raw = zlib.decompressobj(31).decompress(raw, MOST_BYTES + 1)
            return raw.decode("utf-8", "replace")
        except zlib.error:
            return None

    return pa.array([text(x) for x in payloads.to_pylist()], pa.string())
