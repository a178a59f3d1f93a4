"""Price mentions with the heading they stand under, found within a page's row.

The page's tokens are one array.  Headings that close with text are an
ascending array of places, so the section of a mention is found by halving;
nothing is exploded, windowed or shuffled before the mentions are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.operators.nearest import places_below
from crawlight.operators.tokens import TOKEN

#: A mark and an amount; the currency is read off the whole mention.
MENTION = r"((?:₹|Rs\.?|INR|\$|USD|€|EUR|£|GBP)\s?\d[\d,]*(?:\.\d{1,2})?)"
_HEADING = r"(?i)^<{}h[1-4][\s/>]"


def _texts(tokens: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.filter(tokens, lambda t: ~t.startswith("<")), lambda t: F.trim(t)), lambda t: t != ""), " ")


def _once(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.inline(F.array(F.struct(*columns))))


def scoped_prices(pages: DataFrame) -> DataFrame:
    """page_id, section, price, currency, interval, raw of (page_id, html): one row per mention outside headings.

    The section is the last heading (h1 to h4) that has closed with text, General before any.  Prices of zero are left
    out.  A heading that opens within another begins anew; one that never closes takes up all that follows.
    """
    rows = _once(pages, "page_id", F.regexp_extract_all("html", F.lit(TOKEN), 1).alias("toks"))
    numbered = F.transform("toks", lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    marks = F.filter(numbered, lambda x: x["t"].rlike(_HEADING.format("/?")))
    said = F.filter(numbered, lambda x: ~x["t"].startswith("<") & x["t"].rlike("(?i)" + MENTION))
    rows = _once(rows, "page_id", "toks", marks.alias("marks"), said.alias("said")).where(F.size("said") > 0)
    closing = F.filter(
        F.transform("marks", lambda m, j: F.struct(m["i"].alias("i"), m["t"].alias("t"), F.get("marks", j - 1).alias("s"))),
        lambda x: x["t"].startswith("</") & x["s"].isNotNull() & ~x["s"]["t"].startswith("</"),
    )
    closed = F.transform(closing, lambda x: F.struct(x["i"].alias("i"), _texts(F.slice("toks", x["s"]["i"] + 2, x["i"] - x["s"]["i"] - 1)).alias("text")))
    rows = _once(rows, "page_id", "marks", "said", F.filter(closed, lambda x: x["text"] != "").alias("closed"))
    at_mark, at_head = F.transform("marks", lambda x: x["i"]), F.transform("closed", lambda x: x["i"])
    rows = _once(rows, "page_id", "marks", "said", "closed", at_mark.alias("at_mark"), at_head.alias("at_head"))
    rows = rows.select("page_id", "marks", "closed", "at_mark", "at_head", F.explode("said").alias("x"))
    last = F.get("marks", places_below(F.col("at_mark"), F.col("x.i")) - 1)["t"]
    head = F.get("closed", places_below(F.col("at_head"), F.col("x.i")) - 1)["text"]
    inside = ~F.coalesce(last, F.lit("</")).startswith("</")
    found = _once(rows, "page_id", F.coalesce(head, F.lit("General")).alias("section"), F.col("x.t").alias("text"), inside.alias("inside")).where("not inside")
    found = found.select("page_id", "section", T.interval(F.col("text")).alias("interval"), F.explode(F.regexp_extract_all("text", F.lit("(?i)" + MENTION), 1)).alias("raw"))
    amount = F.regexp_extract("raw", r"(\d[\d,]*(?:\.\d{1,2})?)$", 1)
    out = found.select("page_id", "section", T.price(amount).alias("price"), T.currency(F.col("raw")).alias("currency"), "interval", "raw")
    return out.where(F.col("price").cast("double") > 0)
