"""What a page's tags declare: directives, language alternates, headings, actions.  All within the row.

Tags in scripts, styles and comments are not read, those in noscript are.
Null markup gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlight.functions import rendering as N
from crawlight.operators.tokens import attribute

LINK, META, ANCHOR = r"(?i)^<link[\s>/]", r"(?i)^<meta[\s>/]", r"(?i)^<a[\s>/]"
#: A heading up to the first end of either level; the level is that of the end.
HEADING = r"(?is)<h[12](?:\s[^>]*)?>.*?</h[12]\s*>"
LEVEL = r"(?is)</h([12])\s*>$"
#: All before the text of the innermost heading.
LEAD = r"(?is)^.*<h[12](?:\s[^>]*)?>"
SEPARATORS = r"[,;\s]+"
# Directives that exclude, languages and region that do not exist, marks of an action.
EXCLUDING = ["noindex", "none"]
WRONG_LANGUAGES, WRONG_REGION = ["eng", "jp"], "UK"
ACTION_CLASSES = ["btn", "button", "cta"]


def robots_directives(html: Column, header: Column) -> Column:
    """Distinct directives, in order of the alphabet, of the last robots meta tag and the X-Robots-Tag header."""
    metas = F.filter(N.start_tags(html), lambda t: t.rlike(META) & (F.lower(attribute(t, "name")) == "robots"))
    declared = F.coalesce(attribute(F.try_element_at(metas, F.lit(-1)), "content"), F.lit(""))
    words = F.split(F.lower(F.concat(declared, F.lit(" "), F.coalesce(header, F.lit("")))), SEPARATORS)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def excluded(directives: Column) -> Column:
    return F.arrays_overlap(directives, F.array(*map(F.lit, EXCLUDING)))


def hreflangs(html: Column) -> Column:
    """Language codes of alternate links, lower case, in order."""
    links = F.filter(N.start_tags(html), lambda t: t.rlike(LINK) & (F.lower(attribute(t, "rel")) == "alternate"))
    return F.filter(F.transform(links, lambda t: F.trim(F.lower(attribute(t, "hreflang")))), lambda c: c != "")


def wrong_hreflang(code: Column) -> Column:
    """A code whose language or region does not exist; x-default is none."""
    parts = F.split(code, "-")
    region = F.upper(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    return (code != "x-default") & (parts[0].isin(WRONG_LANGUAGES) | (region == WRONG_REGION))


def headings(html: Column, level: int) -> Column:
    """Texts of closed h1 or h2 headings; pieces between tags are trimmed and joined by a blank."""
    clean = F.regexp_replace(F.regexp_replace(html, N.RAW, ""), N.COMMENT, "")
    found = F.filter(F.regexp_extract_all(clean, F.lit(HEADING), 0), lambda h: F.regexp_extract(h, LEVEL, 1) == str(level))
    pieces = F.transform(found, lambda h: F.filter(F.split(F.regexp_replace(F.regexp_replace(h, LEAD, ""), LEVEL, ""), "<[^>]+>"), lambda p: p != ""))
    return F.transform(F.filter(pieces, lambda p: F.size(p) > 0), lambda p: F.trim(F.array_join(F.transform(p, lambda x: F.trim(x)), " ")))


def anchors(html: Column) -> Column:
    """Start tags of anchors with an address."""
    return F.filter(N.start_tags(html), lambda t: t.rlike(ANCHOR) & (attribute(t, "href") != ""))


def actions(html: Column) -> Column:
    """Addresses of anchors dressed as buttons, by class or role."""

    def acts(t: Column) -> Column:
        out = F.lower(attribute(t, "role")) == "button"
        for part in ACTION_CLASSES:
            out = out | F.lower(attribute(t, "class")).contains(part)
        return out

    return F.transform(F.filter(anchors(html), acts), lambda t: attribute(t, "href"))
