"""What a page shows without scripts, and what its content signals are: expressions over one page's markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.functions.urls import as_sql_reads

Q = r"[\x22\x27]"
# Traces of application shells, hydrated blocks and author marks.
SHELL_IDS = ["root", "app", "mount", "__next", "__nuxt", "app-root", "___gatsby", "svelte", "svelte-app", "react-root", "vue-app", "app-container", "main-app", "application"]
SHELL_CLASSES = ["react-root", "vue-app", "app-container", "spa-container", "application-root", "mount-point"]
SHELL_ELEMENTS = ["app-root", "app-main", "ng-component", "router-outlet"]
SHELL_ATTRIBUTES = ["data-reactroot", "data-v-app", "ng-app"]
SCRIPT_NOTICES = ["enable javascript", "requires javascript", "javascript to run", "javascript enabled"]
EDGE_SCRIPTS = ["aem", "scripts", "configs", "commerce"]
EDGE_BLOCKS = ["section-metadata", "cards", "offer", "teaser", "reward", "store-locator", "carousel", "hero", "commerce"]
#: Words that a hydrated block and an application shell stand for.
BLOCK_WORDS, SHELL_WORDS = 60, 450
#: Elements that are no content of a body.
NO_CONTENT = ["script", "style", "noscript", "link", "meta", "head"]
STORE_PATHS = ["/location", "/store", "/find-a-store", "/branches", "/dealers"]
STORE_BLOCKS = ["store-locator", "location-search", "find-store"]
STORE_LINKS = ["/locations/", "/stores/", "/branches/"]
LOCAL_SCHEMAS = ["LocalBusiness", "Store", "Restaurant", "GeoCoordinates", "streetAddress"]
FAQ_TYPES = ["FAQPage", "Question"]
ORGANIZATIONS = ["Organization", "Corporation", "LocalBusiness"]
CALLS_TO_ACTION = ["buy", "cart", "subscribe", "contact", "order", "get"]

_any = "|".join
#: Patterns that both engines read alike.
RAW = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
NOSCRIPT = r"(?is)<noscript\b[^>]*>.*?</noscript>"
COMMENT = r"(?s)<!--.*?-->"
STARTS = r"<[A-Za-z][^>]*>"
CONTAINER = r"(?i)^<(?:div|main|section)[\s>/]"
SHELL_ID = rf"(?i)\sid\s*=\s*{Q}?\s*(?:(?:{_any(SHELL_IDS)})\s*(?:{Q}|\s|>)|[^\x22\x27>]*(?:react|vue|angular|svelte|spa)[-_](?:root|app|container))"
SHELL_CLASS = rf"(?i)\sclass\s*=\s*{Q}?[^\x22\x27>]*(?:\b(?:{_any(SHELL_CLASSES)})\b|(?:react|vue|angular|svelte)[-_](?:root|app|container))"
SHELL_ELEMENT = rf"(?i)^<(?:{_any(SHELL_ELEMENTS)})[\s>/]"
SHELL_ATTRIBUTE = rf"(?i)\s(?:{_any(SHELL_ATTRIBUTES)})[\s=>/]"
NOTICE = rf"(?i)\b(?:{_any(SCRIPT_NOTICES)})\b"
JSON_SCRIPT = rf"(?is)<script[^>]*type={Q}application/json{Q}[^>]*>(.*?)</script>"
STATE_SCRIPT = rf"(?is)<script[^>]*id={Q}__(?:NEXT|NUXT)_DATA__{Q}[^>]*>(.*?)</script>"
LD_SCRIPT = rf"(?is)<script[^>]*type={Q}application/ld\+json{Q}[^>]*>(.*?)</script>"
#: Escapes go first (a backslash, blanks, anything else), so that a string is a plain run: long strings need no stack.
JSON_ESCAPES = [(r"\x5C\x5C", "x"), (r"\x5C[nrtf]", " "), (r"\x5C.", "x")]
JSON_STRING = r"\x22[^\x22]*\x22\s*:?"
EDGE_SCRIPT = rf"(?i)/scripts/(?:{_any(EDGE_SCRIPTS)})\.js"
EDGE_BLOCK = rf"(?i)<div class={Q}(?:{_any(EDGE_BLOCKS)}){Q}"
SCRIPT_SOURCE = r"(?i)<script[^>]*src="
SCRIPT_SOURCES = rf"(?i)<script\b[^>]*\ssrc\s*=\s*{Q}([^\x22\x27]+){Q}"
BODY = r"(?is)(<body\b.*)"
AFTER_BODY = r"(?is)</body>.*"
NO_CONTENT_TAG = rf"(?i)^<(?:{_any(NO_CONTENT)})[\s>/]"
HEADING_TEXT = r"(?i)<h[1-6](?:\s[^>]*)?>[^<]*[^<\s]"
PARAGRAPH_TEXT = r"(?i)<(?:p|article|li|span)(?:\s[^>]*)?>[^<]*[^<\s]"
HEADINGS = r"(?i)<h[1-6](?:\s[^>]*)?>([^<]*[^<\s])"
HTTP_LINKS = rf"(?i)<a\s[^>]*href\s*=\s*{Q}(http[^\x22\x27]*){Q}"
HREFS = rf"(?i)<a[^>]*href={Q}([^\x22\x27]+){Q}[^>]*>"
AUTHOR = rf"(?i)\s(?:rel\s*=\s*{Q}[^\x22\x27]*author|class\s*=\s*{Q}[^\x22\x27]*(?:author|byline)|itemprop\s*=\s*{Q}author{Q})"
FAQ_HEADING = rf"^(?:{_any(T.FAQ_WORDS)})\b|\?$"
QUESTION_HEADING = rf"(?i)^(?:{_any(T.QUESTION_WORDS)})\b|\?$"
NAVIGATION = r"(?is)<nav\b[^>]*>(.*?)</nav>"
NODE_ID = r"\x22@id\x22\s*:\s*\x22(https?://[^\x22]*)\x22"
TYPE_VALUE = r"\x22@type\x22\s*:\s*(\x22[^\x22]*\x22|\[[^\]]*\])"
OFFER_TYPE = r"\x22(?:product|offer|aggregateoffer)\x22"
CANONICAL = rf"(?i)<link\s[^>]*rel={Q}canonical{Q}[^>]*href={Q}([^\x22\x27]*){Q}"
ANCHOR_TEXT = r"(?is)<a\s[^>]*>(.*?)</a>"
STORE_BLOCK = rf"(?i)<div class={Q}(?:{_any(STORE_BLOCKS)}){Q}"
FORM_INPUT = rf"(?i)<input[^>]*type={Q}(?:search|text){Q}[^>]*>|<div class={Q}store-locator{Q}"
FORM_TEXT = r"(?is)<(?:form|button)[^>]*>.*?(?:search|find|post code|zip).*?</(?:form|button)>"


def _all(html: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), group)


def start_tags(html: Column) -> Column:
    """Start tags outside scripts, styles and comments."""
    return _all(F.regexp_replace(F.regexp_replace(html, RAW, " "), COMMENT, " "), STARTS)


def is_shell(html: Column) -> Column:
    """Whether a container, element or attribute of a client-side framework stands in the markup."""

    def marks(tag: Column) -> Column:
        container = tag.rlike(CONTAINER)
        return (container & (tag.rlike(SHELL_ID) | tag.rlike(as_sql_reads(SHELL_CLASS)))) | tag.rlike(SHELL_ELEMENT) | (~container & tag.rlike(SHELL_ATTRIBUTE))

    return F.exists(start_tags(html), marks)


def asks_for_scripts(html: Column) -> Column:
    return F.exists(_all(html, NOSCRIPT), lambda x: x.rlike(as_sql_reads(NOTICE)))


def json_words(html: Column) -> Column:
    """Words in strings of two words or more, keys aside, of embedded JSON state; what is no JSON counts nothing."""
    blobs = F.filter(F.transform(F.concat(_all(html, JSON_SCRIPT, 1), _all(html, STATE_SCRIPT, 1)), F.trim), lambda b: F.try_parse_json(b).isNotNull())

    def plain(b: Column) -> Column:
        for escape, sign in JSON_ESCAPES:
            b = F.regexp_replace(b, escape, sign)
        return b

    strings = F.filter(F.flatten(F.transform(blobs, lambda b: _all(plain(b), JSON_STRING))), lambda s: ~s.endswith(":"))
    words = F.transform(strings, lambda s: T.split_words(s.substr(F.lit(2), F.length(s) - 2)))
    return F.aggregate(F.filter(words, lambda n: n >= 2), F.lit(0), lambda a, n: a + n)


def client_words(html: Column, visible: Column) -> Column:
    """Words that scripts are taken to add: from JSON state, hydrated blocks, or an application shell."""
    state, blocks = json_words(html), F.regexp_count(html, F.lit(EDGE_BLOCK))
    edge = html.rlike(EDGE_SCRIPT) & (blocks > 0)
    shell = (is_shell(html) | asks_for_scripts(html)) & (visible < 100) & (F.regexp_count(html, F.lit(SCRIPT_SOURCE)) >= 2)
    return F.when(edge, F.greatest(state, blocks * BLOCK_WORDS)).when(shell, F.greatest(state, F.lit(SHELL_WORDS))).otherwise(state)


def app_scripts(html: Column, third_party: str) -> Column:
    return F.size(F.filter(_all(html, SCRIPT_SOURCES, 1), lambda s: ~s.rlike(f"(?i){third_party}")))


def body_elements(html: Column) -> Column:
    body = F.regexp_replace(F.regexp_extract(html, BODY, 1), AFTER_BODY, "")
    return F.size(F.filter(start_tags(body), lambda t: ~t.rlike(NO_CONTENT_TAG)))


def outside_scripts(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, RAW, " "), NOSCRIPT, " ")


def has_semantic_content(html: Column, visible: Column) -> Column:
    clean = outside_scripts(html)
    return (clean.rlike(HEADING_TEXT) & clean.rlike(PARAGRAPH_TEXT)) | (visible >= 15)


def heading_texts(html: Column) -> Column:
    return F.transform(_all(F.regexp_replace(html, RAW, " "), HEADINGS, 1), F.trim)


def has_schema(html: Column, names: list[str]) -> Column:
    """A node of one of these types at the top, in a list, or in a graph of some JSON-LD block."""
    named = rf"(?:^|\x22)(?:{'|'.join(names)})(?:\x22|$)"
    found = lambda b, path: F.coalesce(F.get_json_object(b, path).rlike(named), F.lit(False))
    return F.exists(_all(html, LD_SCRIPT, 1), lambda b: found(b, "$.@type") | found(b, "$[*].@type") | found(b, "$.@graph[*].@type"))


def cites_authority(html: Column, host: Column) -> Column:
    """Some link to another host leads to an authority."""
    other = lambda u: (F.lower(F.regexp_extract(u, "(?i)^https?://([^/?#]*)", 1)) != host) & ~F.endswith(F.lower(F.regexp_extract(u, "(?i)^https?://([^/?#]*)", 1)), F.concat(F.lit("."), host))
    return F.exists(_all(html, HTTP_LINKS, 1), lambda u: other(u) & T.has_authority(u))


def has_byline(html: Column) -> Column:
    return F.exists(start_tags(html), lambda t: t.rlike(AUTHOR))


def anchor_texts(html: Column) -> Column:
    return F.lower(F.array_join(F.transform(_all(html, ANCHOR_TEXT, 1), lambda a: F.regexp_replace(a, "<[^>]+>", "")), " "))


def is_form_gated(html: Column, path: Column) -> Column:
    """A store page with a search form, without links onward to stores and without local schema."""
    low = F.lower(html)
    any_of = lambda column, parts: sum((F.contains(column, F.lit(p)).cast("int") for p in parts), F.lit(0)) > 0
    store = any_of(path, STORE_PATHS) | html.rlike(STORE_BLOCK) | (low.contains("find a location") & low.contains("search"))
    form = html.rlike(FORM_INPUT) | html.rlike(FORM_TEXT) | (low.contains("post code") & low.contains("search"))
    own = F.regexp_replace(path, "/+$", "")
    onward = F.exists(_all(html, HREFS, 1), lambda h: any_of(F.lower(h), STORE_LINKS) & ~F.endswith(F.regexp_replace(h, "/+$", ""), own))
    return store & form & ~onward & ~any_of(html, LOCAL_SCHEMAS)


def canonical(html: Column) -> Column:
    return F.regexp_extract(html, CANONICAL, 1)


