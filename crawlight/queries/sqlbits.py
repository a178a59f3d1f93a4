"""Common table expressions that the SQL equivalents share."""

from __future__ import annotations

from crawlight.functions import urls as U
from crawlight.queries.registry import sql_in, sql_list

NETLOC = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
TITLE = "trim(regexp_extract(html, '(?i)<title[^>]*>([^<]{1,300})</title>', 1))"
TOKEN = r"(?is)(<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<[^>]+>|[^<]+)"

URLS = rf"""urls as (
    select page_id, url, html, {NETLOC} as site, {PATH} as path, {TITLE} as title,
           list_filter(string_split({PATH}, '/'), lambda x: x <> '') as all_segments
    from pages
), located as (
    select *, coalesce(lower(all_segments[1]) in {sql_in(U.KNOWN_LOCALES)} or regexp_full_match(lower(all_segments[1]), '[a-z]{{2}}(-[a-z]{{2}})?'), false) as has_locale from urls
), logical as (
    select *, case when has_locale then lower(all_segments[1]) else 'default' end as locale,
           case when has_locale then '/' || array_to_string(all_segments[2:], '/') when path = '' then '/' else path end as logical_path
    from located
)"""


def _cascade() -> str:
    s = "segments"
    rules = [
        (f"len({s}) = 0 or logical_path = '/'", "homepage", "high", "'/'"),
        (f"{s}[-1] in {sql_in(U.TEMPLATE_WORDS)}", "template", "high", "logical_path"),
        (f"len({s}) = 1 and {s}[1] in {sql_in(U.LISTING_WORDS)}", "product_listing", "high", "logical_path"),
        (f"len({s}) >= 2 and {s}[1] in {sql_in(U.DETAIL_WORDS)} and {s}[2] not in {sql_in(U.NO_DETAIL_WORDS)}", "product_detail", "high", "'/products/*'"),
    ]
    rules += [(f"list_has_any({s}, {sql_list(words)})", kind, "high", f"'{template}'" if template else "logical_path") for kind, template, words in U.SEGMENT_TYPES]
    rules += [(f"regexp_matches(lower(title), '{U.between_edges(p)}')", kind, confidence, f"'{template}'") for kind, confidence, template, p in U.TITLE_TYPES]
    whens = " ".join(f"when {c} then {{'page_type': '{k}', 'confidence': '{f}', 'template': {t}}}" for c, k, f, t in rules)
    return f"case {whens} else {{'page_type': 'other', 'confidence': 'low', 'template': logical_path}} end"


CLASSED = rf"""{URLS}, split as (
    select *, list_filter(string_split(logical_path, '/'), lambda x: x <> '') as segments from logical
), classed as (
    select page_id, url, html, site, title, locale, logical_path, segments, c.page_type, c.confidence, c.template from (select *, {_cascade()} as c from split)
)"""

TOKENS = rf"""raw_tokens as (
    select page_id, unnest(range(len(toks))) as pos, unnest(toks) as tok from (select page_id, regexp_extract_all(html, '{TOKEN}', 1) as toks from pages)
), tokens as (
    select page_id, pos, tok,
           case when regexp_matches(tok, '^<[!?]') then 'decl' when regexp_matches(tok, '(?i)^<(?:script|style)\b') then 'raw' when starts_with(tok, '</') then 'end' when starts_with(tok, '<') then 'start' else 'text' end as kind,
           lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)) as tag
    from raw_tokens
), governed as (
    select *, nullif(last_value(case when kind = 'start' and not ends_with(tok, '/>') then tag when kind in ('start', 'end', 'raw') then '' end ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and current row), '') as current_tag from tokens
), text_nodes as (
    select page_id, pos, trim(tok) as text, current_tag from governed where kind = 'text' and trim(tok) <> ''
)"""
