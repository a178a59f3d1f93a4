"""SQL functions: pure ones as SQL expressions, the others on Arrow, one aggregate, one table function."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from crawlight.functions import text as T
from crawlight.functions import urls as U


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _sql_functions() -> dict[str, str]:
    marks = [("INR", "₹ INR RS"), ("BRL", "R$ BRL"), ("CAD", "C$ CAD"), ("AUD", "A$ AUD"), ("USD", "$ USD"), ("EUR", "€ EUR"), ("GBP", "£ GBP"), ("JPY", "¥ JPY CNY RMB"), ("AED", "AED DHS")]
    currency = " ".join(f"when {' or '.join(f'contains(upper(x), {_quoted(m)})' for m in ms.split())} then '{code}'" for code, ms in marks)
    interval = " ".join(f"when lower(x) rlike {_quoted('|'.join(p))} then '{name}'" for name, p in T.INTERVALS)
    plain = (
        r"case when trim(x) rlike r'\d+\.\d{3},\d{2}' then replace(replace(trim(x), '.', ''), ',', '.') when contains(x, ',') and contains(x, '.') then replace(trim(x), ',', '') "
        r"when size(split(trim(x), ',')) = 2 and length(split(trim(x), ',')[1]) = 2 then replace(trim(x), ',', '.') else replace(trim(x), ',', '') end"
    )
    return {
        "detect_currency": f"case {currency} else 'UNKNOWN' end",
        "billing_interval": f"case {interval} else 'one_time' end",
        "normalize_price": rf"get(transform(filter(array(try_cast(nullif(regexp_extract({plain}, r'(\d+(?:\.\d{{1,2}})?)', 1), '') as double)), v -> v is not null), v -> format_string('%.2f', v)), 0)",
    }


class _Tokens(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, str, str, str]] = []

    def _add(self, kind: str, tag: str, text: str) -> None:
        self.rows.append((len(self.rows), kind, tag, text))

    def handle_starttag(self, tag, attrs):
        self._add("start", tag, self.get_starttag_text() or "")

    def handle_startendtag(self, tag, attrs):
        self._add("start", tag, self.get_starttag_text() or "")

    def handle_endtag(self, tag):
        self._add("end", tag, "")

    def handle_data(self, data):
        self._add("text", "", data)


class HtmlTokens:
    """The standard parser as table function: a fallback for markup that the token pattern cannot read."""

    def eval(self, html: str):
        parser = _Tokens()
        parser.feed(html or "")
        yield from parser.rows


def entropy_of(values: list[int]) -> float:
    """Bits per token of a group's token counts."""
    import math

    total = sum(values)
    return -sum(c / total * math.log2(c / total) for c in values) if total else 0.0


def register(spark: SparkSession) -> None:
    """Makes detect_currency, billing_interval, normalize_price, classify_page, robots_octets, zlib_ratio, token_entropy and html_tokens known to SQL."""
    for name, body in _sql_functions().items():
        spark.sql(f"create or replace temporary function {name}(x string) returns string return {body}")
    from crawlight.operators.robots import octets_udf
    from crawlight.queries.content import zlib_ratio

    spark.udf.register("robots_octets", octets_udf)
    spark.udf.register("zlib_ratio", zlib_ratio)

    def token_entropy(counts: pd.Series) -> float:
        return entropy_of([c for c in counts.tolist() if c])

    token_entropy = F.pandas_udf(token_entropy, DoubleType())
    spark.udf.register("token_entropy", token_entropy)
    spark.udtf.register("html_tokens", F.udtf(HtmlTokens, returnType="pos int, kind string, tag string, text string"))
    whens = " ".join(f"when exists(s, x -> x in ({', '.join(repr(w) for w in words)})) then '{kind}'" for kind, _, words in U.SEGMENT_TYPES)
    first = f"when size(s) = 0 then 'homepage' when try_element_at(s, -1) in {tuple(U.TEMPLATE_WORDS)} then 'template' when size(s) = 1 and get(s, 0) in {tuple(U.LISTING_WORDS)} then 'product_listing' when size(s) >= 2 and get(s, 0) in {tuple(U.DETAIL_WORDS)} and get(s, 1) not in {tuple(U.NO_DETAIL_WORDS)} then 'product_detail'"
    spark.sql(f"create or replace temporary function page_type_of_segments(s array<string>) returns string return case {first} {whens} else 'other' end")
    every = r"filter(split(regexp_extract(x, r'^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/'), e -> e != '')"
    located = f"size({every}) > 0 and (lower(get({every}, 0)) in {tuple(U.KNOWN_LOCALES)} or lower(get({every}, 0)) rlike '^[a-z]{{2}}(-[a-z]{{2}})?$')"
    spark.sql(f"create or replace temporary function classify_page(x string) returns string return page_type_of_segments(case when {located} then slice({every}, 2, size({every})) else {every} end)")
