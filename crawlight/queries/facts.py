"""Fact extraction, ledgers and cross-page conflicts.

The page corpus has no prices, so ledgers are bound to line items: an entity
is a part's name, its price the unit price of an order line, its page the
supplier; life-cycle states come from line status and return flag.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.functions.urls import as_sql_reads
from crawlight.operators.names import mentions
from crawlight.operators.nearest import nearest
from crawlight.operators.scoped_prices import MENTION, scoped_prices
from crawlight.queries.registry import Area, sql_in
from crawlight.queries.sqlbits import TITLE, TOKENS
from crawlight.sources.tables import table

area = Area()
q = area.query

#: Price texts of all line items, made alike by both engines: marks, thousands and decimal signs, billing words, some without a number.
_PRICE_TEXTS = """items as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, case l_linenumber % 2 when 0 then ' ' else '' end as gap, cast(cast(round(l_extendedprice * 100) as bigint) as string) as cents from lineitem),
parts as (select *, left(cents, length(cents) - 2) as whole, right(cents, 2) as rest from items),
grouped as (select *, case when length(whole) > 3 then left(whole, length(whole) - 3) else '' end as head, case when length(whole) > 3 then right(whole, 3) else whole end as tail from parts),
amounts as (select *, case l_partkey % 6
 when 0 then whole || '.' || rest
 when 1 then head || case when head = '' then '' else ',' end || tail || '.' || rest
 when 2 then head || case when head = '' then '' else '.' end || tail || ',' || rest
 when 3 then whole || ',' || rest
 when 4 then head || case when head = '' then '' else ',' end || tail
 else head || case when head = '' then '' else '.' end || tail end as amount from grouped),
priced as (select l_orderkey, l_linenumber, case l_orderkey % 17
 when 0 then '$' || gap || amount
 when 1 then '€' || amount
 when 2 then '₹' || amount
 when 3 then 'Rs. ' || amount
 when 4 then 'R$' || gap || amount
 when 5 then 'C$' || amount
 when 6 then 'A$ ' || amount
 when 7 then '£' || gap || amount
 when 8 then '¥' || amount
 when 9 then 'AED ' || amount
 when 10 then amount || ' Dhs'
 when 11 then 'US$ ' || amount
 when 12 then 'cad' || gap || amount
 when 13 then amount
 when 14 then 'EUR ' || amount
 when 15 then 'price on request'
 else 'from ' || amount || ' rmb' end || case l_suppkey % 12
 when 0 then ' monthly'
 when 1 then ' per month'
 when 2 then '/mo'
 when 3 then ' / year'
 when 4 then ', billed annually'
 when 5 then ' weekly plan'
 when 6 then ' / day'
 when 7 then ' per user/mo'
 when 8 then ' Yearly'
 when 9 then ' / wk'
 when 10 then ' per seat/month'
 else '' end as raw from amounts)"""


def price_texts(spark, d):
    """l_orderkey, l_linenumber, raw: what a shop might print for each line item."""
    return spark.sql(f"with {_PRICE_TEXTS.replace('from lineitem', 'from {items}')} select * from priced", items=table(spark, d, "lineitem"))


def _currency_sql() -> str:
    # Currencies and their marks, in order of precedence.
    rules = [
        ("INR", ["₹", "INR", "RS"]),
        ("BRL", ["R$", "BRL"]),
        ("CAD", ["C$", "CAD"]),
        ("AUD", ["A$", "AUD"]),
        ("USD", ["$", "USD"]),
        ("EUR", ["€", "EUR"]),
        ("GBP", ["£", "GBP"]),
        ("JPY", ["¥", "JPY", "CNY", "RMB"]),
        ("AED", ["AED", "DHS"]),
    ]
    whens = " ".join("when " + " or ".join(f"contains(upper(raw), '{m}')" for m in marks) + f" then '{code}'" for code, marks in rules)
    return f"case {whens} else 'UNKNOWN' end"


@q("o120_currency", f"with {_PRICE_TEXTS} select l_orderkey, l_linenumber, raw, {_currency_sql()} as currency from priced")
def o120(spark, d):
    return price_texts(spark, d).select("l_orderkey", "l_linenumber", "raw", T.currency(F.col("raw")).alias("currency"))


@q("o121_interval", f"with {_PRICE_TEXTS} select l_orderkey, l_linenumber, raw, case " + " ".join(f"when regexp_matches(lower(raw), '{"|".join(p)}') then '{n}'" for n, p in T.INTERVALS) + f" else 'one_time' end as interval from priced")
def o121(spark, d):
    return price_texts(spark, d).select("l_orderkey", "l_linenumber", "raw", T.interval(F.col("raw")).alias("interval"))


_PRICE = r"""nullif(regexp_extract(case when regexp_matches(trim(raw), '\d+\.\d{3},\d{2}') then replace(replace(trim(raw), '.', ''), ',', '.') when contains(trim(raw), ',') and contains(trim(raw), '.') then replace(trim(raw), ',', '') when len(string_split(trim(raw), ',')) = 2 and length(string_split(trim(raw), ',')[2]) = 2 then replace(trim(raw), ',', '.') else replace(trim(raw), ',', '') end, '(\d+(?:\.\d{1,2})?)', 1), '')"""


@q("o122_price", f"with {_PRICE_TEXTS} select l_orderkey, l_linenumber, raw, case when {_PRICE} is not null then printf('%.2f', {_PRICE}::double) end as price from priced")
def o122(spark, d):
    return price_texts(spark, d).select("l_orderkey", "l_linenumber", "raw", T.price(F.col("raw")).alias("price"))


@q("o123_price_mentions", rf"with m as (select doc_id, unnest(regexp_extract_all(replace(text, ' un ', ' $1,249.50 '), '(?i){T.PRICE}', 1)) as amount from documents) select doc_id, amount, count(*) as times from m group by all")
def o123(spark, d):
    """Prices in running text; the data has none, so a frequent word is read as one."""
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.replace(F.col("text"), F.lit(" un "), F.lit(" $1,249.50 ")), F.lit(rf"(?i){T.PRICE}"), 1)).alias("amount"))
    return m.groupBy("doc_id", "amount").agg(F.count("*").alias("times"))


@q("o124_emails", rf"with m as (select doc_id, lower(trim(unnest(regexp_extract_all(text, '{T.EMAIL}')), '.')) as email from documents) select distinct doc_id, email, case when contains(email, 'sales') then 'sales' when contains(email, 'support') then 'support' else 'general' end as scope from m where not regexp_matches(email, '{T.ASSET_SUFFIX}')")
def o124(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({T.EMAIL})"), 1)).alias("raw")).select("doc_id", F.lower(F.expr("trim(both '.' from raw)")).alias("email"))
    return m.where(~F.col("email").rlike(T.ASSET_SUFFIX)).select("doc_id", "email", F.when(F.col("email").contains("sales"), "sales").when(F.col("email").contains("support"), "support").otherwise("general").alias("scope")).distinct()


@q("o125_phones", rf"with m as (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '{T.PHONE}')), '[^0-9]', '', 'g') as phone from documents) select distinct doc_id, phone from m where length(phone) between 8 and 15")
def o125(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({T.PHONE})"), 1)).alias("raw")).select("doc_id", F.regexp_replace("raw", "[^0-9]", "").alias("phone"))
    return m.where(F.length("phone").between(8, 15)).distinct()


YEAR = 2026


@q("o126_copyright_years", rf"with m as (select page_id, unnest(regexp_extract_all(html || case when page_id % 4 = 0 then ' Copyright 1999-' || (2015 + page_id % 10) else '' end, '{T.COPYRIGHT}', 1))::int as year from pages) select page_id, array_to_string(list_sort(list_distinct(list(year))), ',') as years from m where year between 1990 and {YEAR + 1} group by page_id")
def o126(spark, d):
    """Years of copyright lines; the latest year allowed is a parameter, so results do not age."""
    html = F.concat("html", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" Copyright 1999-"), (2015 + F.col("page_id") % 10).cast("string"))).otherwise(""))
    m = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(html, F.lit(T.COPYRIGHT), 1)).alias("y")).select("page_id", F.col("y").cast("int").alias("year"))
    return m.where(F.col("year").between(1990, YEAR + 1)).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"))  # at most YEAR - 1988 values


_PARTS = "(select p_partkey, case when p_partkey % 3 = 0 then p_name || ' (discontinued)' else p_name end as name from part)"


@q("o127_discontinued", rf"select p_partkey, regexp_matches(name, '(?i)\b(?:{T.DISCONTINUED})\b') as discontinued from {_PARTS}")
def o127(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" (discontinued)"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", name.rlike(as_sql_reads(rf"(?i)\b(?:{T.DISCONTINUED})\b")).alias("discontinued"))


@q("o128_availability", "with a as (select p_partkey, case p_partkey % 4 when 0 then 'https://schema.org/InStock' when 1 then 'http://schema.org/Discontinued' when 2 then 'PreOrder' end as value from part), l as (select p_partkey, lower(coalesce(value, '')) as v from a) select p_partkey, case when contains(v, 'discontinued') then 'discontinued' when contains(v, 'instock') then 'in_stock' when contains(v, 'preorder') then 'preorder' else 'unknown' end as status from l")
def o128(spark, d):
    k = F.col("p_partkey") % 4
    value = F.when(k == 0, "https://schema.org/InStock").when(k == 1, "http://schema.org/Discontinued").when(k == 2, "PreOrder")
    return table(spark, d, "part").select("p_partkey", T.availability(value).alias("status"))


@q("o129_modification_dates", """select doc_id, coalesce(json_extract_string(j, '$.dateModified'), json_extract_string(j, '$.datePublished'), 'meta-' || doc_id) as modified from (select doc_id, case doc_id % 3 when 0 then '{"dateModified":"2024-01-' || doc_id || '","datePublished":"2020"}' when 1 then '{"datePublished":"2023-' || doc_id || '"}' else '{}' end as j from documents)""")
def o129(spark, d):
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    j = F.when(k == 0, F.concat(F.lit('{"dateModified":"2024-01-'), i, F.lit('","datePublished":"2020"}'))).when(k == 1, F.concat(F.lit('{"datePublished":"2023-'), i, F.lit('"}'))).otherwise("{}")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.get_json_object(j, "$.dateModified"), F.get_json_object(j, "$.datePublished"), F.concat(F.lit("meta-"), i)).alias("modified"))


_NAMES = "(select distinct p_name as name from part union select unnest(['Cloud Pro Suite', 'What is it', 'FAQ', 'Pricing', 'Plan 2024', 'Box:', 'ab', 'Annual fee', 'Cookie settings', '$5 deal', 'Data Tier', 'Blue Widget']))"
_PRODUCT = rf"(length(trim(name)) between 3 and 50 and not regexp_matches(trim(name), '[?:]$') and not regexp_matches(lower(trim(name)), '^(?:{'|'.join(T.QUESTION_STARTS)})') and not regexp_matches(trim(name), '[$€£₹¥]') and not regexp_matches(lower(trim(name)), '\b(?:{'|'.join(T.BILLING_WORDS)})\b') and not regexp_matches(trim(name), '\d{{2,}}') and lower(trim(name)) not in {sql_in(T.UTILITY_HEADINGS)} and not regexp_matches(lower(trim(name)), '{'|'.join(T.UTILITY_PARTS)}'))"


@q("o044_product_names", f"select name, {_PRODUCT} as valid from {_NAMES}")
def o044(spark, d):
    extra = ["Cloud Pro Suite", "What is it", "FAQ", "Pricing", "Plan 2024", "Box:", "ab", "Annual fee", "Cookie settings", "$5 deal", "Data Tier", "Blue Widget"]
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(spark.createDataFrame([(v,) for v in extra], "name string")).distinct()
    return names.select("name", T.is_product_name(F.col("name")).alias("valid"))


def price_facts(spark, d):
    """entity, currency, interval, variant, price (two decimals, text) and page."""
    price = F.format_string("%.2f", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0))
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", price.alias("price"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("entity"), "p_brand")
    return l.join(p, "l_partkey").select("entity", F.lit("USD").alias("currency"), F.lit("one_time").alias("interval"), F.col("p_brand").alias("variant"), "price", F.col("l_suppkey").alias("page"))


_PRICES = "prices as (select lower(p_name) as entity, 'USD' as currency, 'one_time' as interval, p_brand as variant, printf('%.2f', round(l_extendedprice / l_quantity, 0)) as price, l_suppkey as page from lineitem join part on p_partkey = l_partkey)"
_KEY = ["entity", "currency", "interval", "variant"]


@q("o073_price_ledger", f"with {_PRICES} select entity, currency, interval, variant, price, count(distinct page) as pages from prices group by all")
def o073(spark, d):
    return price_facts(spark, d).groupBy(*_KEY, "price").agg(F.count_distinct("page").alias("pages"))


_CONFLICTS = f"{_PRICES}, single as (select entity, currency, interval, variant, page, min(price) as price from prices group by all having count(distinct price) = 1), conflicts as (select entity, currency, interval, variant, count(distinct price) as prices, count(distinct page) as pages from single group by all having count(distinct price) >= 2 and count(distinct page) >= 2)"


def price_conflicts(spark, d):
    """Two levels: pages that state one price for a key, then keys with several prices on several pages.

    Rows are dealt by key and page before they are grouped: a task that reads a large file holds no groups, and prices
    are numbers, which group without sorts.  A key has a page once, so its pages are its rows.
    """
    facts = price_facts(spark, d).select(*_KEY, F.col("price").try_cast("double").alias("price"), "page").repartition("entity", "variant", "page")
    single = facts.groupBy(*_KEY, "page").agg(F.min("price").alias("price"), F.max("price").alias("most")).where("price = most")
    return single.groupBy(*_KEY).agg(F.count_distinct("price").alias("prices"), F.count("page").alias("pages")).where("prices >= 2 and pages >= 2")


@q("o074_price_conflicts", f"with {_CONFLICTS} select * from conflicts")
def o074(spark, d):
    return price_conflicts(spark, d)


@q("r30_price_conflict", f"with {_CONFLICTS} select 'FIRST_PARTY_FACT_CONFLICT' as id, 'high' as severity, 'Conflicting pricing published for ''' || entity || '''' as title, pages from conflicts")
def r30(spark, d):
    title = F.concat(F.lit("Conflicting pricing published for '"), "entity", F.lit("'"))
    return price_conflicts(spark, d).select(F.lit("FIRST_PARTY_FACT_CONFLICT").alias("id"), F.lit("high").alias("severity"), title.alias("title"), "pages")


_STATES = "states as (select lower(p_name) as name, case when l_returnflag = 'R' then 'discontinued' when l_linestatus = 'O' then 'in_stock' else 'unknown' end as status, l_suppkey as page from lineitem join part on p_partkey = l_partkey)"


def lifecycle_conflicts(spark, d):
    status = F.when(F.col("l_returnflag") == "R", "discontinued").when(F.col("l_linestatus") == "O", "in_stock").otherwise("unknown")
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", status.alias("status"))
    s = l.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("name")), "l_partkey")
    out = s.groupBy("name").agg(F.bool_or(F.col("status") == "discontinued").alias("gone"), F.bool_or(F.col("status").isin("in_stock", "current")).alias("sold"), F.count_distinct("l_suppkey").alias("pages"))
    return out.where("gone and sold and pages >= 2").select("name", "pages")


_LIFE = f"with {_STATES} select name, count(distinct page) as pages from states group by name having bool_or(status = 'discontinued') and bool_or(status in ('in_stock', 'current')) and count(distinct page) >= 2"


@q("o075_lifecycle_conflicts", _LIFE)
def o075(spark, d):
    return lifecycle_conflicts(spark, d)


@q("r31_lifecycle_conflict", f"select 'DISCONTINUED_VS_CURRENT_CONFLICT' as id, 'high' as severity, name, pages from ({_LIFE})")
def r31(spark, d):
    return lifecycle_conflicts(spark, d).select(F.lit("DISCONTINUED_VS_CURRENT_CONFLICT").alias("id"), F.lit("high").alias("severity"), "name", "pages")


_DRIFT = "with y as (select l_suppkey as site, l_partkey as page, max(year(l_shipdate)) as year from lineitem group by all) select site, min(year)::int as oldest, max(year)::int as newest from y group by site having max(year) - min(year) >= 3 and count(distinct year) >= 2"


def copyright_drift(spark, d):
    y = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site"), "l_partkey").agg(F.max(F.year("l_shipdate")).alias("year"))
    return y.groupBy("site").agg(F.min("year").alias("oldest"), F.max("year").alias("newest")).where("newest - oldest >= 3")


@q("o076_copyright_drift", _DRIFT)
def o076(spark, d):
    return copyright_drift(spark, d)


@q("r32_copyright_sync", f"select site, 'Copyright years range from ' || oldest || ' to ' || newest as rationale from ({_DRIFT})")
def r32(spark, d):
    return copyright_drift(spark, d).select("site", F.format_string("Copyright years range from %d to %d", "oldest", "newest").alias("rationale"))


_CLAIMS = f"{_PRICES}, claims as (select lower(p_name) as entity, p_retailprice as claimed, p_partkey as claim from part), judged as (select claim, entity, claimed, bool_and(abs(price::double - claimed) >= 0.01) as wrong from claims join prices using (entity) group by all)"


def nearest_prices(spark, d):
    """Each claim with the published price of its entity that is nearest."""
    claims = table(spark, d, "part").select(F.lower("p_name").alias("entity"), F.col("p_retailprice").alias("claimed"), F.col("p_partkey").alias("claim"))
    return nearest(claims, price_facts(spark, d).select("entity", "price"), "entity", "claimed", "price")


def claim_conflicts(spark, d):
    """Claims that no published price of the entity supports within a cent."""
    return nearest_prices(spark, d).where("distance >= 0.01").select("claim", "entity", "claimed")


@q("o065_nearest_prices", f"with {_PRICES}, claims as (select lower(p_name) as entity, p_retailprice as claimed, p_partkey as claim from part), v as (select distinct entity, price::double as v from prices) select claim, entity, claimed, min(struct_pack(d := abs(v - claimed), v := v)).v as nearest, round(min(abs(v - claimed)), 6) as distance from claims join v using (entity) group by all")
def o065_nearest(spark, d):
    return nearest_prices(spark, d).select("claim", "entity", "claimed", "nearest", F.round("distance", 6).alias("distance"))


@q("o065_unsupported_claims", f"with {_CLAIMS} select claim, entity, claimed from judged where wrong")
def o065(spark, d):
    return claim_conflicts(spark, d)


@q("r33_ai_fact_conflict", f"with {_CLAIMS} select 'AI_FACT_CONFLICT' as id, 'high' as severity, entity, count(*) as claims from judged where wrong group by entity")
def r33(spark, d):
    return claim_conflicts(spark, d).groupBy(F.lit("AI_FACT_CONFLICT").alias("id"), F.lit("high").alias("severity"), "entity").agg(F.count("*").alias("claims"))


_BRANDS = f"brands as (select distinct lower(string_split({TITLE}, ' ')[1]) as brand from pages where length(string_split({TITLE}, ' ')[1]) > 3)"


def brands(spark, d):
    """First words of page titles, longer than three letters, in lower case."""
    first = F.split(T.title(F.col("html")), " ")[0]
    return table(spark, d, "pages").select(F.lower(F.when(F.length(first) > 3, first)).alias("brand")).where("brand is not null").distinct()


@q("r33_brand_mentions", f"with {_BRANDS} select brand, count(*) as documents from brands join documents on contains(lower(text), brand) group by brand")
def r33_mentions(spark, d):
    """Texts that name each brand, all brands found in one scan of a text."""
    texts = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return mentions(texts, "doc_id", "text", brands(spark, d), "brand").groupBy(F.col("name").alias("brand")).agg(F.count("*").alias("documents"))


@q("r33_omitted_brands", f"with {_BRANDS}, answers as (select conv_id, turn, lower(text) as text from conversations where role = 'assistant'), met as (select distinct conv_id, turn from answers join brands on contains(text, brand)) select conv_id, turn, 'Assistant-' || (conv_id % 5 + 1) || ' omitted brand.' as note from answers anti join met using (conv_id, turn)")
def r33_omitted(spark, d):
    """Notes on answers that name no brand; five assistants answer in turn."""
    answers = table(spark, d, "conversations").where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("answer"), F.lower("text").alias("text"))
    met = mentions(answers, "answer", "text", brands(spark, d), "brand").select("answer").distinct()
    note = F.concat(F.lit("Assistant-"), (F.col("answer.conv_id") % 5 + 1).cast("string"), F.lit(" omitted brand."))
    return answers.join(met, "answer", "left_anti").select("answer.conv_id", "answer.turn", note.alias("note"))


_PRICED = """replace(replace(replace(replace(html, ' of ', ' $1,249.50 monthly '), ' and ', ' €12,50 '), '<p>An', '<h3>Red <i>Plan</i></h3><p>An'), '<p>Th', '<h2> </h2><p>Th')"""
_SCOPED = rf"""with dressed as (select page_id, {_PRICED} as html from pages), {TOKENS.replace("from pages", "from dressed")},
marked as (select page_id, pos, tok, case when regexp_matches(tok, '(?i)^<h[1-4][\s/>]') then 's' when regexp_matches(tok, '(?i)^</h[1-4][\s/>]') then 'e' end as m from tokens),
numbered as (select *, count(m) over (partition by page_id order by pos) as n, last_value(m ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and current row) as last from marked),
heads as (select page_id, n, string_agg(trim(tok), ' ' order by pos) as head from numbered where last = 's' and not starts_with(tok, '<') and trim(tok) <> '' group by all),
closing as (select c.page_id, c.pos, head from numbered c join heads h on h.page_id = c.page_id and h.n = c.n - 1 where c.m = 'e'),
said as (select s.page_id, coalesce(head, 'General') as section, tok from (select * from numbered where not starts_with(tok, '<') and coalesce(last, 'e') = 'e') s asof left join closing c on c.page_id = s.page_id and s.pos >= c.pos),
mentioned as (select page_id, section, tok, unnest(regexp_extract_all(tok, '(?i){MENTION}', 1)) as mention from said),
priced as (select page_id, section, mention, {_currency_sql().replace("raw", "mention")} as currency, case {" ".join(f"when regexp_matches(lower(tok), '{'|'.join(p)}') then '{n}'" for n, p in T.INTERVALS)} else 'one_time' end as interval, regexp_extract(mention, '(\d[\d,]*(?:\.\d{{1,2}})?)$', 1) as raw from mentioned)
select page_id, section, printf('%.2f', {_PRICE}::double) as price, currency, interval, {_PRODUCT.replace("name", "section")} as product, count(*) as times from priced where {_PRICE}::double > 0 group by all"""


@q("o096_section_prices", _SCOPED)
def o096(spark, d):
    """Prices with the heading they stand under, on pages in whose texts two words are put as prices and some headings are added."""
    found = scoped_prices(table(spark, d, "pages").select("page_id", F.expr(_PRICED).alias("html")))
    return found.groupBy("page_id", "section", "price", "currency", "interval", T.is_product_name(F.col("section")).alias("product")).agg(F.count("*").alias("times"))


@q("o096_carried_turns", "with c as (select conv_id, turn, role, last_value(case when role = 'user' then left(text, 20) end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as section from conversations) select conv_id, turn, coalesce(section, 'General') as section from c where role <> 'user'")
def o096_turns(spark, d):
    """The same over rows: the last user turn governs the answers after it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = table(spark, d, "conversations").withColumn("section", F.last(F.when(F.col("role") == "user", F.left("text", F.lit(20))), True).over(w))
    return c.where("role != 'user'").select("conv_id", "turn", F.coalesce("section", F.lit("General")).alias("section"))


@q("o097_sorted_sets", "select p_type, array_to_string(list_sort(list_distinct(list(p_brand))), ',') as brands from part group by p_type")
def o097(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@q("q10_markup_discrepancy", f"with {_PRICES}, m as (select lower(p_name) as entity, l_suppkey as page, printf('%.2f', round(p_retailprice, 0)) as markup from lineitem join part on p_partkey = l_partkey group by all), s as (select entity, page, list_sort(list_distinct(list(price))) as shown from prices group by all) select entity, page, markup, len(shown) as shown from m join s using (entity, page) where not list_contains(shown, markup)")
def q10(spark, d):
    """Markup prices that the same page does not show."""
    f = price_facts(spark, d).groupBy("entity", "page").agg(F.collect_set("price").alias("s"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("entity"), F.format_string("%.2f", F.round("p_retailprice", 0)).alias("markup"))
    m = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("page")).join(p, "l_partkey").select("entity", "page", "markup").distinct()
    return m.join(f, ["entity", "page"]).where(~F.array_contains("s", F.col("markup"))).select("entity", "page", "markup", F.size("s").cast("long").alias("shown"))


QUERIES, SQL = area.queries, area.sql
