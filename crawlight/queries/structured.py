"""JSON-LD graphs, identity and answerability rules, corroboration.

Blocks are made from parts, suppliers and nations: products with an offer of
their own, by reference or by inverse reference, organisations with sameAs
links, and malformed blocks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.functions import urls as U
from crawlight.operators import structured as S
from crawlight.queries.registry import Area
from crawlight.queries.sqlbits import NETLOC, TITLE
from crawlight.sources.tables import table

area = Area()
q = area.query

#: A JSON-LD block of a part, as SQL text that both engines read alike (single quotes, || only).
_BODY = """case when p_partkey % 7 = 0 then '{"@type":"Product","name":' when p_partkey % 7 = 1 then '[{"@type":["Product","Thing"],"@id":"p' || p_partkey || '","name":"' || p_name || '","offers":{"@id":"o' || p_partkey || '"}},{"@type":"Offer","@id":"o' || p_partkey || '","price":"' || p_size || '.50","availability":"https://schema.org/InStock"}]'
 when p_partkey % 7 = 2 then '{"@graph":[{"@type":"Product","@id":"p' || p_partkey || '","name":"' || p_name || '"},{"@type":"Offer","@id":"x","price":"' || p_size || '","availability":"Discontinued","itemOffered":{"@id":"p' || p_partkey || '"}}]}'
 when p_partkey % 7 = 3 then '{"@type":"Organization","name":"' || p_brand || '","sameAs":["https://en.wikipedia.org/wiki/' || p_partkey || '","ftp://no"]}'
 when p_partkey % 7 = 4 then '{"@type":"Organization","@id":"https://other.example.org/#org","name":"' || p_brand || '","sameAs":"https://www.wikidata.org/' || p_size || '"}'
 else '{"@type":"Product","@id":"p' || p_partkey || '","name":"' || p_name || '","sku":"S' || p_size || '","description":"' || p_type || '","offers":[{"price":"' || p_size || '.00","priceCurrency":"usd","availability":"https://schema.org/PreOrder"}]}' end"""


def blocks(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.expr(_BODY).alias("body"))


def entities(spark, d):
    return S.entities(S.nodes(blocks(spark, d)))


_NODES = f"""blocks as (select p_partkey as page_id, {_BODY} as body from part), good as (select page_id, body::json as v from blocks where json_valid(body)),
items as (select page_id, case when json_type(v) = 'ARRAY' then unnest(from_json(v, '["json"]')) else v end as v from good where json_type(v) = 'ARRAY' union all select page_id, v from good where json_type(v) = 'OBJECT'),
nodes as (select page_id, v from items where json_extract(v, '$."@graph"') is null union all select page_id, unnest(from_json(json_extract(v, '$."@graph"'), '["json"]')) from items where json_extract(v, '$."@graph"') is not null),
typed as (select page_id, v, case json_type(v, '$."@type"') when 'ARRAY' then list_transform(from_json(json_extract(v, '$."@type"'), '["varchar"]'), lambda x: lower(x)) else [lower(json_extract_string(v, '$."@type"'))] end as types,
    case when json_type(v, '$.offers') = 'ARRAY' then json_extract(v, '$.offers[0]') else json_extract(v, '$.offers') end as offer,
    case json_type(v, '$.sameAs') when 'ARRAY' then from_json(json_extract(v, '$.sameAs'), '["varchar"]') when 'VARCHAR' then [json_extract_string(v, '$.sameAs')] else [] end as same_as from nodes),
entities as (select page_id, types, same_as, json_extract_string(v, '$."@id"') as node_id, json_extract_string(v, '$.name') as name, json_extract_string(v, '$.sku') as sku, json_extract_string(v, '$.description') as description,
    json_extract_string(offer, '$.price') as price, upper(coalesce(json_extract_string(offer, '$.priceCurrency'), 'UNKNOWN')) as currency, json_extract_string(offer, '$.availability') as availability, json_extract_string(offer, '$."@id"') as offer_id,
    json_extract_string(v, '$.itemOffered."@id"') as item_id, json_extract_string(v, '$.price') as node_price, json_extract_string(v, '$.availability') as node_availability from typed)"""


@q("o142_jsonld_nodes", f"with {_NODES} select page_id, count(*) as nodes from entities group by page_id")
def o142(spark, d):
    return S.nodes(blocks(spark, d)).groupBy("page_id").agg(F.count("*").alias("nodes"))


@q("o144_type_match", f"with {_NODES} select page_id, coalesce(node_id, '') as node_id, array_to_string(list_sort(types), ',') as types, list_has_any(types, ['organization', 'corporation', 'localbusiness']) as is_organization from entities")
def o144(spark, d):
    return entities(spark, d).select("page_id", F.coalesce("node_id", F.lit("")).alias("node_id"), F.array_join(F.array_sort("types"), ",").alias("types"), S.has_type(F.col("types"), "Organization", "Corporation", "LocalBusiness").alias("is_organization"))


_FORWARD = "with {nodes}, offers as (select * from entities where list_has_any(types, ['offer', 'aggregateoffer'])), f as (select page_id, node_id as offer_id, min(node_price) as f_price, min(node_availability) as f_av from offers where node_id is not null group by all), i as (select page_id, item_id as node_id, min(node_price) as i_price, min(node_availability) as i_av from offers where item_id is not null group by all), resolved as (select p.page_id, p.node_id, p.name, coalesce(p.price, f_price, i_price) as price, coalesce(p.availability, f_av, i_av) as availability, p.description, p.sku from entities p left join f using (page_id, offer_id) left join i on i.page_id = p.page_id and i.node_id = p.node_id where list_contains(p.types, 'product'))".replace("{nodes}", _NODES)


@q("o062_graph_references", f"{_FORWARD} select page_id, name, price, availability from resolved")
def o062(spark, d):
    return S.resolved_offers(entities(spark, d)).select("page_id", "name", "price", "availability")


#: Nodes that refer to each other, some in a circle; as SQL text that both engines read alike.
_LINKED = """'[{"@type":"Product","@id":"p' || p_partkey || '","brand":{"@id":"b' || p_size || '"},"manufacturer":{"@id":" m "}},{"@id":"b' || p_size || '","@type":"Brand","publisher":{"@id":"o"},"author":{"name":"none"}},{"@id":"o","@type":"Organization","name":"' || p_brand || '","organizer":{"@id":"a"},"provider":{"@id":"o"}},{"@id":"a","name":"' || p_type || '"' || case when p_partkey % 3 = 0 then ',"provider":{"@id":"p' || p_partkey || '"}' else '' end || '}]'"""
_RELATED = ", ".join(f"'{r}'" for r in S.RELATIONS)


@q("o062_reference_closure", rf"""with recursive blocks as (select p_partkey as page_id, ({_LINKED})::json as v from part), nodes as (select page_id, unnest(from_json(v, '["json"]')) as n from blocks),
edges as (select distinct page_id, trim(json_extract_string(n, '$."@id"')) as a, trim(json_extract_string(n, '$.' || r || '."@id"')) as b from nodes, unnest([{_RELATED}]) as t(r) where json_extract_string(n, '$.' || r || '."@id"') is not null),
reach(page_id, a, b, depth) as (select page_id, a, b, 1 from edges where a <> b union select r.page_id, r.a, e.b, r.depth + 1 from reach r join edges e on e.page_id = r.page_id and e.a = r.b where e.b <> r.a and e.a <> e.b and r.depth < 8)
select page_id, a as node_id, b as target_id, min(depth)::int as depth from reach group by all""")
def o062_closure(spark, d):
    """Everything that a node's brand, publisher and so on lead to."""
    b = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.expr(_LINKED).alias("body"))
    return S.closure(S.references(S.nodes(b)))


@q("o063_inverse_references", f"with {_NODES}, i as (select page_id, item_id as node_id, min(node_price) as price, min(node_availability) as availability from entities where list_has_any(types, ['offer', 'aggregateoffer']) and item_id is not null group by all) select page_id, p.name, i.price, i.availability from entities p join i using (page_id, node_id) where list_contains(p.types, 'product')")
def o063(spark, d):
    """Products that an offer names as its item."""
    e = entities(spark, d)
    offers = e.where(S.has_type(F.col("types"), "Offer", "AggregateOffer") & F.col("item_id").isNotNull()).groupBy("page_id", F.col("item_id").alias("node_id"))
    offers = offers.agg(F.min("node_price").alias("price"), F.min("node_availability").alias("availability"))
    return e.where(S.has_type(F.col("types"), "Product")).select("page_id", "node_id", "name").join(offers, ["page_id", "node_id"]).select("page_id", "name", "price", "availability")


@q("o084_answerability", f"{_FORWARD} select page_id, name, round_even((price is not null)::int * 0.25::double + (availability is not null)::int * 0.25::double + (name is not null)::int * 0.2::double + (coalesce(description, '') <> '')::int * 0.3::double, 2) as score from resolved")
def o084(spark, d):
    r = S.resolved_offers(entities(spark, d))
    score = S.answerability(F.col("price").isNotNull(), F.col("availability").isNotNull(), F.col("name").isNotNull(), F.coalesce("description", F.lit("")) != "")
    return r.select("page_id", "name", F.bround(score.cast("double"), 2).alias("score"))


@q("o102_missing_attributes", f"{_FORWARD} select page_id, concat_ws(',', case when price is null then 'price' end, case when availability is null then 'availability' end, case when description is null then 'description' end) as missing from resolved")
def o102(spark, d):
    r = S.resolved_offers(entities(spark, d))
    return r.select("page_id", F.concat_ws(",", *(F.when(F.col(c).isNull(), c) for c in ("price", "availability", "description"))).alias("missing"))


@q("r21_attribute_incompleteness", f"{_FORWARD} select page_id, 'ATTRIBUTE_INCOMPLETENESS' as id, 'medium' as severity from resolved where price is null or availability is null or description is null")
def r21(spark, d):
    r = S.resolved_offers(entities(spark, d)).where("price is null or availability is null or description is null")
    return r.select("page_id", F.lit("ATTRIBUTE_INCOMPLETENESS").alias("id"), F.lit("medium").alias("severity"))


_SAME = f"with {_NODES}, s as (select page_id, unnest(same_as) as link from entities), links as (select distinct page_id, link from s where regexp_matches(link, '^https?://'))"


def same_as(spark, d):
    e = entities(spark, d).select("page_id", F.explode("same_as").alias("link"))
    return e.where(F.col("link").rlike("^https?://")).distinct()


@q("o146_same_as", f"{_SAME} select page_id, array_to_string(list_sort(list(link)), ' ') as links from links group by page_id")
def o146(spark, d):
    return same_as(spark, d).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("link")), " ").alias("links"))


@q("r40_same_as_missing", f"{_SAME} select distinct page_id, 'SAME_AS_MISSING' as id from entities anti join links using (page_id)")
def r40(spark, d):
    return entities(spark, d).select("page_id").distinct().join(same_as(spark, d), "page_id", "left_anti").select("page_id", F.lit("SAME_AS_MISSING").alias("id"))


_MICRO = "'<div itemscope itemtype=\"https://schema.org/Product\"><span itemprop=\"sku\">ECS-' || p_partkey || '</span><meta itemprop=\"name\" content=\"' || p_name || '\"></div>'"


@q("o145_microdata", "select p_partkey as page_id, 'Product' as item_type, unnest(['sku', 'name']) as property, unnest(['ECS-' || p_partkey, p_name]) as value from part")
def o145(spark, d):
    return S.microdata(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.expr(_MICRO).alias("html")))


@q("o069_without_schema", f"with {_NODES} select p_partkey as page_id from part where p_partkey not in (select page_id from entities where list_contains(types, 'product'))")
def o069(spark, d):
    e = entities(spark, d).where(S.has_type(F.col("types"), "Product")).select("page_id").distinct()
    return table(spark, d, "part").select(F.col("p_partkey").alias("page_id")).join(e, "page_id", "left_anti")


@q("o101_type_intersection", f"with {_NODES} select page_id, len(list_intersect(types, ['product', 'thing', 'offer']))::int as shared from entities")
def o101(spark, d):
    return entities(spark, d).select("page_id", F.size(F.array_intersect("types", F.array(*map(F.lit, ["product", "thing", "offer"])))).alias("shared"))


QUERIES, SQL = area.queries, area.sql
