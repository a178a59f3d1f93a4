"""Structured data: JSON-LD nodes, references between them, microdata, answerability.

Nodes come from JSON text through the variant type; a malformed block gives
none.  A ``@type`` or ``sameAs`` that is text, list or object is normalised to
an array once, here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlight.sources.written import written


def _exploded(df: DataFrame, v: Column) -> DataFrame:
    """The rows with pos, key and value of a variant's entries."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(v.outer()))


def nodes(blocks: DataFrame) -> DataFrame:
    """page_id, pos, node of (page_id, body): lists and @graph are flattened."""
    b = blocks.select("page_id", F.try_parse_json("body").alias("v")).where("v is not null")
    form = F.schema_of_variant("v")
    listed = _exploded(b.where(form.startswith("ARRAY")), F.col("v")).select("page_id", F.col("pos").alias("k"), F.col("value").alias("v"))
    items = b.where(form.startswith("OBJECT")).select("page_id", F.lit(0).alias("k"), "v").unionByName(listed)
    items = items.withColumn("graph", F.try_variant_get("v", "$['@graph']", "variant"))
    inner = _exploded(items.where("graph is not null"), F.col("graph")).select("page_id", (F.col("k") * 1000 + F.col("pos")).alias("pos"), F.col("value").alias("node"))
    out = items.where("graph is null").select("page_id", F.col("k").alias("pos"), F.col("v").alias("node")).unionByName(inner)
    return out.where(F.schema_of_variant("node").startswith("OBJECT"))


# Properties that may refer to another node.
RELATIONS = ["brand", "manufacturer", "publisher", "provider", "author", "organizer"]


def references(n: DataFrame) -> DataFrame:
    """page_id, node_id, relation, target_id of every node that refers to another by @id."""
    each = F.array_compact(F.array(*(F.when(F.try_variant_get("node", f"$.{r}['@id']", "string").isNotNull(), F.struct(F.lit(r).alias("relation"), F.trim(F.try_variant_get("node", f"$.{r}['@id']", "string")).alias("target_id"))) for r in RELATIONS)))
    return n.select("page_id", F.trim(F.try_variant_get("node", "$['@id']", "string")).alias("node_id"), F.inline(each)).where("node_id is not null")


def closure(edges: DataFrame, most: int = 8) -> DataFrame:
    """page_id, node_id, target_id, depth: what a node leads to over any number of references up to ``most``, by the shortest way.

    Ways double in every round.  A way that comes back to its node is cut, so cycles end.
    """
    reach = edges.where("node_id != target_id").select("page_id", "node_id", "target_id", F.lit(1).alias("depth")).distinct()
    length = 1
    while length < most:
        reach = written(reach, "references")  # each round reads the last one three times
        more = reach.select("page_id", F.col("node_id").alias("target_id"), F.col("target_id").alias("_far"), F.col("depth").alias("_more"))
        longer = reach.join(more, ["page_id", "target_id"]).select("page_id", "node_id", F.col("_far").alias("target_id"), (F.col("depth") + F.col("_more")).alias("depth"))
        reach = reach.unionByName(longer.where("node_id != target_id")).groupBy("page_id", "node_id", "target_id").agg(F.min("depth").alias("depth"))
        length *= 2
    return reach.where(F.col("depth") <= most)


def field(node: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({node}, \"{path}\", '{kind}')")


def texts(node: str, path: str) -> Column:
    """A text, a list of texts or an object's @id as array of texts."""
    listed = field(node, path, "array<string>")
    plain = F.expr(f"case when schema_of_variant(try_variant_get({node}, \"{path}\")) = 'STRING' then try_variant_get({node}, \"{path}\", 'string') end")
    reference = field(node, path + "['@id']")
    return F.coalesce(listed, F.array_compact(F.array(F.coalesce(plain, reference))))


def entities(n: DataFrame) -> DataFrame:
    """Scalars of each node: id, types (lower case), name, sku, price, currency, availability, offer reference, description."""
    offers = "coalesce(try_variant_get(node, '$.offers[0]'), try_variant_get(node, '$.offers'))"
    n = n.withColumn("offer", F.expr(offers))
    return n.select(
        "page_id", "pos", field("node", "$['@id']").alias("node_id"), F.transform(texts("node", "$['@type']"), F.lower).alias("types"), field("node", "$.name").alias("name"), field("node", "$.sku").alias("sku"),
        F.coalesce(field("offer", "$.price"), field("offer", "$.lowPrice")).alias("price"), F.upper(F.coalesce(field("offer", "$.priceCurrency"), F.lit("UNKNOWN"))).alias("currency"), field("offer", "$.availability").alias("availability"),
        field("offer", "$['@id']").alias("offer_id"), field("node", "$.itemOffered['@id']").alias("item_id"), field("node", "$.description").alias("description"), texts("node", "$.sameAs").alias("same_as"),
        field("node", "$.price").alias("node_price"), field("node", "$.availability").alias("node_availability"),
    )


def has_type(types: Column, *wanted: str) -> Column:
    return F.arrays_overlap(types, F.array(*(F.lit(w.lower()) for w in wanted)))


def resolved_offers(e: DataFrame) -> DataFrame:
    """Products with price and availability from their own offer, one they refer to, or one that refers to them."""
    product, offer = e.where(has_type(F.col("types"), "Product")), e.where(has_type(F.col("types"), "Offer", "AggregateOffer"))
    own = offer.select("page_id", F.col("node_id").alias("offer_id"), F.col("node_price").alias("ref_price"), F.col("node_availability").alias("ref_availability"), "item_id")
    forward = own.where("offer_id is not null").groupBy("page_id", "offer_id").agg(F.min("ref_price").alias("f_price"), F.min("ref_availability").alias("f_availability"))
    inverse = own.where("item_id is not null").groupBy("page_id", F.col("item_id").alias("node_id")).agg(F.min("ref_price").alias("i_price"), F.min("ref_availability").alias("i_availability"))
    out = product.join(forward, ["page_id", "offer_id"], "left").join(inverse, ["page_id", "node_id"], "left")
    return out.select("page_id", "node_id", "name", F.coalesce("price", "f_price", "i_price").alias("price"), F.coalesce("availability", "f_availability", "i_availability").alias("availability"), "description")


def microdata(pages: DataFrame) -> DataFrame:
    """page_id, item_type, property, value of non-nested itemscope elements; closing tags match their opening ones."""
    item = F.regexp_extract_all("html", F.lit(r"(?is)(<(\w+)[^>]*\bitemscope\b[^>]*>.*?</\2>)"), 1)
    i = pages.select("page_id", F.explode(item).alias("item"))
    i = i.select("page_id", F.regexp_extract("item", r"(?is)\bitemtype=[\"'](?:https?://schema\.org/)?([^\"']+)", 1).alias("item_type"), F.explode(F.regexp_extract_all("item", F.lit(r"(?is)(<\w+[^>]*\bitemprop=[\"'][^\"']+[\"'][^>]*>[^<]*)"), 1)).alias("p"))
    value = F.coalesce(F.nullif(F.regexp_extract("p", r"(?is)\bcontent=[\"']([^\"']*)", 1), F.lit("")), F.trim(F.regexp_extract("p", "(?s)>([^<]*)$", 1)))
    return i.select("page_id", "item_type", F.regexp_extract("p", r"(?is)\bitemprop=[\"']([^\"']+)", 1).alias("property"), value.alias("value"))


def answerability(price: Column, availability: Column, specification: Column, description: Column) -> Column:
    """Weighted presence of what a buyer asks for."""
    return price.cast("int") * 0.25 + availability.cast("int") * 0.25 + specification.cast("int") * 0.20 + description.cast("int") * 0.30
