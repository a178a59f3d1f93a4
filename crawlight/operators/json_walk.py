"""Objects at any depth of JSON values, found level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlight.operators.structured import texts
from crawlight.sources.written import written


def objects(values: DataFrame, v: str) -> DataFrame:
    """The rows with ``node``: the value itself if it is an object, and every object within it.

    Each round opens the lists and objects that the last one found; a round's
    rows are written, so nothing is opened twice, and the rounds are as many as
    the deepest value has levels.  Null values have no objects.
    """
    kept = [c for c in values.columns if c != v]
    form = F.schema_of_variant("node")
    level = values.select(*kept, F.col(v).alias("node")).where(form.startswith("OBJECT") | form.startswith("ARRAY"))
    found = []
    while True:
        level = written(level, "json-level")
        if level.isEmpty():
            break
        found.append(level.where(form.startswith("OBJECT")))
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("node").outer())).select(*kept, F.col("value").alias("node"))
        level = inner.where(form.startswith("OBJECT") | form.startswith("ARRAY"))
    out = found[0] if found else level
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# Types whose identity must stay with the page's own name, and the properties that state it.
IDENTIFIED_TYPES = ["Product", "Offer", "AggregateOffer", "IndividualProduct"]
IDENTITIES = ["@id", "url"]


def identities(nodes: DataFrame) -> DataFrame:
    """The rows with property and target: where products and offers say they live, web addresses only."""
    typed = F.arrays_overlap(texts("node", "$['@type']"), F.array(*map(F.lit, IDENTIFIED_TYPES)))
    value = lambda p: F.expr(f"try_variant_get(node, \"$['{p}']\", 'string')")
    each = F.array(*(F.struct(F.lit(p).alias("property"), value(p).alias("target")) for p in IDENTITIES))
    kept = [c for c in nodes.columns if c != "node"]
    return nodes.where(typed).select(*kept, F.inline(each)).where(F.col("target").rlike("^https?://"))
