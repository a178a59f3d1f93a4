"""Evidence references against an index of the artifacts' paths.

Artifacts are taken apart once into (artifact, path, value); references then
meet their path by a join, so an artifact is parsed once however many
references it has.  A reference to an artifact that holds most of them meets
it by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlight.operators.skew import keyed_join
from crawlight.plans import catalogue as C

#: Steps of a path that are indexed.
MOST_DEPTH = 6


def path_index(artifacts: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """artifact, path, value of (artifact, body): every value of the JSON, texts as they stand, all else as JSON.

    Paths are written as locators are: a.b[2].c.  Bodies that are no JSON have none.
    """
    spark = artifacts.sparkSession
    rows = artifacts.select("artifact", F.lit("").alias("path"), F.try_parse_json("body").alias("v")).where("v is not null")
    out = None
    for _ in range(depth):
        holds = rows.where(F.schema_of_variant("v").rlike("^(?:OBJECT|ARRAY)"))
        parts = holds.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        named = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(named)
        rows = parts.select("artifact", step.alias("path"), F.col("value").alias("v"))
        out = rows if out is None else out.unionByName(rows)
    value = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v"))
    return out.select("artifact", "path", value.alias("value"))


def resolved(references: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The (artifact, locator, quote, ...) rows with ``outcome``: artifact_missing, locator_grammar, locator_unresolved, quote_missing, quote_not_found or ok.

    Both sides are dealt by their whole rows first, so that a task that reads a large file does not group all of its paths.
    """
    references, artifacts = references.repartition(*references.columns), artifacts.select("artifact", "body").repartition("artifact", "body")
    known = artifacts.groupBy("artifact").agg(F.lit(True).alias("_known"))
    index = path_index(artifacts).groupBy("artifact", F.col("path").alias("locator")).agg(F.min("value").alias("_value"))
    out = keyed_join(keyed_join(references, known, ["artifact"], "left"), index, ["artifact", "locator"], "left")
    quote = F.coalesce(F.col("quote"), F.lit(""))
    outcome = (
        F.when(F.col("_known").isNull(), "artifact_missing").when(~F.coalesce(F.col("locator").rlike(f"^(?:{C.LOCATOR})$"), F.lit(False)), "locator_grammar").when(F.col("_value").isNull(), "locator_unresolved")
        .when(quote == "", "quote_missing").when(~F.contains("_value", quote), "quote_not_found").otherwise("ok")
    )
    return out.withColumn("outcome", outcome).drop("_known", "_value")
