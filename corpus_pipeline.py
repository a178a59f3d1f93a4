"""A training corpus in five stages: quality, exact copies, near copies, mixing, packing.

Every stage works on all rows its predecessor kept.  All but the last return
rows of ``documents`` as they came, extra columns included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlight.llm.common import discard, discard_since, mark, written
from crawlight.llm.exact_dedup import exact_dedup
from crawlight.llm.jaccard_join import jaccard_components
from crawlight.llm.mixing import mix_documents
from crawlight.llm.packing import pack_documents
from crawlight.llm.quality import fit_quality, keep_quality

#: Documents that score below are rejected.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores LEAST_QUALITY or more; rows of null id or text are scored like any other."""
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), LEAST_QUALITY)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id, null included, is not among ``gone.gone_id``; rows of null id meet no join."""
    kept = docs.where("doc_id is not null").join(gone.hint("merge"), docs["doc_id"] == gone["gone_id"], "left_anti")
    return kept.unionByName(docs.where("doc_id is null")) if gone.where("gone_id is null").isEmpty() else kept


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text the one with the largest id; of those with that id too, one."""
    found = written(exact_dedup(docs, keep="largest"), "pipeline-exact")
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    out = _without(docs, rows.where("k = 0").select(F.col("doc_id").alias("gone_id")))
    several = rows.where("n > 1 and k > 0").select(F.col("doc_id").alias("gone_id"))
    if several.isEmpty():
        return out
    # ids that several rows have: their rows are told apart by text, of equal ones one stays
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256")).distinct()
    mixed = docs.join(several.hint("merge"), docs["doc_id"].eqNullSafe(several["gone_id"]), "left_semi").withColumn("_sha256", digest)
    mixed = mixed.join(kept, mixed["doc_id"].eqNullSafe(kept["kept_id"]) & (mixed["_sha256"] == kept["kept_sha256"]), "left_semi")
    return _without(out, several).unionByName(mixed.dropDuplicates(["doc_id", "_sha256"]).drop("_sha256"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; rows of null id stay."""
    found = jaccard_components(docs)
    return _without(docs, found.where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows sampled so that sources, languages and topics meet their targets."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixing", mixing), ("packing", packing)]

#: Training, raking and packing have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        start, before = mark(), docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            discard_since(spark, start, docs)  # what the stage wrote for itself
            if k:
                discard(before)
    return docs
