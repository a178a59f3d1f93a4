"""Places within groups of any size, and digests of ordered groups.

A group that holds most rows would be one task of a window.  Here groups are
cut into ranges of the order: bounds come from a sample drawn by a hash of the
order, so they are the same whenever they are drawn; a row's place is its rank
within its range plus the rows of the ranges before.  Only groups of more than
RANGE rows have bounds at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlight.sources.written import written

#: Rows that a range has, about, and rows drawn for a bound.
RANGE, DRAWN = 1 << 20, 16


def bounds(table: DataFrame, group: str, order: str, size: int = RANGE) -> DataFrame:
    """group, bounds: the order values at which ranges of about ``size`` rows begin; groups of one range are left out.

    DRAWN rows are drawn for every ``size`` of the table, so there are about rows / size values in all.
    """
    drawn = table.where(F.pmod(F.xxhash64(order), F.lit(max(1, size // DRAWN))) == 0)
    lists = drawn.groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("drawn"), F.count("*").alias("n")).where(F.col("n") > DRAWN)
    return lists.select(group, F.transform(F.sequence(F.lit(DRAWN), F.col("n") - 1, F.lit(DRAWN)), lambda k: F.get("drawn", k.cast("int"))).alias("bounds"))


def placed(df: DataFrame, group: str, order: list[Column], name: str = "place", size: int = RANGE) -> DataFrame:
    """The rows with their place, from 1, in the ascending order of the columns within their group.

    Rows that are equal in all of ``order`` have places in any order, but are in one range.
    """
    table = written(df.withColumn("_order", F.struct(*(c.alias(f"c{k}") for k, c in enumerate(order)))), "ranks")
    if table.count() <= size:  # no group can have two ranges
        local = F.row_number().over(Window.partitionBy(group).orderBy("_order"))
        return table.withColumn(name, local.cast("long")).drop("_order")
    cut = bounds(table, group, "_order", size).withColumnRenamed(group, "_group")
    met = table.join(F.broadcast(cut), table[group].eqNullSafe(cut["_group"]), "left").drop("_group")
    below = F.size(F.filter(F.coalesce("bounds", F.array().cast(cut.schema["bounds"].dataType)), lambda b: b <= F.col("_order")))
    met = met.withColumn("_range", below).drop("bounds")
    local = met.withColumn("_local", F.row_number().over(Window.partitionBy(group, "_range").orderBy("_order")).cast("long"))
    counts = met.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)))
    # ranges after a group's first are as many as the bounds
    before = before.where("_of > 0").drop("n")
    out = local.join(F.broadcast(before), local[group].eqNullSafe(before["_group"]) & (local["_range"] == before["_of"]), "left")
    return out.withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_order", "_range", "_local", "_before", "_group", "_of")


#: Items whose digests are taken together.
BLOCK = 4096


def digest_of_digests(ranked: DataFrame, group: str, item: str, place: str = "place", block: int = BLOCK) -> DataFrame:
    """group, items, fingerprint: SHA-256 over the digests of the group's blocks.

    A block is ``block`` items of consecutive places; its digest is the SHA-256 of their texts in order, joined by
    commas, and the fingerprint that of the blocks' hexadecimal digests, in order, joined by commas.
    """
    blocks = ranked.groupBy(group, F.floor((F.col(place) - 1) / block).alias("_block")).agg(
        F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, item))), lambda x: x[item]), ","), 256).alias("_digest")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_digest"))), lambda x: x["_digest"]), ",")
    return blocks.groupBy(group).agg(F.sum("n").alias("items"), F.sha2(joined, 256).alias("fingerprint"))
