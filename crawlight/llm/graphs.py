"""Connected components and skew-safe lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlight.llm.common import discard, written

#: A key of more than one in so many rows is heavy; there are fewer than so many.
HEAVY = 2000
#: A key of so many rows at most burdens no task, however small the table.
LIGHT = 256


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Joins a table of one row per key that knows how many rows each key has.

    Keys of more than 1/HEAVY of all rows, and of more than LIGHT, are fewer
    than HEAVY, so they are listed and broadcast; the rest meet by a shuffle in
    which no key is larger than that.  The list is a table, never literals: those
    stand in every plan the driver keeps.  ``table`` should be written.  With
    ``how`` left_semi only rows are kept.
    """
    kept = table.select(*(c for c in table.columns if c != count))
    heavy = table.where((F.col(count) * HEAVY > total) & (F.col(count) > LIGHT)).select(*kept.columns).collect()  # fewer than HEAVY
    if not heavy:
        return rows.join(kept.hint("merge"), key, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(heavy, kept.schema))
    met = rows.join(few, key, "left_semi" if how == "left_semi" else "inner")
    return met.unionByName(rows.join(few, key, "left_anti").join(kept.hint("merge"), key, how))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of the nodes of (a, b) edges.

    Alternates large stars and small stars until nothing changes; a node's
    neighbours are only ever reduced to their minimum, never gathered.  An
    empty table gives none; loops and repeated edges do no harm.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    last = _signature(edges)
    if not last[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour joins the smallest
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: every smaller neighbour, and the node, join the smallest
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, edges = edges, written(small.where("a != b").distinct(), "cc")
        discard(before)
        now = _signature(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
