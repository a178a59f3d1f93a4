"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one in so many rows is hot; there are fewer than so many.
HOT = 2000


def hot_keys(rows: DataFrame, keys: list[str], most: int = HOT) -> DataFrame:
    """The keys of more than 1/``most`` of all rows: fewer than ``most`` rows."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_total"))
    return counts.join(F.broadcast(total), F.col("_n") * most > F.col("_total")).select(*keys)


def keyed_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", most: int = HOT) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key; ``how`` is inner or left.

    Rows of hot keys meet a broadcast of those keys' rows, which are fewer than ``most``; the rest meet by a shuffle
    in which no key has more than 1/``most`` of the rows.  Null keys meet nothing.
    """
    hot = F.broadcast(hot_keys(rows.select(*keys), keys, most).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    wide = F.broadcast(table.join(hot, keys, "left_semi"))
    cold = marked.where("_hot is null").drop("_hot").join(table.hint("merge"), keys, how)
    return cold.unionByName(marked.where("_hot").drop("_hot").join(wide, keys, how), allowMissingColumns=False)


def equal_to(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]]):
    """Condition that keys agree, nulls with nulls."""
    return reduce(lambda x, y: x & y, (a[p].eqNullSafe(b[q]) for p, q in keys))
