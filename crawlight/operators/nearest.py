"""Nearest-value join: for each row the value of its key that is nearest.

A key's distinct values become sorted arrays, one for each range of about
RANGE values, so a hot key has many.  An array also has the last value of the
range before and the first of the range after, so the nearest value of
anything that falls into a range is in its array, where a binary search finds
it.  No row ever meets another's values one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlight.operators.ranks import bounds
from crawlight.operators.skew import keyed_join

#: Values of an array, about.
RANGE = 4096


def places_below(values: Column, x: Column) -> Column:
    """How many entries of an ascending array are at most ``x``, by halving."""
    n = F.size(values)
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2((n + 1).cast("double"))).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(values, middle) <= x)
        return F.struct(F.when(right, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def _ranged(df: DataFrame, cut: DataFrame, key: str, value: str) -> DataFrame:
    met = df.join(F.broadcast(cut), key, "left")
    return met.withColumn("_range", F.when(F.col("bounds").isNull(), 0).otherwise(places_below(F.col("bounds"), F.col(value)))).drop("bounds")


def value_arrays(facts: DataFrame, key: str, value: str, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(key, _range, values of the range and one from either neighbour; the bounds of keys with several ranges)."""
    distinct = facts.select(key, F.col(value).cast("double").alias("_value")).where(F.col(key).isNotNull() & F.col("_value").isNotNull()).distinct()
    cut = bounds(distinct, key, "_value", size)
    arrays = _ranged(distinct, cut, key, "_value").groupBy(key, "_range").agg(F.array_sort(F.collect_list("_value")).alias("values"))
    # a key has few ranges: one for RANGE values
    w = Window.partitionBy(key).orderBy("_range")
    before, after = F.lag(F.element_at("values", -1)).over(w), F.lead(F.element_at("values", 1)).over(w)
    return arrays.withColumn("values", F.array_compact(F.concat(F.array(before), "values", F.array(after)))), cut


def nearest(rows: DataFrame, facts: DataFrame, key: str, x: str, value: str, size: int = RANGE) -> DataFrame:
    """``rows`` of keys that have values, with ``nearest`` and ``distance``; of two equally near values the smaller."""
    arrays, cut = value_arrays(facts, key, value, size)
    met = keyed_join(_ranged(rows.where(F.col(x).isNotNull()), cut, key, x), arrays, [key, "_range"])
    at = places_below(F.col("values"), F.col(x))
    met = met.withColumn("_at", at).withColumns({"_low": F.get("values", F.col("_at") - 1), "_high": F.get("values", F.col("_at"))})
    low, high = F.abs(F.col("_low") - F.col(x)), F.abs(F.col("_high") - F.col(x))
    lower = F.col("_high").isNull() | (low <= high)
    out = met.withColumns({"nearest": F.when(lower, F.col("_low")).otherwise(F.col("_high")), "distance": F.when(lower, low).otherwise(high)})
    return out.drop("_range", "values", "_at", "_low", "_high")
