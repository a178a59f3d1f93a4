"""Redirect chains of all addresses at once.

An address has one redirect at most: the latest that was seen.  Paths double
in every round: the path of an address is followed by the path of the address
it has reached, so three rounds give eight hops, more than may be followed.
Many addresses redirect to one; such hot targets are looked up by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlight.functions import urls as U
from crawlight.operators.skew import keyed_join
from crawlight.sources.written import written

#: Redirects that are followed; the next one is an error.
MOST_HOPS = 5


def latest(seen: DataFrame) -> DataFrame:
    """url, target of the (url, target, at) that were seen last; of equally late ones the greatest target."""
    return seen.where("url is not null and target is not null").groupBy("url").agg(F.max_by("target", F.struct("at", "target")).alias("target"))


def _allowed(url: Column) -> Column:
    return url.rlike("^https?://") & ~U.is_unsafe_host(F.regexp_replace(U.netloc(url), r":\d+$", ""))


def paths(edges: DataFrame, hops: int = MOST_HOPS + 1) -> DataFrame:
    """url, path: what the address leads to, hop by hop, up to ``hops`` or more."""
    # each round reads the last one several times, so it is written
    state = written(edges.select("url", F.array("target").alias("path")), "redirects")
    length = 1
    while length < hops:
        after = state.select(F.col("url").alias("_at"), F.col("path").alias("_more"))
        met = keyed_join(state.withColumn("_at", F.element_at("path", -1)), after, ["_at"], "left")
        state = written(met.select("url", F.concat("path", F.coalesce("_more", F.array().cast("array<string>"))).alias("path")), "redirects")
        length *= 2
    return state


def chains(edges: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """url, final, hops, outcome: where an address ends.

    ``outcome`` is unsafe if a hop within the bound leads to a scheme or host that must not be fetched, else loop if
    the path comes back to an address it has been at, else too_many beyond ``most`` hops, else ok; final is null unless
    it is ok, and ``hops`` counts what was followed until then.
    """
    every = paths(edges, most + 1).withColumn("path", F.slice("path", 1, most + 1))
    n = F.size("path")
    unsafe = F.filter(F.sequence(F.lit(1), n), lambda k: ~_allowed(F.element_at("path", k)))
    been = F.concat(F.array("url"), "path")
    again = F.filter(F.sequence(F.lit(1), n), lambda k: F.array_contains(F.slice(been, F.lit(1), k), F.element_at("path", k)))
    first = lambda x: F.coalesce(F.get(x, F.lit(0)), F.lit(most + 2))
    every = every.withColumns({"_unsafe": first(unsafe), "_again": first(again), "_n": n})
    stop = F.least("_unsafe", "_again")
    outcome = F.when((stop <= most) & (F.col("_unsafe") <= F.col("_again")), "unsafe").when(stop <= most, "loop").when(F.col("_n") > most, "too_many").otherwise("ok")
    hops = F.when(stop <= most, stop - 1).otherwise(F.least("_n", F.lit(most)))
    return every.select("url", F.when(outcome == "ok", F.element_at("path", -1)).alias("final"), hops.alias("hops"), outcome.alias("outcome"))
