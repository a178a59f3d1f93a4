"""Keyed streams with timers against a walk over all rows."""

import random
from datetime import datetime, timedelta

import pytest

from crawlight.streaming import events as E


@pytest.fixture(scope="module")
def rows():
    """Times out of order, one user with a third of the rows, users that come back after long."""
    rng = random.Random(9)
    return [(k, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(50000)), 7 if rng.random() < 0.3 else rng.randrange(60), rng.choice(["purchase", "click", "error"]), rng.choice([None, float(rng.randrange(100))]), None) for k in range(900)]


@pytest.mark.parametrize("parts,forgotten", [(1, 40), (5, 40), (5, 10000)])
def test_streams_equal_walk(spark, rows, parts, forgotten):
    folder = E.arrivals(spark, spark.createDataFrame(rows, E.SCHEMA), parts)
    assert len(spark.read.parquet(folder).inputFiles()) == parts
    sights = {tuple(r) for r in E.to_the_end(spark, E.first_sights(E.stream(spark, folder), forgotten)).collect()}
    alerts = sorted(tuple(r) for r in E.to_the_end(spark, E.widening_prices(E.stream(spark, folder), forgotten)).collect())
    last, seen, held, want = {}, set(), {}, []
    for i, _, user, kind, value, _ in rows:
        if i - last.get((user, kind), -(10**9)) > forgotten:
            seen.add((user, kind, i))
        last[user, kind] = i
        if kind == "purchase" and value is not None:
            key, price = user % 20, int(value)
            low, high, at = held.get(key, (None, None, -(10**9)))
            if i - at > forgotten:
                low = high = None
            if low is not None and not low <= price <= high:
                want.append((key, i, min(low, price), max(high, price)))
            held[key] = (price if low is None else min(low, price), price if high is None else max(high, price), i)
    assert sights == seen and alerts == sorted(want)
    assert forgotten > 1000 or len(seen) > len({x[:2] for x in seen})


def test_parts_grow_with_the_events(spark):
    """A batch has a bounded stretch of numbers; first sights need no Python."""
    rows = [(k, datetime(2024, 1, 1), 1, "click", None, None) for k in (0, 3 * E.PART, 8 * E.PART - 1)]
    folder = E.arrivals(spark, spark.createDataFrame(rows, E.SCHEMA))
    assert len(spark.read.parquet(folder).inputFiles()) == 8
    sights = E.first_sights(E.stream(spark, folder))
    assert "Pandas" not in sights._jdf.queryExecution().analyzed().toString()
    assert {tuple(r) for r in E.to_the_end(spark, sights).collect()} == {(1, "click", k) for k, *_ in rows}
