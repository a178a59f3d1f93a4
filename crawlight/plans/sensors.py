"""Sensors: named groups of rules, their payloads, and a place to add more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = Callable[[SparkSession, str], DataFrame]
SENSORS: dict[str, dict[str, Rule]] = {}
#: Which query areas' rules belong to which sensor, by the rule's number.
RANGES = {"discoverability": (1, 18), "entity_content": (20, 22), "fact_consistency": (30, 33), "corroboration": (40, 42), "geo_content": (50, 61), "engagement": (70, 79)}


def add_rule(sensor: str, name: str, rule: Rule) -> None:
    """Registers a rule: (spark, folder) to a table of findings with an id."""
    SENSORS.setdefault(sensor, {})[name] = rule


def add_known_rules() -> None:
    from crawlight.queries import queries

    for name, run in queries().items():
        if name[0] == "r" and name[1:3].isdigit():
            for sensor, (low, high) in RANGES.items():
                if low <= int(name[1:3]) <= high:
                    add_rule(sensor, name, run)


def payload(spark: SparkSession, folder: str, sensor: str) -> DataFrame:
    """sensor, rule, finding: each finding of a sensor as JSON, one row each (write with ``.write.text`` or ``.json``)."""
    if not SENSORS:
        add_known_rules()
    out = None
    for name, rule in SENSORS[sensor].items():
        found = rule(spark, folder).select(F.lit(sensor).alias("sensor"), F.lit(name).alias("rule"), F.to_json(F.struct("*")).alias("finding"))
        out = found if out is None else out.unionByName(found)
    return out
