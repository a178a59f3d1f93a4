"""Schemas walked level by level against the plain validator, on random values."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlight.plans import report as P
from crawlight.plans.schema import compiled, schema_violations

DEEP = {
    "type": "object",
    "required": ["a.b", "list", "gone"],
    "additionalProperties": False,
    "properties": {
        "a.b": {"type": ["integer", "null"], "minimum": 2, "maximum": 5},
        "list": {"type": "array", "minItems": 2, "items": {"type": "object", "required": ["x[0]"], "properties": {"x[0]": {"type": "string", "minLength": 2, "maxLength": 3}, "more": {"type": "array", "items": {"type": "number", "maximum": 3}}}}},
        "kind": {"type": "string", "enum": ["red", "blue"]},
        "when": {"type": "string", "format": "date-time"},
        "free": {"properties": {"n": {"type": "boolean"}}},
        "name": {"type": "string", "pattern": "^[a-c]+$"},
    },
}
SCHEMAS = [DEEP, {"type": "array", "items": {"type": "array", "minItems": 1, "items": {"type": "integer"}}}, {"type": "string", "minLength": 3}, {"required": ["a"], "additionalProperties": False}, {}]
NAMES = ["a.b", "list", "kind", "when", "free", "name", "x[0]", "more", "n", "a", "it\"s"]
TEXTS = ["", "a", "abc", "red", "blue", "2024-01-01T00:00:00Z", "2024-02-30T00:00:00Z", "2024-01-01 10:00+01:00", "yesterday", "日本語"]


def random_value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.4:
        return {name: random_value(rng, depth - 1) for name in rng.sample(NAMES, rng.randrange(5))}
    if depth and kind < 0.65:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, 3, 7, 2.5, rng.choice(TEXTS), rng.choice(TEXTS)])


def near_deep(rng):
    """A value that mostly keeps to the first schema."""
    item = lambda: {"x[0]": rng.choice(["ab", "a", "abcd", 3]), "more": [rng.choice([1, 2.5, 9, "x"]) for _ in range(rng.randrange(3))]}
    out = {"a.b": rng.choice([3, 1, 9, None, "3"]), "list": [rng.choice([item(), item(), 4]) for _ in range(rng.randrange(4))], "kind": rng.choice(["red", "green"]), "when": rng.choice(TEXTS), "free": {"n": rng.choice([True, 1])}, "name": rng.choice(["abc", "abd"])}
    for name in rng.sample(list(out), rng.randrange(3)):
        del out[name]
    return out | ({"odd": 1} if rng.random() < 0.2 else {})


@pytest.mark.parametrize("k", range(len(SCHEMAS)))
def test_equals_plain_validator(spark, k):
    rng = random.Random(k)
    values = [near_deep(rng) if k == 0 and rng.random() < 0.7 else random_value(rng, 3) for _ in range(250)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(999, None)], "i long, body string").select("i", F.parse_json("body").alias("v"))
    got = Counter((r.i, r.path, r.rule) for r in schema_violations(df, "i", "v", SCHEMAS[k]).collect())
    want = Counter((i, path, rule) for i, v in enumerate(values) for path, rule in P.violations(v, SCHEMAS[k]))
    assert got - want == Counter() and want - got == Counter()
    assert k in (4,) or got


def test_states():
    states = compiled(DEEP)
    assert [s.level for s in states].count(1) == 6 and max(s.level for s in states) == 4 and states[0].closed and states[states[0].names["list"]].items is not None
