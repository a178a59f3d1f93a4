"""Objects at any depth against a recursive walk; price texts, locators and site metrics on small cases."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.operators import json_walk as W

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab@.", max_size=3),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["@type", "@id", "url", "a.b", "x"]), inner, max_size=3),
    max_leaves=12,
)


def walked(value):
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    if isinstance(value, list):
        for inner in value:
            yield from walked(inner)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(VALUES, max_size=6))
def test_objects_equal_recursive_walk(spark, values):
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(99, "{broken"), (98, None)]
    v = spark.createDataFrame(rows, "k int, body string").select("k", F.try_parse_json("body").alias("v"))
    got = sorted((r.k, json.dumps(json.loads(r.t), sort_keys=True)) for r in W.objects(v, "v").select("k", F.to_json("node").alias("t")).collect())
    assert got == sorted((k, json.dumps(o, sort_keys=True)) for k, x in enumerate(values) for o in walked(x))


def test_identities_of_products_only(spark):
    body = {"@type": "WebPage", "url": "https://a.b", "x": [{"@type": ["T", "Offer"], "@id": "http://c.d", "url": 7}, {"@type": "offer", "url": "https://e.f"}, {"@type": "Product", "url": "ftp://g"}]}
    v = spark.createDataFrame([(1, json.dumps(body))], "k int, body string").select("k", F.try_parse_json("body").alias("v"))
    assert [tuple(r) for r in W.identities(W.objects(v, "v")).collect()] == [(1, "@id", "http://c.d")]


def test_objects_of_an_empty_table(spark):
    v = spark.createDataFrame([], "k int, body string").select("k", F.try_parse_json("body").alias("v"))
    assert W.objects(v, "v").collect() == []


def test_price_texts_read_as_meant(spark):
    cases = [("€1.250,50", "1250.50"), ("$1,250.50", "1250.50"), ("49,99", "49.99"), ("price on request", None), ("₹5,499 / mo", "5499.00")]
    d = spark.createDataFrame(cases, "raw string, want string").select("want", T.price(F.col("raw")).alias("got"))
    assert all(r.want == r.got for r in d.collect())
