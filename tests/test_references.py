"""Reference closures and path indexes against plain Python."""

import json
import random

from pyspark.sql import functions as F

from crawlight.operators import structured as S
from crawlight.plans.evidence import path_index, resolved


def test_closure_equals_search(spark):
    """Chains, circles of one and more, several ways to one node, pages of their own."""
    rng = random.Random(6)
    edges = {(p, f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for p in range(12) for _ in range(rng.randrange(12))} | {(90, f"c{k}", f"c{k + 1}") for k in range(12)} | {(91, "a", "a"), (92, "a", "b"), (92, "b", "a")}
    df = spark.createDataFrame([(p, a, "brand", b) for p, a, b in edges], "page_id long, node_id string, relation string, target_id string")
    got = {(r.page_id, r.node_id, r.target_id): r.depth for r in S.closure(df).collect()}
    want = {}
    for page, start, _ in edges:
        seen, front = {start: 0}, [start]
        for depth in range(1, 9):
            front = [b for p, a, b in edges if p == page and a in front and b not in seen and not seen.update({b: depth})]
        want |= {(page, start, b): d for b, d in seen.items() if d}
    assert got == want and max(got.values()) == 8


def test_chain_of_three_and_dereference(spark):
    body = [{"@id": "p", "@type": "Product", "brand": {"@id": " b "}, "offers": {"@id": "o"}}, {"@id": "b", "publisher": {"@id": "org"}}, {"@id": "org", "author": {"@id": "p"}, "provider": "text"}]
    n = S.nodes(spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps({"@graph": body})), (3, "{broken"), (4, None), (5, "[]")], "page_id long, body string"))
    got = sorted((r.page_id, r.node_id, r.target_id, r.depth) for r in S.closure(S.references(n)).collect())
    one = [("b", "org", 1), ("b", "p", 2), ("org", "b", 2), ("org", "p", 1), ("p", "b", 1), ("p", "org", 2)]
    assert got == [(p, *x) for p in (1, 2) for x in one]


def test_index_resolves_what_locators_name(spark):
    body = {"a": {"b": [1, {"c": "deep \"quoted\""}]}, "text": "plain", "n": None, "f": True, "odd.name": 1}
    artifacts = spark.createDataFrame([("x", json.dumps(body)), ("list", "[[7]]"), ("bad", "{"), ("null", None)], "artifact string, body string")
    index = {(r.artifact, r.path): r.value for r in path_index(artifacts).collect()}
    assert index["x", "a.b[1].c"] == 'deep "quoted"' and index["x", "a.b[0]"] == "1" and json.loads(index["x", "a"]) == body["a"] and index["x", "f"] == "true" and index["list", "[0][0]"] == "7"
    asked = [("x", "a.b[1].c", "quoted", "ok"), ("x", "a.b[1].c", "absent", "quote_not_found"), ("x", "a.b[9]", "1", "locator_unresolved"), ("x", "a..b", "1", "locator_grammar"), ("x", "text", "", "quote_missing"), ("x", "text", None, "quote_missing"), ("x", "a", '"c"', "ok"), ("y", "text", "p", "artifact_missing"), ("bad", "text", "p", "locator_unresolved"), (None, "text", "p", "artifact_missing"), ("x", None, "p", "locator_grammar")] + [("x", "text", "plain", "ok")] * 50
    refs = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(asked)], "k int, artifact string, locator string, quote string").withColumn("other", F.lit(1))
    got = {r.k: r.outcome for r in resolved(refs, artifacts).collect()}
    assert got == {k: x[3] for k, x in enumerate(asked)}


def test_rows_are_dealt_before_they_are_grouped(spark):
    """Conflicts group prices without sorts; references and artifacts leave the tasks that read them before any grouping."""
    from crawlight.plans.evidence import resolved
    from crawlight.queries.facts import price_conflicts
    from tests.conftest import DATA

    if DATA.exists():
        assert "SortAggregate" not in price_conflicts(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    references = spark.createDataFrame([("a", "x", "1"), ("b", "x", "1")], "artifact string, locator string, quote string")
    out = resolved(references, spark.createDataFrame([("a", '{"x":"1"}')], "artifact string, body string"))
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.artifact, r.outcome) for r in out.collect()} == {("a", "ok"), ("b", "artifact_missing")}
