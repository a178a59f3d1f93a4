import json

import pytest
from pyspark.sql import functions as F

from crawlight.functions import rendering as N
from crawlight.functions import text as T
from crawlight.plans import archetypes as A
from crawlight.plans import catalogue as C
from crawlight.plans import report as P
from crawlight.queries.dom import THIRD_PARTY
from crawlight.streaming import events as E


def values(spark, pages, column):
    rows = spark.createDataFrame(list(enumerate(pages)), "i long, html string").orderBy("i").select("i", column.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def html():
    return F.col("html")

SHELLS = [
    ('<div id="root"></div>', True), ("<main id='__next'>x</main>", True), ('<div id="rooted"></div>', False), ('<div class="a react-root b"></div>', True), ('<div id="my-vue-app-x"></div>', True),
    ("<app-root></app-root>", True), ('<body data-reactroot="">', True), ('<div data-reactroot=""></div>', False), ('<script>var x = "<div id=root>";</script>', False), ('<!-- <div id="app"> -->', False),
]


def test_shells(spark):
    assert values(spark, [h for h, _ in SHELLS], N.is_shell(html())) == [x for _, x in SHELLS]
    notices = ["<noscript>Please enable JavaScript.</noscript>", "<p>enable javascript</p>", "<noscript>hello</noscript>", "<noscript><b>It requires JavaScript to run</b></noscript>"]
    assert values(spark, notices, N.asks_for_scripts(html())) == [True, False, False, True]


def state(value, attributes='type="application/json"'):
    return f"<script {attributes}>{json.dumps(value)}</script>"


def spoken(value):
    """Words of strings of two words or more, keys aside."""
    if isinstance(value, str):
        return len(value.split()) if len(value.split()) >= 2 else 0
    if isinstance(value, dict):
        return sum(map(spoken, value.values()))
    return sum(map(spoken, value)) if isinstance(value, list) else 0


STATES = [{"a key": "two words", "b": ["one", "three more words", {"c": 'with "quotes" and \\ backslash'}], "n": 1, "line": "a\nb c"}, [], "plain text here", {"": ":"}, {"x": "ends with colon:"}, {"long": "many words " * 50_000, "escaped": 'a\n"b" ' * 20_000}]


def test_json_state(spark):
    pages = [state(v) for v in STATES] + ['<script type="application/json">{broken "two words"}</script>', state(STATES[0], 'id="__NEXT_DATA__"'), state(STATES[0], 'id="__NUXT_DATA__" type="application/json"')]
    want = [spoken(v) for v in STATES] + [0, spoken(STATES[0]), 2 * spoken(STATES[0])]
    assert values(spark, pages, N.json_words(html())) == want


def test_client_words(spark):
    two = '<script src="/a.js"></script><script src="/b.js"></script>'
    pages = ['<script src="/scripts/aem.js"></script><div class="cards"></div><div class="hero"></div>', f'<div id="root"></div>{two}', '<div id="root"></div><script src="/a.js"></script>', f"<p>{'word ' * 120}</p><div id='app'></div>{two}", "<p>text</p>"]
    visible = T.split_words(T.visible_text(html()))
    assert values(spark, pages, N.client_words(html(), visible)) == [120, 450, 0, 0, 0]


def test_structure(spark):
    page = '<html><head><title>t</title></head><body class="x"><div><script src="/app.js"></script><script src="https://js.stripe.com/v3"></script><br></div></body><p></html>'
    assert values(spark, [page], N.app_scripts(html(), THIRD_PARTY)) == [1] and values(spark, [page], N.body_elements(html())) == [3]
    pages = ["<h1>Head</h1><p>Text</p>", "<h1>Head</h1>", "<noscript><h1>x</h1><p>y</p></noscript>", f"<div>{'w ' * 15}</div>"]
    assert values(spark, pages, N.has_semantic_content(html(), T.split_words(T.visible_text(html())))) == [True, False, False, True]


def test_schema_and_signals(spark):
    block = lambda v: f'<script type="application/ld+json">{json.dumps(v)}</script>'
    pages = [block({"@type": "FAQPage"}), block([{"@type": "Thing"}, {"@type": "Question"}]), block({"@graph": [{"@type": "FAQPage"}]}), block({"@type": "Thing", "name": "FAQPage"}), "<script type='application/ld+json'>{bad</script>", "FAQPage"]
    assert values(spark, pages, N.has_schema(html(), N.FAQ_TYPES)) == [True, True, True, False, False, False]
    links = ['<a href="https://doi.org/1">x</a>', '<a class="c" href="https://uni.edu">x</a>', '<a href="https://www.me.gov/x">x</a>', '<a href="/doi.org">x</a>', '<a href="https://other.example">x</a>']
    assert values(spark, links, N.cites_authority(html(), F.lit("me.gov"))) == [True, True, False, False, False]
    assert values(spark, ['<span class="byline">', '<a rel="author" href="">', '<i itemprop="author">', "<p>author</p>"], N.has_byline(html())) == [True, True, True, False]
    gates = ['<form><input type="text"></form>', '<form><input type="text"></form><a href="/stores/9">x</a>', '<form><input type="text"></form>LocalBusiness', "<p>none</p>", '<form><input type="text"></form><a href="/stores/find">x</a>']
    assert values(spark, gates, N.is_form_gated(html(), F.lit("/stores/find"))) == [True, False, False, False, True]


ARTIFACT = {"text": 'He said "yes" twice', "source": {"canonicals": ["https://a/x", "https://a/y"], "n": 3}, "b": [{"c": "first"}, {"c": "second word"}]}


@pytest.mark.parametrize(
    ("locator", "quote", "fault"),
    [
        ("text", 'said "yes"', None), ("response body", "twice", None), ("response", "never", "quote_not_found"), ("b[1].c", "second", None), ("b[2].c", "second", "locator_unresolved"), ("b.c.d", "x", "locator_unresolved"),
        ("source", '"n":3', None), ("source.canonicals", "https://a/y | https://a/x", None), ("source.canonicals", "https://a/y | https://b", "quote_not_found"), ("1bad", "x", "locator_grammar"), ("a..b", "x", "locator_grammar"),
        ("text", "", "quote_missing"), ("text", None, "quote_missing"), ("source.text.deep", "x", "locator_unresolved"),
    ],
)
def test_evidence(spark, locator, quote, fault):
    row = spark.createDataFrame([(json.dumps(ARTIFACT), locator, quote)], "artifact string, locator string, quote string")
    assert row.select(P.evidence_fault(F.col("artifact"), F.col("locator"), F.col("quote")).alias("f")).first().f == fault


def test_scores_fall_back_and_lose_by_static_rate(spark):
    findings = spark.createDataFrame(
        [("s", "1", "high", ["?"], "X_ENTITY", ""), ("s", "2", "low", ["?"], "STATIC_HTML_X", "entity-identity"), ("s", "3", "medium", ["?"], "", "product-answerability"), ("s", "4", "critical", ["A1", "E1", "A2"], "", "")],
        "site string, finding string, severity string, check_ids array<string>, id string, category string",
    )
    coverage = spark.createDataFrame([("s", 47), ("t", 95), ("u", 0)], "site string, rate int")
    got = {(r.site, r.domain): (r.score, r.findings) for r in P.domain_scores(findings, C.catalogue(spark), coverage=coverage).collect()}
    assert got["s", "entity_content"] == (100 - 25 - 15 - 40, 3)
    assert got["s", "discoverability"] == (100 - 5 - 40 - 21, 2)  # 21: two fifths of 53, cut
    assert got["t", "discoverability"] == (100, 0) and got["u", "discoverability"] == (60, 0) and got["u", "geo_citability"] == (100, 0)


SCHEMA = {
    "type": "object", "required": ["n", "name"], "additionalProperties": False,
    "properties": {"n": {"type": "integer", "minimum": 0, "maximum": 9}, "name": {"type": ["string", "null"], "minLength": 2, "maxLength": 4, "pattern": "^a"}, "kind": {"enum": ["x", "y"]}, "in": {"type": "object", "required": ["q"], "properties": {"q": {"type": "number"}}}},
}


def test_violations_as_expressions(spark):
    docs = [{"n": 1, "name": "abc"}, {"n": -1, "name": "b"}, {"n": 10, "name": None, "kind": "z"}, {"n": "1", "more": 1}, [], "x", {"n": 2, "name": "abcde", "in": {}}, {"n": 3, "name": "ab", "in": {"q": 1.5}}, {"n": 3, "name": "ab", "in": {"q": "1"}}, {"n": True, "name": "ab"}, None]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    got = {r.i: sorted(map(tuple, r.x)) for r in rows.select("i", P.violation_array(F.col("v"), SCHEMA).alias("x")).collect()}
    assert got == {i: sorted(P.violations(x, SCHEMA)) for i, x in enumerate(docs)}


def test_archetypes(spark):
    pages = [
        ("shop", "/shop/item-1", "buy widgets - add to cart, in stock", ["Product", "Offer"], "product_detail"), ("shop", "/cart", "free shipping and a shopping bag", [], "other"),
        ("docs", "/docs/a", "getting started with the quickstart", [], "other"), ("docs", "/docs/b", "nothing", ["HowTo"], "other"), ("plain", "/x", "nothing", ["Product"], "other"),
    ]
    p = spark.createDataFrame(pages, "site string, path string, content string, types array<string>, page_type string")
    e = p.select("site", F.explode(A.page_evidence(F.col("path"), F.col("content"), F.col("types"), F.col("page_type"))).alias("x")).select("site", "x.*")
    checks = A.check_evidence(spark.createDataFrame([("shop", "EC1"), ("shop", "A1")], "site string, check_id string"))
    points = {(r.site, r.category, r.family): r.n for r in e.unionByName(checks).groupBy("site", "category", "family").agg(F.sum("points").alias("n")).collect()}
    assert points["shop", "ECOMMERCE", "schema_org"] == 8 and points["shop", "ECOMMERCE", "label_cues"] == 6 and points["shop", "ECOMMERCE", "specialist_checks"] == 1
    got = {r.site: (r.primary, r.confidence, r.families) for r in A.archetypes(p.select("site").distinct(), e.unionByName(checks)).collect()}
    assert got["shop"] == ("ECOMMERCE", "high", "inventory_type,label_cues,schema_org,specialist_checks,url_path")
    assert got["docs"][0] == "DOCUMENTATION" and got["docs"][1] == "medium" and got["plain"] == ("GENERIC", "low", "")


def test_late_events_are_what_a_stream_drops(spark, tmp_path):
    """Windows that close before a row comes lack that row, in the stream and in the batch without late rows."""
    from datetime import datetime, timedelta

    start, rows = datetime(2024, 1, 1), []
    for i in range(40):
        behind = 30 if i % 9 == 8 else 0
        rows.append((i, start + timedelta(hours=2 * i - behind), i % 3, "view", 1.0, "{}"))
    ddl = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    marked = E.late_events(spark.createDataFrame(rows, ddl), 40, "10 hours")
    late = {r.event_id for r in marked.where("late").collect()}
    assert late == {i for i, ts, *_ in rows if any(t - timedelta(hours=10) > ts for j, t, *_ in rows if j < i)} and late
    for part in range(40):
        spark.createDataFrame(rows[part : part + 1], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = stream.withWatermark("ts", "10 hours").groupBy(F.window("ts", "1 minute")).count()
    q = counted.writeStream.format("memory").queryName("kept").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("kept").count() == 40 - len(late)
