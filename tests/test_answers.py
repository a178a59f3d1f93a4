"""Markup declarations and answer packs against Python's own parser and brute force on small pages."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from crawlight.functions import markup as M
from crawlight.plans import rubrics as R

PAGES = [
    '<meta name="robots" content="noindex, Follow"><h1>A <b>B</b> C</h1>',
    '<META CONTENT="none" NAME=ROBOTS><meta name="robots" content="all"><h2></h2><h2> x </h2><a href="/a" class="Big BTN">t</a>',
    '<!-- <meta name="robots" content="none"><h1>no</h1> --><script>"<h1>no</h1><a href=/s>"</script><a role=button href=/b></a>',
    '<link rel="alternate" hreflang="en-UK" href="/u"><link rel=alternate hreflang=JP><link rel="alternate" hreflang=" x-default "><link rel="icon" hreflang="eng">',
    '<h1>open <h2>inner</h2> rest</h1><h1>left open',
    '<a>none</a><a href="">none</a><a href="/c" class="cta-x">c</a><h2>one<br>two</h2>',
    "",
]


class Reader(HTMLParser):
    """Reads the same declarations tag by tag."""

    def __init__(self):
        super().__init__()
        self.robots, self.langs, self.hrefs, self.ctas, self.heads, self.open = "", [], [], [], {"h1": [], "h2": []}, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name", "").lower() == "robots":
            self.robots = a.get("content", "")
        if tag == "link" and a.get("rel", "").lower() == "alternate" and a.get("hreflang", "").strip():
            self.langs.append(a["hreflang"].lower().strip())
        if tag in self.heads:
            self.open = []
        if tag == "a" and a.get("href"):
            self.hrefs.append(a["href"])
            if a.get("role", "").lower() == "button" or any(c in a.get("class", "").lower() for c in M.ACTION_CLASSES):
                self.ctas.append(a["href"])

    def handle_endtag(self, tag):
        if tag in self.heads and self.open is not None:
            if self.open:
                self.heads[tag].append(" ".join(self.open).strip())
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data.strip())


def test_declarations_match_a_parser(spark):
    html = F.col("html")
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(PAGES)], "i int, html string").select(
        "i", M.robots_directives(html, F.lit("")).alias("robots"), M.hreflangs(html).alias("langs"), M.headings(html, 1).alias("h1"), M.headings(html, 2).alias("h2"), F.size(M.anchors(html)).alias("n"), M.actions(html).alias("ctas"),
    ).orderBy("i").collect()
    for row, page in zip(rows, PAGES):
        r = Reader()
        r.feed(page)
        words = sorted({w for w in r.robots.lower().replace(",", " ").split()})
        assert (row.robots, row.langs, row.h1, row.h2, row.n, row.ctas) == (words, r.langs, r.heads["h1"], r.heads["h2"], len(r.hrefs), r.ctas), page


def test_header_joins_meta_and_null_markup(spark):
    df = spark.createDataFrame([("<p>", "noindex"), ("<p>", None), (None, "none")], "html string, header string")
    got = [r.d for r in df.select(M.robots_directives(F.col("html"), F.col("header")).alias("d")).collect()]
    assert got == [["noindex"], [], ["none"]]


@pytest.mark.parametrize("code,wrong", [("en-gb", False), ("en-uk", True), ("jp", True), ("eng-us", True), ("x-default", False), ("de", False)])
def test_wrong_codes(spark, code, wrong):
    assert spark.range(1).select(M.wrong_hreflang(F.lit(code)).alias("w")).first().w is wrong


def _expected(pages, known):
    out = {}
    for site in {p[0] for p in pages}:
        kinds = {k for s, k, _ in pages if s == site}
        category = known.get(site) or next((c for c, types in R.CATEGORIES if kinds & set(types)), R.OTHER)
        text = " ".join((t or "")[: R.READ].lower() for s, _, t in pages if s == site)
        pack = category if category in {c for c, _, _ in R.RUBRICS} else R.OTHER
        for c, kind, parts in R.RUBRICS:
            if c == pack:
                missing = [p for p in parts if R.stems(p) and not any(x in text for x in R.stems(p))]
                out[site, category, kind] = (missing, (len(parts) - len(missing)) / len(parts))
    return out


def test_rubrics_match_brute_force(spark):
    pages = [
        ("a", "product_detail", "Product SPECIFICATIONS, price and stock"), ("a", "article", "shipping and delivery " * 3), ("b", "article", None), ("b", "other", "x" * R.READ + " summary"),
        ("c", "documentation", "error code response"), ("d", "other", "about our brand"), ("e", None, "features and integrations"), ("f", "other", "target"), (None, "blog", "author statistics"),
    ]
    pages += [("a", "other", f"page {i}") for i in range(300)]  # a hot site
    known = {"e": "SAAS", "f": "UNHEARD_OF"}
    df = spark.createDataFrame(pages, "site string, page_type string, text string")
    given = spark.createDataFrame(list(known.items()), "site string, category string")
    coverage = R.rubric_coverage(df.withColumn("found", F.lit(1)).withColumn("rank", F.lit("x")), given)
    got = {(r.site, r.category, r.type): (r.missing, r.coverage) for r in coverage.collect()}
    assert got == _expected(pages, known)
    open_ids = {(r.site, r.id) for r in R.open_questions(coverage).collect()}
    assert open_ids == {(s, f"PROACTIVE.GEO.QUERY_RUBRIC.{c}.{k.upper()}") for (s, c, k), (m, x) in _expected(pages, known).items() if x < R.LEAST_COVERAGE and m}
    assert R.rubric_coverage(df.limit(0)).count() == 0


def test_a_site_sends_stems_not_texts(spark):
    df = spark.createDataFrame([("a", "other", "price")], "site string, page_type string, text string")
    plan = R.rubric_coverage(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan


def test_missing_facts(spark):
    rows = [("pricing", "our pro tier billed per month with a feature list"), ("pricing", "nothing"), ("pricing", None), ("product_detail", "in stock now"), ("product_detail", "stock"), ("other", "nothing"), (None, "x")]
    df = spark.createDataFrame(rows, "kind string, text string").select(R.missing_facts(F.col("text"), F.col("kind")).alias("m"))
    every = ["tier_names", "billing_interval", "feature_matrix"]
    assert [r.m for r in df.collect()] == [[], every, every, [], ["availability"], [], []]
