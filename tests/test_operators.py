from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlight.operators import robots as R
from crawlight.operators import sitemaps as S
from crawlight.operators import structured as D
from crawlight.operators import tokens as K


class Counter(HTMLParser):
    def __init__(self):
        super().__init__()
        self.starts, self.ends = [], []

    def handle_starttag(self, tag, attrs):
        self.starts.append(tag)

    def handle_endtag(self, tag):
        self.ends.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.starts.append(tag)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b class='x'>", "</b>", "text ", "<!-- c -->", "<script>var a='<p>';</script>", "<br/>", "<a href=\"/x\">", "</a>", "ü"]), max_size=30))
def test_tokens_agree_with_the_standard_parser(spark, parts):
    html = "".join(parts)
    parser = Counter()
    parser.feed(html)
    rows = K.tokens(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    raw = [r.tag for r in rows if r.kind == "raw"]
    assert sorted([r.tag for r in rows if r.kind == "start"] + raw) == sorted(parser.starts)
    assert sorted([r.tag for r in rows if r.kind == "end"] + raw) == sorted(parser.ends)


def test_paragraphs_and_links(spark):
    html = '<nav><a href="/a">One</a></nav><p>first <b>bold</b> lost</p><p>open<p>second</p><a href=/c>C <i>d</i></a>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert sorted(r.text for r in K.paragraphs(pages).collect()) == ["first", "second"]
    assert sorted((r.href, r.label, r.in_nav) for r in K.links(pages).collect()) == [("/a", "One", True), ("/c", "C d", False)]


def decide(spark, text, path, bot):
    robots = spark.createDataFrame([("s", text)], "site string, text string")
    target = spark.createDataFrame([("s", path)], "site string, path string")
    return R.decisions(robots, target, spark.createDataFrame([(bot,)], "bot string")).first()


def test_robots_longest_match_and_ties(spark):
    text = "User-agent: *\nDisallow: /shop/\nAllow: /shop/special/deal.html\nAllow: /page\nDisallow: /page\n"
    assert decide(spark, text, "/shop/special/deal.html", "x").allowed
    assert not decide(spark, text, "/shop/other", "x").allowed
    assert decide(spark, text, "/page", "x").allowed
    assert decide(spark, text, "/else", "x").is_default


def test_robots_groups_and_delay(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nAllow: /\nCrawl-delay: 3.5\nSitemap: https://a/1.xml\nSitemap: https://a/2.xml\n"
    assert decide(spark, text, "/", "GPTBot").allowed
    assert decide(spark, text, "/", "gptbot").crawl_delay == 3.5
    assert not decide(spark, text, "/", "Other").allowed
    found = R.sitemaps(spark.createDataFrame([("s", text)], "site string, text string")).orderBy("place").collect()
    assert [r.url for r in found] == ["https://a/1.xml", "https://a/2.xml"]


def test_robots_wildcards(spark):
    text = "User-agent: *\nDisallow: /*.pdf$\nDisallow: /a(b\n"
    assert not decide(spark, text, "/x/y.pdf", "b").allowed
    assert decide(spark, text, "/x/y.pdf?z", "b").allowed
    assert not decide(spark, text, "/a(b", "b").allowed


def test_sitemaps(spark):
    import gzip

    good = '<urlset><url><loc>https://a.b/x</loc><lastmod>2024-01-02</lastmod></url></urlset>'
    bodies = [("good", good), ("dtd", "<!DOCTYPE x>" + good), ("bad", "<list></list>"), ("mod", good.replace("2024-01-02", "soon")), ("rel", good.replace("https://a.b", ""))]
    v = {r.url: r for r in S.validated(spark.createDataFrame(bodies, "url string, body string")).collect()}
    assert v["good"].valid and not v["dtd"].valid and v["bad"].errors == "no_root,empty" and v["mod"].warnings == "bad_lastmod" and v["rel"].errors == "relative_loc"
    packed = spark.createDataFrame([("z", bytearray(gzip.compress(good.encode()))), ("b", bytearray(b"\x1f\x8bjunk"))], "url string, body binary")
    assert {r.url: r.t for r in packed.select("url", S.gunzipped("body").alias("t")).collect()} == {"z": good, "b": None}


def test_jsonld(spark):
    bodies = [(1, '{"@graph":[{"@type":"Product","@id":"a","name":"N","offers":{"@id":"o"}},{"@type":"Offer","@id":"o","price":"5"}]}'), (1, "{bad"), (2, '[{"@type":["A","B"],"sameAs":"https://x"}]'), (3, None)]
    e = D.entities(D.nodes(spark.createDataFrame(bodies, "page_id long, body string")))
    assert e.count() == 3
    assert D.resolved_offers(e).first().price == "5"
    assert e.where("page_id = 2").first().same_as == ["https://x"]


def test_microdata(spark):
    html = '<div itemscope itemtype="https://schema.org/Product"><span itemprop="sku">ECS-100</span></div>'
    assert D.microdata(spark.createDataFrame([(1, html)], "page_id long, html string")).first().value == "ECS-100"
    assert D.microdata(spark.createDataFrame([(1, None)], "page_id long, html string")).count() == 0


def test_answerability(spark):
    row = spark.range(1).select(D.answerability(F.lit(True), F.lit(False), F.lit(True), F.lit(True)).alias("x")).first()
    assert abs(float(row.x) - 0.75) < 1e-9
