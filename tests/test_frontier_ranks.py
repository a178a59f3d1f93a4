"""The bounded crawl against a walk in plain Python, and ranks of groups cut into ranges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from crawlight.operators import frontier as Fr
from crawlight.operators import ranks as R


def plain_walk(queue, children, site, most=8):
    """One address at a time, in order."""
    same = lambda u: f"//{site}/" in u or f".{site}/" in u
    read, queue = [], list(queue)
    while queue and len(read) < most:
        url = queue.pop(0)
        if url in read or not same(url):
            continue
        read.append(url)
        queue += [c for c in children.get(url, ()) if c not in read]
    return read


def test_walk_equals_plain_walk(spark):
    rng = random.Random(11)
    sites = [f"s{k}.example" for k in range(30)]
    children, queues = {}, {}
    for site in sites:
        names = [f"https://{rng.choice([site, 'www.' + site, 'a.' + site, 'other.example'])}/{k}.xml" for k in range(rng.choice([1, 4, 14]))]
        for url in names:
            children[url] = [rng.choice(names) for _ in range(rng.choice([0, 1, 2, 12]))]
        if rng.random() < 0.3:  # a chain as long as the quota and more
            names = [f"https://{site}/chain{k}.xml" for k in range(12)]
            children |= {a: [b, names[0]] for a, b in zip(names, names[1:], strict=False)}
        queues[site] = [names[0], *rng.sample(names, min(2, len(names)))]
    q = spark.createDataFrame(list(queues.items()), "site string, queue array<string>")
    r = spark.createDataFrame(list(children.items()), "url string, sitemaps array<string>")
    got = {x.site: x.read for x in Fr.walk(q, r).collect()}
    assert got == {s: plain_walk(queues[s], children, s) for s in sites}
    assert max(map(len, got.values())) == 8


def test_quotas_and_fallback(spark):
    text = "".join(f"Sitemap: https://a.example/{k}.xml\n" for k in range(9))
    homes = spark.createDataFrame(
        [("a.example", "https://a.example", 200, text, "<a href='/x'>"), ("b.example", "https://b.example", 404, text, '<a href="/shop/1?a=b">1</a><a href="https://c.example/">2</a><a href="/p.pdf"></a>'), ("c.example", "https://c.example", 200, None, None)],
        "site string, base_url string, status int, text string, html string",
    )
    queues = Fr.starts(homes)
    assert {r.site: len(r.queue) for r in queues.collect()} == {"a.example": 5, "b.example": 1, "c.example": 1}
    body = "<urlset>" + "".join(f"<url><loc>https://a.example/products/{k}</loc></url>" for k in range(40)) + "".join(f"<url><loc>https://a.example/p{k}</loc></url>" for k in range(60)) + "</urlset>"
    resources = Fr.links(spark.createDataFrame([("https://a.example/0.xml", 200, body), ("https://a.example/1.xml", 404, body), ("https://b.example/sitemap.xml", 200, None)], "url string, status int, body string"))
    walked = Fr.walk(queues, resources)
    urls = Fr.candidates(walked, resources, homes)
    picked = Fr.sample(urls, homes).orderBy("site", "place").collect()
    a = [r for r in picked if r.site == "a.example"]
    assert len(a) == 28 and [r.page_type for r in a[:5]] == ["homepage", "product_detail", "product_detail", "product_detail", "other"] and [r.place for r in a] == list(range(28))
    assert [(r.place, r.url) for r in picked if r.site == "b.example"] == [(0, "https://b.example/"), (1, "https://b.example/shop/1")]
    s = {r.site: r for r in Fr.statistics(walked, resources, urls, Fr.sample(urls, homes)).collect()}
    assert (s["a.example"].sitemaps_found, s["a.example"].sitemaps_processed, s["a.example"].urls_extracted) == (5, 1, 100) and s["c.example"].urls_extracted == 0


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_places_of_one_site(spark, size):
    """Nearly all rows in one group, ties, a null group: places run without gaps in the stated order."""
    rng = random.Random(3)
    rows = [("hot" if k % 50 else f"s{k}", rng.randrange(40), k) for k in range(3000)] + [(None, 1, k) for k in range(5)]
    df = spark.createDataFrame(rows, "site string, a int, b int")
    out = R.placed(df, "site", [-F.col("a"), F.col("b")], size=size)
    got = {(r.site, r.b): r.place for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["site", "a", "b", "place"]
    for site in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == site), key=lambda r: (-r[1], r[2]))
        assert [got[r[0], r[2]] for r in order] == list(range(1, len(order) + 1))
    if size == 64:
        table = df.withColumn("o", F.struct((-F.col("a")).alias("a"), "b"))
        cuts = {r.site: r.bounds for r in R.bounds(table, "site", "o", size).collect()}
        assert list(cuts) == ["hot"] and 20 < len(cuts["hot"]) < 90  # about 46 ranges
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(site#" in plan and "_range" in plan


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "site string, a int")
    assert R.placed(empty, "site", [F.col("a")]).count() == 0 and R.digest_of_digests(R.placed(empty, "site", [F.col("a")]), "site", "a").count() == 0


def test_digest_has_a_stated_order(spark):
    df = spark.createDataFrame([("x", f"k{k:02d}", k) for k in range(1, 11)] + [("y", "only", 1)], "site string, key string, place long").repartition(4)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    keys = [f"k{k:02d}" for k in range(1, 11)]
    want = sha(",".join(sha(",".join(keys[a : a + 4])) for a in (0, 4, 8)))
    assert {r.site: (r["items"], r.fingerprint) for r in R.digest_of_digests(df, "site", "key", block=4).collect()} == {"x": (10, want), "y": (1, sha(sha("only")))}
