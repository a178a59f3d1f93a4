"""Redirect chains and prices under headings against plain Python."""

import random
import re
from html.parser import HTMLParser

import pytest

from crawlight.operators import redirects as R
from crawlight.operators.scoped_prices import MENTION, scoped_prices


def plain_chain(url, target, most=5):
    at, been = url, [url]
    for hop in range(most + 1):
        if at not in target:
            return at, hop, "ok"
        if hop == most:
            return None, most, "too_many"
        nxt = target[at]
        if not re.match("https?://", nxt) or "//10." in nxt or "localhost" in nxt:
            return None, hop, "unsafe"
        if nxt in been:
            return None, hop, "loop"
        been.append(nxt)
        at = nxt


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_equal_plain_walk(spark, seed):
    """Chains of every length about the bound, loops of one and more, unsafe hops early and late, one hot target, repeats."""
    rng = random.Random(seed)
    u = lambda k: f"https://h{k}.example/"
    target = {u(k): u(k + 1) for k in range(100, 112)} | {u(k): u(0) for k in range(200, 500)} | {u(50): u(50), u(51): u(52), u(52): u(51), u(53): u(51), u(60): "http://10.1.2.3/", u(61): u(60), u(62): "ftp://x/", u(63): "http://localhost:80/"}
    target |= {u(k): u(rng.randrange(600, 700)) for k in rng.sample(range(600, 700), 60)}
    seen = [(a, b, 5) for a, b in target.items()] + [(a, "https://old.example/", 1) for a in list(target)[::3]] + [(None, "x", 1), ("https://null.example/", None, 9)]
    rng.shuffle(seen)
    edges = R.latest(spark.createDataFrame(seen, "url string, target string, at int"))
    got = {r.url: (r.final, r.hops, r.outcome) for r in R.chains(edges).collect()}
    want = {a: plain_chain(a, target) for a in target}
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in want.items()}
    assert got == want


def test_no_redirects(spark):
    assert R.chains(R.latest(spark.createDataFrame([], "url string, target string, at int"))).count() == 0


class Sections(HTMLParser):
    """Text outside headings with the heading before it."""

    def __init__(self):
        super().__init__()
        self.section, self.open, self.words, self.out = "General", None, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3", "h4"):
            self.open, self.words = tag, []

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3", "h4"):
            text = " ".join(w for w in self.words if w)
            if self.open and text:
                self.section = text
            self.open = None

    def handle_data(self, data):
        if self.open:
            self.words.append(data.strip())
        else:
            self.out += [(self.section, m) for m in re.findall(f"(?i){MENTION}", data)]


def test_prices_under_headings(spark):
    pieces = ["<h1>Red Plan</h1>", "<h2>Blue <b>Box</b></h2>", "<h3> </h3>", "<h4>$5 deal</h4>", "<p>only $12.50 monthly</p>", "<p>€ 1,250.50 and USD 7</p>", "<h2>never closed ", "</h2>", "<div>", "<h5>small</h5>", "Rs. 700 ", "£0 "]
    rng = random.Random(4)
    pages = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))) for k in range(150)] + [(900, ""), (901, None), (902, "<h1>X</h1>" + "<p>$1 </p>" * 2000)]
    got = sorted((r.page_id, r.section, r.raw) for r in scoped_prices(spark.createDataFrame(pages, "page_id long, html string")).select("page_id", "section", "raw").collect())
    want = []
    for k, html in pages:
        p = Sections()
        p.feed(html or "")
        p.close()
        want += [(k, s, m) for s, m in p.out if float(re.search(r"[\d,.]+$", m).group().replace(",", "")) > 0]
    assert got == sorted(want)
    plan = scoped_prices(spark.createDataFrame(pages, "page_id long, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    one = scoped_prices(spark.createDataFrame([(1, "<h2>Pro Plan</h2>now $1,250.50 per month")], "page_id long, html string")).first()
    assert (one.section, one.price, one.currency, one.interval) == ("Pro Plan", "1250.50", "USD", "month")
