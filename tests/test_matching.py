"""Nearest values, names in texts and robots tries against plain Python; hot keys in many ranges."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlight.operators import names as N
from crawlight.operators import nearest as V
from crawlight.operators import robots as R
from crawlight.operators import skew as S
from crawlight.operators.rule_trie import RuleTrie


@pytest.mark.parametrize("size", [32, 4096])
def test_nearest_equals_brute_force(spark, size):
    """A key with most values and claims, ties, repeats, values beyond either end, keys without values, nulls."""
    rng = random.Random(2)
    facts = [("hot", round(rng.uniform(0, 500), 1)) for _ in range(2500)] + [(f"k{rng.randrange(20)}", float(rng.randrange(50))) for _ in range(200)] + [(None, 1.0), ("k1", None)]
    rows = [(k, rng.choice(["hot", "hot", f"k{rng.randrange(25)}"]), rng.choice([7.25, round(rng.uniform(-50, 600), 2)])) for k in range(1500)] + [(9000, None, 1.0), (9001, "hot", None)]
    got = V.nearest(spark.createDataFrame(rows, "id long, key string, x double"), spark.createDataFrame(facts, "key string, price double"), "key", "x", "price", size)
    values = {}
    for k, v in facts:
        if k is not None and v is not None:
            values.setdefault(k, set()).add(v)
    want = {}
    for i, k, x in rows:
        if k in values and x is not None:
            v = min(values[k], key=lambda v: (abs(v - x), v))
            want[i] = (v, abs(v - x))
    assert {r.id: (r.nearest, r.distance) for r in got.collect()} == want
    arrays, cut = V.value_arrays(spark.createDataFrame(facts, "key string, price double"), "key", "price", size)
    longest = arrays.agg(F.max(F.size("values"))).first()[0]
    assert (longest < 250 and cut.count() == 1) if size == 32 else longest > 1500


def test_no_values_and_no_rows(spark):
    facts, rows = spark.createDataFrame([], "key string, price double"), spark.createDataFrame([(1, "a", 2.0)], "id long, key string, x double")
    assert V.nearest(rows, facts, "key", "x", "price").count() == 0 and V.nearest(rows.limit(0), rows.withColumnRenamed("x", "price"), "key", "x", "price").count() == 0


@pytest.mark.parametrize("most", [5, 2000])
def test_keyed_join(spark, most):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot", f"k{rng.randrange(300)}", None]), k % 2) for k in range(2000)]
    table = [("hot", 0, "a"), ("hot", 1, "b")] + [(f"k{k}", 1, "c") for k in range(200)]
    df, t = spark.createDataFrame(rows, "id long, key string, part long"), spark.createDataFrame(table, "key string, part long, v string")
    known = {(k, p): v for k, p, v in table}
    for how in ("inner", "left"):
        got = {r.id: r.v for r in S.keyed_join(df, t, ["key", "part"], how, most).collect()}
        assert got == {i: known.get((k, p)) for i, k, p in rows if how == "left" or (k, p) in known}
    hot = {tuple(r) for r in S.hot_keys(df.select("key"), ["key"], 5).collect()}
    assert hot == {("hot",), (None,)}


@pytest.mark.parametrize("shard", [3, 1000])
def test_mentions(spark, shard):
    """Names within each other, repeated, empty, null, beyond ASCII; texts empty, null and long."""
    names = ["the", "he", "her", "there", "日本", "é", "", None, "the", "zz top", "a" * 50]
    texts = ["there he goes", "", None, "日本 é", "x" * 100000 + "zz top", "a" * 60, "nothing of it", "THE"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted((r.id, r.name) for r in N.mentions(df, "id", "text", spark.createDataFrame([(n,) for n in names], "name string"), shard=shard).collect())
    assert got == sorted((i, n) for i, t in enumerate(texts) if t for n in {n for n in names if n} if n in t)
    assert N.mentions(df, "id", "text", spark.createDataFrame([], "name string")).count() == 0


PIECES = st.lists(st.sampled_from(["/", "a", "b", "*", "$", "ab", ".", "?x=", "%2F", "("]), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, st.integers(0, 5), st.booleans()), max_size=8), st.lists(PIECES, min_size=1, max_size=4))
def test_trie_equals_rules_one_by_one(rules, paths):
    trie = RuleTrie()
    for line, (pattern, size, allow) in enumerate(rules):
        trie.add(pattern, size, allow, line)
    trie.ready()
    for path in paths:
        held = []
        for line, (pattern, size, allow) in enumerate(rules):
            body = pattern[:-1] if pattern.endswith("$") else pattern
            if re.match(".*".join(map(re.escape, body.split("*"))) + ("$" if pattern.endswith("$") else ""), path):
                held.append(((size, allow, -line), pattern))
        assert trie.best(path) == (max(held) if held else None)


def test_descent_visits_depths_not_rules():
    trie = RuleTrie()
    for k in range(5000):
        trie.add(f"/p/{k:05d}/", 9, False, k)
    trie.ready()
    assert trie.depths == [9] and trie.best("/p/00042/x")[1] == "/p/00042/" and trie.best("/q") is None


@pytest.mark.parametrize("stream", [3, 100_000])
def test_decisions_of_a_hot_host(spark, stream):
    """A host in many streams decides as in one; hosts without rules allow; hosts without a file are left out."""
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nCrawl-delay: 3\n\nUser-agent: GPTBot\nDisallow: /\n"
    robots = spark.createDataFrame([("hot", text), ("bare", ""), ("other", "User-agent: *\nDisallow:\n")], "site string, text string")
    paths = [f"/{x}{k}" for x in ("a", "a/b", "c/x.pdf?", "") for k in range(12)] + ["/", "/z.pdf", "/é/a"]
    targets = spark.createDataFrame([("hot", p) for p in paths] + [("bare", "/x"), ("other", "/x"), ("none", "/x")], "site string, path string")
    bots = spark.createDataFrame([("GPTBot", "training"), ("PerplexityBot", "retrieval")], "bot string, role string")
    got = {(r.site, r.path, r.bot): (r.allowed, r.pattern, r.crawl_delay, r.is_default) for r in R.decisions(robots, targets, bots, stream).collect()}
    assert len(got) == 2 * (len(paths) + 2)
    for p in paths:
        assert got["hot", p, "GPTBot"] == (False, "/", 0.0, False)
        pattern = "/a/b" if p.startswith("/a/b") else "/*.pdf$" if p.endswith(".pdf") else "/a" if p.startswith("/a") else None
        assert got["hot", p, "PerplexityBot"] == (pattern in (None, "/a/b"), pattern, 3.0, pattern is None)
    assert got["bare", "/x", "GPTBot"] == (True, None, 0.0, True) and got["other", "/x", "GPTBot"] == (True, "", 0.0, False)


def test_mentions_leave_in_bounded_batches(monkeypatch):
    """A batch of texts that mention much gives several batches, none of many mentions more than its last text has."""
    import pyarrow as pa

    from crawlight.operators import names as N

    monkeypatch.setattr(N, "TEXTS", 7, raising=False)
    monkeypatch.setattr(N, "MENTIONS", 20, raising=False)
    texts = ["ab bc", "", None, "abc", "zz"] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["key", "text"])
    out = list(N._scanner(["ab", "bc", "zz"])(iter([batch])))
    got = sorted((k, n) for b in out for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    assert got == sorted((k, n) for k, t in enumerate(texts) for n in ("ab", "bc", "zz") if t and n in t)
    assert max(b.num_rows for b in out) < 20 + 3
