"""Operators over the whole corpus: exact and near copies, windows, mixing, quality, language model, pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlight.llm import exact_dedup as X
from crawlight.llm import graphs as G
from crawlight.llm import jaccard_join as J
from crawlight.llm import language_model as LM
from crawlight.llm import mixing as MX
from crawlight.llm import quality as Q
from crawlight.llm import queries as LQ
from crawlight.llm import recurrent as R
from crawlight.llm import substrings as S
from tests.compare import assert_same, database
from tests.conftest import DATA
from tests.llm.conftest import WORDS, rows

SPLIT = r"[\x20\x09-\x0D]+"


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(LQ.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(LQ.queries()[name](spark, str(DATA)).toPandas(), database(DATA).execute(LQ.oracle_sql()[name]).df())


@pytest.mark.parametrize("digest", [X.sha256_bytes, lambda t: F.substring(F.unhex(F.sha2(t.cast("binary"), 256)), 1, 1)])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep, digest, monkeypatch):
    """A digest of one byte makes collisions, which the byte comparison must resolve."""
    monkeypatch.setattr(X, "HEAVY", 20)
    rng = random.Random(4)
    texts = [rng.choice(["a", "b", "c" * 50, "", "d e"]) if rng.random() < 0.5 else f"t{rng.randrange(400)}" for _ in range(600)]
    got = {r.doc_id: r for r in X.exact_dedup(rows(spark, texts), keep=keep, digest=digest).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, []).append(i)
    for i, t in enumerate(texts):
        k = (min if keep == "smallest" else max)(groups[t])
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (k, len(groups[t]), i == k, hashlib.sha256(t.encode()).hexdigest())


def test_filters_pack_bits_and_levels_stay_few():
    digests = np.array([hashlib.sha256(b"%d" % k).digest() + b"\x01" for k in range(4000)], "S33")
    words = X._words(digests)
    bits = X.BloomFilter(words[:2000])
    assert bits.set.nbytes <= 10 * 2000 / 8 + 8 and bits.may_have(words[:2000]).all() and bits.may_have(words[2000:]).mean() < 0.05
    index = X.MergeIndex(memtable=10)
    for k in range(0, 4000, 10):
        one = np.ones(10, np.int64)
        index.put(digests[k : k + 10], one, one, one)
        assert sum(map(len, index.levels)) <= X.FAN * 4
    assert sum(len(run[0]) for run in index.compact()) == 4000


def test_exact_dedup_of_null_ids(spark, monkeypatch):
    """Rows of one text without ids are dealt to several parts."""
    monkeypatch.setattr(X, "VERIFIED_TOGETHER", 16)
    got = X.exact_dedup(spark.createDataFrame([(None, "same")] * 300 + [(3, "same"), (4, "own")], "doc_id long, text string").repartition(4), keep="largest").collect()
    assert len(got) == 302 and [r.doc_id for r in got if r.kept and r.group_size == 301] == [3]
    none = X.exact_dedup(spark.createDataFrame([(None, "same")] * 50, "doc_id long, text string")).collect()
    assert [r.keep_id for r in none] == [None] * 50 and sum(r.kept for r in none) == 1


def test_exact_dedup_of_messy_rows(messy, nothing):
    got = X.exact_dedup(messy, keep="largest").collect()
    assert len(got) == 11 and sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True]
    assert X.exact_dedup(nothing).count() == 0


def test_merge_index_folds_runs():
    rng = np.random.default_rng(1)
    index, all_d, all_i = X.MergeIndex(memtable=64), [], []
    for _ in range(10):
        d = np.array([b"%031d\x01" % k for k in rng.integers(0, 200, 50)], "S33")
        ids = rng.integers(0, 10**6, 50)
        index.put(d, ids, ids, np.ones(50, np.int64))
        all_d += d.tolist()
        all_i += ids.tolist()
    got = {}
    for run in index.compact():
        for d, lo, hi, n in zip(*run, strict=True):
            assert d not in got
            got[d] = (lo, hi, n)
    for d in set(all_d):
        own = [i for x, i in zip(all_d, all_i, strict=True) if x == d]
        assert got[d] == (min(own), max(own), len(own))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(got.get(n, n) == find(n) for n in parent)
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = [x for x in re.split(SPLIT, (text or "").lower()) if x]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_jaccard_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL", 16)  # many cells in the large group
    rng = random.Random(6)
    base, common, texts = words(rng, 60), words(rng, 30), []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [" ".join(words(rng, rng.choice([0, 1, 3, 4, 5, 6, 9, 40]))) for _ in range(80)]
    texts += [" ".join(common + words(rng, rng.choice([2, 4, 6, 8]))) for _ in range(40)]
    texts += [None, "", "   ", texts[0], texts[0].upper(), "a b c", "A b  c"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(rows(spark, texts)).collect()}
    assert got == all_pairs_components(texts)


def all_pairs_components(texts):
    """Set size and component of each place in ``texts``."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def chain(rng, n, links, change=4):
    """Texts of n words of which each is like its neighbours only."""
    w, out = [f"c{rng.randrange(10**6)}" for _ in range(n)], []
    for k in range(links):
        out.append(" ".join(w))
        w = list(w)
        w[k * change : (k + 1) * change] = [f"c{rng.randrange(10**6)}" for _ in range(change)]
    return out


@pytest.mark.parametrize("gone", [{1}, {0}, {2}, {1, 3}, {0, 1, 2, 3, 4}])
def test_jaccard_links_run_through_null_ids(spark, gone):
    texts = chain(random.Random(15), 100, 5)
    expected = all_pairs_components(texts)
    assert {c for _, c in expected.values()} == {0}
    docs = spark.createDataFrame([(None if i in gone else i, t) for i, t in enumerate(texts)] + [(9, "other words are here for one")], "doc_id long, text string")
    got = J.jaccard_components(docs).collect()
    named = [i for i in range(len(texts)) if i not in gone]
    assert {r.component_id for r in got if r.doc_id != 9} == {min(named) if named else None}
    assert len(got) == 6 and [r.component_id for r in got if r.doc_id == 9] == [9]


def test_jaccard_of_equal_ids_with_different_texts(spark):
    """A repeated id joins nothing: only the texts count."""
    texts = chain(random.Random(16), 60, 2, 1) + ["one two three four five six seven"]
    got = J.jaccard_components(spark.createDataFrame([(4, texts[0]), (5, texts[1]), (4, texts[2]), (4, texts[0])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(4, 3, 4), (4, 56, 4), (4, 56, 4), (5, 56, 4)]


def test_jaccard_pairs_of_a_busy_node_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(J, "PARTNERS", 3)
    rng = random.Random(17)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 80, 2)] + [" ".join(words(rng, 30)) for _ in range(5)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(rows(spark, texts)).collect()} == all_pairs_components(texts)


def test_lookup_keeps_heavy_keys_out_of_plans(spark, monkeypatch):
    """Heavy keys were literals in a filter and its opposite, in every plan the driver keeps."""
    found = spark.createDataFrame([(None if i % 50 == 49 else i % 150, i) for i in range(3000)], "key long, row long")
    table = spark.createDataFrame([(k, 20, f"v{k}") for k in range(140)], "key long, n long, value string")
    for least, heavy in ((0, True), (256, False)):
        monkeypatch.setattr(G, "LIGHT", least, raising=False)
        for how in ("left", "inner", "left_semi"):
            out = G.lookup(found, table, "key", "n", 3000, how)
            plan = out._jdf.queryExecution().logical().toString()
            assert " IN (" not in plan and ("strategy=broadcast" in plan) == heavy
            assert sorted(out.collect(), key=str) == sorted(found.join(table.drop("n"), "key", how).collect(), key=str)


def test_jaccard_settles_components_once_without_new_links(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(J, "components", lambda edges: calls.append(1) or G.components(edges))
    rng = random.Random(18)
    base = words(rng, 80)
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), *(" ".join(words(rng, 40)) for _ in range(10))]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(rows(spark, texts)).collect()} == all_pairs_components(texts)
    assert len(calls) == 1


def test_jaccard_of_messy_rows(messy, nothing):
    got = J.jaccard_components(messy).collect()
    assert len(got) == 11
    assert {r.component_id for r in got if r.doc_id in (1, 7)} == {1} and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert {r.n_shingles for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert J.jaccard_components(nothing).count() == 0


def test_count_tree_misses_nothing():
    rng = np.random.default_rng(2)
    points = rng.poisson(2, (500, 16)).astype(np.uint8)
    tree = J.CountRTree(points)
    for p in points[:40]:
        overlap = np.minimum(points, p).sum(1, dtype=np.int64)
        for least in (20, 26, 30):
            assert sorted(tree.within(p, least)) == np.flatnonzero(overlap >= least).tolist()


@pytest.mark.parametrize(("heavy", "broadcast"), [(2000, 1 << 20), (20, 1 << 20), (20, 0)])
def test_windows_against_brute_force(spark, monkeypatch, heavy, broadcast):
    monkeypatch.setattr(S, "HEAVY", heavy)
    monkeypatch.setattr(S, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(7)
    passage, base, texts = words(rng, 30), words(rng, 120), []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [" ".join(words(rng, rng.choice([0, 5, 12, 13, 20])) + (passage if i % 2 else []) + words(rng, 10)) for i in range(60)]
    texts += [texts[3], texts[3], None, "", "  a b ", ("zz " * 60).strip(), ("zz " * 30).strip()]
    rng.shuffle(texts)
    split = [[x for x in re.split(SPLIT, t or "") if x] for t in texts]
    first = {}
    for i, w in enumerate(split):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    expected = {}
    for i, w in enumerate(split):
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        expected[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.repeated_windows(rows(spark, texts)).collect()} == expected


def test_windows_of_messy_rows(messy, nothing):
    got = S.repeated_windows(messy).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].n_removed == 0 and by[6].n_removed == by[6].n_words == 12000
    assert S.repeated_windows(nothing).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    data = [(i, " ".join(words(rng, rng.randrange(5, 40))), rng.choice(["en", "en", "de"]), rng.choice("aab")) for i in range(800)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = MX.with_probabilities(docs, keep=0.5, rounds=20, targets={"source": {"a": 0.5, "b": 0.5}}).toPandas()
    total = (got._mix_tokens * got._mix_probability).sum()
    assert abs(total / got._mix_tokens.sum() - 0.5) < 1e-6
    mass = (got._mix_tokens * got._mix_weight).groupby(got.source).sum()
    assert abs(mass["a"] / mass.sum() - 0.5) < 0.02
    kept = MX.mix_documents(docs, keep=0.5)
    assert kept.columns == docs.columns and 250 < kept.count() < 550
    assert MX.mix_documents(docs, keep=1.0).count() == 800


def test_raking_apart_gives_the_same(spark, monkeypatch):
    rng = random.Random(18)
    cells = {(rng.choice("abcde"), rng.choice("xyz"), rng.choice("0123")): rng.randrange(1, 5000) for _ in range(60)}
    table = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    for options in ({"keep": 0.9, "rounds": 3}, {"targets": {"source": {"a": 0.7, "b": 0.3}}, "rounds": 2}):
        monkeypatch.setattr(MX, "MOST_CELLS", 1 << 20)
        here = {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in MX.rake(table, **options).collect()}
        monkeypatch.setattr(MX, "MOST_CELLS", 0)
        apart = {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in MX.rake(table, **options).collect()}
        assert here.keys() == apart.keys() == cells.keys()
        assert all(np.allclose(here[k], apart[k], atol=1e-9) for k in here)


def test_margins_are_met_or_reported(spark):
    data = [(s, lang, topic, n * (3 if lang == "en" else 1) + int(topic)) for s, n in (("big", 90_000), ("mid", 900), ("small", 3)) for lang in ("en", "de") for topic in "01"]
    got = MX.margins(MX.rake(spark.createDataFrame(data, "source string, lang string, topic string, tokens long"), keep=0.5)).toPandas().set_index(["margin", "value"])
    share = {s: sum(n for x, _, _, n in data if x == s) ** MX.TEMPER for s in ("big", "mid", "small")}
    for k, v in share.items():
        assert abs(got.target["source", k] - v / sum(share.values())) < 1e-6
    assert got.expected["source", "small"] < got.target["source", "small"]  # its few tokens are all there are
    assert abs(got.expected.groupby("margin").sum() - 1).max() < 1e-9


def test_topics_come_from_the_whole_text(spark):
    word = next(w for w in (f"topicword{c}" for c in "abcdefghijklmnop") if int(hashlib.md5(w.encode()).hexdigest()[0], 16) % 8 == 5)
    other = next(w for w in (f"anothers{c}" for c in "abcdefghijklmnop") if int(hashlib.md5(w.encode()).hexdigest()[0], 16) % 8 == 2)
    docs = rows(spark, [f"{other} {word.upper()} it is {word}", f"{other} {word}", "", None, "tiny"])
    got = [r[0] for r in docs.orderBy("doc_id").select(MX.topic_of(F.col("text"))).collect()]
    assert got == ["5", "2", "0", "0", "0"]


def shares_of(text):
    found = [hashlib.md5(w.encode()).hexdigest()[:2] for w in re.findall(r"[^\W\d_]{6,}", (text or "").lower())]
    return [1000 * sum(d[k] == f"{x:x}" for d in found) // max(len(found), 1) for k in (0, 1) for x in range(16)], len(found)


def test_topics_are_fitted_over_all_documents(spark):
    rng = random.Random(81)
    subjects = [[f"{name}{c}word" for c in "abcdefghij"] for name in ("ocean", "tensor", "violin")]
    of = [k for k in range(3) for _ in range(60)]
    texts = [" ".join(rng.choices(subjects[k], k=40)) for k in of] + [texts_of for texts_of in ("", None, "tiny it is", "Ärgerliche Überraschung")]
    docs = rows(spark, texts).repartition(5)
    got = {r.doc_id: r._mix_topic for r in MX.with_probabilities(docs.withColumns({"source": F.lit("s"), "lang": F.lit("l")})).collect()}
    shares, n = zip(*(shares_of(t) for t in texts), strict=True)
    told = [i for i, k in enumerate(n) if k]
    topic = {i: max(range(8), key=lambda k, x=shares[i]: (x[k] + x[k + 8], -k)) for i in told}
    for _ in range(MX.TOPIC_ROUNDS):
        means = {t: [sum(n[i] * shares[i][j] for i in told if topic[i] == t) // sum(n[i] for i in told if topic[i] == t) for j in range(32)] for t in set(topic.values())}
        topic = {i: min(means, key=lambda t, x=shares[i]: (sum((a - b) ** 2 for a, b in zip(x, means[t], strict=True)), t)) for i in told}
    assert got == {i: str(topic[i]) if i in topic else "none" for i in range(len(texts))}
    assert not any(got[i] == got[j] for i in range(180) for j in range(180) if of[i] != of[j])


def test_mixing_of_messy_rows(messy, nothing):
    got = MX.with_probabilities(messy).collect()
    assert sorted((r.doc_id or -1, r._mix_source, r._mix_tokens) for r in got)[:3] == [(-1, "<null>", 0), (-1, "a", 2), (1, "a", 6)]
    assert all(0 <= r._mix_probability <= 1 for r in got) and {r._mix_kept for r in got if not r._mix_tokens} == {True}
    assert len({r._mix_kept for r in got if r.doc_id == 7}) == 1
    assert MX.mix_documents(messy).columns == messy.columns
    assert MX.mix_documents(nothing).count() == 0


def quality_corpus(rng, n):
    texts, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 80))
        bad = rng.random() < 0.3
        texts.append(" ".join(rng.choice([[x.upper() + "!!" for x in w], [w[0]] * 60, [x + "###" for x in w]])) if bad else " ".join(w).capitalize() + ".")
        labels.append((i, 0 if bad else 1))
    return texts, labels


def test_quality_on_held_out_rows(spark):
    texts, labels = quality_corpus(random.Random(9), 900)
    docs, marks = rows(spark, texts), spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int")
    model = Q.fit_quality(docs, marks)
    got = Q.score_quality(docs, model).withColumn("held_out", Q.in_fold(F.col("doc_id"), 5, 0)).toPandas().set_index("doc_id")
    held = [(i, y) for i, y in labels if got.held_out[i]]
    assert len(held) > 100
    assert np.mean([(got.score[i] >= 0.3) == bool(y) for i, y in held]) > 0.95
    # scores come from the text alone
    again = Q.score_quality(docs.withColumn("doc_id", F.col("doc_id") + 10_000), model).toPandas()
    assert np.allclose(sorted(again.score), sorted(got.score))


def test_quality_without_labels_and_of_messy_rows(spark, messy, nothing):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = Q.fit_quality(messy, none)
    assert {r.score for r in Q.score_quality(messy, model).collect()} == {1.0}
    fitted = Q.fit_quality(messy, spark.createDataFrame([(1, 1), (5, 0), (7, 1), (7, 0)], "doc_id long, quality int"))
    assert Q.score_quality(messy, fitted).count() == 11 and Q.score_quality(nothing, fitted).count() == 0
    assert Q.keep_quality(messy, model, 0.3).columns == messy.columns


@pytest.mark.parametrize("groups", [None, [0, 0, 1], [0, 0, 0]])
def test_network_gradients(groups):
    rng = np.random.default_rng(3)
    members = [np.array([0, 1, 4]), np.array([], int), np.array([2, 3])]
    model = R.GatedModel(6, np.array([0.5, 0.2, 0.3]), members, np.ones(5), groups, hidden=4)
    model.params = [p.astype(np.float64) for p in model.params]
    x = rng.integers(0, 6, (5, 3))
    classes = rng.integers(0, 3, 15)
    w = np.array([rng.choice(members[c]) if len(members[c]) else -1 for c in classes])

    def loss():
        states, _ = model.forward(x, np.zeros((3, 4)))
        return -model.log_probabilities(states.reshape(-1, 4).astype(np.float64), classes, w).sum()

    kept = []
    states, _ = model.forward(x, np.zeros((3, 4)), kept)
    _, d, heads = model.log_probabilities(states.reshape(-1, 4).astype(np.float64), classes, w, True)
    grads = model.backward(x, kept, d.reshape(5, 3, 4)) + heads
    for p, g in zip(model.params, grads, strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_training_steps_are_plain_adam_in_one_array():
    """Parameters lie in one array that is changed in place; the step's values are those of the plain formula."""
    rng = np.random.default_rng(6)
    members = [np.array([0, 1]), np.array([], int)]
    make = lambda: R.GatedModel(6, np.array([0.7, 0.3]), members, np.ones(2), hidden=4)
    classes = rng.integers(0, 2, 20).astype(np.int32)
    tokens = (np.r_[R.START, rng.integers(1, 6, 19)].astype(np.int32), classes, np.where(classes == 0, rng.integers(0, 2, 20), -1).astype(np.int32))
    model, plain = make(), make()
    assert model.train([tokens], window=32, rate=0.01) == 20
    kept = []
    x = tokens[0][:, None]
    states, _ = plain.forward(x, np.zeros((1, 4), np.float32), kept)
    _, d, heads = plain.log_probabilities(states.reshape(-1, 4), tokens[1], tokens[2], True)
    for p, before, g in zip(model.params, plain.params, plain.backward(x, kept, d.reshape(states.shape)) + heads, strict=True):
        g = np.clip(g / 20, -1, 1)
        pace = np.float32(0.01 * (1 / 20) * (1 - 0.8))
        assert np.allclose(p, before - pace * g / (np.abs(g) + 1e-6), atol=1e-7)
    assert len({id(p.base) for p in model.params}) == 1 and model.params[0].base is not None


@pytest.mark.parametrize("groups", [None, [0, 0]])
def test_network_is_a_distribution(groups):
    members = [np.array([0, 1]), np.array([2, 3, 4])]
    model = R.GatedModel(8, np.array([0.6, 0.4]), members, np.ones(5), groups, hidden=4)
    states = np.random.default_rng(4).normal(size=(1, 4)).astype(np.float32)
    total = sum(np.exp(model.log_probabilities(states, np.array([c]), np.array([w])))[0] for c, ws in enumerate(members) for w in ws)
    assert abs(total - 1) < 1e-5


def test_state_is_carried_and_reset():
    """A document scores the same alone, among others, and whatever the window."""
    rng = np.random.default_rng(5)
    model = R.GatedModel(6, np.array([0.5, 0.5]), [np.array([], int)] * 2, np.ones(0), hidden=4)
    docs = []
    for n in (1, 3, 70, 20, 200):
        x = rng.integers(1, 6, n)
        x[0] = R.START
        docs.append((x.astype(np.int32), rng.integers(0, 2, n).astype(np.int32), np.full(n, -1, np.int32)))
    together = model.score(docs, window=16, streams=3)
    alone = [model.score([d], window=7, streams=1)[0] for d in docs]
    assert np.allclose(together, alone, atol=1e-3)


def test_language_model_scores(spark):
    rng = random.Random(10)
    vocabularies = [[f"{p}{i}" for i in range(150)] for p in "xy"]
    texts = [" ".join(rng.choice(vocabularies[i % 2]) for _ in range(rng.randrange(5, 60))) for i in range(700)] + [None, "", "Unseen WORDS here"]
    texts += [f"solo{i % 9} solo{i % 9} x1 new{i} new{i} everywhere" for i in range(40)]  # rare and unseen words, repeated
    got = LM.score_documents(rows(spark, texts)).toPandas().set_index("doc_id")
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tokens = {i: [w for w in re.split(SPLIT, (t or "").lower()) if w] + [None] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert abs(base - got.base_score[i]) < 1e-6 * max(1, abs(base))
        assert (got.n_tokens[i], got.n_known[i], got.train_tokens[i], got.held_out[i]) == (len(ws), sum(c[w] > 0 for w in ws), n, held[i])
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() + 0.15 * out.n_tokens.sum()


def test_language_model_trains_on_every_document(spark, monkeypatch):
    docs = rows(spark, [f"word{i % 9} other{i % 7} end" for i in range(900)])
    training = docs.where(~Q.in_fold(F.col("doc_id"), 7, 2)).toPandas()
    seen = []
    averaged, maximised = LM._averaged, LM.maximised
    monkeypatch.setattr(LM, "_averaged", lambda d, *a: (seen.append(sorted(r.doc_id for r in d.select("doc_id").collect())), averaged(d, *a))[1])
    held = []
    monkeypatch.setattr(LM, "maximised", lambda sums, n, share: (held.append((float(n.sum()), float(sums.sum()))), maximised(sums, n, share))[1])
    LM.score_documents(docs)
    assert seen == [sorted(training["doc_id"])]
    assert len(training) > LM.WARM_DOCUMENTS and abs(held[-1][0] - len(training)) < 1e-6
    assert abs(held[-1][1] - 4 * len(training)) < 1e-6  # three words and the end


def test_language_model_of_messy_rows(messy, nothing):
    got = LM.score_documents(messy).collect()
    assert len(got) == 11 and all(math.isfinite(r.score) for r in got)
    assert LM.score_documents(nothing).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    texts, labels = quality_corpus(rng, 300)
    good = [i for i, y in labels if y]
    texts += [texts[good[0]], texts[good[0]], texts[good[1]] + " added words", None]
    docs = rows(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "kept": F.lit(1)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality", "exact_copies", "near_copies", "mixing", "packing"]
    a = P.quality(spark, docs, str(tmp_path))
    assert a.columns == docs.columns and abs(a.count() - len(good) - 3) <= 12
    b = P.exact_copies(spark, docs, str(tmp_path)).toPandas()
    assert len(b) == len(set(texts) - {None}) + 1 and b.text.nunique() == len(set(texts) - {None})
    assert b[b.text == texts[good[0]]].doc_id.tolist() == [301]
    c = P.near_copies(spark, docs, str(tmp_path)).toPandas()
    assert good[1] in set(c.doc_id) and 302 not in set(c.doc_id)
    assert P.mixing(spark, docs, str(tmp_path)).columns == docs.columns
    out = P.run(spark, str(tmp_path)).toPandas()
    assert len(out) and out.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_stages_on_messy_rows(spark, messy, nothing, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = messy
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == messy.columns
    deduped = P.exact_copies(spark, messy, str(tmp_path)).collect()
    assert len(deduped) == len({(r.text or "") for r in messy.collect()})
    for _, stage in P.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
