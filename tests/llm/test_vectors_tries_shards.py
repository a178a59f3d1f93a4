"""Vector codes, the prefix trie and sharding against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlight.llm import prefix_trie as T
from crawlight.llm import scans as SC
from crawlight.llm import sharding as S
from crawlight.llm import vector_codes as V


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Codes by comparing every part with every entry, in Python integers."""
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((x - y) ** 2 for x, y in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(near(r[2], p)[1], []).append(cut(r[2], p))
            for k, members in groups.items():
                new[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        books = new
    out, by_label = [], Counter()
    for i, lab, v in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[lab] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*r, by_label[r[1]], digest) for r in out), key=str)


@pytest.mark.parametrize("size", [0.3, 100000.0])
def test_codes_equal_brute_force(spark, size):
    """Ties, nulls, hot vectors and labels, doubles beyond 64-bit arithmetic."""
    rng = random.Random(5)
    base = [[rng.uniform(-size, size) for _ in range(16)] for _ in range(40)]
    rows = [(k, rng.choice([1, 2, None]), rng.choice(base) if rng.random() < 0.4 else [round(rng.uniform(-size, size), 1) for _ in range(16)]) for k in range(300)]
    rows += [(900, 1, None), (901, 1, [None] * 16), (902, 1, [float("nan")] * 16), (903, 1, [float("inf")] * 16), (7, 2, rows[7][2]), (None, None, base[0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3).withColumn("code", F.lit("clash"))
    got = V.encode_vectors(df)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows)


def test_filter_compares_few_and_finds_the_first_nearest():
    rng = np.random.default_rng(3)
    entries = rng.integers(-900, 900, (64, 8))
    entries[9] = entries[4]  # equally near: the first counts
    parts = np.concatenate([rng.integers(-1000, 1000, (8, 3000)), entries.T], axis=1)
    k, d, compared = V.CellFilter(entries).nearest(parts)
    apart = ((parts.T[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (d == apart.min(axis=1)).all() and (k == apart.argmin(axis=1)).all()
    assert compared < 0.4 * apart.size
    one = V.CellFilter(entries[:1]).nearest(parts)
    assert (one[0] == 0).all()


def test_odd_vectors(spark):
    rows = [(k, "a", [float(k)] * 3) for k in range(5)] + [(9, None, [1.0]), (10, "b", []), (11, "b", [1e300] * 3)]
    got = {r.vec_id: r for r in V.encode_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert len(got) == 8 and [got[k].code for k in (9, 10, 11)] == [None] * 3 and got[11].error is None and got[10].label_error is None
    assert all(got[k].error == 0 and len(got[k].code) == 16 for k in range(5))
    for rows in ([], [(1, 1, None)], [(1, 1, [])], [(1, 1, [1e300])]):
        out = V.encode_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
        assert len(out) == len([r for r in rows if r[2] is not None])


def brute_trie(rows):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            conv.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest(), x or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in conv.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes, kids = {}, Counter()
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += k not in kids
    return sorted(
        (
            (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))).encode()).hexdigest())
            for k, m in nodes.items()
        ),
        key=str,
    )


def conversations(seed):
    """Hot first turns and whole conversations, one very long conversation, ties, nulls, repeats and negative numbers."""
    rng = random.Random(seed)
    rows = []
    for _ in range(160):
        c = rng.choice([rng.randrange(-250, 400), rng.randrange(100000)])
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ccc é", f"x{rng.randrange(9)}"])))
    for c in range(500, 560):
        rows += [(c, t, "user", f"same {t}") for t in range(3)]
    rows += [(77, k, "user", f"long {k % 50}") for k in range(700)] + [(78, k, "user", f"long {k % 50}") for k in range(400)]
    rows += [(None, 1, "user", "no number")] * 3 + [(5, 1, "user", "again")] * 4
    return rows


@pytest.mark.parametrize("seed,cells", [(1, 4096), (2, 160)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, cells):
    """Small scan partitions and low shares of hot keys, so that long conversations and paths lie in many partitions."""
    monkeypatch.setattr(SC, "TASK_ROWS", cells)
    monkeypatch.setattr(T, "CHUNK", 7)
    rows = conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumns({c: F.lit("clash") for c in ("key", "depth", "parent", "pos", "n", "path")})
    got = T.conversation_trie(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert T.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    assert T.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    for rows in ([(3, 0, None, None)], [(c, t, "u", "x" * t) for c in (1, 103, 205) for t in range(2)]):
        assert sorted((tuple(r) for r in T.conversation_trie(spark.createDataFrame(rows, schema)).collect()), key=str) == brute_trie(rows)


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(1)
    good, bad, drawn = 3_000_000_000, 7_000_000_000, 5_000_000_000
    x = np.array([S.hypergeometric(rng, good, bad, drawn) for _ in range(60)], float)
    mean, sd = drawn * 0.3, math.sqrt(drawn * 0.3 * 0.7 * 0.5)
    assert abs(x.mean() - mean) < 5 * sd / math.sqrt(60) and 0.7 < x.std() / sd < 1.35
    # the inverted law where the exact one can be written down
    assert S.hypergeometric(rng, 10**9, 0, 7) == 7 and S.hypergeometric(rng, 0, 10**9, 7) == 0 and S.hypergeometric(rng, 10**9, 5, 10**9 + 5) == 10**9
    few = Counter(S.hypergeometric(rng, 10**9, 10**9, 2) for _ in range(4000))
    assert all(abs(few[k] - 4000 * p) < 160 for k, p in ((0, 0.25), (1, 0.5), (2, 0.25)))


def test_matrix_has_exact_margins():
    starts, buckets = np.cumsum([0, 5, 0, 17, 3, 40, 1]), np.array([20, 0, 30, 16])
    rows = np.stack([S.matrix_row(starts, buckets, k, 9) for k in range(6)])
    assert (rows.sum(axis=0) == buckets).all() and (rows.sum(axis=1) == np.diff(starts)).all() and (rows >= 0).all()
    # over seeds a cell has the mean of the hypergeometric law
    cell = [S.matrix_row(starts, buckets, 4, seed)[2] for seed in range(600)]
    assert abs(np.mean(cell) - 40 * 30 / 66) < 0.5


@pytest.mark.parametrize("n", [0, 3, 1000])
def test_shards(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(S, "BLOCK", 64)
    monkeypatch.setattr(S, "BUCKET", 50)
    df = spark.createDataFrame([(k if k % 7 else None, f"text {k % 3}" if k % 5 else None, k) for k in range(n)], "doc_id long, text string, shard int").withColumn("slot", F.lit("clash"))
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    for given in (table, df, table.unionByName(table.limit(0)), table.where("shard >= 0")):
        got = S.shard_documents(given).select("row.*", F.col("shard").alias("of"), F.col("slot").alias("place")).toPandas()
        assert sorted(got["shard"]) == list(range(n))  # every row once, its own columns untouched
        counts = got.groupby("of").size()
        assert n < 8 or (len(counts) == 8 and counts.max() - counts.min() <= 1)
        for _, rows in got.groupby("of"):
            assert sorted(rows["place"]) == list(range(len(rows)))
    again = S.shard_documents(table).select("row.shard", F.col("shard").alias("of"), "slot")
    assert again.exceptAll(S.shard_documents(table).select("row.shard", F.col("shard").alias("of"), "slot")).count() == 0


def test_shards_mix(spark, tmp_path, monkeypatch):
    """Neighbours of the input spread over shards and slots as chance has it."""
    monkeypatch.setattr(S, "BLOCK", 256)
    spark.range(4000).repartition(4).write.parquet(str(tmp_path / "ids"))
    got = S.shard_documents(spark.read.parquet(str(tmp_path / "ids")), shards=4, seed=3).select("row.id", "shard", "slot").toPandas()
    seen = np.histogram2d(got["id"] // 1000, got["shard"], bins=4)[0]
    assert ((seen - 250) ** 2 / 250).sum() < 40  # 9 degrees of freedom
    assert abs(np.corrcoef(got["id"], got["slot"])[0, 1]) < 0.08
