"""Prefix trie over rebuilt conversations, summed along heavy paths.

A turn is known by the 128-bit digest of its role and text, so texts are read
once and never dealt.  A prefix is known by two 64-bit polynomial hashes of
its turns' digests, which are running sums: a conversation may lie in any
number of partitions.  Nodes are the distinct prefixes, by one grouping of all
rebuilt turns.

Sums over subtrees use a heavy-path decomposition.  The largest child of a node, the
one with most conversations, goes on with its parent's path; every other child
is light and starts a path.  A light child has at most half of its parent's
conversations, so a conversation meets a light node at most log2 of their
number times; those few of each conversation say on which path and level each
of its nodes lies.  Levels are taken from the deepest up: within a level, sums
run along all paths from the bottom (suffix sums in the order of the path),
and the totals of the paths' first nodes are added to the nodes that they hang
from, one level up.  The rounds are as many as the levels.

The digest of a node's conversations takes their numbers in order, which one
stream has to do; it gets them as texts of CHUNK numbers, made in parallel.

Contract: rows of null conversation are left out.  Turns go by ``turn``, null
first; of equal turns, by role, then by digest of the text; null role or text
is empty.  Repeated rows are turns of their own.  ``conv_id - conv_id % 100``
follows the sign of conv_id.  Empty input gives no rows; other columns are
ignored.  Two different prefixes are taken for one with a chance of about
2**-128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlight.llm.common import buffers, discard_since, mark, mix, written
from crawlight.llm.graphs import lookup
from crawlight.llm.scans import carried, ranged, segments

#: Factor of the prefix hashes, and the turns that a conversation takes from its base: fewer than so many.
FACTOR, HEADS = (0x9E3779B97F4A7C15 & ~7) | 5, 6
#: Conversation numbers of one text.
CHUNK = 512
_BITS = 2**64


def powers(exponents: np.ndarray) -> np.ndarray:
    """FACTOR to the given powers, modulo 2**64; negative ones too."""
    out, factor = np.ones(len(exponents), np.uint64), FACTOR
    left = np.asarray(exponents, np.int64).view(np.uint64).copy()
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] *= np.uint64(factor)
        left >>= np.uint64(1)
        factor = factor * factor % _BITS
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _unsigned(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy().view(np.uint64) for n in names], axis=1)


def _keys(hashes: np.ndarray, depth: np.ndarray) -> pa.Array:
    """Prefix hashes and depths as 16 bytes each."""
    raw = np.ascontiguousarray(mix(hashes + mix(depth.astype(np.uint64))[:, None]))
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, 16 * len(raw) + 1, 16, dtype=np.int32)), pa.py_buffer(raw)])


ROOT = _keys(np.zeros((1, 2), np.uint64), np.zeros(1, np.int64))[0].as_py()

_STATES = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("a1", pa.int64()), ("a2", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_chars", pa.int64()), ("part", pa.int32()), ("at", pa.int64())])
_STATES_DDL = "conv_id long, pos long, a1 long, a2 long, t1 long, t2 long, n_chars long, part int, at long"


def _turn_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and prefix hash of each turn within what the task has of its conversation."""
    part, at, last, n, sums = TaskContext.get().partitionId(), 0, None, 0, np.zeros(2, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        raw, bounds = buffers(batch.column(1))
        turn = raw[bounds[0] : bounds[-1]].view(np.uint64).reshape(-1, 2)
        start = segments(np.r_[conv[0] != last, conv[1:] != conv[:-1]])
        pos = np.arange(len(conv)) - np.where(start < 0, -n, start)
        terms = turn * powers(pos)[:, None]
        total = np.cumsum(terms, axis=0)
        before = np.where((start < 0)[:, None], np.uint64(0) - sums, total[start] - terms[start])
        prefix = total - before
        last, n, sums = conv[-1], int(pos[-1]) + 1, prefix[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pos), *(pa.array(_signed(x[:, k])) for x in (prefix, turn) for k in (0, 1)), batch.column(2), pa.array(np.full(len(conv), part, np.int32)), pa.array(np.arange(at, at + len(conv)))],
            schema=_STATES,
        )
        at += len(conv)


def _joined(a: tuple, b: tuple) -> tuple:
    """State (last place, prefix hashes) of two stretches of one conversation."""
    factor = pow(FACTOR, a[0] + 1, _BITS)
    wrap = [(x + factor * y) % _BITS for x, y in zip(a[1:], b[1:], strict=True)]
    return (a[0] + b[0] + 1, *(x - _BITS if x >= _BITS // 2 else x for x in wrap))


def _completed(before: dict):
    """Adds what earlier partitions have of a conversation."""

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, part, pos = (batch.column(n).to_numpy() for n in ("conv_id", "part", "pos"))
            pos, prefix = pos.copy(), _unsigned(batch, "a1", "a2").copy()
            for p in np.unique(part).tolist():
                if p not in before:
                    continue
                group, state = before[p]
                mine = (part == p) & (conv == group)
                factor, sums = np.uint64(pow(FACTOR, state[0] + 1, _BITS)), np.array([x % _BITS for x in state[1:]], np.uint64)
                prefix[mine] = prefix[mine] * factor + sums
                pos[mine] += state[0] + 1
            names = ["conv_id", "pos", "a1", "a2", "t1", "t2", "n_chars"]
            given = {"pos": pa.array(pos), "a1": pa.array(_signed(prefix[:, 0])), "a2": pa.array(_signed(prefix[:, 1]))}
            yield pa.RecordBatch.from_arrays([given[n] if n in given else batch.column(n) for n in names], names=names)

    return complete


_MEMBERS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("n_chars", pa.int64()), ("length", pa.int64())])
_MEMBERS_DDL = "conv_id long, depth long, key binary, parent binary, n_chars long, length long"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the prefix that ends with each turn and of the one before it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shift = batch.column("shift").to_numpy()
        turn, prefix = _unsigned(batch, "t1", "t2"), _unsigned(batch, "a1", "a2")
        depth = batch.column("pos").to_numpy() + shift + 1
        whole = _unsigned(batch, "b1", "b2") + (prefix - _unsigned(batch, "c1", "c2")) * powers(shift)[:, None]
        parent = whole - turn * powers(depth - 1)[:, None]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth), _keys(whole, depth), _keys(parent, depth - 1), batch.column("n_chars"), batch.column("length")], schema=_MEMBERS)


def turn_rows(df: DataFrame) -> DataFrame:
    """conv_id, pos, prefix hashes, digest words and code points of every turn, in order of its conversation; written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), digest.alias("digest"), F.char_length(text).cast("long").alias("n_chars"), "turn", role.alias("role"), F.monotonically_increasing_id().alias("place")
    )
    dealt = ranged(rows, df.count(), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "place")
    table = written(dealt.select("conv_id", "digest", "n_chars").mapInArrow(_turn_states, _STATES_DDL), "trie-turns")
    before = carried(table, "conv_id", ["pos", "a1", "a2"], _joined)
    return table.mapInArrow(_completed(before), "conv_id long, pos long, a1 long, a2 long, t1 long, t2 long, n_chars long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per conversation its length once rebuilt; the prefixes of all rebuilt conversations but the empty one), both written."""
    head = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "a1", "a2", "t1", "t2", "n_chars"))
    heads = written(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("head")), "trie-heads")
    base = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    plan = heads.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")})
    # a base serves 199 conversations at most
    plan = plan.join(base.hint("merge"), "base", "left").withColumn("taken", F.slice(F.coalesce("base_head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h")))
    m, cut = F.size("taken"), F.least(F.col("h"), F.size("head"))

    def at(array: str, n, field: str):
        return F.coalesce(F.get(F.col(array), n - 1)[field], F.lit(0)).cast("long")

    plan = plan.select(
        "conv_id", "n", "h", "taken", (m + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"), (m - F.col("h")).cast("long").alias("shift"),
        at("head", cut, "a1").alias("c1"), at("head", cut, "a2").alias("c2"), at("taken", m, "a1").alias("b1"), at("taken", m, "a2").alias("b2"),
    )
    plan = written(plan, "trie-plans")
    columns = ["conv_id", "pos", "a1", "a2", "t1", "t2", "n_chars", "length", "shift", "b1", "b2", "c1", "c2"]
    own = lookup(turns, plan.drop("taken"), "conv_id", "n", plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).where("pos >= h").select(*columns)
    zero = {c: F.lit(0).cast("long") for c in ("shift", "b1", "b2", "c1", "c2")}
    taken = plan.select("conv_id", "length", F.inline("taken")).withColumns(zero).select(*columns)
    return plan, written(own.unionByName(taken).mapInArrow(_prefixes, _MEMBERS_DDL), "trie-members")


def _linked(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with children counted, parents' conversation and light mark; the root's largest child and number of children)."""
    nodes = members.groupBy("key").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("n_chars").alias("n_chars"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = written(nodes, "trie-nodes")
    largest = F.max_by("key", F.struct("n_convs", F.bitwise_not("conv_id"))).alias("heavy")  # of equal ones that of the smallest conversation
    children = nodes.where("depth > 1").groupBy("parent").agg(F.count("*").alias("n_children"), largest)
    root = nodes.where("depth = 1").agg(F.count("*").alias("n_children"), largest).first()
    nodes = nodes.join(children.withColumnRenamed("parent", "key").hint("merge"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes, "trie-children")
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("parent_heavy"), "n_children")
    deep = nodes.where("depth > 1").withColumnRenamed("n_children", "own_children")
    deep = lookup(deep, above, "parent", "n_children", deep.count()).withColumn("light", F.col("key") != F.col("parent_heavy"))
    deep = deep.select("key", "depth", "n_chars", "n_convs", "conv_id", F.col("own_children").alias("n_children"), "parent_conv_id", "light")
    top = nodes.where("depth = 1").withColumns({"parent_conv_id": F.lit(None).cast("long"), "light": F.col("key") != F.lit(bytes(root.heavy) if root.heavy else b"")}).select(*deep.columns)
    return written(deep.unionByName(top), "trie-linked"), root


def _on_paths(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes with the path they lie on, its level, and for a path's first node the path it hangs from; written."""
    total = members.count()
    light = nodes.where("light").select("key", "n_convs")
    met = lookup(members.select("conv_id", "key", "depth", "length"), light, "key", "n_convs", total, "left_semi")
    # log2 of the number of conversations at most
    crossed = written(met.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("crossed"), F.max("length").alias("n")), "trie-crossed")
    out = lookup(nodes, crossed, "conv_id", "n", total).withColumn("crossed", F.filter("crossed", lambda x: x["depth"] <= F.col("depth")))
    level = F.coalesce(F.size("crossed"), F.lit(0))
    out = out.withColumn("level", F.when(level < 0, 0).otherwise(level))
    path = [F.coalesce(F.get("crossed", F.col("level") - k)["key"], F.lit(ROOT)) for k in (1, 2)]
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("n_chars")
    out = out.select("key", "depth", "level", path[0].alias("path"), F.when(F.col("light"), path[1]).alias("hangs_from"), leaf.alias("leaves"), saved.alias("saved"))
    return written(out, "trie-paths")


_SUMS = pa.schema([("path", pa.binary()), ("depth", pa.int64()), ("key", pa.binary()), ("hangs_from", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64()), ("part", pa.int32()), ("at", pa.int64())])
_SUMS_DDL = "path binary, depth long, key binary, hangs_from binary, leaves long, saved long, part int, at long"


def _path_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums along each path from its bottom, over what the task has of it."""
    part, at, last, sums = TaskContext.get().partitionId(), 0, None, np.zeros(2, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, bounds = buffers(batch.column(0))
        path = raw[bounds[0] : bounds[-1]].reshape(-1, 16)
        values = np.stack([batch.column(k).to_numpy() for k in (4, 5)], axis=1)
        start = segments(np.r_[path[0].tobytes() != last, (path[1:] != path[:-1]).any(axis=1)])
        total = np.cumsum(values, axis=0)
        out = total - np.where((start < 0)[:, None], -sums, total[start] - values[start])
        last, sums = path[-1].tobytes(), out[-1]
        n = len(out)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], schema=_SUMS)
        at += n


def _subtree_sums(paths: DataFrame) -> DataFrame:
    """key, n_leaves, saved_tokens of every node; one round a level, from the deepest."""
    spark = paths.sparkSession
    levels = {r.level: r.n for r in paths.groupBy("level").agg(F.count("*").alias("n")).collect()}  # log2 of the number of conversations at most
    columns = ["path", "depth", "key", "hangs_from", "leaves", "saved"]
    done, hanging = [], None
    for level in sorted(levels, reverse=True):
        rows = paths.where(F.col("level") == level).select(*columns)
        if hanging is not None:
            rows = rows.unionByName(hanging.withColumns({"key": F.lit(None).cast("binary"), "hangs_from": F.lit(None).cast("binary")}))
        # what hangs from a node comes before the node
        dealt = ranged(rows, levels[level], "path", F.col("depth").desc(), F.col("key").asc_nulls_first())
        table = written(dealt.mapInArrow(_path_sums, _SUMS_DDL), f"trie-level-{level}")
        before = carried(table, "path", ["leaves", "saved"], lambda a, b: (a[0] + b[0], a[1] + b[1]))
        sums = table
        if before:  # a row a partition at most
            more = spark.createDataFrame([(p, g, *s) for p, (g, s) in before.items()], "part int, path binary, more_leaves long, more_saved long")
            sums = table.join(F.broadcast(more), ["part", "path"], "left")
            sums = sums.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
        done.append(sums.where("key is not null").select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
        hanging = sums.where("hangs_from is not null").groupBy(F.col("hangs_from").alias("path"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of each key as texts of at most CHUNK."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, bounds = buffers(batch.column(0))
        key = raw[bounds[0] : bounds[-1]].reshape(-1, 16)
        ids = batch.column(1).to_pylist()
        at = [*np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]).tolist(), len(ids)]
        cuts = [(k, min(k + CHUNK, b)) for a, b in zip(at[:-1], at[1:], strict=True) for k in range(a, b, CHUNK)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a for a, _ in cuts])), pa.array([ids[a] for a, _ in cuts]), pa.array([",".join(map(str, ids[a:b])) for a, b in cuts])], names=["key", "first", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's texts, joined; they come in order."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    last, digest = None, None
    for batch in batches:
        keys, out = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key == last:
                digest.update(b"," + text.encode())
                continue
            if last is not None:
                keys.append(last)
                out.append(digest.hexdigest())
            last, digest = key, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], schema=schema)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)


_TRIE_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def conversation_trie(df: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    start = mark()
    plans, members = rebuilt(turn_rows(df))
    top = plans.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if not top.n:
        return df.sparkSession.createDataFrame([], _TRIE_DDL)
    nodes, root = _linked(members)
    least = F.lit(top.least).cast("long")
    paths = _on_paths(nodes, members)
    first = paths.sparkSession.createDataFrame([(ROOT, 0, 0, ROOT, None, int(root.n_children == 0), 0)], paths.schema)
    sums = _subtree_sums(written(paths.unionByName(first), "trie-rooted"))
    ends = members.where("depth = length").select("key", "conv_id").unionByName(plans.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    texts = ranged(ends, top.n, "key", "conv_id").mapInArrow(_chunks, "key binary, first long, text string")
    digests = texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")
    head = nodes.sparkSession.createDataFrame([(ROOT, 0, 0, top.n, top.least, root.n_children, None, False)], nodes.schema)
    out = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("parent_conv_id"))).unionByName(head)
    out = out.join(sums.hint("merge"), "key").join(digests.hint("merge"), "key", "left")
    out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    out = written(out.select(*(c.split()[0] for c in _TRIE_DDL.split(", "))), "trie")
    discard_since(df.sparkSession, start, out)
    return out
