"""N-gram Jaccard join with a count-vector R-tree.

Shingle hashes fall into GROUPS groups; a document's point is its count per
group.  For two sets the overlap is at most the sum over groups of the smaller
count, and for a tree node at most the sum of the smaller of the query's count
and the node's largest one; a pair is linked only if the overlap reaches
t / (1 + t) of the summed sizes, so nodes and pairs below that bound are
pruned and the survivors are verified on their shingle sets.

In dense text one tree over all documents prunes little and visits pairs in
number near the square of the documents, so space is cut first, exactly: sets
with the threshold overlap share one of their rarest shingles (the prefix of
length n - ceil(t n) + 1 in an order by document frequency, here estimated in
a fixed-size table over all documents).  Documents that share such a shingle
form a block.  Every pair that is verified comes out of a tree: first each
block's most central document asks the trees of its block; blocks whose
documents then all are in one component can show nothing new.  In the blocks
left the documents outside the central one's component ask, and pairs across
components come out.

Blocks of any size are cut into cells of about CELL documents, each with a
tree; identical sets are one node, so copies never meet in a block.

Contract: one row per input row.  Null text counts as empty.  A document
without words has an empty set and is linked with nothing.  Rows with the same
id are one node of the graph only through equal sets; null ids are never the
smallest id unless all ids of the component are null, then it is null.  An
empty table gives no rows; other columns are ignored.  Sets and nodes are
64-bit hashes: two different shingles of compared documents collide with a
chance of about 2**-64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlight.llm.common import batch_of, buffers, discard, document_view, hash_words, shingle_set, slices, tree_sum, written
from crawlight.llm.graphs import components, lookup

#: Groups of the count vectors, documents of a cell's side, entries of a leaf.
GROUPS, CELL, LEAF = 256, 128, 16
#: Nodes whose list is broadcast to pick their sets (8 bytes each); longer lists meet the sets by a shuffle.
BROADCAST_NODES = 200_000
#: Pairs of one node that meet one copy of its set.
PARTNERS = 1000
#: Entries of the frequency table, and of one of its chunks.
TABLE, CHUNK = 1 << 20, 1 << 12


def vector_of(shingles: np.ndarray) -> np.ndarray:
    """Counts per group, in the narrowest type that holds them."""
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS)
    return counts.astype(np.min_scalar_type(int(counts.max())))


def point_of(raw: bytes) -> np.ndarray:
    """The count vector that was written as ``raw``."""
    return np.frombuffer(raw, np.dtype(f"u{len(raw) // GROUPS}"))


def node_of(shingles: np.ndarray) -> int:
    """One number for a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63 if len(shingles) else 0


class CountRTree:
    """Points in count space under boxes' upper corners, bulk loaded in order of size and heaviest groups."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        points = np.asarray(points)
        order = np.lexsort((points.argmax(1), points.sum(1))) if len(points) else np.empty(0, np.int64)
        self.order, self.leaf = order, leaf
        level = points[order]
        self.levels = [level]
        while len(level) > leaf:
            level = np.maximum.reduceat(level, np.arange(0, len(level), leaf), axis=0)
            self.levels.append(level)

    def within(self, point: np.ndarray, least: int) -> np.ndarray:
        """Places of the points whose summed minima with ``point`` reach ``least``."""
        if not len(self.order):
            return self.order
        at = np.arange(len(self.levels[-1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            at = at[np.minimum(level[at], point).sum(1, dtype=np.int64) >= least]
            if depth:
                at = (at[:, None] * self.leaf + np.arange(self.leaf)).ravel()
                at = at[at < len(self.levels[depth - 1])]
        return self.order[at]


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Id and shingle set of each row of (doc_id, text)."""
    data, bounds = buffers(batch.column(1))
    hashes, words = hash_words(data, bounds)
    for doc_id, a, b in zip(batch.column(0).to_pylist(), words[:-1].tolist(), words[1:].tolist(), strict=True):
        yield doc_id, shingle_set(hashes[a:b], width)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int64) & (TABLE - 1)


_FIRST = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _first_pass(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (node, set size), and each task's document frequencies in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TABLE, np.int32)
        for batch in slices(batches):
            ids, nodes, sizes, held = [], [], [], 0
            waiting: list[np.ndarray] = []
            for doc_id, shingles in _sets(batch, width):
                ids.append(doc_id)
                nodes.append(node_of(shingles))
                sizes.append(len(shingles))
                waiting.append(_slot(shingles))
                held += len(shingles)
                if held > TABLE:
                    table += np.bincount(np.concatenate(waiting), minlength=TABLE).astype(np.int32)
                    waiting, held = [], 0
            n = len(ids)
            if held:
                table += np.bincount(np.concatenate(waiting), minlength=TABLE).astype(np.int32)
            yield batch_of(_FIRST, ids, nodes, sizes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
        task = TaskContext.get().partitionId()
        for k in range(0, TABLE, CHUNK):
            part = table[k : k + CHUNK]
            if part.any():
                yield batch_of(_FIRST, [None], [None], [None], [k // CHUNK], [task], [part.tobytes()])

    return docs.mapInArrow(run, "doc_id long, node long, n long, chunk int, part int, counts binary")


def _frequencies(first: DataFrame) -> np.ndarray:
    """The summed table: TABLE counts, whatever the input's size."""
    tasks = first.where("chunk is not null").select("chunk", "part", F.lit(0.0).alias("weight"), F.col("counts").alias("values"))
    out = np.zeros(TABLE, np.int64)
    for r in tree_sum(tasks, np.int32).collect():  # at most TABLE / CHUNK rows
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["values"], np.float64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("central", pa.float32())])


def _prefixes(docs: DataFrame, frequencies, t: Fraction, width: int) -> DataFrame:
    """key, node, central: each set's rarest shingles, of which two similar sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequencies.value
        for batch in slices(batches):
            keys, nodes, centres, done = [], [], [], set()
            for _, shingles in _sets(batch, width):
                n = len(shingles)
                node = node_of(shingles)
                if not n or node in done:
                    continue
                done.add(node)
                often = table[_slot(shingles)]
                take = n - -(-t.numerator * n // t.denominator) + 1
                keys.append(shingles[np.argsort(often, kind="stable")[:take]])  # ties by hash: the set is sorted
                nodes.append(np.full(take, node, np.int64))
                centres.append(np.full(take, np.log1p(often).mean(), np.float32))
            if keys:
                yield batch_of(_KEYS, np.concatenate(keys).view(np.int64), np.concatenate(nodes), np.concatenate(centres))

    return docs.mapInArrow(run, "key long, node long, central float")


_POINTS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary()), ("point", pa.binary())])


def _points(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for _, shingles in _sets(batch, width):
                for column, value in zip(out, (node_of(shingles), len(shingles), shingles.tobytes(), vector_of(shingles).tobytes()), strict=True):
                    column.append(value)
            yield batch_of(_POINTS, *out)

    return docs.mapInArrow(run, "node long, n long, shingles binary, point binary")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(pairs: DataFrame, points: DataFrame, t: Fraction) -> DataFrame:
    """The (a, b) pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                if both * t.denominator >= t.numerator * (len(x) + len(y) - both):
                    left.append(a)
                    right.append(b)
            yield batch_of(_LINKS, left, right)

    pairs = written(pairs, "jaccard-pairs")
    total = pairs.count()
    if not total:
        return pairs
    wanted = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "jaccard-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted.hint("merge")
    sets = points.select("node", "shingles").join(wanted, "node", "left_semi")
    # one node may be in very many pairs: its pairs are dealt to PARTNERS at a time, each with a copy of its set
    whole, few = pairs, total <= PARTNERS * BROADCAST_NODES
    for side, column in (("a", "x"), ("b", "y")):
        copies = sets.withColumnsRenamed({"node": side, "shingles": column})
        often = whole.groupBy(side).agg(F.count("*").alias("m")).where(F.col("m") > PARTNERS).select(side, F.ceil(F.col("m") / PARTNERS).cast("int").alias("parts"))
        if total <= PARTNERS or often.isEmpty():
            pairs = pairs.join(copies, side)
            continue
        part = F.floor(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("parts")).cast("int")
        often = F.broadcast(often) if few else often.hint("merge")  # fewer than pairs / PARTNERS rows
        pairs = pairs.join(often, side, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(part)).drop("parts")
        copies = copies.join(often, side, "left")
        copies = copies.select(side, column, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        pairs = pairs.join(copies, [side, "part"]).drop("part")
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _open_blocks(rows: DataFrame, size: DataFrame, t: Fraction) -> DataFrame:
    """Of blocks with the same members one, without documents that no other of the block matches in size.

    A passage that two documents share makes a block of every run in it.  All
    look-ups by key go through ``lookup``: a key may hold a third of the rows.
    """
    # sizes that the threshold allows together are in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.001 * math.log(t.denominator / t.numerator)))
    # a slot is a key's band, hashed: two that collide only keep more rows
    slot = lambda key, band: F.xxhash64(key, band.cast("long")).alias("slot")
    sized = written(rows.join(size, "node").select("key", "node", "central", "n", band.alias("band")), "jaccard-rows")
    total = sized.count()
    counts = sized.groupBy("key", "band").agg(F.count("*").alias("m"))
    near = counts.select("key", "band", "m", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
    near = near.groupBy("key", (F.col("band") + F.col("d")).alias("band")).agg(F.sum("m").alias("m"), F.sum(F.when(F.col("d") == 0, F.col("m")).otherwise(0)).alias("own"))
    near = written(near.where("m > 1 and own > 0").groupBy(slot("key", F.col("band"))).agg(F.sum("own").alias("own")), "jaccard-near")
    kept = written(lookup(sized.withColumn("slot", slot("key", F.col("band"))), near, "slot", "own", total, "left_semi").select("key", "node", "central", "n"), "jaccard-rows")
    same = kept.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("h"), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 20)).alias("g"), F.min("n").alias("x"), F.max("n").alias("y"))
    same = same.where((F.col("m") > 2) | _close("x", "y", t)).groupBy("m", "h", "g").agg(F.min("key").alias("key")).select("key", "m")
    same = written(same, "jaccard-same")
    blocks = written(lookup(kept, same, "key", "m", kept.count(), "left_semi").select("key", "node", "central", "n"), "jaccard-blocks")
    discard(sized, near, kept, same)
    return blocks


def _close(x: str, y: str, t: Fraction):
    """Sizes that the threshold allows."""
    least, most = F.least(x, y), F.greatest(x, y)
    return least * t.denominator >= most * t.numerator


def _cell_pairs(cells: DataFrame, t: Fraction) -> DataFrame:
    """(a, b) across components whose bound reaches the threshold; a tree for each cell."""

    def search(rows: list[tuple]) -> tuple[list[int], list[int]]:
        data, asks = [r for r in rows if r[3] != 1], [r for r in rows if r[3] != 0]
        if not data or not asks:
            return [], []
        tree = CountRTree(np.stack([point_of(r[7]) for r in data]))
        nodes, parts, sizes = (np.array([r[k] for r in data], np.int64) for k in (4, 5, 6))
        left, right = [], []
        for r in asks:
            size, point = r[6], point_of(r[7])
            # overlap >= t (x + y - overlap), and y >= t x
            smallest = -(-t.numerator * size // t.denominator)
            at = tree.within(point, -(-t.numerator * (size + smallest) // (t.numerator + t.denominator)))
            at = at[(parts[at] != r[5]) & (nodes[at] != r[4])]
            if not len(at):
                continue
            bound = np.minimum(tree.levels[0][np.argsort(tree.order)[at]], point).sum(1, dtype=np.int64)
            at = at[(bound * (t.numerator + t.denominator) >= t.numerator * (size + sizes[at]))]
            for other in nodes[at].tolist():
                left.append(max(r[4], other))
                right.append(min(r[4], other))
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            left, right = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != current:
                    for out, more in zip((left, right), search(rows), strict=True):
                        out.extend(more)
                    current, rows = row[:3], []
                rows.append(row)
            yield batch_of(_LINKS, left, right)
        yield batch_of(_LINKS, *search(rows))

    return cells.mapInArrow(run, "a long, b long").distinct()


def _cells(rows: DataFrame) -> DataFrame:
    """The rows (key, node, component, hub_component, n, point) dealt out to cells.

    A block's rows of its hub's component are data, the others ask; those ask
    each other too.  Each side is cut into parts of about CELL rows.
    """
    main = F.col("component") == F.col("hub_component")
    sizes = rows.groupBy("key").agg(F.count_if(main).alias("mains"), F.count_if(~main).alias("others"))
    parts = written(sizes.select("key", (F.col("mains") + F.col("others")).alias("size"), F.ceil(F.col("mains") / CELL).alias("data_parts"), F.ceil(F.col("others") / CELL).alias("ask_parts")), "jaccard-cells")
    rows = lookup(rows, parts, "key", "size", rows.count(), "inner").withColumn("data_part", F.pmod(F.xxhash64("node"), F.greatest("data_parts", F.lit(1)))).withColumn("ask_part", F.pmod(F.xxhash64("node"), F.greatest("ask_parts", F.lit(1))))
    cell = lambda kind, i, j, role: F.struct(i.cast("long").alias("i"), (j * 2 + kind).cast("long").alias("j"), F.lit(role).alias("role"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    empty = F.array().cast("array<struct<i:long,j:long,role:int>>")
    as_data = F.transform(upto(F.col("ask_parts")), lambda q: cell(0, F.col("data_part"), q, 0))
    asking = F.when(F.col("data_parts") > 0, F.transform(upto(F.greatest("data_parts", F.lit(1).cast("long"))), lambda i: cell(0, i, F.col("ask_part"), 1))).otherwise(empty)
    # pairs of asking parts (i <= j): both roles within a part, data in the earlier and asking in the later one
    among = F.transform(upto(F.col("ask_parts")), lambda q: F.when(q == F.col("ask_part"), cell(1, q, q, 2)).when(q < F.col("ask_part"), cell(1, q, F.col("ask_part"), 1)).otherwise(cell(1, F.col("ask_part"), q, 0)))
    dealt = F.when(main, F.when(F.col("ask_parts") > 0, as_data).otherwise(empty)).otherwise(F.concat(asking, among))
    return rows.select("key", "node", "component", "n", "point", F.explode(dealt).alias("cell")).select("key", "cell.i", "cell.j", "cell.role", "node", "component", "n", "point")


def _points_of(view: DataFrame, nodes: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """node, n, shingles and point of every node that is among ``members``.

    Texts are found by a node's smallest id; a node that only rows of null id have, among those rows.
    """
    found = nodes.join(members, "node", "left_semi")
    ids = found.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    unnamed = found.where("least is null").select("node")
    by_id = _points(view.join(ids.hint("merge"), "doc_id", "left_semi"), width).join(found.select("node").hint("merge"), "node", "left_semi")
    by_node = _points(view.where("doc_id is null"), width).join(unnamed.hint("merge"), "node", "left_semi")
    return by_id.unionByName(by_node).dropDuplicates(["node"])


def _hub_cells(blocks: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, hub, hub's block size) and the cells in which each block's most central document asks for the others."""
    hubs = written(blocks.groupBy("key").agg(F.max_by("node", F.struct("central", "node")).alias("hub"), F.count("*").alias("m")), "jaccard-hubs")
    asks = hubs.select("key", "hub", F.ceil(F.col("m") / CELL).alias("parts"), "m")
    rows = lookup(blocks, asks, "key", "m", blocks.count(), "inner").join(points.select("node", "point"), "node")
    cell = lambda i, role: F.struct(i.cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(role).alias("role"))
    own = F.array(cell(F.pmod(F.xxhash64("node"), "parts"), 0))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: cell(i, 1))
    dealt = F.explode(F.when(F.col("node") == F.col("hub"), every).otherwise(own)).alias("cell")
    rows = rows.select("key", F.col("node").alias("component"), "n", "point", "node", dealt)
    return hubs, rows.select("key", "cell.i", "cell.j", "cell.role", "node", "component", "n", "point")


def jaccard_components(docs: DataFrame, threshold: Fraction = Fraction(4, 5), width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row."""
    spark = docs.sparkSession
    view = document_view(docs, id_col, text_col)
    first = written(_first_pass(view, width), "jaccard-first")
    rows = first.where("chunk is null").select("doc_id", "node", "n")
    total = rows.count()
    nodes = written(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count("*").alias("rows")), "jaccard-nodes")

    frequencies = spark.sparkContext.broadcast(_frequencies(first))  # 4 MB
    keys = written(_prefixes(view, frequencies, threshold, width), "jaccard-prefixes")
    frequencies.destroy()
    several = keys.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("m")).where("x != y").select("key", "m")
    several = written(several, "jaccard-several")
    shared = several.agg(F.sum("m")).first()[0] or 0
    blocks = _open_blocks(lookup(keys, several, "key", "m", shared, "left_semi").distinct(), nodes.select("node", "n"), threshold)
    discard(keys, several)
    points = written(_points_of(view, nodes, blocks.select("node").distinct(), width), "jaccard-points")

    order = ["key", "i", "j"]
    hubs, cells = _hub_cells(blocks, points)
    links = written(_verified(_cell_pairs(cells.repartition(*order).sortWithinPartitions(*order), threshold), points, threshold), "jaccard-links")
    parts = written(components(links), "jaccard-parts")

    # blocks that still have documents of several components
    part = F.coalesce("component", "node")
    placed = blocks.join(parts, "node", "left").select("key", "node", "n", part.alias("component"))
    hub_part = hubs.join(parts.withColumnRenamed("node", "hub"), "hub", "left").select("key", F.coalesce("component", "hub").alias("hub_component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x != y").select("key", "m")
    open_keys = written(open_keys.join(hub_part, "key"), "jaccard-keys")
    if not open_keys.isEmpty():
        left = lookup(placed, open_keys, "key", "m", blocks.count(), "inner").join(points.select("node", "point"), "node")
        left = written(left, "jaccard-open")
        more = written(_verified(_cell_pairs(_cells(left).repartition(*order).sortWithinPartitions(*order), threshold), points, threshold), "jaccard-more")
        discard(left)
        if not more.isEmpty():
            # the components found so far are stars: they settle in fewer rounds than their links
            stars = parts.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            before, parts = parts, written(components(stars.unionByName(more)), "jaccard-parts")
            discard(before)
        discard(more)
    discard(blocks, points, hubs, open_keys)

    known = nodes.join(parts, "node", "left").select("node", "least", "rows", F.coalesce("component", "node").alias("component"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    found = written(known.join(smallest, "component").select("node", "rows", "component_id"), "jaccard-components")
    discard(nodes, links, parts)
    with_words = lookup(rows.where("n > 0"), found, "node", "rows", total)
    without = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return with_words.unionByName(without).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
