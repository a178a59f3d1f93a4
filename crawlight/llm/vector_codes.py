"""Vector code compression: product codes in integers, nearest entries by VA-file filtering.

Components become integers ``floor(scale * x)``; vectors are cut into equal
parts, and each part position has a small codebook that a fixed number of
rounds refines.  Every comparison, sum and mean is exact, so codes do not
depend on how rows are dealt to tasks.

The nearest entry of a part is found as in a vector approximation file.  The
entries' coordinates are quantised to BITS bits, which gives each a cell.  Per
part, tables over cells hold the least and the greatest squared difference
that a coordinate can have to any value in the cell; summed over coordinates
they bound the distance to every entry.  Only entries whose lower bound does
not exceed the smallest upper bound are compared by their integers.

A round is one pass over the integer vectors: every task assigns its rows and
adds up their parts in place, so one row an entry and coordinate leaves a task,
whatever the data.  The driver holds the codebooks alone, ``entries`` times the
vector's width numbers.

Contract: rows whose vector is null or has null or non-finite components are
dropped.  The width is the length that most kept vectors have, of equally
frequent ones the greatest; where it is no multiple of ``parts``, zeros are
added.  A vector of another length, or with a component of 2**62 or more after
scaling, has null code and error and takes part in nothing.  Codebooks start
with the rows of smallest id, null ids last, equal ids in order of their
vectors; fewer rows make smaller codebooks.  Repeated rows count as often as
they occur.  An error that no long holds is null.  Empty input gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlight.llm.common import discard, written
from crawlight.llm.graphs import lookup

#: Bits of a quantised coordinate; parts compared at a time.
BITS, TOGETHER = 3, 4096
#: Components below this are compared in 64 bits; larger ones as Python integers.
EXACT = 1 << 27
#: Components from here on have no code.
REACH = 1 << 62


class CellFilter:
    """The entries of one part position, with the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        cells = 1 << bits
        least = entries.min(axis=0)
        span = entries.max(axis=0) - least + 1
        edges = np.stack([least + span * c // cells for c in range(cells + 1)])
        self.first, self.last = edges[:-1], edges[1:] - 1
        self.cell = np.stack([np.searchsorted(edges[:, j], entries[:, j], "right") - 1 for j in range(entries.shape[1])], axis=1)

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """entry x part: whether the bounds leave the entry in play.  ``parts`` is coordinate x part."""
        lower = np.zeros((len(self.entries), parts.shape[1]), parts.dtype)
        upper = lower.copy()
        for j, q in enumerate(parts):
            to_first, to_last = self.first[:, j, None] - q, q - self.last[:, j, None]
            near = np.maximum(np.maximum(to_first, to_last), 0)
            far = np.maximum(abs(to_first), abs(to_last))
            lower += (near * near)[self.cell[:, j]]
            upper += (far * far)[self.cell[:, j]]
        return lower <= upper.min(axis=0)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of each part's nearest entry, the smallest of equally near ones, its squared distance, and how many were compared."""
        of, entry = np.nonzero(self.candidates(parts).T)
        apart = parts.T[of] - self.entries[entry]
        distance = (apart * apart).sum(axis=1)
        # rows of one part are neighbours, entries ascending
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        least = np.minimum.reduceat(distance, first)
        hits = np.flatnonzero(distance == np.repeat(least, np.diff(np.r_[first, len(of)])))
        hits = hits[np.r_[True, of[hits][1:] != of[hits][:-1]]]
        return entry[hits], least, len(of)


def _blocks(column: pa.Array, width: int, whole: int, exact: bool) -> Iterator[np.ndarray]:
    """The vectors of a batch as coordinate x row, TOGETHER rows at a time, zeros added up to ``whole``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    for at in range(0, len(flat), TOGETHER):
        block = flat[at : at + TOGETHER].T
        block = np.concatenate([block, np.zeros((whole - width, block.shape[1]), block.dtype)])
        yield block.astype(object) if not exact or abs(block).max(initial=0) >= EXACT else block


class ProductCode:
    """Codebooks of all part positions: position -> entry x coordinate."""

    def __init__(self, books: list[list[list[int]]], width: int):
        self.books, self.width = books, width
        self.step = len(books[0][0])
        self.exact = all(abs(x) < EXACT for book in books for entry in book for x in entry)

    def _filters(self, kind) -> list[CellFilter]:
        return [CellFilter(np.array(book, kind).reshape(len(book), self.step)) for book in self.books]

    def assigned(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """Blocks of vectors with the entries and distances of each position."""
        made: dict = {}
        for block in _blocks(column, self.width, self.step * len(self.books), self.exact):
            kind = object if block.dtype == object else np.int64
            if kind not in made:
                made[kind] = self._filters(kind)
            found = [f.nearest(block[p * self.step : (p + 1) * self.step]) for p, f in enumerate(made[kind])]
            yield block, [f[0] for f in found], [f[1] for f in found]

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slot, total) of a task: for every position and entry the number of its parts, then their sum by coordinate."""
        size = self.step + 1
        total = [0] * (sum(len(b) for b in self.books) * size)
        for batch in batches:
            for block, entries, _ in self.assigned(batch.column(0)) if batch.num_rows else ():
                at = 0
                for p, chosen in enumerate(entries):
                    part = block[p * self.step : (p + 1) * self.step]
                    for e in range(len(self.books[p])):
                        mine = chosen == e
                        n = int(mine.sum())
                        if n:
                            for k, x in enumerate([n, *part[:, mine].sum(axis=1).tolist()]):
                                total[at + k] += x
                        at += size
        used = [k for k, x in enumerate(total) if x]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([Decimal(total[k]) for k in used], pa.decimal128(38, 0))], names=["slot", "total"])

    def moved(self, totals: dict[int, int]) -> ProductCode:
        """The codebooks of the next round: floors of means; unused entries stay."""
        size, at, books = self.step + 1, 0, []
        for book in self.books:
            new = []
            for entry in book:
                n = totals.get(at, 0)
                new.append([totals.get(at + 1 + j, 0) // n for j in range(self.step)] if n else entry)
                at += size
            books.append(new)
        return ProductCode(books, self.width)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label, vector (array of long) of the rows whose vector is whole and finite."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & whole).withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale)))))


def fit_codes(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int) -> ProductCode:
    """Codebooks after ``rounds`` passes over written integer vectors of one width."""
    step = -(-width // parts)
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    padded = [list(r[0]) + [0] * (step * parts - width) for r in seeds]
    code = ProductCode([[v[p * step : (p + 1) * step] for v in padded] for p in range(parts)], width)
    for _ in range(rounds):
        sums = vectors.select("vector").mapInArrow(code.sums, "slot int, total decimal(38,0)").groupBy("slot").agg(F.sum("total").alias("total"))
        code = code.moved({r.slot: int(r.total) for r in sums.collect()})  # entries x (width + parts) numbers
    return code


_OUT = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def _encoder(code: ProductCode):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, errors = [], []
            for _, entries, distances in code.assigned(batch.column(2)):
                raw = np.stack(entries, axis=1).astype(np.uint8).tobytes().hex()
                texts += [raw[k : k + 2 * len(entries)] for k in range(0, len(raw), 2 * len(entries))]
                total = sum(d.astype(object) for d in distances).tolist() if distances[0].dtype == object else sum(distances).tolist()
                errors += [x if x < 2**63 else None for x in total]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], schema=_OUT)

    return encode


def encode_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept row.

    ``label_error`` sums errors over equal labels, nulls together; a label may
    have any share of the rows.  ``entries`` is 256 at most.
    """
    vectors = written(integer_vectors(df, id_col, vector_col, label_col, scale), "vectors")
    length = F.size("vector")
    common = vectors.groupBy(length.alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    kind = dict(vectors.dtypes)["label"]
    if common is None:
        empty = vectors.withColumns({"code": F.lit("").cast("string"), "error": F.lit(0).cast("long"), "label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
        return empty.drop("vector")
    if common.width < 1:
        zeros = "00" * parts  # vectors without components are all alike
        code, coded = None, vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.when(length == 0, zeros).alias("code"), F.when(length == 0, 0).cast("long").alias("error"))
    else:
        fits = (length == common.width) & F.forall("vector", lambda x: (x > -REACH) & (x < REACH))
        usable = vectors.where(fits)
        if usable.isEmpty():
            code, coded = None, vectors.limit(0).select("vec_id", F.col("label").cast("string").alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        else:
            code = fit_codes(usable, common.width, parts, entries, rounds)
            coded = usable.select("vec_id", F.col("label").cast("string").alias("label"), "vector").mapInArrow(_encoder(code), "vec_id long, label string, code string, error long")
        odd = vectors.where(~fits).select("vec_id", F.col("label").cast("string").alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded = coded.unionByName(odd)
    # the label's text is a key that null labels have too
    coded = written(coded.withColumn("label_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "vector-codes")
    discard(vectors)
    sums = coded.groupBy("label_key").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"), F.count("*").alias("n"))
    sums = written(sums, "label-errors")
    total = coded.count()
    out = lookup(coded, sums, "label_key", "n", total)
    digest = code.digest() if code is not None else hashlib.sha256(b"").hexdigest()
    return out.select("vec_id", F.col("label").cast(kind).alias("label"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
