"""Shared pieces: document views, written intermediates, hashed word streams.

Word hashes are polynomial hashes over random byte codes modulo 2**64,
finished by a bijective mixer.  They are computed on the Arrow buffer of a
whole batch with prefix sums, so no Python string is made per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and the codes 9 to 13.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes hashed at a time; longer stretches are cut at white space.
SEGMENT = 1 << 16

_rng = np.random.Generator(np.random.PCG64(20240131))
_CODES = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_FOLDED = _CODES.copy()
_FOLDED[0x41:0x5B] = _CODES[0x61:0x7B]
_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False
_STEP = 0x9E3779B97F4A7C15 | 5
_STEP = (_STEP & ~7) | 5
_INVERSE = pow(_STEP, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        factor = np.uint64(pow(base, done, 2**64))
        more = min(done, n - done)
        np.multiply(out[:more], factor, out=out[done : done + more])
        done += more
    return out


class _Tables:
    up: np.ndarray = np.ones(1, np.uint64)
    down: np.ndarray = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, SEGMENT + 4096)
            cls.up, cls.down = _powers(_STEP, n), _powers(_INVERSE, n)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_segment(data: np.ndarray, codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = _WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = inside[0]
    edge[-1] = inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(breaks):
        # a document starts here without white space before it
        cut = breaks[(breaks > 0) & (breaks < len(data))]
        cut = np.unique(cut[inside[cut] & inside[cut - 1]])  # empty documents repeat a bound
        if len(cut):
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
    up, down = _Tables.get(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64)), starts, ends


def hash_words(data: np.ndarray, bounds: np.ndarray, fold: bool = True, places: bool = False):
    """Hashes of the words of consecutive documents in one byte buffer.

    ``bounds`` has n + 1 byte positions; words never cross them.  With ``fold``
    A-Z hash as a-z.  Returns (hashes, word bounds of each document) and with
    ``places`` the byte starts and ends of the words too.
    """
    codes = _FOLDED if fold else _CODES
    first, last = int(bounds[0]), int(bounds[-1])
    hashes, starts, ends = [], [], []
    at = first
    while at < last:
        to = min(last, at + SEGMENT)
        if to < last:
            # move back to white space or a document's start; a word longer than a segment moves it on
            near = np.flatnonzero(~_WORD[data[max(at + 1, to - 4096) : to]])
            if len(near):
                to = max(at + 1, to - 4096) + int(near[-1])
            else:
                k = int(np.searchsorted(bounds, to, "right")) - 1
                if bounds[k] > at:
                    to = int(bounds[k])
                else:
                    limit = int(bounds[k + 1])
                    step = to
                    while step < limit:
                        gap = np.flatnonzero(~_WORD[data[step : min(limit, step + SEGMENT)]])
                        if len(gap):
                            step += int(gap[0])
                            break
                        step = min(limit, step + SEGMENT)
                    to = step
        lo, hi = np.searchsorted(bounds, (at, to))
        h, s, e = _hash_segment(data[at:to], codes, bounds[lo:hi] - at)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    s = np.concatenate(starts) if starts else np.empty(0, np.int64)
    words = np.searchsorted(s, bounds)
    if places:
        return h, words, s, (np.concatenate(ends) if ends else np.empty(0, np.int64))
    return h, words


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column without nulls."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, bounds


def raw_texts(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes."""
    data, bounds = buffers(column)
    whole = memoryview(data)
    return [bytes(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


#: Factors of a rolling hash over words: position k before the end has ROLL**k.
ROLL = (0xC2B2AE3D27D4EB4F & ~7) | 3


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    factor = np.uint64(ROLL)
    for k in range(1, width):
        out *= factor
        out += hashes[k : k + n]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` make one shingle, none make none."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < width:
        return rolling(words, len(words)) + np.uint64(len(words))
    return distinct(rolling(words, width))


def document_view(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, as long, and the text, null as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    On one machine, as in tests, a temporary one is set where none is named; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='crawlight-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Removes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and lost executors cost nothing.

    The job's shuffle files go as soon as the table stands.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _tables.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them must be written itself."""
    for table in tables:
        if table._written_to in _tables:
            _tables.remove(table._written_to)
            _delete(table.sparkSession, table._written_to)


def mark() -> int:
    """Where the list of written tables ends now."""
    return len(_tables)


def discard_since(spark: SparkSession, start: int, keep: DataFrame | None = None) -> None:
    """Deletes the tables written since ``mark`` gave ``start``, but for ``keep``."""
    kept = getattr(keep, "_written_to", None)
    for path in [p for p in _tables[start:] if p != kept]:
        _tables.remove(path)
        _delete(spark, path)


def tree_sum(rows: DataFrame, given=np.float64, fan: int = 1024) -> DataFrame:
    """(chunk, part, weight, values: bytes of ``given``) rows of any number of tasks -> per chunk the sums, as float64 bytes.

    Parts are tasks; two levels, so that no group holds more than ``fan`` rows up to fan**2 tasks.
    """
    ddl = "chunk int, part int, weight double, values binary"

    def adder(kind):
        def add(frame):
            out = frame.iloc[:1].copy()
            out["weight"] = frame["weight"].sum()
            total = np.frombuffer(frame["values"].iloc[0], kind).astype(np.float64)
            for raw in frame["values"].iloc[1:]:
                total += np.frombuffer(raw, kind)
            out["values"] = [total.tobytes()]
            return out

        return add

    for kind in (given, np.float64):
        rows = rows.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("chunk", "part").applyInPandas(adder(kind), ddl)
    return rows


def drawn(rows: DataFrame, order: Column, most: int, total: int) -> DataFrame:
    """The ``most`` distinct rows of smallest ``order``, a 64-bit hash, of about ``total``.

    A bound on the hash leaves a few times ``most`` rows before any are sorted, so no task sees more.
    """
    if total > 8 * most:
        # of 8 * most expected rows fewer than ``most`` come out with no chance worth naming
        rows = rows.where(order < F.lit(int(-(2**63) + 2**64 * (8 * most / total))))
    return rows.distinct().orderBy(order, *rows.columns).limit(most)


def id_and_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0), batch.column(1)


#: Bytes of text that an operator takes up at a time, about; one text is never cut.
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded text, so that memory does not follow the texts' lengths; empty ones are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = buffers(batch.column(text_at))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
