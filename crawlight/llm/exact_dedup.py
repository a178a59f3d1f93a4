"""Exact dedup over a log-structured merge index of text digests.

The index has shards by digest.  Every map task keeps a memtable per batch:
it folds the batch's digests and flushes one sorted run (digest, smallest id,
largest id, rows), so a text with a third of all rows enters the shuffle once
a batch.  A shard's task takes those runs in, flushes its memtable as
sorted in-memory runs that each carry a Bloom filter, and FAN runs of a level
merge to one of the next.  Compaction joins what is left: entries that no
other run's filter reports pass through, the others are folded to the smallest
and the largest identifier.  There are shards enough that each has about
SHARD_ROWS entries at most, whatever the input.  Documents that hit an
entry of several rows are compared with the kept text byte by byte; one that
differs (a digest collision) is grouped by its text instead.

Digests of more than 1/HEAVY of the rows are fewer than HEAVY by counting, so
they are broadcast; the others are looked up by a shuffle in which no key has
more than that share.

Contract: one row per input row.  Null text counts as empty.  Null ids sort
before all others; a group of null ids only keeps one of its rows.  Of rows
with equal text and equal id one stays.  Empty input gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlight.llm.common import batch_of, document_view, written

#: A digest of more than one in so many rows is heavy; there are fewer than so many.
HEAVY = 2000
#: Rows that meet one kept text in one task at most.
VERIFIED_TOGETHER = 256
#: Entries of a shard's memtable before it is flushed, entries a shard is laid out for, runs of a level.
MEMTABLE, SHARD_ROWS, FAN = 1 << 16, 1 << 19, 8

_RUN = pa.schema([("digest", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("n", pa.int64())])
_DDL = "digest binary, least long, most long, n long"
#: Stands for a null id within the index; real ids are above it.
NO_ID = -(2**63)


def _fold(digests: np.ndarray, least: np.ndarray, most: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct digests with the smallest and largest id and the rows of each."""
    order = np.argsort(digests, kind="stable")
    digests = digests[order]
    first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]])
    return digests[first], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first), np.add.reduceat(n[order], first)


class BloomFilter:
    """A bit set over digests, ten bits an entry; a miss is certain."""

    def __init__(self, words: np.ndarray):
        self.bits = max(64, 10 * len(words))
        marks = np.zeros(self.bits, bool)
        for k in range(4):
            marks[self._place(words, k)] = True
        self.set = np.packbits(marks, bitorder="little")

    def _place(self, words: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((words[:, 0] + np.uint64(k) * words[:, 1]) % np.uint64(self.bits)).astype(np.int64)

    def may_have(self, words: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), bool)
        for k in range(4):
            at = self._place(words, k)
            out &= (self.set[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _words(digests: np.ndarray) -> np.ndarray:
    """Two 64-bit words of each digest, for the filters."""
    raw = np.frombuffer(digests.astype("S32").tobytes(), np.uint64).reshape(len(digests), 4)
    return raw[:, :2] ^ (raw[:, 2:] >> np.uint64(1))


class MergeIndex:
    """One shard: a memtable, levels of sorted runs with filters, and compaction."""

    def __init__(self, memtable: int = MEMTABLE):
        self.memtable, self.waiting, self.levels = memtable, [], []
        self.held = 0

    def put(self, digests: np.ndarray, least: np.ndarray, most: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((digests, least, most, n))
        self.held += len(digests)
        if self.held >= self.memtable:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        run, level = _merged(self.waiting), 0
        self.waiting, self.held = [], 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append((run, BloomFilter(_words(run[0]))))
            if len(self.levels[level]) < FAN:
                return
            run = _merged([run for run, _ in self.levels[level]])
            self.levels[level] = []
            level += 1

    def compact(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The entries of all runs, each digest once."""
        self.flush()
        runs, shared = [entry for level in self.levels for entry in level], []
        for i, (run, _) in enumerate(runs):
            words, hit = _words(run[0]), np.zeros(len(run[0]), bool)
            for j, (_, other) in enumerate(runs):
                if i != j:
                    hit |= other.may_have(words)
            if not hit.all():
                yield tuple(x[~hit] for x in run)
            if hit.any():
                shared.append(tuple(x[hit] for x in run))
        if shared:
            yield _merged(shared)


def _merged(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One sorted run of several."""
    return _fold(*map(np.concatenate, zip(*runs, strict=True)))


def _digest_array(column: pa.Array) -> np.ndarray:
    # fixed width with a closing byte: numpy drops trailing zero bytes otherwise
    return np.array([x + b"\x01" for x in column.to_pylist()], dtype="S33")


def _out(run: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return batch_of(_RUN, [x[:-1] for x in run[0].tolist()], *run[1:])


def _memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            yield _out(_fold(_digest_array(batch.column(0)), ids, ids, np.ones(len(ids), np.int64)))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = MergeIndex()
    for batch in batches:
        if batch.num_rows:
            index.put(_digest_array(batch.column(0)), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))
    for run in index.compact():
        yield _out(run)


def merge_index(digests: DataFrame, total: int) -> DataFrame:
    """digest, least, most, n of the ``total`` (digest, doc_id) rows: one row per digest."""
    shards = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_ROWS), 1)
    return digests.mapInArrow(_memtables, _DDL).repartition(shards, "digest").mapInArrow(_shard, _DDL)


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256_bytes) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    ``keep`` says which identifier of a group stays: "smallest" or "largest".
    ``digest`` gives at most 32 bytes of a text; a weak one only costs time.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    view = document_view(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    keyed = view.withColumn("digest", digest(F.col("text")))
    chosen = "least" if keep == "smallest" else "most"
    total = docs.count()
    index = merge_index(keyed.select("digest", "doc_id"), total)
    several = written(index.where("n > 1").select("digest", F.col(chosen).alias("keep_id"), F.col("n").alias("group_size")), "dedup-index")
    heavy = F.broadcast(several.where(F.col("group_size") * HEAVY > total))  # fewer than HEAVY rows
    light = several.where(F.col("group_size") * HEAVY <= total)

    # rows whose digest no other row has: ids and digests move, texts do not
    hits = keyed.select("doc_id", "digest", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    single = hits.join(heavy, "digest", "left_anti").join(light, "digest", "left_anti")
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    # texts move once, and those of groups are written: the same plan at any size
    rows = keyed.join(heavy, "digest").unionByName(keyed.join(heavy, "digest", "left_anti").join(light.hint("merge"), "digest"))
    rows = written(rows, "dedup-rows")
    same = written(_verify(rows), "dedup-verified")
    bad = same.where("not same").select("digest").distinct()
    if same.where("not same").isEmpty():
        groups = same.drop("same")
    else:  # texts that share a digest without being equal
        again = rows.join(bad, "digest", "left_semi")
        by_text = again.groupBy("digest", "text").agg((F.min if keep == "smallest" else F.max)("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        again = again.drop("keep_id", "group_size").join(by_text, ["digest", "text"])
        again = again.select("doc_id", "digest", "keep_id", "group_size", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
        groups = written(same.drop("same").join(bad, "digest", "left_anti").unionByName(again), "dedup-groups")
    out = single.unionByName(_one_kept(groups))
    return out.select(*(F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("doc_id", "keep_id")), "group_size", "kept", "text_sha256")


def _verify(rows: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, text_sha256, and whether the text is the kept one, byte by byte.

    Groups are dealt out in parts of about VERIFIED_TOGETHER rows, each with a copy of the kept text.
    """
    parts = F.ceil(F.col("group_size") / VERIFIED_TOGETHER)
    kept = rows.where("doc_id = keep_id").groupBy("digest", "group_size").agg(F.min("text").alias("kept_text"))
    kept = kept.select("digest", "kept_text", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    # by place, not by id: many rows may have no id; any part is right, so it may change from run to run
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("long"))
    return dealt.join(kept, ["digest", "part"]).select("doc_id", "digest", "keep_id", "group_size", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), (F.col("text") == F.col("kept_text")).alias("same"))


def _one_kept(groups: DataFrame) -> DataFrame:
    """The rows with ``kept``: where several rows of a group have its kept id, one of them."""
    key = ["digest", "text_sha256"]
    ties = groups.where("doc_id = keep_id").groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if ties.isEmpty():
        return groups.withColumn("kept", F.col("doc_id") == F.col("keep_id")).select(columns)
    tied = groups.where("doc_id = keep_id").join(ties, key).groupBy(*key, "doc_id", "keep_id", "group_size").agg(F.count("*").alias("rows"))
    spread = tied.select("doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"), "text_sha256")
    rest = groups.join(ties, key, "left_anti").withColumn("kept", F.col("doc_id") == F.col("keep_id"))
    others = groups.where("doc_id != keep_id").join(ties, key, "left_semi").withColumn("kept", F.lit(False))
    return spread.withColumn("kept", F.col("copy") == 1).select(columns).unionByName(rest.select(columns)).unionByName(others.select(columns))
