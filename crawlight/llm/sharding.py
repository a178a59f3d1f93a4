"""Sharding by a uniform shuffle with exact shard sizes.

Rows lie in blocks: at most BLOCK neighbouring rows of one file.  A shard's
slots are cut into buckets of about equal size, and a communication matrix
says how many rows each block sends to each bucket.  Given block and bucket
sizes, the matrix of a uniform permutation is hypergeometric.  It is never
made as a whole: blocks are halved again and again, and each half's counts are
drawn from the hypergeometric law given the counts of both, with a generator
seeded by the bounds of the halves.  So a task draws only the rows of its own
blocks, and a task that is run again draws the same.

Then each block's rows are permuted and dealt out by the row of the matrix,
exchanged, and put in random order within their bucket, which gives the slots.
Only the file and the place of a row, never its content, decide where it goes:
a hot source or group of copies is spread like anything else.

The rows are read where they lie, without a copy, if the table is one of whole
Parquet files; anything else is written first.

Contract: every row, null and repeated ones too, gets one shard and one slot;
shard sizes are at most one apart, and slots run from 0 without gaps.  The
input's columns come back as the struct ``row``, so no name can clash.  Fewer
rows than shards leave the last shards empty; empty input gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlight.llm.common import written

#: Rows of a block and, unless there would be more than MOST_BUCKETS, of a bucket.
BLOCK, BUCKET, MOST_BUCKETS = 1 << 20, 1 << 13, 20000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` things taken from ``good`` + ``bad`` are good; populations of any size.

    numpy draws below 1e9; beyond, the law is inverted over twelve standard
    deviations about its mode, outside of which lies less than double precision shows.
    """
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    least, most = max(0, drawn - bad), min(good, drawn)
    mode = min(most, max(least, (good + 1) * (drawn + 1) // (total + 2)))
    spread = 12 * math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / (total - 1))) + 40
    lo, hi = max(least, mode - int(spread)), min(most, mode + int(spread))
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    weight = np.r_[0.0, np.cumsum(steps)]
    weight = np.cumsum(np.exp(weight - weight.max()))
    return lo + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def split(rng: np.random.Generator, sizes: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` things come from each of several groups of given sizes."""
    total = int(sizes.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(sizes, drawn, method="marginals")
    out = np.zeros_like(sizes)
    for j, n in enumerate(sizes.tolist()):
        total -= n
        out[j] = hypergeometric(rng, n, total, drawn)
        drawn -= int(out[j])
    return out


def matrix_row(starts: np.ndarray, buckets: np.ndarray, block: int, seed: int) -> np.ndarray:
    """How many rows block ``block`` sends to each bucket; ``starts`` has the bounds of all blocks."""
    lo, hi, left = 0, len(starts) - 1, buckets
    while hi - lo > 1:
        middle = (lo + hi) // 2
        first = split(np.random.Generator(np.random.PCG64([seed, lo, hi])), left, int(starts[middle] - starts[lo]))
        left, lo, hi = (first, lo, middle) if block < middle else (left - first, middle, hi)
    return left


def _even(total: int, n: int) -> np.ndarray:
    """``n`` sizes at most one apart, larger ones first."""
    return np.array([total // n + (j < total % n) for j in range(n)], np.int64)


def bucket_sizes(total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all buckets in order of shards, and how many each shard has."""
    rows = max(BUCKET, -(-total // MOST_BUCKETS))
    shard = _even(total, shards)
    parts = np.maximum(1, -(-shard // rows))
    return np.concatenate([_even(int(n), int(k)) for n, k in zip(shard, parts, strict=True)]), parts


class Dealer:
    """Gives rows, by file and place in the file, their bucket."""

    def __init__(self, files: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, seed: int):
        self.order = {key: k for k, key in enumerate(zip(files.tolist(), blocks.tolist(), strict=True))}
        self.starts, self.buckets, self.seed, self.rows = np.r_[0, np.cumsum(sizes)], buckets, seed, BLOCK
        self.last: tuple[int, np.ndarray] | None = None

    def dealt(self, block: int) -> np.ndarray:
        """The buckets of a block's rows: a random order of what the matrix sends to each."""
        if self.last is None or self.last[0] != block:
            rows = matrix_row(self.starts, self.buckets, block, self.seed)
            out = np.repeat(np.arange(len(rows), dtype=np.int32), rows)
            self.last = block, np.random.Generator(np.random.PCG64([self.seed, 1, block])).permutation(out)
        return self.last[1]

    def deal(self, file: np.ndarray, place: np.ndarray) -> np.ndarray:
        out, block = np.empty(len(place), np.int32), place // self.rows
        change = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for part in np.split(np.arange(len(place)), change):
            if len(part):
                out[part] = self.dealt(self.order[int(file[part[0]]), int(block[part[0]])])[place[part] % self.rows]
        return out


def _placed(df: DataFrame) -> DataFrame:
    """row, _file, _place of every row of a table of files."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))


def _counted(placed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Files, blocks and sizes of all blocks, in order; None unless every file is there once and whole.

    One row a file and BLOCK rows, which is what the driver holds.
    """
    place = F.col("_place")
    found = placed.groupBy("_file", F.floor(place / BLOCK).cast("long").alias("block")).agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    found = found.orderBy("_file", "block").collect()
    if any(r.a != r.block * BLOCK or r.b - r.a + 1 != r.n for r in found):
        return None
    return tuple(np.array([r[k] for r in found], np.int64) for k in range(3))


def shard_documents(df: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """row (struct of the input's columns), shard, slot of every row."""
    try:
        placed = _placed(df)
        found = _counted(placed)
    except AnalysisException:  # no table of files
        found = None
    if found is None:
        placed = _placed(written(df, "to-shard"))
        found = _counted(placed)
    files, blocks, sizes = found
    buckets, parts = bucket_sizes(int(sizes.sum()), shards)
    dealer = Dealer(files, blocks, sizes, buckets, seed)

    @F.pandas_udf("int")
    def bucket_of(file: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(dealer.deal(file.to_numpy(), place.to_numpy()))

    # per bucket its shard and first slot
    ends = np.cumsum(buckets)
    shard = np.repeat(np.arange(shards), parts)
    first = ends - buckets - np.r_[0, np.cumsum(_even(int(sizes.sum()), shards))][shard]
    layout = df.sparkSession.createDataFrame(list(zip(range(len(buckets)), shard.tolist(), first.tolist(), strict=True)), "_bucket int, shard int, _first long")
    sent = placed.withColumn("_bucket", bucket_of("_file", "_place")).repartitionById(len(buckets), F.col("_bucket"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(seed), "_file", "_place"), "_file", "_place"))
    slot = (F.col("_first") + F.col("_within") - 1).cast("long").alias("slot")
    return sent.withColumn("_within", within).join(F.broadcast(layout), "_bucket", "left").select("row", "shard", slot)  # at most MOST_BUCKETS + shards rows

