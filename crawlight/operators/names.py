"""Which of many names a text mentions, in one scan of the text.

The names become one automaton (Aho and Corasick), so a text is read once
however many names there are.  Names are counted first; beyond SHARD of them
there are several automata, and every text meets each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of one automaton at most; texts taken up at a time, mentions of a batch, about.
SHARD, TEXTS, MENTIONS = 200_000, 256, 1 << 16


def _scanner(names: list[str]):
    """Batches of (key, text) -> (key, name) for every name that a text contains, once each."""

    def told(batch: pa.RecordBatch, rows: list[int], found: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([names[k] for k in found], pa.string())], names=["key", "name"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, name in enumerate(names):
            automaton.add_word(name, k)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for start in range(0, batch.num_rows, TEXTS):
                for i, text in enumerate(batch.column(1).slice(start, TEXTS).to_pylist(), start):
                    hits = {k for _, k in automaton.iter(text)} if text else ()
                    found += hits
                    rows += [i] * len(hits)
                    if len(found) >= MENTIONS:
                        yield told(batch, rows, found)
                        rows, found = [], []
            if found:
                yield told(batch, rows, found)

    return scan


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", shard: int = SHARD) -> DataFrame:
    """``key``, name: every name that the row's text contains as it stands, once a row.  Null and empty names and texts mention nothing."""
    given = names.select(F.col(name).cast("string").alias("name")).where("name != ''").distinct()
    shards = max(1, -(-given.count() // shard))
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = None
    for k in range(shards):
        part = given.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == k)
        some = sorted(r["name"] for r in part.collect())  # about ``shard`` names
        found = rows.mapInArrow(_scanner(some), f"key {kind}, name string") if some else rows.limit(0).select("key", F.lit("").alias("name"))
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", key)
