"""Substring dedup: repeated fixed-length token windows are removed.

Every window of WIDTH words has a Rabin-Karp hash.  Which windows go into the
shuffle is settled first, exactly: each window names one of its short word
runs (its anchor: the run with the longest words, then by hash, leftmost), so
equal windows name equal anchors, and neighbouring windows mostly share one.
Anchors are far fewer than windows; Spark finds those that several documents
have, and only windows at such anchors are hashed and counted: for each window
hash the smallest document id.  Windows that start in a document with a
smaller id merge into maximal intervals, whose words go.

Equal texts are one: of them the row with the smallest id takes part, every
other row loses all its words to it (if it has WIDTH or more).

Contract: one row per input row.  Null text has no words.  A null id is
smaller or larger than no other, so such rows neither remove nor lose words.
Rows with equal ids are one document: they do not remove each other's words.
Texts under WIDTH words lose nothing.  An empty table gives no rows; other
columns are ignored.  Window and text hashes have 64 bits; equal hashes count
as equal windows and texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlight.llm.common import batch_of, buffers, discard, distinct, document_view, hash_words, mix, raw_texts, rolling, slices, written
from crawlight.llm.graphs import lookup

#: An anchor with more than one in so many of the shared rows is heavy.
HEAVY = 2000
#: Repeated windows at heavy anchors that are broadcast at most (16 bytes each); beyond them they are joined.
BROADCAST_WINDOWS = 1 << 20
#: Words of a window, and of an anchor.
WIDTH, ANCHOR = 13, 4

_ANCHORS = pa.schema([("key", pa.int64()), ("text_key", pa.int64())])
_PLACES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32())])
_PLACE_LISTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("places", pa.list_(pa.int32()))])
_RESULT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_RESULT_DDL = "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string"


def anchor_places(hashes: np.ndarray, lengths: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, the place of its anchor; and the hashes of all anchor-long runs."""
    keys = rolling(hashes, anchor)
    total = np.r_[0, np.cumsum(lengths)]
    long = np.minimum(total[anchor:] - total[:-anchor], 4095).astype(np.uint64)
    score = (long << np.uint64(52)) | (mix(keys) >> np.uint64(12))
    span = width - anchor + 1
    return np.arange(len(hashes) - width + 1) + np.lib.stride_tricks.sliding_window_view(score, span).argmax(1), keys


def _word_arrays(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, word hashes and word lengths of each text."""
    data, bounds = buffers(column)
    hashes, words, starts, ends = hash_words(data, bounds, fold=False, places=True)
    lengths = ends - starts
    for i, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist(), strict=True)):
        yield i, hashes[a:b], lengths[a:b]


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys, owners = batch.column(0).to_pylist(), [], []
            for i, hashes, lengths in _word_arrays(batch.column(1)):
                if len(hashes) >= width:
                    places, runs = anchor_places(hashes, lengths, width)
                    found = np.unique(runs[places])
                    keys.append(found)
                    owners.append(np.full(len(found), ids[i], np.int64))
            if keys:
                yield batch_of(_ANCHORS, np.concatenate(keys).view(np.int64), np.concatenate(owners))

    return docs.mapInArrow(run, "key long, text_key long")


def _windows(candidates: DataFrame, width: int, heavy: np.ndarray, crowded: bool) -> DataFrame:
    """The distinct windows of (doc_id, text_key, text, keys) whose anchor is among keys, and heavy or not as asked.

    ``place`` is a window's place among its text's sorted distinct windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            ids, marks, shared = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, hashes, lengths in _word_arrays(batch.column(2)):
                if len(hashes) < width:
                    continue
                places, runs = anchor_places(hashes, lengths, width)
                at = runs[places].view(np.int64)
                chosen = np.isin(at, shared[i].values.to_numpy()) & (np.isin(at, heavy) == crowded)
                if chosen.any():
                    windows = rolling(hashes, width)
                    found, every = distinct(windows[chosen]), distinct(windows)
                    for column, values in zip(out, (found.view(np.int64), np.full(len(found), ids[i]), np.full(len(found), marks[i]), np.searchsorted(every, found).astype(np.int32)), strict=True):
                        column.append(values)
            if out[0]:
                yield batch_of(_PLACES, *map(np.concatenate, out))

    return candidates.select("doc_id", "text_key", "text", "keys").mapInArrow(run, "key long, doc_id long, text_key long, place int")


def _crowded_places(candidates: DataFrame, width: int, heavy: np.ndarray, keys: np.ndarray, firsts: np.ndarray) -> DataFrame:
    """doc_id, text_key and the places of its windows at heavy anchors that start in an earlier document.

    ``keys`` (sorted) and ``firsts`` are the repeated windows at heavy anchors and their smallest ids.
    """
    shared = candidates.sparkSession.sparkContext.broadcast((keys, firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts = shared.value
        for batch in slices(batches, 2):
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], []]
            for i, hashes, lengths in _word_arrays(batch.column(2)):
                if len(hashes) < width:
                    continue
                places, runs = anchor_places(hashes, lengths, width)
                chosen = np.isin(runs[places].view(np.int64), heavy)
                if not chosen.any():
                    continue
                windows = rolling(hashes, width)
                found = distinct(windows[chosen]).view(np.int64)
                at = np.searchsorted(keys, found)
                at[at == len(keys)] = 0
                gone = (keys[at] == found) & (firsts[at] < ids[i])
                if gone.any():
                    for column, value in zip(out, (ids[i], marks[i], np.searchsorted(distinct(windows), found[gone].view(np.uint64)).astype(np.int32)), strict=True):
                        column.append(value)
            yield batch_of(_PLACE_LISTS, *out)

    return candidates.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, places array<int>")


def _plain(docs: DataFrame) -> DataFrame:
    """Every row as if nothing were removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sizes, digests = [], []
            for raw in raw_texts(batch.column(2)):
                words = raw.split()
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield batch_of(_RESULT, batch.column(0), batch.column(1), sizes, [0] * len(sizes), digests)

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, _RESULT_DDL)


def intervals(starts: np.ndarray, width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal intervals of words that windows at these sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + width).tolist(), strict=True))


def _removed(rows: DataFrame, width: int) -> DataFrame:
    """Result rows of (doc_id, text_key, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sizes, gone, digests = [], [], []
            raws = raw_texts(batch.column(2))
            for i, hashes, _ in _word_arrays(batch.column(2)):
                words, windows = raws[i].split(), rolling(hashes, width)
                starts = np.flatnonzero(np.isin(windows, distinct(windows)[batch.column(3)[i].values.to_numpy()]))
                kept, at = [], 0
                for a, b in intervals(starts, width):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                sizes.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield batch_of(_RESULT, batch.column(0), batch.column(1), sizes, gone, digests)

    return rows.select("doc_id", "text_key", "text", "places").mapInArrow(run, _RESULT_DDL)


def repeated_windows(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    view = document_view(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    named = view.where("doc_id is not null")
    keys = named.select("doc_id", "text_key")
    texts = written(keys.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "windows-texts")

    anchors = written(_anchors(named.select("text_key", "text"), width), "windows-all-anchors")
    several = anchors.groupBy("key").agg(F.min("text_key").alias("x"), F.max("text_key").alias("y"), F.count("*").alias("n")).where("x != y").select("key", "n")
    several = written(several, "windows-several")
    shared = several.agg(F.sum("n")).first()[0] or 0
    # anchors with over 1/HEAVY of the shared rows are fewer than HEAVY
    heavy = np.array(sorted(r["key"] for r in several.where(F.col("n") * HEAVY > shared).select("key").collect()), np.int64)
    # rows of heavy anchors are kept anyway: they are dealt by text and need no partner
    hot = F.col("key").isin(heavy.tolist())
    dealt = anchors.select("text_key", F.when(hot, F.col("key")).alias("hot"), F.when(hot, F.xxhash64("text_key", "key")).otherwise(F.col("key")).alias("probe"))
    met = dealt.join(several.select(F.col("key").alias("probe"), F.lit(True).alias("met")).hint("merge"), "probe", "left").where("hot is not null or met")
    hits = met.groupBy("text_key").agg(F.collect_set(F.coalesce("hot", "probe")).alias("keys"))
    hits = written(hits.join(texts, "text_key").select(F.col("first_id").alias("doc_id"), "text_key", "keys"), "windows-anchors")
    discard(anchors)
    candidates = written(named.join(hits.hint("merge"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]), "windows-candidates")

    others = _windows(candidates, width, heavy, False).withColumn("first", F.min("doc_id").over(Window.partitionBy("key"))).where("first < doc_id")
    places = others.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))
    if len(heavy):
        # windows at heavy anchors are counted before the shuffle; of the others no key has more rows than its anchor
        crowded = _windows(candidates, width, heavy, True)
        firsts = crowded.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
        firsts = written(firsts, "windows-firsts")
        if firsts.count() <= BROADCAST_WINDOWS:
            known = firsts.toArrow().sort_by("key")
            lost = _crowded_places(candidates, width, heavy, known["key"].to_numpy(), known["first"].to_numpy())
        else:
            lost = crowded.join(firsts.hint("merge"), "key").where("first < doc_id").groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))
        places = places.unionByName(lost).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("places")).alias("places"))
    places = written(places, "windows-places")
    changed = written(_removed(candidates.join(places.hint("merge"), ["doc_id", "text_key"]), width), "windows-removed")

    # later rows of a text lose everything
    copies = lookup(keys, texts.where("rows > 1"), "text_key", "rows", docs.count(), "inner").where("doc_id > first_id").select("doc_id", "text_key").distinct()
    changed = changed.select("doc_id", "text_key", F.col("n_removed").alias("r"), F.col("kept_sha256").alias("k"))
    changed = changed.unionByName(copies.select("doc_id", "text_key", F.lit(-1).cast("long").alias("r"), F.lit(hashlib.sha256(b"").hexdigest()).alias("k")))
    out = _plain(view).join(changed, ["doc_id", "text_key"], "left")
    copy, short = F.col("r") == -1, F.col("n_words") < width
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.when(short, 0).otherwise(F.col("n_words"))).otherwise(F.coalesce("r", "n_removed")).alias("n_removed"),
        F.when(copy & short, F.col("kept_sha256")).otherwise(F.coalesce("k", "kept_sha256")).alias("kept_sha256"),
    )
