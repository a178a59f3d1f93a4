"""Best-fit packing of token pieces by bin completion.

Documents become ids plus an end id and are cut into pieces of at most the
capacity; full pieces are sequences of their own.  The other pieces matter
only by length, so the histogram of lengths (fewer entries than the capacity)
is all that is solved: bin completion takes the largest length left,
enumerates the undominated fillings of the room beside it, applies a filling
as often as the counts allow or once, prunes by the waste that the incumbent
still permits, and starts from best-fit decreasing as incumbent.  The plan says for
each length which of its ranks go to which sequences; ranks come from counts
per block of pieces, so no length is ever gathered in one task.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlight.llm.common import batch_of, document_view, slices, written
from crawlight.llm.token_counts import PRE_TOKEN, byte_letters

#: Pieces that a block holds about.
BLOCK = 20_000
#: Steps of the search before the incumbent stands; bytes of the states it remembers (forgetting only repeats work).
STEPS, SEEN_BYTES = 200_000, 64 << 20
#: Characters of a text that are encoded at a time, about.
CHUNK = 1 << 20
#: A place where a text can be cut without changing its ids: no pre-token spans the gap before a blank between letters.
SAFE = re.compile(r"[A-Za-z](?= [A-Za-z])")

Plan = list[tuple[tuple[int, ...], int]]


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Plan:
    """Each length, largest first, into the fullest sequences that have room; equal ones are placed together."""
    rooms: list[int] = []
    bins: dict[int, list[list]] = {}

    def add(room: int, items: tuple[int, ...], n: int) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append([items, n])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fits = capacity // length
                if left >= fits:
                    add(capacity - fits * length, (length,) * fits, left // fits)
                    left %= fits
                else:
                    add(capacity - left * length, (length,) * left, 1)
                    left = 0
                continue
            room = rooms[at]
            entry = bins[room][-1]
            n = min(left, entry[1])
            fits = min(room // length, left // n)
            entry[1] -= n
            if not entry[1]:
                bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            add(room - fits * length, entry[0] + (length,) * fits, n)
            left -= n * fits
    return [(items, n) for room in rooms for items, n in bins[room]]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by what cannot share a sequence."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return 0
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    best = -(-int(lengths @ counts) // capacity)
    for k in [0, *[x for x in lengths.tolist() if x <= capacity // 2]]:
        alone, half = lengths > capacity - k, (lengths <= capacity - k) & (2 * lengths > capacity)
        small = (lengths >= k) & (2 * lengths <= capacity)
        room = int(counts[half].sum()) * capacity - int(lengths[half] @ counts[half])
        more = int(lengths[small] @ counts[small]) - room
        best = max(best, int(counts[alone].sum() + counts[half].sum()) + max(0, -(-more // capacity)))
    return best


def _fillings(counts: np.ndarray, room: int, waste: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of the room that leave at most ``waste`` of it, made one at a time, largest lengths first.

    A filling is dominated if an unused length could join it, or take the place
    of one or two of its lengths: whatever it holds then fits elsewhere no worse.
    Each step takes one from ``budget``; nothing is made once that is used up.
    """
    present = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    if present and present[0] == room:
        yield (room,)  # every other filling would fit into that one length's place
        return
    left_of = {x: int(counts[x]) for x in present}
    ascending = present[::-1]

    def open_between(least: int, most: int) -> bool:
        """Whether a length from least to most is unused."""
        return any(left_of[y] for y in ascending[bisect.bisect_left(ascending, max(least, 1)) : bisect.bisect_right(ascending, most)])

    def dominated(items: list[int], left: int) -> bool:
        if open_between(1, left):
            return True
        kinds = sorted(set(items))
        if left and any(open_between(x + 1, x + left) for x in kinds):
            return True
        for k, x in enumerate(kinds):
            for y in kinds[k:]:
                if (x != y or items.count(x) > 1) and x + y <= room and open_between(x + y, x + y + left):
                    return True
        return False

    items: list[int] = []
    frames = [(0, room)]  # next length to try, room left
    while frames:
        at, left = frames.pop()
        budget[0] -= 1
        if budget[0] < 0:
            return
        at = max(at, len(ascending) - bisect.bisect_right(ascending, left))
        while at < len(present) and not left_of[present[at]]:
            at += 1
        if at < len(present):
            x = present[at]
            frames += [(at + 1, left), (at, left - x)]  # without this length after all; with it first
            items.append(x)
            left_of[x] -= 1
            continue
        if left <= waste and not dominated(items, left):
            yield tuple(items)
        if frames:  # the frame on top goes on without the last length
            left_of[items.pop()] += 1


def bin_completion(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> Plan:
    """(lengths of a sequence, how many such sequences) that hold all of the histogram in as few sequences as it finds.

    The search is exact unless ``steps`` (nodes, and steps of enumeration) run out first; then the incumbent stands.
    """
    histogram = {int(k): int(v) for k, v in histogram.items() if v}
    if any(not 0 < k <= capacity for k in histogram):
        raise ValueError("a length is not between 1 and the capacity")
    best = best_fit_decreasing(histogram, capacity)
    most, least = sum(n for _, n in best), lower_bound(histogram, capacity)
    total = sum(k * v for k, v in histogram.items())
    counts = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    budget = [steps]
    seen: dict[bytes, int] = {}

    def children(waste: int) -> Iterator[tuple]:
        """Sequences around the largest length left: each filling as often as it goes, then once."""
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        beside = counts.copy()
        counts[largest] += 1
        for items in _fillings(beside, capacity - largest, (most - 1) * capacity - total - waste, budget):
            pattern = (largest, *items)
            need = Counter(pattern)
            times = min(int(counts[x]) // m for x, m in need.items())
            for n in dict.fromkeys((times, 1)):
                yield pattern, need, n, waste + n * (capacity - sum(pattern))

    def rest() -> dict[int, int]:
        return {x: int(counts[x]) for x in np.flatnonzero(counts).tolist()}

    path: list[tuple] = []
    made = 0
    stack: list[Iterator[tuple]] = [children(0)] if total and most > least else []
    while stack and budget[0] > 0 and most > least:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                _, need, times, _ = path.pop()
                made -= times
                for x, m in need.items():
                    counts[x] += m * times
            continue
        # what may be wasted by a packing with one sequence less than the incumbent
        if step[3] > (most - 1) * capacity - total:
            continue
        budget[0] -= 1
        path.append(step)
        made += step[2]
        for x, m in step[1].items():
            counts[x] -= m * step[2]
        if not counts.any():
            if made < most:
                best, most = [(p, n) for p, _, n, _ in path], made
            stack.append(iter(()))
            continue
        state = counts.tobytes()
        known = seen.get(state)
        if (known is not None and known <= made) or made + lower_bound(rest(), capacity) >= most:
            stack.append(iter(()))
            continue
        if len(seen) * len(state) < SEEN_BYTES:
            seen[state] = made
        stack.append(children(step[3]))
    return best


def encoding_of(vocabulary: str) -> tiktoken.Encoding:
    """The ids of a byte-level BPE file, special strings as single ids."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    codes = {letter: b for b, letter in byte_letters().items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(codes[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them.

    ``tiktoken`` with the same vocabulary gives the same ids in a quarter of the
    time, but its pattern fails on runs of about a million blanks; such texts
    are encoded by the library itself.  Long texts are cut where that changes
    no id, so memory follows CHUNK and not the text.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary, self.fast, self.library = vocabulary, encoding_of(vocabulary), None

    def chunks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHUNK:
            cut = SAFE.search(text, at + CHUNK)
            if cut is None:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:] if at else text

    def ids(self, text: str) -> np.ndarray:
        out = []
        for part in self.chunks(text):
            try:
                out.append(self.fast.encode_to_numpy(part, allowed_special="all"))
            except ValueError:
                # loaded where it is needed: workers outlive a stage, and with them what they hold
                self.library = self.library or Tokenizer.from_file(self.vocabulary)
                out.append(np.array(self.library.encode(part, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(out) if len(out) > 1 else out[0]


_encoders: dict[str, Encoder] = {}
_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_RESULT_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_DDL = "row long, " + _RESULT_DDL
_PACKED_DDL = _RESULT_DDL + ", sequence_id long, offset long"


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, piece, start, length and ids_crc32: ids and the end id, cut so that only the first piece may be shorter.

    ``row`` numbers the pieces by task and place; it is meant to be written at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, Encoder(vocabulary))
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.append(encoder.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = len(tokens) % capacity or capacity
                start = 0
                for piece, end in enumerate(range(first, len(tokens) + 1, capacity)):
                    for column, value in zip(out, (row, doc_id, piece, start, end - start, zlib.crc32(tokens[start:end].tobytes())), strict=True):
                        column.append(value)
                    start = end
                    row += 1
            yield batch_of(_PIECES, *out)

    return document_view(docs, id_col, text_col).mapInArrow(run, _PIECES_DDL)


def slots_of(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, the runs' first sequence, and their offset in it."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            runs.setdefault(length, []).append((rank, sequence, offset))
            taken[length] = rank + n
            offset += length
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for length, rows in runs.items()}


def pack_pieces(pieces: DataFrame, capacity: int, steps: int = STEPS) -> DataFrame:
    """The written pieces with sequence_id and offset.

    Full pieces take negative sequence ids; the others take the plan's, from 0 on.
    """
    short = pieces.where(F.col("length") < capacity)
    total = short.count()
    blocks = -(-total // BLOCK) or 1
    # rows are numbered, so neither null nor repeated ids make a block larger
    short = short.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    counts = written(short.groupBy("length", "block").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer rows than the capacity
    slots = slots_of(bin_completion(histogram, capacity, steps))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))

    def place(rows: pd.DataFrame, bases: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"])
        base = dict(zip(bases["length"].tolist(), bases["base"].tolist(), strict=True))
        sequences, offsets = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        at = 0
        for length, n in rows.groupby("length", sort=True).size().items():
            ranks = base[length] + np.arange(n)
            first, sequence, offset = slots[length]
            k = np.searchsorted(first, ranks, "right") - 1
            sequences[at : at + n], offsets[at : at + n] = sequence[k] + ranks - first[k], offset[k]
            at += n
        return rows.drop(columns=["row", "block"]).assign(sequence_id=sequences, offset=offsets)

    packed = short.groupBy("block").cogroup(bases.groupBy("block")).applyInPandas(place, _PACKED_DDL)
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full.drop("row"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset: all pieces of all rows.

    Null text is empty and gives a piece of the end id alone; null ids stay
    null; repeated rows are packed as often as they come; an empty table gives
    no rows; other columns are ignored.  Pieces of any length are whole: only
    documents longer than the capacity are cut.  Texts of any length and kind
    are encoded, runs of millions of blanks or letters among them.
    """
    return pack_pieces(written(pieces_of(docs, vocabulary, capacity, end_id, id_col, text_col), "packing-pieces"), capacity, steps)
