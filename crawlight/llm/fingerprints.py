"""Merkle fingerprints of documents.

Lines are paragraphs; long ones are cut at words chosen by content, so an
edit moves no cut but its own.  A leaf is the digest of a piece's bytes,
leaves are grouped to sections at leaves chosen by content, a section's
digest covers its leaves and the root covers the sections.  Roots test
equality; going down only into sections whose digests differ locates edits.

A fingerprint is the text "root|section=leaf,leaf|section=leaf..."; a section
is twelve, a leaf eight hex digits of its digest and, in hex, its bytes.

Contract: one row per input row.  Null text counts as empty.  Null ids sort
before all others, rows of equal ids by their text; the first row follows the
last, so a single row follows itself.  Likeness is the share of bytes in equal
sections and, below the others, in equal leaves (1 for two empty texts).
``edit_start`` and ``edit_end`` are the bytes between which the edit changed
leaves of the text, null where it changed none.  An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlight.llm.common import batch_of, document_view, hash_words, mix, slices

#: One word in so many starts a leaf, one leaf in so many starts a section.
LEAF_WORDS, SECTION_LEAVES = 8, 16
NO_ID = -(2**63)


def _cuts(raw: bytes) -> list[int]:
    """Byte places where leaves start, and the end."""
    data = np.frombuffer(raw, np.uint8)
    hashes, _, starts, _ = hash_words(data, np.array([0, len(data)]), fold=False, places=True)
    # the word before has a say too, so that frequent words alone make few leaves
    before = np.zeros_like(hashes)
    before[1:] = hashes[:-1]
    chosen = starts[(mix(hashes * np.uint64(3) + before) % np.uint64(LEAF_WORDS)) == 0]
    lines = np.flatnonzero(data == 0x0A) + 1
    return np.unique(np.concatenate([[0], chosen, lines, [len(data)]])).tolist()


def fingerprint(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    sections: list[str] = []
    digests: list[bytes] = []
    leaves: list[bytes] = []
    names: list[str] = []
    sizes: list[int] = []

    def close() -> None:
        digest = hashlib.blake2b(b"".join(leaves), digest_size=16).digest()
        digests.append(digest)
        sections.append(f"{digest[:6].hex()}{sum(sizes):x}={','.join(names)}")
        leaves.clear()
        names.clear()
        sizes.clear()

    cuts = _cuts(raw) if raw else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        leaf = hashlib.blake2b(raw[a:b], digest_size=16).digest()
        if leaves and leaf[15] % SECTION_LEAVES == 0:
            close()
        leaves.append(leaf)
        sizes.append(b - a)
        names.append(f"{leaf[:4].hex()}{b - a:x}")
    if leaves:
        close()
    root = hashlib.blake2b(b"".join(digests), digest_size=16).hexdigest()
    return "|".join([root, *sections])


def _sections(mark: str) -> list[tuple[str, str]]:
    """Name and leaves of each section."""
    return [(name, leaves) for name, _, leaves in (section.partition("=") for section in mark.split("|")[1:])]


def _below(sections: list[tuple[str, str]], equal: Counter) -> Counter:
    """The leaves of the sections that are not among the equal ones."""
    left, out = equal.copy(), Counter()
    for name, leaves in sections:
        if left[name]:
            left[name] -= 1
        else:
            out.update(leaves.split(","))
    return out


def likeness(a: str, b: str) -> float:
    """Bytes in equal sections, and in equal leaves below differing ones, of all bytes: 1 for equal roots, 0 if nothing is shared."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    x, y = _sections(a), _sections(b)
    equal = Counter(name for name, _ in x) & Counter(name for name, _ in y)
    size = lambda names, digits: sum(int(name[digits:], 16) * n for name, n in names.items())
    same = size(equal, 12) + size(_below(x, equal) & _below(y, equal), 8)
    return 2 * same / max(size(Counter(name for name, _ in x), 12) + size(Counter(name for name, _ in y), 12), 1)


def _shared_ends(x: list, y: list) -> tuple[int, int]:
    """How many first and, of the rest, last entries two lists share."""
    most = min(len(x), len(y))
    head = next((k for k in range(most) if x[k] != y[k]), most)
    tail = next((k for k in range(most - head) if x[-1 - k] != y[-1 - k]), most - head)
    return head, tail


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges of the first text that the second lacks or has elsewhere, found below differing sections only.

    Sections, then leaves, that both texts begin or end with are set aside; of the leaves between, those are kept that
    the second text has in the same order, each taken at its next place.  If the second text only has more, the range
    is empty and stands where that begins; different texts always have a range.
    """
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    x, y = _sections(a), _sections(b)
    head, tail = _shared_ends([name for name, _ in x], [name for name, _ in y])
    at = sum(int(name[12:], 16) for name, _ in x[:head])
    x, y = ([leaf for _, leaves in s[head : len(s) - tail] for leaf in leaves.split(",")] for s in (x, y))
    head, tail = _shared_ends(x, y)
    at += sum(int(leaf[8:], 16) for leaf in x[:head])
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    places: dict[str, list[int]] = {}
    for k, leaf in enumerate(y):
        places.setdefault(leaf, []).append(k)
    out: list[tuple[int, int]] = []
    begin, reached, more = at, 0, None
    for leaf in x:
        end = at + int(leaf[8:], 16)
        later = places.get(leaf, [])
        k = bisect.bisect_left(later, reached)
        if k < len(later):
            if later[k] > reached and more is None:
                more = at
            reached = later[k] + 1
        elif out and out[-1][1] == at:
            out[-1] = (out[-1][0], end)
        else:
            out.append((at, end))
        at = end
    return out or [(begin if not x else more if more is not None else at,) * 2]


_DEALT = pa.schema([("part", pa.int32()), ("after", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edit_start", pa.int64()), ("edit_end", pa.int64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long, edit_end long"


def _dealt(view: DataFrame) -> DataFrame:
    """Each row with its range of ids, and each range's first row again, after the range before it."""
    parts = 4 * max(int(view.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    shares = [k / parts for k in range(1, parts)]
    found = view.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, 100 * parts).alias("bounds")).first()
    least = found["least"]
    # the bounds are ids that occur, so each is the first id of its range
    bounds = sorted({b for b in found["bounds"] or [] if b > least}) if least is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {b: k for k, b in enumerate(bounds)} | {least: len(bounds)}
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            yield batch_of(_DEALT, [bisect.bisect_right(bounds, i) for i in ids], [False] * len(ids), batch.column(0), batch.column(1))
            again = [k for k, i in enumerate(ids) if i in firsts]
            if again:
                rows = batch.take(pa.array(again))
                yield batch_of(_DEALT, [firsts[ids[k]] for k in again], [True] * len(again), rows.column(0), rows.column(1))

    dealt = view.mapInArrow(run, "part int, after boolean, doc_id long, text string")
    return dealt.repartition(max(parts // 4, 1), "part").sortWithinPartitions("part", "after", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text edited with its successor's start, and their likeness."""

    def result(row: tuple, following: tuple) -> list:
        _, doc_id, text, mark = row
        k = len(text) // 4
        edited = text[: len(text) - k] + following[2][:k]
        edited_mark = fingerprint(edited) if k else mark
        spans = differing(mark, edited_mark)
        where = [spans[0][0], spans[-1][1]] if spans else [None, None]
        return [None if doc_id == NO_ID else doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, following[3]), *where]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, id, text and fingerprint of the row that waits for its successor
        for batch in slices(batches, 3):
            out: list[list] = []
            for part, after, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or last[0] != part:
                    if after:
                        continue  # a further row of the successor's id
                row = (part, doc_id, text, fingerprint(text))
                if last is not None and last[0] == part:
                    out.append(result(last, row))
                last = None if after else row
            if out:
                yield batch_of(_OUT, *zip(*out, strict=True))

    view = document_view(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    return _dealt(view).mapInArrow(run, _DDL)
