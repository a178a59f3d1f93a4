"""License scans: winnowed template fingerprints, then banded alignment.

Templates are the full texts of public licenses (``license_texts``) and short
statements and openings that name one.  A template of more than PART words is
cut into parts.  A part's word runs are winnowed into an inverted index (hash
to part and place), which is as large as the templates, not the corpus.  A
document's runs are looked up; each chain of hits on near diagonals is a
candidate, and a banded alignment of the part with the words around it gives
the matched words and their span; every copy is a candidate, also of copies
next to each other.  A part of a long template counts if half of its words
match.  Parts of one template that follow each other are one match, and up to
GAP words put in between two parts cost nothing; its coverage is the matched
words over all words of the template: of a full text, the share of the
license; of a statement or an opening, of that sentence alone.

Contract: any number of rows per document, one per match, best spans first by
place; documents without a match give none.  Null text counts as empty; null
ids are carried; repeated rows report again; an empty table or no templates
give no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crawlight.llm.common import batch_of, buffers, document_view, hash_words, rolling, slices

#: Half width of the alignment's band; words of a part; words between two parts of one match at most.
BAND, PART, GAP = 8, 64, 200
#: Words of a run and runs of a winnowing window: of short templates, and of parts of long ones, whose short runs are everyday words.
SHORT, LONG = (3, 2), (6, 4)
#: Public license statements and the openings of license texts.
STATEMENTS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License.",
    "MIT-opening": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def templates() -> dict[str, str]:
    """The statements, and the full texts as ``<license>-text``."""
    folder = Path(__file__).parent / "license_texts"
    return STATEMENTS | {f"{path.stem}-text": path.read_text(encoding="utf-8") for path in sorted(folder.glob("*.txt"))}


_MATCHES = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
_DDL = "doc_id long, license string, coverage double, matched_words int, start_word long, end_word long, start_byte long, end_byte long"


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return hash_words(data, np.array([0, len(data)]))[0] if len(data) else np.empty(0, np.uint64)


def winnow(runs: np.ndarray, window: int) -> np.ndarray:
    """Places of each window's smallest hash, the rightmost of equal ones."""
    if len(runs) <= window:
        return np.array([int(runs.argmin())]) if len(runs) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(runs, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))


class TemplateIndex:
    """Inverted index of the parts' winnowed runs, one for each length of run."""

    def __init__(self, texts: dict[str, str]):
        self.names, self.sizes = list(texts), []
        self.parts: list[tuple[int, int, np.ndarray]] = []  # template, part of it, words
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, text in enumerate(texts.values()):
            words = words_of(text)
            self.sizes.append(len(words))
            run, window = SHORT if len(words) <= PART else LONG
            for j, start in enumerate(range(0, len(words), PART)):
                part = words[start : start + PART]
                length = min(run, len(part))
                runs = rolling(part, length)
                for p in winnow(runs, window).tolist():
                    self.at.setdefault(length, {}).setdefault(int(runs[p]), []).append((len(self.parts), p))
                self.parts.append((k, j, part))
        self.hashes = {length: np.array(sorted(at), np.uint64) for length, at in self.at.items()}

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(part, place where it would start) of every run that the index has."""
        for length, hashes in self.hashes.items():
            runs = rolling(words, length)
            for p in np.flatnonzero(np.isin(runs, hashes)).tolist():
                for part, q in self.at[length][int(runs[p])]:
                    yield part, p - q


def align(template: np.ndarray, words: np.ndarray, band: int = BAND) -> tuple[int, int, int]:
    """Matched words and the span (from, to) in ``words`` of the best local banded alignment.

    A match counts 2, a skipped or changed word costs 1; cells more than
    ``band`` off the diagonal of ``words`` (which starts ``band`` words before
    the template's expected place) are not visited.
    """
    n, m = len(template), len(words)
    best = (0, 0, 0, 0)
    above = [(0, 0, 0)] * (m + 1)  # score, matches, start
    for i in range(1, n + 1):
        row = [(0, 0, 0)] * (m + 1)
        for j in range(max(1, i - band), min(m, i + 3 * band) + 1):
            score, matched, start = above[j - 1]
            if template[i - 1] == words[j - 1]:
                cell = (score + 2, matched + 1, start if score else j - 1)
            else:
                cell = max((score - 1, matched, start), (above[j][0] - 1, *above[j][1:]), (row[j - 1][0] - 1, *row[j - 1][1:]))
                if cell[0] <= 0:
                    cell = (0, 0, 0)
            row[j] = cell
            if cell[0] > best[0]:
                best = (*cell, j)
        above = row
    return best[1], best[2], best[3]


def _occurrences(own: np.ndarray, words: np.ndarray, lo: int, hi: int, needed: float) -> list[tuple[int, int, int]]:
    """(matched words, from, to) of a part in a stretch of the document: the best alignment, then what is left of it before."""
    found = []
    while hi - lo >= needed:
        matched, a, b = align(own, words[lo:hi])
        if not matched or matched < needed:
            break
        found.append((matched, lo + a, lo + b))
        hi = lo + a
    return found[::-1]


def _aligned(words: np.ndarray, index: TemplateIndex, least: float) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each template (part, matched words, from, to) of its parts found in the document, by place."""
    chains: dict[int, set[int]] = {}
    for part, place in index.hits(words):
        chains.setdefault(part, set()).add(place)
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for part, places in chains.items():
        template, j, own = index.parts[part]
        n = len(own)
        # of a long template half of a part is enough: the template's coverage decides
        needed = (least if n == index.sizes[template] else min(least, 0.5)) * n
        # two copies of a part are its length apart, so hits less than half of that apart are of one copy
        near, places = min(BAND, (n - 1) // 2), sorted(places)
        at, end, out = 0, 0, found.setdefault(template, [])
        while at < len(places):
            first = at
            while at + 1 < len(places) and places[at + 1] - places[first] <= near:
                at += 1
            at += 1
            p = places[first]
            if p >= end and np.array_equal(words[p : p + n], own):
                hits = [(n, p, p + n)]
            else:
                # what an earlier copy has taken is not aligned again
                hits = _occurrences(own, words, max(p - BAND, end), max(0, p + n + 2 * BAND), needed)
            for matched, a, b in hits:
                out.append((j, matched, a, b))
                end = b
    return {template: sorted(parts, key=lambda x: (x[2], x[0])) for template, parts in found.items()}


def _runs(parts: list[tuple[int, int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """Matched words and span of runs of parts: of each part's heaviest run, those that do not overlap and match most words in all.

    In a run, parts follow each other in template and document and are no more than GAP words apart; it has ``least``
    matched words.  One sweep finds the heaviest run that ends with each part, another chooses among them.
    """
    sums, starts = [x[1] for x in parts], [x[2] for x in parts]
    for k, x in enumerate(parts):
        for i in range(k - 1, -1, -1):
            y = parts[i]
            if x[2] - y[2] > GAP + 4 * PART:
                break
            if y[0] < x[0] and y[3] <= x[2] and x[2] - y[3] <= GAP and sums[i] + x[1] > sums[k]:
                sums[k], starts[k] = sums[i] + x[1], starts[i]
    runs = sorted((parts[k][3], starts[k], sums[k]) for k in range(len(parts)) if sums[k] >= least)
    ends, best, take = [r[0] for r in runs], [0], []
    for k, (_, start, matched) in enumerate(runs):
        before = bisect.bisect_right(ends, start, 0, k)
        take.append(before if best[before] + matched > best[-1] else -1)
        best.append(max(best[-1], best[before] + matched))
    out, k = [], len(runs)
    while k:
        if take[k - 1] < 0:
            k -= 1
        else:
            end, start, matched = runs[k - 1]
            out.append((matched, start, end))
            k = take[k - 1]
    return out


def scan_words(words: np.ndarray, index: TemplateIndex, least: float) -> list[tuple[int, float, int, int, int]]:
    """Matches (template, coverage, matched words, from, to) in the document's word hashes."""
    found = []
    for template, parts in _aligned(words, index, least).items():
        size = index.sizes[template]
        found += [(template, matched / size, matched, a, b) for matched, a, b in _runs(parts, least * size)]
    # of overlapping spans the one with more matched words, then coverage, stays
    found.sort(key=lambda x: (-x[2], -x[1], x[3], index.names[x[0]]))
    spans: list[tuple[int, int]] = []
    kept: list[tuple] = []
    for x in found:
        at = bisect.bisect_left(spans, (x[3], x[4]))
        if (at == len(spans) or x[4] <= spans[at][0]) and (at == 0 or spans[at - 1][1] <= x[3]):
            spans.insert(at, (x[3], x[4]))
            kept.append(x)
    return sorted(kept, key=lambda x: x[3])


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, least_coverage: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched_words and the span of every match, in words and in bytes; ``texts``: templates by name."""
    index = TemplateIndex(templates() if texts is None else texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches) if len(index.hashes) else ():
            data, bounds = buffers(batch.column(1))
            hashes, words, starts, ends = hash_words(data, bounds, places=True)
            ids, out = batch.column(0).to_pylist(), [[] for _ in _MATCHES]
            # one look-up for the whole batch; only documents with a hit are chained and aligned
            hit = np.zeros(len(hashes), bool)
            for length, known in index.hashes.items():
                runs = rolling(hashes, length)
                hit[: len(runs)] |= np.isin(runs, known)
            for i in np.unique(np.searchsorted(words, np.flatnonzero(hit), "right") - 1).tolist():
                a, b = int(words[i]), int(words[i + 1])
                for template, coverage, matched, s, e in scan_words(hashes[a:b], index, least_coverage):
                    row = (ids[i], index.names[template], coverage, matched, s, e, int(starts[a + s] - bounds[i]), int(ends[a + e - 1] - bounds[i]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield batch_of(_MATCHES, *out)

    return document_view(docs, id_col, text_col).mapInArrow(run, _DDL)
