"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as a linked list of byte symbols.  A heap holds the
adjacent pairs by merge rank, then place; the lowest is popped and merged until
none is left.  The count is the initial symbols minus the merges: no ids are
made.  Pre-tokens recur, so their counts are kept in a bounded table.

Contract: one row per input row.  Null text counts as empty: 0 bytes, 0 tokens.
Null ids stay null; repeated rows are each counted; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from crawlight.llm.common import batch_of, document_view, id_and_text

#: Fixed value: the byte-level pre-tokenizer's public pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks whose letter and number classes no Unicode version has changed since long; beyond them the
#: library's own pre-tokenizer cuts the text, as its classes may be of another version.
SETTLED = regex.compile(r"[\x00-\u0527\u1E00-\u1EFF\u2000-\u205F\u20A0-\u20BF\u2190-\u23FF\u2500-\u2BFF\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3\uFF01-\uFF5E\U0001F300-\U0001F64F]*")
#: Entries of the table of pre-tokens, and the longest one kept there.
KEPT, KEPT_CHARS = 400_000, 64

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 codes stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of texts under one vocabulary file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        codes = {letter: b for b, letter in letters.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = codes.setdefault(left + right, len(codes))
            self.pairs.setdefault((codes[left], codes[right]), (rank, made))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PRE_TOKEN).findall
        self.kept: dict[str, int] = {}
        self.library_split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def merged(self, raw: bytes) -> int:
        """Symbols that are left of one pre-token."""
        n = len(raw)
        if n < 2:
            return n
        pairs, symbols = self.pairs, list(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1) if (found := pairs.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            merges += 1
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((made, symbols[k])):
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbols[h], made))):
                heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return n - merges

    def _missed(self, token: str) -> int:
        count = self.merged(token.encode("utf-8", "surrogatepass"))
        if len(token) <= KEPT_CHARS:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[token] = count
        return count

    def _plain(self, text: str) -> int:
        if SETTLED.fullmatch(text):
            tokens = self.split(text)
        else:
            tokens = [text[a:b] for _, (a, b) in self.library_split(text)]
        known = self.kept.get
        counts = list(map(known, tokens))
        try:
            return sum(counts)
        except TypeError:
            return sum(c if c is not None else (known(t) or self._missed(t)) for c, t in zip(counts, tokens, strict=True))

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_counters: dict[str, MergeCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row.

    ``vocabulary`` is a byte-level BPE file that every node has at that path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(vocabulary) or _counters.setdefault(vocabulary, MergeCounter(vocabulary))
        for ids, texts in id_and_text(batches):
            counts, sizes = [], []
            for text in texts:
                text = text.as_py()
                counts.append(counter.count(text))
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
            yield batch_of(_SCHEMA, ids, sizes, counts)

    return document_view(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
