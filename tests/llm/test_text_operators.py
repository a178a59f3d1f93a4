"""Operators that work text by text: token counts, packing, fingerprints, licenses, hashing."""

import hashlib
import itertools
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlight.llm import common as C
from crawlight.llm import fingerprints as M
from crawlight.llm import licenses as L
from crawlight.llm import packing as P
from crawlight.llm import token_counts as T
from tests.llm.conftest import rows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tabc'.1 ")), max_size=80)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_and_ids_equal_the_library(text):
    library = Tokenizer.from_file(VOCABULARY) if not hasattr(test_counts_and_ids_equal_the_library, "t") else test_counts_and_ids_equal_the_library.t
    test_counts_and_ids_equal_the_library.t = library
    counter = T._counters.setdefault(VOCABULARY, None) or T.MergeCounter(VOCABULARY)
    T._counters[VOCABULARY] = counter
    encoder = P._encoders.get(VOCABULARY) or P._encoders.setdefault(VOCABULARY, P.Encoder(VOCABULARY))
    ids = library.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(ids)
    assert encoder.ids(text).tolist() == ids


def long_texts():
    rng = random.Random(12)
    return [
        " " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "".join(rng.choice("abcxyz019") for _ in range(2_000_000)), " \u3000\t" * 700_000,
        "one two three, <|endoftext|> don't 42 " * 100_000, "x y" + " " * 1_500_000 + "end " + "of the text " * 200_000,
    ]


def test_ids_of_very_long_texts_equal_the_library():
    library, encoder = Tokenizer.from_file(VOCABULARY), P.Encoder(VOCABULARY)
    for text in long_texts():
        assert np.array_equal(encoder.ids(text), np.array(library.encode(text, add_special_tokens=False).ids, np.uint32))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["ab", " c", "  ", "'s", "1", " <|endoftext|>", "\n", "é", " Z z"]), max_size=40).map("".join), st.integers(1, 20))
def test_cut_texts_have_the_same_ids(text, chunk):
    encoder = P._encoders.get(VOCABULARY) or P._encoders.setdefault(VOCABULARY, P.Encoder(VOCABULARY))
    whole, old = encoder.ids(text).tolist(), P.CHUNK
    P.CHUNK = chunk
    try:
        parts = list(encoder.chunks(text))
        assert "".join(parts) == text and encoder.ids(text).tolist() == whole
    finally:
        P.CHUNK = old


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB \t\n\x0b\x0cé "), max_size=30), max_size=6), st.integers(3, 40))
def test_word_hashes_split_as_bytes_do(texts, segment):
    old, C.SEGMENT = C.SEGMENT, segment
    try:
        data, bounds = C.buffers(pa.array(texts, pa.string()))
        hashes, words = C.hash_words(data, bounds)
    finally:
        C.SEGMENT = old
    expected = [w for t in texts for w in t.encode().lower().split()]
    assert np.diff(words).tolist() == [len(t.encode().split()) for t in texts]
    assert len(hashes) == len(expected)
    seen = {}
    for h, w in zip(hashes.tolist(), expected, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * n for n in (1, 50, 3, 0, 200, 2)])], ["i", "t"])
    parts = list(C.slices([batch], 1, 52))
    assert [r for p in parts for r in p.column(0).to_pylist()] == list(range(6)) and len(parts) > 2


def test_written_tables_can_be_discarded(spark):
    from pathlib import Path

    start = C.mark()
    a, b = C.written(spark.range(5).toDF("x"), "t"), C.written(spark.range(3).toDF("x"), "t")
    path = Path(a._written_to.removeprefix("file://"))
    assert a.count() == 5 and path.exists()
    C.discard(a)
    assert not path.exists() and b.count() == 3
    C.discard_since(spark, start)
    assert not Path(b._written_to.removeprefix("file://")).exists() and C.mark() == start


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        C.shared_folder(Session())


def test_sums_of_many_tasks(spark):
    parts = [(k % 3, t, 1.0, np.full(4, t + k, np.int32).tobytes()) for t in range(40) for k in range(3)]
    got = C.tree_sum(spark.createDataFrame(parts, "chunk int, part int, weight double, values binary"), np.int32, fan=7).collect()
    assert {r.chunk: (r.weight, np.frombuffer(r["values"]).tolist()) for r in got} == {k: (40.0, [780.0 + 40 * k] * 4) for k in range(3)}


def test_token_counts_of_messy_rows(messy, nothing):
    got = T.count_tokens(messy, VOCABULARY).collect()
    assert len(got) == 11 and sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
    assert T.count_tokens(nothing, VOCABULARY).count() == 0


def brute_force_bins(lengths, capacity):
    """Fewest bins by trying all placements."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i, room in enumerate(bins):
            if room >= lengths[k] and room not in bins[:i]:
                place(k + 1, bins[:i] + [room - lengths[k]] + bins[i + 1 :])
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best


def check_plan(lengths, capacity, plan):
    held = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= capacity
        for x in pattern:
            held[x] += n
    assert held == Counter(lengths)
    return sum(n for _, n in plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_optimal_on_small_cases(lengths):
    assert check_plan(lengths, 20, P.bin_completion(Counter(lengths), 20)) == brute_force_bins(lengths, 20)


def test_bin_completion_is_optimal_with_fourteen_pieces():
    rng = random.Random(13)
    cases = [(50, [30, 26, 25, 22, 21, 19, 18, 17, 16, 16, 15, 9, 8, 6])]
    for _ in range(300):
        capacity = rng.choice([20, 50, 100, 300, 1024])
        cases.append((capacity, [rng.randint(1, max(2, int(capacity * rng.choice([0.3, 0.45, 0.6, 0.9])))) for _ in range(rng.randint(8, 14))]))
    for capacity, lengths in cases:
        most = check_plan(lengths, capacity, P.bin_completion(Counter(lengths), capacity))
        # of the brute-force search only whether one sequence less would do
        assert most == P.lower_bound(Counter(lengths), capacity) or most == brute_force_bins(lengths, capacity)


def test_bin_completion_keeps_the_incumbent_without_steps():
    lengths = [30, 26, 25, 22, 21, 19, 18, 17, 16, 16, 15, 9, 8, 6]
    assert check_plan(lengths, 50, P.bin_completion(Counter(lengths), 50, steps=0)) >= 5
    rng = random.Random(14)
    many = [rng.randint(1, 1023) for _ in range(3000)]
    assert check_plan(many, 1024, P.bin_completion(Counter(many), 1024)) <= 1.01 * P.lower_bound(Counter(many), 1024) + 1


def check_packing(frame, texts_by_row):
    library = Tokenizer.from_file(VOCABULARY)
    assert frame.groupby("sequence_id").length.sum().max() <= 1024
    for _, x in frame.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert (x.offset.to_numpy() == (x.length.cumsum() - x.length).to_numpy()).all()
    for doc_id, text in texts_by_row.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        x = frame[frame.doc_id == doc_id].sort_values("piece")
        assert x.length.sum() == len(ids) and (x.length.to_numpy()[1:] == 1024).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(x.start, x.length, strict=True)] == x.ids_crc32.tolist()


def test_packing_of_repeated_rows(spark, monkeypatch):
    """Rows that agree in everything are dealt to all blocks and packed each."""
    monkeypatch.setattr(P, "BLOCK", 50)
    got = P.pack_documents(spark.createDataFrame([(None, "a b c")] * 600 + [(4, "x " * 700)] * 3, "doc_id long, text string"), VOCABULARY).toPandas()
    assert len(got) == 600 + 3 and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got.drop_duplicates(["sequence_id", "offset"]).shape[0] == len(got)


def test_packing_round_trip(spark, messy, nothing):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(3000))) for _ in range(60)]
    texts += ["word " + " " * 1_500_000, "b" * 1_200_000]
    check_packing(P.pack_documents(rows(spark, texts), VOCABULARY).toPandas(), dict(enumerate(texts)))
    got = P.pack_documents(messy, VOCABULARY).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024 and (got.piece == 0).sum() == 11
    assert P.pack_documents(nothing, VOCABULARY).count() == 0


def test_fingerprints(spark, messy, nothing):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(200))) for _ in range(40)] + ["", "x"]
    got = M.fingerprint_edits(rows(spark, texts)).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        follows = texts[(i + 1) % len(texts)]
        k = len(t) // 4
        assert got.edited_sha256[i] == hashlib.sha256((t[: len(t) - k] + follows[:k]).encode()).hexdigest()
    big = got[got.n_chars > 200]
    assert big.near_edited.mean() > 0.6 and got.near_next.mean() < 0.2
    out = M.fingerprint_edits(messy).toPandas()
    assert len(out) == 11
    same = out[out.doc_id.isin([5, 6])].fingerprint
    assert same.nunique() == 1
    assert M.fingerprint_edits(nothing).count() == 0
    single = M.fingerprint_edits(rows(spark, ["abcd"])).first()
    assert single.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and single.near_next == 1.0


def test_fingerprints_locate_edits():
    rng = random.Random(3)
    a = "\n".join(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(12)) for _ in range(60))
    at = len(a) // 2
    b = a[:at] + " CHANGED " + a[at:]
    found = M.differing(M.fingerprint(a), M.fingerprint(b))
    assert found and all(x <= at + 120 and y >= at - 120 for x, y in found)
    assert M.differing(M.fingerprint(a), M.fingerprint(a)) == []


def test_licenses(spark, messy, nothing):
    texts = ["x y\nReleased under the MIT License.\nz", "released UNDER the mit license. again", "Licensed under CC BY-NC 4.0.", "Licensed under the old Apache License, Version 2.0. tail", "nothing here at all", None,
             "This work is licensed under the GNU General Public License, version 3. and Released under the MIT License."]
    got = L.scan_licenses(rows(spark, texts)).collect()
    found = sorted((r.doc_id, r.license) for r in got)
    assert found == [(0, "MIT"), (1, "MIT"), (2, "CC-BY-NC-4.0"), (3, "Apache-2.0"), (6, "GPL-3.0"), (6, "MIT")]
    for r in got:
        span = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert len(span.split()) == r.end_word - r.start_word
    assert next(r for r in got if r.doc_id == 0).coverage == 1.0
    assert L.scan_licenses(messy).count() == 0 and L.scan_licenses(nothing).count() == 0 and L.scan_licenses(messy, texts={}).count() == 0


def brute_alignment(template, words):
    """Matched words of the best local alignment of two word lists, every cell visited."""
    best, above = (0, 0), [(0, 0)] * (len(words) + 1)
    for x in template:
        row = [(0, 0)]
        for j, y in enumerate(words, 1):
            cell = (above[j - 1][0] + 2, above[j - 1][1] + 1) if x == y else max((above[j - 1][0] - 1, above[j - 1][1]), (above[j][0] - 1, above[j][1]), (row[j - 1][0] - 1, row[j - 1][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1])
        above = row
    return best[1]


def test_licenses_against_brute_force(spark):
    """Statements with changed, dropped and added words among other words: found if and only if enough of them is there."""
    rng = random.Random(19)
    statements = {f"T{k}": " ".join(f"t{k}w{i}" for i in range(n)) for k, n in enumerate((6, 12, 25, 40, 60))}
    texts, checked = [], 0
    for _ in range(200):
        name = rng.choice(list(statements))
        w = statements[name].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3]) * len(w) // 20):
            at, kind = rng.randrange(len(w)), rng.random()
            w[at : at + 1] = [] if kind < 0.3 and len(w) > 3 else [rng.choice(["x", "y"])] if kind < 0.7 else [w[at], "x"]
        w = w[: rng.choice([len(w), len(w), len(w) // 2])]
        texts.append(" ".join([*(f"a{rng.randrange(50)}" for _ in range(rng.randrange(30))), *w, *(f"b{rng.randrange(50)}" for _ in range(rng.randrange(30)))]))
    got = {}
    for r in L.scan_licenses(rows(spark, texts), texts=statements).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.matched_words
    for i, text in enumerate(texts):
        for name, statement in statements.items():
            n, size = brute_alignment(statement.split(), text.split()), len(statement.split())
            assert got.get(i, {}).get(name, 0) == (n if n >= 0.7 * size else 0), (text, name)
            checked += n >= 0.7 * size
    assert checked > 60


def test_full_license_texts(spark):
    texts = L.templates()
    filler = "some words that say nothing of rights " * 20
    apache = texts["Apache-2.0-text"].split()
    middle = len(apache) // 2
    docs = [filler + texts["MIT-text"] + filler, texts["GPL-3.0-text"], " ".join(apache[200:]) + filler, " ".join([*apache[:middle], *("extra " * 90).split(), *apache[middle:]]),
            " ".join(apache[: middle]), texts["BSD-3-Clause-text"].replace("copyright holder", "named university"), filler]
    got = {}
    for r in L.scan_licenses(rows(spark, docs)).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.coverage, 2)))
    assert got[0] == [("MIT-text", 1.0)]
    assert got[1][0][0] == "GPL-3.0-text" and got[1][0][1] > 0.99
    assert got[2][0][0] == "Apache-2.0-text" and 0.8 < got[2][0][1] < 0.95
    assert got[3][0][0] == "Apache-2.0-text" and got[3][0][1] > 0.95
    assert all(name != "Apache-2.0-text" for name, _ in got.get(4, []))
    assert got[5][0][0] == "BSD-3-Clause-text" and got[5][0][1] > 0.9
    assert 6 not in got


def test_neighbouring_licenses(spark):
    """Copies next to each other, of one part and of several, one with a changed word, are a match each; many cost no more than their number."""
    texts = L.templates()
    mit, text = "Released under the MIT License.", texts["MIT-text"]
    changed = "Licensed under the Apache Licence, Version 2.0."
    docs = [mit + " " + mit, " ".join([mit] * 1000), f"{mit} filler {mit} {mit}", " ".join([text] * 3), f"{texts['Apache-2.0']} {changed} {texts['Apache-2.0']} {changed}", " ".join([text, mit, text])]
    got = {}
    for r in L.scan_licenses(rows(spark, docs)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start_word, r.end_word))
    assert got[0] == [("MIT", 0, 5), ("MIT", 5, 10)] and got[1] == [("MIT", 5 * k, 5 * k + 5) for k in range(1000)]
    assert got[2] == [("MIT", 0, 5), ("MIT", 6, 11), ("MIT", 11, 16)]
    n = len(text.split())
    assert got[3] == [("MIT-text", k * n, (k + 1) * n) for k in range(3)]
    assert [x[1:] for x in got[4]] == [(7 * k, 7 * k + 7) for k in range(4)]
    assert [x[0] for x in got[5]] == ["MIT-text", "MIT", "MIT-text"]
    index = L.TemplateIndex(texts)
    began = time.perf_counter()
    assert len(L.scan_words(L.words_of(" ".join([mit] * 40_000)), index, 0.7)) == 40_000
    assert time.perf_counter() - began < 12
    assert len(L.scan_words(L.words_of(" ".join([text] * 150)), index, 0.7)) == 150


def test_runs_against_brute_force():
    """Of all sets of the parts' heaviest runs that do not overlap, one with most matched words."""
    rng = random.Random(8)

    def best(parts, least):
        chains = []

        def grow(chain):
            if sum(x[1] for x in chain) >= least:
                chains.append(chain)
            for y in parts:
                x = chain[-1]
                if y[0] > x[0] and x[3] <= y[2] <= x[3] + L.GAP:
                    grow([*chain, y])

        for x in parts:
            grow([x])
        weight = lambda c: sum(x[1] for x in c)
        heaviest = [max((c for c in chains if c[-1] is x), key=weight, default=None) for x in parts]
        spans = sorted({(c[0][2], c[-1][3], weight(c)) for c in heaviest if c})
        return max((sum(s[2] for s in pick) for n in range(4) for pick in itertools.combinations(spans, n) if all(a[1] <= b[0] for a, b in itertools.pairwise(pick))), default=0)

    for _ in range(60):
        parts, at = [], 0
        for _ in range(rng.randrange(1, 7)):
            at += rng.choice([0, 3, 60, 150])
            parts.append((rng.randrange(3), rng.choice([5, 9, 17, 33]) + len(parts), at, at + 40))
        parts.sort(key=lambda x: (x[2], x[0]))
        got = L._runs(parts, 20)
        assert sum(m for m, _, _ in got) == best(parts, 20)
        assert all(a[1] >= b[2] for a, b in itertools.pairwise(got))


def test_edits_are_located():
    """A range wherever texts differ: repeated, moved, dropped and added lines."""
    line = "abc def\n"
    assert M.differing(M.fingerprint(line * 8), M.fingerprint(line * 6 + "zzz yyy\n" * 2)) == [(48, 64)]
    mark = lambda t: M.fingerprint(t)
    rng = random.Random(12)
    lines = [f"line {k} {'x' * rng.randrange(20)}\n" for k in range(300)]
    whole = "".join(lines)
    assert M.differing(mark(whole), mark(whole)) == []
    gone = M.differing(mark(whole), mark("".join(lines[:100] + lines[120:])))
    assert gone and gone[0][0] <= len("".join(lines[:100])) and gone[-1][1] >= len("".join(lines[:120]))
    more = M.differing(mark("".join(lines[:100] + lines[120:])), mark(whole))
    assert more and abs(more[0][0] - len("".join(lines[:100]))) < 600
    for a, b in ((lines[::-1], lines), (lines, lines + lines[:1]), ([], lines), (lines, []), (lines[:50] * 2, lines[:50])):
        assert M.differing(mark("".join(a)), mark("".join(b)))


def test_fingerprints_against_brute_force(spark):
    """Equal fingerprints mean equal texts, likeness is that of plain leaf lists, and edits lie where texts differ."""
    rng = random.Random(20)
    base = [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(400)]
    texts = [" ".join(base[: rng.randrange(400)]) for _ in range(25)]
    texts += [" ".join(w if rng.random() > 0.02 else "new" for w in base) for _ in range(15)] + [texts[3], "", "\n\n", "é" * 50]
    marks = [M.fingerprint(t) for t in texts]

    def leaves(text):
        raw = text.encode()
        cuts = M._cuts(raw) if raw else [0]
        return Counter(raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True))

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (marks[i] == marks[j]) == (a == b)
            x, y = leaves(a), leaves(b)
            size = sum(len(k) * n for c in (x, y) for k, n in c.items())
            plain = 2 * sum(len(k) * n for k, n in (x & y).items()) / size if size else 1.0
            # a section that both have pairs its leaves off first, so no more than that can be lost
            assert M.likeness(marks[i], marks[j]) <= plain + 1e-9 and (a == b or M.likeness(marks[i], marks[j]) >= plain - 0.1)
    got = M.fingerprint_edits(rows(spark, texts)).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        k = len(t) // 4
        edited = t[: len(t) - k] + texts[(i + 1) % len(texts)][:k]
        assert got.edit_start.notna()[i] == (t != edited)
        if t != edited:
            a, b = t.encode(), edited.encode()
            common = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got.edit_start[i] <= common and got.edit_end[i] <= len(a)
        assert abs(got.near_edited[i] - M.likeness(marks[i], M.fingerprint(edited))) < 1e-12
