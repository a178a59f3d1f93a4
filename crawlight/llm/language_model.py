"""Language-model scoring of whole documents.

Every training token is counted in Spark.  The TOP most frequent words get
classes: documents are sorted into CLUSTERS by a mixture over the most
frequent words, started on the warm documents and fitted on sums over all
training documents; a word belongs to the cluster where it is most frequent, and a
cluster's words are cut into bands by frequency.  A gated recurrent network
(see ``recurrent``) predicts the cluster and then the class of each token and,
in the two upper bands, the word; in other classes words keep their share of c + 1.  All other
words, unseen ones included, are one class in which a word's share is c + 1
over the class's sum, the unseen words being one more entry of 1: so the model
is a distribution over the known words and one unknown.

Training: a warm start on at most WARM_DOCUMENTS training documents of at most
WARM_CHARS characters, then every task runs truncated backpropagation over all
its training documents and the tasks' parameters are averaged by their tokens.

Rare and unseen words leave a document as (word, count) and are looked up with
the frequent ones of them broadcast, so a new word in a third of all rows is no
hot key.  The table of frequent words is at most TOP entries (20 MB).

Contract: one row per input row.  Null text counts as empty: one token, the
end.  A null id is never held out.  Repeated rows are scored alike.  An empty
table gives no rows; without training rows all words are unknown and only the
end is known.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlight.llm.common import batch_of, buffers, document_view, drawn, hash_words, slices, tree_sum, written
from crawlight.llm.graphs import HEAVY
from crawlight.llm.quality import in_fold
from crawlight.llm.recurrent import START, GatedModel

#: Words with a class of their own or a band; words of the document mixture; clusters.
TOP, MIXTURE_WORDS, CLUSTERS = 1 << 19, 1024, 8
#: Occurrences below which a word is rare: else unseen words would have a class that training never shows.
LEAST = 4
#: Words up to these places within a cluster make a band; the first SOFT bands have a softmax of their own.
BANDS, SOFT = (16, 64, 256, 2048, 16384), 2
#: Documents of the warm start at most, and their characters; rounds of the mixture over all training documents.
WARM_DOCUMENTS, WARM_CHARS, MIXTURE_ROUNDS = 600, 1 << 16, 1
#: The end of a document, as a word's hash.
END = np.uint64(0x656E64)
#: Tokens that are scored at a time, about.
TOKENS = 2_000_000

_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])
_CLUSTERED = pa.schema([("word", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64())])
_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("neural", pa.float64()), ("n_rare", pa.int64()), ("key", pa.int64()), ("times", pa.int64())])
_SCORED_DDL = "row long, doc_id long, n_tokens long, n_known long, base double, neural double, n_rare long, key long, times long"
_PART = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("weight", pa.float64()), ("values", pa.binary())])


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each closed by END, and the texts' bounds in them."""
    data, bounds = buffers(column)
    hashes, words = hash_words(data, bounds)
    return np.insert(hashes, words[1:], END), words + np.arange(len(words))


def _count(docs: DataFrame) -> DataFrame:
    """key, n: every training token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, n = np.unique(_tokens(batch.column(1))[0], return_counts=True)
            yield batch_of(_COUNTS, keys.view(np.int64), n)

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Places:
    """Where each known hash stands: open addressing, so a batch is looked up at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several the last stays
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place, -1 if it is not known."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.table[slot]
        if not len(self.keys):
            return out
        rows = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        while len(rows):
            slot[rows] = (slot[rows] + 1) & self.mask
            out[rows] = self.table[slot[rows]]
            rows = rows[(out[rows] >= 0) & (self.keys[out[rows]] != hashes[rows])]
        return out


def expected(x: np.ndarray, logs: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Each row's shares in the clusters, and the fit."""
    joint = x @ logs.T + np.log(prior)
    top = joint.max(1, keepdims=True)
    post = np.exp(joint - top)
    total = post.sum(1, keepdims=True)
    post /= total
    return post, float((np.log(total) + top).sum())


def maximised(sums: np.ndarray, held: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log word shares and priors from each cluster's word counts and rows."""
    counts = sums + 5 * share
    return np.log(counts / counts.sum(1, keepdims=True)), (held + 0.1) / (held.sum() + 0.1 * len(held))


def fit_mixture(x: np.ndarray, clusters: int, rounds: int = 25, starts: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Log word shares and prior of each cluster: a mixture of unigram models by expectation maximisation."""
    best, most = None, -np.inf
    share = x.sum(0) + 1.0
    share /= share.sum()
    for seed in range(starts):
        rng = np.random.default_rng(seed)
        # centres far from each other
        norm = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        centres = [int(rng.integers(len(x)))]
        for _ in range(1, clusters):
            far = 1 - (norm @ norm[centres].T).max(1)
            far = np.maximum(far, 1e-6) ** 2
            centres.append(int(rng.choice(len(x), p=far / far.sum())))
        logs = np.log((x[centres] + 20 * share) / (x[centres].sum(1, keepdims=True) + 20))
        prior = np.full(clusters, 1 / clusters)
        for _ in range(rounds):
            post, fit = expected(x, logs, prior)
            logs, prior = maximised(post.T @ x, post.sum(0), share)
        if fit > most:
            best, most = (logs, prior), fit
    return best


class Vocabulary:
    """Frequent words: hash order, counts, classes, inputs of the network, and shares within fixed classes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.int64)
        self.total, self.distinct = total, distinct
        self.rare_sum = float(total - int(self.counts.sum()) + distinct - len(self.keys) + 1)
        self.frequent = np.argsort(-self.counts, kind="stable")
        self.logs = np.log10(self.counts + 1.0)
        self.logs_unknown = np.log10(total + distinct + 1.0)

    def classify(self, clusters: np.ndarray) -> None:
        """Sets classes from each word's cluster: bands of each cluster, the end, and the rare words."""
        n = len(self.keys)
        rank = np.zeros(n, np.int64)
        for c in range(CLUSTERS):
            mine = self.frequent[clusters[self.frequent] == c]
            rank[mine] = np.arange(len(mine))
        band = np.searchsorted(BANDS, rank, "right")
        bands = len(BANDS) + 1
        classes = clusters * bands + band
        ends = np.flatnonzero(self.keys == END)
        self.end_class, self.rare_class = CLUSTERS * bands, CLUSTERS * bands + 1
        classes[ends] = self.end_class
        soft = (band < SOFT) & (classes != self.end_class)
        self.classes = classes.astype(np.int32)
        self.words = np.full(n, -1, np.int32)
        # numbered by class, so that a class's words are a slice
        chosen = np.flatnonzero(soft)
        chosen = chosen[np.argsort(classes[chosen], kind="stable")]
        self.words[chosen] = np.arange(len(chosen))
        n_classes = self.rare_class + 1
        mass = np.bincount(classes, weights=self.counts + 1.0, minlength=n_classes)
        mass[self.rare_class] = self.rare_sum
        mass[self.end_class] += not len(ends)
        self.shares = mass / mass.sum()
        self.within = np.where(soft | (classes == self.end_class), 0.0, np.log((self.counts + 1.0) / mass[classes]))
        self.members = [self.words[(self.classes == c) & soft] for c in range(n_classes)]
        self.members = [np.sort(m) for m in self.members]
        self.word_shares = self.counts[chosen] + 1.0
        self.groups = np.r_[np.repeat(np.arange(CLUSTERS), bands), CLUSTERS, CLUSTERS + 1]
        # inputs: START, then classes, then words of the soft bands
        self.inputs = np.where(soft, 1 + n_classes + self.words, 1 + self.classes).astype(np.int32)
        self.n_inputs = 1 + n_classes + int(soft.sum())

    def model(self) -> GatedModel:
        return GatedModel(self.n_inputs, self.shares, self.members, self.word_shares, self.groups)

    def sequences(self, found: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Inputs, classes and words of each document from its tokens' places."""
        known = found >= 0
        at = np.where(known, found, 0)
        if len(self.keys):
            classes = np.where(known, self.classes[at], self.rare_class).astype(np.int32)
            words = np.where(known, self.words[at], -1).astype(np.int32)
            inputs = np.where(known, self.inputs[at], 1 + self.rare_class).astype(np.int32)
        else:
            classes, words, inputs = np.full(len(found), self.rare_class, np.int32), np.full(len(found), -1, np.int32), np.full(len(found), 1 + self.rare_class, np.int32)
        before = np.empty_like(inputs)
        before[1:] = inputs[:-1]
        before[bounds[:-1]] = START
        return [(before[a:b], classes[a:b], words[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The most frequent words, at most TOP, and the first bucket of counts that is among them."""
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("b")).collect()  # a few hundred rows
    total, distinct = sum(r["n"] for r in sizes), sum(r["words"] for r in sizes)
    held, least = 0, 1 << 30
    for r in sizes:
        held += r["words"]
        if held > TOP or r["b"] < 8 * np.log2(LEAST):
            break
        least = r["b"]
    top = counts.where(bucket >= least).toArrow()
    return Vocabulary(top["key"].to_numpy().view(np.uint64), top["n"].to_numpy(), total, distinct), least


def _profile(found: np.ndarray, bounds: np.ndarray, lookup: np.ndarray, width: int) -> np.ndarray:
    """Counts of the mixture's words in each document."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    word = lookup[found]
    return np.bincount((owner * width + word)[word >= 0], minlength=(len(bounds) - 1) * width).reshape(-1, width).astype(np.float64)


def _parts(docs: DataFrame, run) -> list:
    """The rows that ``run`` gives for all documents, summed by chunk."""
    return tree_sum(docs.mapInArrow(run, "chunk int, part int, weight double, values binary")).orderBy("chunk").collect()  # one row a chunk


def _profiles(batches: Iterator[pa.RecordBatch], places: Places, lookup: np.ndarray, width: int):
    """Places, bounds and mixture word counts of the documents, a bounded number at a time."""
    for batch in slices(batches):
        for at in range(0, batch.num_rows, 1024):
            tokens, bounds = _tokens(batch.column(1).slice(at, 1024))
            found = places.find(tokens)
            yield found, bounds, _profile(found, bounds, lookup, width)


def _mixture_round(docs: DataFrame, shared, logs: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of expectation maximisation over all documents; ``shared``: the keys and the mixture's words among them."""
    width = logs.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lookup = shared.value
        places = Places(keys)
        sums, held = np.zeros_like(logs), np.zeros(len(logs))
        for _, _, x in _profiles(batches, places, lookup, width):
            post = expected(x, logs, prior)[0]
            sums += post.T @ x
            held += post.sum(0)
        task = TaskContext.get().partitionId()
        for k, (n, row) in enumerate(zip(held.tolist(), sums, strict=True)):
            yield batch_of(_PART, [k], [task], [n], [row.tobytes()])

    parts = _parts(docs, run)
    sums = np.stack([np.frombuffer(r["values"], np.float64) for r in parts])
    share = sums.sum(0) + 1.0
    return maximised(sums, np.array([r["weight"] for r in parts]), share / share.sum())


def _cluster(docs: DataFrame, sample: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The cluster of each frequent word: where it has most tokens, over all training documents."""
    frequent = vocabulary.frequent[:MIXTURE_WORDS]
    lookup = np.full(len(vocabulary.keys) + 1, -1, np.int64)  # the last answers for unknown words
    lookup[frequent] = np.arange(len(frequent))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.keys, lookup))

    width = len(frequent)
    places = Places(vocabulary.keys)
    rows = sample.select("text").toArrow().combine_chunks()
    if not rows.num_rows or not width:
        return np.zeros(len(vocabulary.keys), np.int64)
    tokens, bounds = _tokens(rows["text"].combine_chunks() if isinstance(rows["text"], pa.ChunkedArray) else rows["text"])
    logs, prior = fit_mixture(_profile(places.find(tokens), bounds, lookup, width), CLUSTERS)
    for _ in range(MIXTURE_ROUNDS):
        logs, prior = _mixture_round(docs, shared, logs, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lookup = shared.value
        places = Places(keys)
        for found, bounds, x in _profiles(batches, places, lookup, width):
            owner = np.repeat((x @ logs.T).argmax(1), np.diff(bounds))
            pairs, n = np.unique((found.astype(np.int64) * CLUSTERS + owner)[found >= 0], return_counts=True)
            yield batch_of(_CLUSTERED, pairs // CLUSTERS, pairs % CLUSTERS, n)

    sums = docs.mapInArrow(run, "word int, cluster int, n long").groupBy("word", "cluster").agg(F.sum("n").alias("n"))
    best = sums.groupBy("word").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("cluster")).toArrow()
    out = np.zeros(len(vocabulary.keys), np.int64)
    out[best["word"].to_numpy()] = best["cluster"].to_numpy()
    return out


def _averaged(docs: DataFrame, vocabulary: Vocabulary, model: GatedModel, chunks: int = 16) -> None:
    """One pass of local training in every task, then the mean of the tasks' parameters by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        local = vocabulary.model()
        local.unpack(model.packed())
        places = Places(vocabulary.keys)
        seen, waiting, held = 0, [], 0
        for batch in slices(batches):
            tokens, bounds = _tokens(batch.column(1))
            waiting += vocabulary.sequences(places.find(tokens), bounds)
            held += len(tokens)
            if held > TOKENS // 2:
                seen += local.train(waiting, rate=0.004)
                waiting, held = [], 0
        if waiting:
            seen += local.train(waiting, rate=0.004)
        if seen:
            task = TaskContext.get().partitionId()
            for k, part in enumerate(np.array_split(local.packed().astype(np.float64) * seen, chunks)):
                yield batch_of(_PART, [k], [task], [float(seen)], [part.tobytes()])

    parts = _parts(docs, run)
    if parts:
        model.unpack(np.concatenate([np.frombuffer(r["values"], np.float64) / r["weight"] for r in parts]))


def score_documents(docs: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    view = document_view(docs, id_col, text_col)
    training = view.where(~in_fold(F.col("doc_id"), folds, held_out))
    counts = written(_count(training), "lm-counts")
    vocabulary, least = _vocabulary(counts)
    short = training.where(F.length("text") <= WARM_CHARS)
    end = int(END.view(np.int64))
    documents = counts.where(F.col("key") == end).first()
    sample = drawn(short, F.xxhash64("doc_id", "text", F.lit(3)), WARM_DOCUMENTS, documents["n"] if documents else 0)
    vocabulary.classify(_cluster(training, sample, vocabulary))

    model = vocabulary.model()
    texts = sample.select("text").toArrow()["text"]
    if len(texts):
        tokens, bounds = _tokens(pa.concat_arrays(texts.chunks))
        model.train(vocabulary.sequences(Places(vocabulary.keys).find(tokens), bounds), streams=64, epochs=6)
        _averaged(training, vocabulary, model)
    shared = spark.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        places = Places(vocabulary.keys)

        def scored(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            text = pa.concat_arrays(rows["text"].chunks)
            tokens, bounds = _tokens(text)
            found = places.find(tokens)
            known = found >= 0
            first = bounds[:-1]
            logs = np.where(known, vocabulary.logs[found], 0.0) if len(vocabulary.keys) else np.zeros(len(found))
            within = np.where(known, vocabulary.within[found], 0.0) if len(vocabulary.keys) else np.zeros(len(found))
            sizes = np.diff(bounds)
            base = np.add.reduceat(logs, first) - sizes * vocabulary.logs_unknown
            neural = (model.score(vocabulary.sequences(found, bounds)) + np.add.reduceat(within, first)) / np.log(10)
            n_known = np.add.reduceat(known.astype(np.int64), first)
            n = rows.num_rows
            yield batch_of(_SCORED, pa.concat_arrays(rows["row"].chunks), pa.concat_arrays(rows["doc_id"].chunks), sizes, n_known, base, neural, sizes - n_known, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()))
            # each document's rare words once, with their number
            rare = np.flatnonzero(~known & (tokens != END))
            owner, keys = np.searchsorted(bounds, rare, "right") - 1, tokens[rare].view(np.int64)
            order = np.lexsort((keys, owner))
            owner, keys = owner[order], keys[order]
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]) if len(rare) else rare
            empty = [pa.nulls(len(first), f.type) for f in _SCORED][1:-2]
            yield batch_of(_SCORED, rows["row"].to_numpy()[owner[first]], *empty, keys[first], np.diff(np.r_[first, len(rare)]))

        waiting, held = [], 0
        for part in slices(batches, 2):
            waiting.append(part)
            held += part.column(2).nbytes
            if held > 6 * TOKENS:
                yield from scored(pa.Table.from_batches(waiting))
                waiting, held = [], 0
        if waiting:
            yield from scored(pa.Table.from_batches(waiting))

    # both kinds of rows come from one written table, so a row's number means the same in both
    rows = written(view.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, _SCORED_DDL), "lm-scored")
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 8)
    rare = rows.where("key is not null").select("row", "key", "times")
    # a new word may be in a third of all rows: keys with over 1/HEAVY of them, fewer than HEAVY, are broadcast
    uses = rare.groupBy("key").agg(F.count("*").alias("uses")).where(F.col("uses") * HEAVY > rare.count())
    hot = written(uses.select("key"), "lm-hot")
    few = counts.where(bucket < least)
    hot_known = few.join(F.broadcast(hot), "key", "left_semi")
    rare = rare.join(F.broadcast(hot_known), "key").unionByName(rare.join(F.broadcast(hot), "key", "left_anti").join(few.hint("merge"), "key"))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs"), F.sum("times").alias("rare_known"))
    out = rows.where("key is null").drop("key").join(rare.hint("merge"), "row", "left")
    more, known = F.coalesce("rare_logs", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return out.select(
        "doc_id", in_fold(F.col("doc_id"), folds, held_out).alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("neural") + more - F.col("n_rare") * F.lit(float(np.log10(vocabulary.rare_sum)))).alias("score"),
    )
