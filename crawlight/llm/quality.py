"""Quality classifier learned from positives and unlabelled text.

Features are style statistics of the whole text (character classes, word and
line repetition, lengths) and a short hashed bag of words.  A small network is
trained on the non-negative unbiased risk: with class prior p, the risk is
p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]), and where the bracket turns
negative the step goes against it.  Positives are trusted labels of training
rows, unlabelled text is any training document; the class prior is estimated
from the labelled training rows.  Scores are then calibrated on these rows.

Contract: one row per input row; null text counts as empty and is scored as
such.  Labels of null quality or id are ignored; of repeated labels the mean
counts, positive from 0.5; of rows with one id one is fitted on.  Without positive labels nothing can be learned
and every score is 1.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlight.llm.common import batch_of, buffers, document_view, drawn, hash_words, rolling, slices

#: Bound on what the model is fitted on: positives, other labelled rows and unlabelled rows, by hash of the id.
POSITIVES, NEGATIVES, UNLABELLED = 8000, 4000, 12000
#: Hashed word features.
BAG = 64
_CLASSES = np.full(256, 7, np.int64)  # other signs
_CLASSES[ord("a") : ord("z") + 1] = 0
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASSES[0x0A] = 4
_CLASSES[[ord(c) for c in ".,;:'\"?-()"]] = 5
_CLASSES[0x80:] = 6
_CLASSES[ord("!")] = 8
_CLASSES[[ord(c) for c in "|#$%&*"]] = 9
_CLASSES[[ord(c) for c in "@/<>_=+\\{}[]~^`"]] = 10
KINDS = 11
STYLE = KINDS + 13
FEATURES = STYLE + BAG


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each text, from all of it."""
    data, bounds = buffers(column)
    hashes, words, starts, ends = hash_words(data, bounds, places=True)
    lengths = (ends - starts).astype(np.float64)
    signed = np.isin(_CLASSES[data[ends - 1]], (7, 8, 9)) if len(ends) else np.empty(0, bool)
    capital = _CLASSES[data[starts]] == 1 if len(starts) else np.empty(0, bool)
    shouted = capital & (_CLASSES[data[np.minimum(starts + 1, len(data) - 1)]] == 1) if len(starts) else capital
    out = np.zeros((len(column), FEATURES), np.float32)
    for i, (a, b, u, v) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), words[:-1].tolist(), words[1:].tolist(), strict=True)):
        size, n = b - a, v - u
        row = out[i]
        if not n:
            row[KINDS] = -1
            continue
        kinds = np.bincount(_CLASSES[data[a:b]], minlength=KINDS)
        row[:KINDS] = kinds / size
        h = hashes[u:v]
        distinct, counts = np.unique(h, return_counts=True)
        pairs = np.unique(rolling(h, 2)) if n > 1 else h
        triples = np.unique(rolling(h, 4)) if n > 3 else h
        row[KINDS : KINDS + 13] = (
            np.log1p(n) / 8, lengths[u:v].mean() / 8, lengths[u:v].std() / 8, np.log1p(lengths[u:v].max()) / 8,
            len(distinct) / n, len(pairs) / max(n - 1, 1), len(triples) / max(n - 3, 1), counts.max() / n,
            (h[1:] == h[:-1]).sum() / n, signed[u:v].sum() / n, capital[u:v].sum() / n, shouted[u:v].sum() / n,
            np.log1p(kinds[4]) / 8,
        )
        bag = np.bincount((distinct & np.uint64(BAG - 1)).astype(np.int64), weights=np.sqrt(counts), minlength=BAG)
        row[STYLE:] = bag / np.sqrt((bag * bag).sum())
    return out


class Model:
    """Standardised features, one hidden layer, and a calibration line."""

    def __init__(self, mean, scale, layers, line=(1.0, 0.0), constant=None):
        self.mean, self.scale, self.layers, self.line, self.constant = mean, scale, layers, line, constant

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b) @ v + c

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.line[0] * self.logit(x).astype(np.float64) + self.line[1], -30, 30)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, labels: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, hidden: int = 24, seed: int = 7) -> Model:
    """``labels``: 1 or 0 for the labelled rows of ``x``; ``unlabelled``: which rows are the unlabelled sample."""
    positive = np.flatnonzero(labels == 1)
    if not len(positive):
        return Model(None, None, None, constant=1.0)
    unlabelled = np.flatnonzero(unlabelled)
    base = x[unlabelled] if len(unlabelled) else x
    mean, scale = base.mean(0), base.std(0) + 1e-3
    scale[STYLE:] *= 4  # words weigh less than style
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 0.3 / np.sqrt(x.shape[1]) * 4, (x.shape[1], hidden)).astype(np.float32)
    b, v, c = np.zeros(hidden, np.float32), rng.normal(0, 0.3, hidden).astype(np.float32), np.float32(0)
    params, moments = [w, b, v, np.array(c)], None
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        p, u = rng.choice(positive, 256), rng.choice(unlabelled, 512) if len(unlabelled) else positive[:0]
        rows = z[np.r_[p, u]]
        hid = np.tanh(rows @ params[0] + params[1])
        f = hid @ params[2] + params[3]
        fp, fu = f[:256], f[256:]
        # logistic losses: l(f) = log(1 + e^-f)
        minus = (np.logaddexp(0, fu).mean() if len(u) else 0.0) - prior * np.logaddexp(0, fp).mean()
        d = np.zeros_like(f)
        if minus >= 0:
            d[:256] = prior * (_sigmoid(fp) - 1) / 256 - prior * _sigmoid(fp) / 256
            if len(u):
                d[256:] = _sigmoid(fu) / len(u)
        else:  # the risk of unlabelled text as negatives went below zero: undo that part
            d[:256] = prior * _sigmoid(fp) / 256
            if len(u):
                d[256:] = -_sigmoid(fu) / len(u)
        back = (d[:, None] * params[2]) * (1 - hid * hid)
        grads = [rows.T @ back + 1e-4 * params[0], back.sum(0), hid.T @ d + 1e-4 * params[2], d.sum()]
        rate = 0.01 * (1 - step / (steps + 1))
        for k, g in enumerate(grads):
            m, s = moments[k]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            params[k] = params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    model = Model(mean, scale, params)
    known = np.flatnonzero(labels >= 0)
    if (labels[known] == 0).any():
        model.line = _calibrate(model.logit(x[known]).astype(np.float64), labels[known], prior)
    return model


def _calibrate(f: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept of a logistic fit, both classes weighted to the prior."""
    a, b = 1.0, 0.0
    weight = np.where(y == 1, prior / max((y == 1).sum(), 1), (1 - prior) / max((y == 0).sum(), 1))
    for _ in range(50):
        p = _sigmoid(a * f + b)
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * f).sum() + 1e-4 * (a - 1), g.sum()])
        hess = np.array([[(h * f * f).sum() + 1e-4, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


_VECTORS = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0) -> Model:
    """Fits on at most POSITIVES + NEGATIVES + UNLABELLED training rows, drawn by hash of the id."""
    view = document_view(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out))
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    ids = view.select("doc_id").distinct()
    known = ids.join(labels, "doc_id")
    sizes = known.agg(F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative")).first()
    prior = sizes["positive"] / max(sizes["positive"] + sizes["negative"], 1)
    prior = min(max(prior, 0.02), 0.98)
    # three bounded draws; they are collected as ids and labels only
    taken: dict[int, list] = {}
    for rows, most, n in ((known.where("y = 1"), POSITIVES, sizes["positive"]), (known.where("y = 0"), NEGATIVES, sizes["negative"])):
        for r in drawn(rows, F.xxhash64("doc_id"), most, n).collect():
            taken[r["doc_id"]] = [r["y"], False]
    for r in drawn(ids, F.xxhash64("doc_id", F.lit(1)), UNLABELLED, ids.count()).collect():
        taken.setdefault(r["doc_id"], [-1, False])[1] = True
    if not taken:
        return Model(None, None, None, constant=1.0)
    chosen = view.sparkSession.createDataFrame([(k,) for k in taken], "doc_id long")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch_of(_VECTORS, batch.column(0), [r.tobytes() for r in features(batch.column(1))])

    # one row an id: the one whose text has the smallest hash
    rows = view.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("order"), "text")).alias("row")).select("doc_id", "row.text")
    rows = rows.mapInArrow(vectors, "doc_id long, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    marks = [taken[k] for k in rows["doc_id"].to_pylist()]
    return fit(x, np.array([m[0] for m in marks]), np.array([m[1] for m in marks]), prior)


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch_of(_SCORES, batch.column(0), model.score(features(batch.column(1))))

    return document_view(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns; texts do not leave their partition."""
    schema, last = docs.schema, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, last):
            good = model.score(features(batch.column(last))) >= least
            yield batch.filter(pa.array(good)).select(list(range(last)))

    return docs.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_scored_text")).mapInArrow(run, schema)
