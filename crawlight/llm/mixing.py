"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed to cells of source, language and topic; raking scales the
cells to each target margin in turn until all margins hold to TOLERANCE.  A
cell's weight over its tokens is its documents' relative sampling rate; the
common factor is calibrated so that the expected tokens meet the budget with
no rate above one.  A cell that would need more than all of its documents is
kept whole, so its margins fall short; ``margins`` reports by how much.  A
document is kept if its hash falls below its probability, so repeated runs and
executors agree.

Default targets are tempered: a value's share is its tokens' share to the
power ``temper``, which lifts small sources, languages and topics.

Where no column names a document's topic, topics are fitted: a document is its
words' shares over DIMS hash cells, documents start grouped by their commonest
cells, and TOPIC_ROUNDS rounds replace each group by its mean over words and move every
document to the nearest mean, of equal ones the first.  All documents take
part; shares are integers, so the result does not depend on partitions.  Text
without a long word has the topic "none".

Up to MOST_CELLS cells are raked in numpy on the driver; beyond that by
margin sums in Spark, with the same result.

Contract: null values of source, language and topic are a category of their
own; a null id hashes as empty text; null text has no tokens.  A cell without
tokens is kept whole.  Repeated rows share their fate.  An empty table gives
no rows.  Columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlight.llm.common import discard, written

#: Rounds of raking at most, and the relative miss of a margin that ends them; tempering of the margins; kept share of all tokens; topics.
ROUNDS, TOLERANCE, TEMPER, KEEP, TOPICS = 100, 1e-12, 0.7, 0.7, 8
#: Hash cells and scale of a document's word shares, rounds that fit the topics.
DIMS, SCALE, TOPIC_ROUNDS = 32, 1000, 5
#: Cells that the driver rakes at most (60 bytes each); cells that are broadcast at most, beyond them documents meet them by a shuffle.
MOST_CELLS, BROADCAST_CELLS = 1 << 20, 50_000
MARGINS = ("source", "lang", "topic")
_NULL = "<null>"


def token_count(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_shares(text: Column) -> Column:
    """Shares, of SCALE each, of the words of six letters or more over two hashes' 16 cells: the first two hex digits of a word's digest.  Last, how many such words there are."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}{6,})"), 1)
    digits = F.transform(words, lambda w: F.substring(F.md5(w.cast("binary")), 1, 2))
    at = lambda d, k: F.array_join(F.transform(d, lambda x: F.substring(x, k, 1)), "")
    count = lambda v, digit: F.length(v) - F.length(F.replace(v, F.lit(f"{digit:x}"), F.lit("")))
    cells = lambda v: F.array(*(F.floor(SCALE * count(v[k], digit) / F.greatest(F.length(v[k]), F.lit(1))).cast("int") for k in (0, 1) for digit in range(DIMS // 2)), F.length(v[0]))
    # one value in a list gives its inner expressions a name, so it is made once
    return F.transform(F.transform(F.array(digits), lambda d: F.array(at(d, 1), at(d, 2))), cells)[0]


def first_topic(shares: Column) -> Column:
    """Where a document starts: cells k and k + TOPICS of the first hash stand for topic k; of equal ones the first."""
    sums = F.array(*(shares[k] + shares[k + TOPICS] for k in range(TOPICS)))
    return F.array_position(sums, F.array_max(sums)) - 1


def topic_of(text: Column) -> Column:
    """The topic at which a text starts, from all of the text."""
    return F.transform(F.array(word_shares(text)), first_topic)[0].cast("string")


def fit_topics(shares: DataFrame, rounds: int = TOPIC_ROUNDS) -> dict[int, list[int]]:
    """Means of the topics over the words of all rows of ``x``; a topic that loses all its documents goes.  At most TOPICS * DIMS sums reach the driver."""
    rows = shares.where(F.col("x")[DIMS] > 0)
    rows = rows.select("x", first_topic(F.col("x")).cast("int").alias("t"))
    means: dict[int, list[int]] = {}
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], means=means) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((TOPICS, DIMS), np.int64), np.zeros(TOPICS, np.int64)
            labels = sorted(means)
            book = np.array([means[t] for t in labels], np.int64).reshape(-1, DIMS)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(-1, DIMS + 1)
                x, words = x[:, :DIMS], x[:, DIMS]
                t = np.array(labels)[np.argmax(2 * x @ book.T - (book * book).sum(1), axis=1)] if labels else batch.column(1).to_numpy()
                np.add.at(total, t, x * words[:, None])
                np.add.at(n, t, words)
            t, j = np.divmod(np.arange(TOPICS * DIMS), DIMS)
            yield pa.record_batch([pa.array(t), pa.array(j), pa.array(n[t]), pa.array(total.ravel())], ["t", "j", "n", "s"])

        found = rows.mapInArrow(sums, "t long, j long, n long, s long").groupBy("t", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").collect()
        at = {(r.t, r.j): r.s // r.n for r in found}
        means = {t: [at[t, j] for j in range(DIMS)] for t in sorted({t for t, _ in at})}
    return means


def nearest_topic(shares: Column, means: dict[int, list[int]]) -> Column:
    """The topic of the nearest mean; "none" for a text without long words."""
    if not means:
        return F.lit("none")
    score = lambda c: 2 * F.aggregate(F.zip_with(shares, F.lit([*c, 0]), lambda a, b: (a * b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b) - sum(v * v for v in c)
    labels = sorted(means)
    best = F.transform(F.array(F.array(*(score(means[t]) for t in labels))), lambda z: F.array_position(z, F.array_max(z)).cast("int"))[0]
    return F.when(shares[DIMS] > 0, F.element_at(F.lit([str(t) for t in labels]), best)).otherwise("none")


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id only."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def raked(codes: list[np.ndarray], tokens: np.ndarray, goals: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell weights whose margins meet the goals; ``codes``: each cell's place in each margin."""
    w = tokens.astype(np.float64)
    for _ in range(rounds):
        missed = 0.0
        for code, goal in zip(codes, goals, strict=True):
            held = np.bincount(code, weights=w, minlength=len(goal))
            factor = np.divide(goal, held, out=np.zeros(len(goal)), where=held > 0)
            w = w * factor[code]
            if w.sum() > 0:
                missed = max(missed, float(np.abs(factor[held > 0] - 1).max(initial=0)))
        if missed <= TOLERANCE:
            break
    return w


def common_factor(rate: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The factor at which the tokens kept meet the budget, with no cell kept at more than one."""
    whole = np.zeros(len(rate), bool)
    while True:
        w = float((rate * tokens)[~whole].sum())
        factor = (budget - float(tokens[whole].sum())) / w if w > 0 else np.inf
        more = ~whole & (factor * rate > 1)
        if not more.any():
            return factor
        whole |= more


def _rake_here(cells: DataFrame, temper: float, rounds: int, keep: float, targets: dict) -> DataFrame:
    table = cells.toArrow()
    tokens = table["tokens"].to_numpy().astype(np.float64)
    codes, goals = [], []
    for m in MARGINS:
        values, code = np.unique(np.array(table[m].to_pylist(), object).astype(str), return_inverse=True)
        if m in targets:
            goal = np.array([targets[m].get(v, 0.0) for v in values.tolist()])
        else:
            goal = np.bincount(code, weights=tokens, minlength=len(values)) ** temper
            goal /= goal.sum()
        codes.append(code)
        goals.append(goal)
    w = raked(codes, tokens, goals, rounds)
    rate = w / tokens
    with np.errstate(invalid="ignore"):  # a cell of no rate under no bound
        probability = np.minimum(1.0, np.nan_to_num(common_factor(rate, tokens, keep * tokens.sum()) * rate, nan=0.0, posinf=1.0))
    weight = rate * tokens.sum() / max(w.sum(), 1e-300)
    return cells.sparkSession.createDataFrame(pa.table({**{m: table[m] for m in MARGINS}, "tokens": table["tokens"], "weight": weight, "probability": probability}))


def _rake_apart(cells: DataFrame, temper: float, rounds: int, keep: float, targets: dict) -> DataFrame:
    """The same by margin sums: no task sees all cells."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0]
    for m in MARGINS:
        if m in targets:
            goal = spark.createDataFrame(list(targets[m].items()), f"{m} string, goal_{m} double")
        else:
            powers = written(cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("g")), "mixing-goals")
            goal = powers.select(m, (F.col("g") / F.lit(powers.agg(F.sum("g")).first()[0])).alias(f"goal_{m}"))
        cells = cells.join(goal, m, "left").withColumn(f"goal_{m}", F.coalesce(f"goal_{m}", F.lit(0.0)))
    cells = written(cells.withColumn("w", F.col("tokens").cast("double")), "mixing-cells")
    for _ in range(rounds):
        missed = 0.0
        for m in MARGINS:
            held = cells.groupBy(m).agg(F.sum("w").alias("held"), F.first(f"goal_{m}").alias("goal"))
            factors = written(held.where("held > 0").select(m, (F.col("goal") / F.col("held")).alias("factor")), "mixing-factors")
            missed = max(missed, factors.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            before, cells = cells, written(cells.join(factors, m, "left").withColumn("w", F.col("w") * F.coalesce("factor", F.lit(0.0))).drop("factor"), "mixing-cells")
            discard(before, factors)
        if missed <= TOLERANCE:
            break
    cells = cells.withColumn("rate", F.col("w") / F.col("tokens"))
    factor, above = None, F.lit(False)
    while True:
        rest = cells.agg(F.sum(F.when(above, 0.0).otherwise(F.col("w"))).alias("w"), F.sum(F.when(above, F.col("tokens")).otherwise(0)).alias("whole")).first()
        now = (keep * total - rest["whole"]) / rest["w"] if rest["w"] else float("inf")
        if now == factor:
            break
        factor = now
        above = above | (F.lit(factor) * F.col("rate") > 1)
    mass = cells.agg(F.sum("w")).first()[0] or 1e-300
    probability = F.when(F.col("rate") > 0, F.least(F.lit(1.0), F.lit(factor) * F.col("rate"))).otherwise(0.0)
    return cells.select(*MARGINS, "tokens", (F.col("rate") * F.lit(float(total)) / F.lit(mass)).alias("weight"), probability.alias("probability"))


def rake(cells: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """source, lang, topic, tokens -> weight (1 on average over tokens) and probability of each cell.

    ``targets`` may give a margin's shares by value; values that it leaves out get none.
    """
    cells = written(cells.where("tokens > 0"), "mixing-cells")
    size = cells.count()
    if not size:
        return cells.select(*MARGINS, "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    return (_rake_here if size <= MOST_CELLS else _rake_apart)(cells, temper, rounds, keep, targets or {})


def margins(cells: DataFrame) -> DataFrame:
    """margin, value, target and expected share of the raked cells: where cells are kept whole the two differ."""
    total = cells.agg(F.sum(F.col("tokens") * F.col("weight")).alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("e")).first()
    share = lambda column, by: F.sum(F.col("tokens") * F.col(column)) / F.lit(by)
    parts = [cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(share("weight", total["t"]).alias("target"), share("probability", total["e"]).alias("expected")) for m in MARGINS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def with_probabilities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, **options) -> DataFrame:
    """The rows with _mix_topic, _mix_tokens, _mix_weight, _mix_probability and _mix_kept."""
    named = docs.select(
        "*", F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL)).alias("_mix_source"), F.coalesce(F.col(lang_col).cast("string"), F.lit(_NULL)).alias("_mix_lang"),
        token_count(F.col(text_col)).alias("_mix_tokens"),
    )
    keys = [f"_mix_{m}" for m in MARGINS]
    if topic_col:
        named = named.withColumn("_mix_topic", F.coalesce(F.col(topic_col).cast("string"), F.lit(_NULL)))
        counted = named
    else:
        shares = written(named.select("_mix_source", "_mix_lang", "_mix_tokens", word_shares(F.col(text_col)).alias("x")), "mixing-shares")
        means = fit_topics(shares)
        topic = lambda x: F.transform(F.array(x), lambda v: nearest_topic(v, means))[0]
        counted = shares.withColumn("_mix_topic", topic(F.col("x")))
        named = named.withColumn("_mix_topic", topic(word_shares(F.col(text_col))))
    cells = rake(counted.groupBy(*keys).agg(F.sum("_mix_tokens").alias("tokens")).withColumnsRenamed(dict(zip(keys, MARGINS, strict=True))), **options)
    if not topic_col:
        discard(shares)
    cells = cells.select(*(F.col(m).alias(k) for m, k in zip(MARGINS, keys, strict=True)), F.col("weight").alias("_mix_weight"), F.col("probability").alias("_mix_probability"))
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells.hint("merge")
    out = named.join(cells, keys, "left").withColumn("_mix_probability", F.coalesce("_mix_probability", F.lit(1.0))).withColumn("_mix_weight", F.coalesce("_mix_weight", F.lit(0.0)))
    return out.withColumn("_mix_kept", draw(F.col(id_col)) < F.round("_mix_probability", 9))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows, with the columns they came with."""
    return with_probabilities(docs, **options).where("_mix_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
