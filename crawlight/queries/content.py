"""Text metrics and content rules over documents and pages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from crawlight.functions import text as T
from crawlight.functions.urls import as_sql_reads, between_edges
from crawlight.queries.registry import Area, once, sql_in
from crawlight.sources.tables import table

area = Area()
q = area.query
WORDS = rf"len(regexp_extract_all(text, '{T.WORD}'))"
DEPTH = " + ".join(f"regexp_matches(lower(text), '{between_edges(m)}')::int" for m in T.MECHANISMS)
STATS = rf"len(regexp_extract_all(text, '(?i)\b(?:{T.STATISTICS})\b'))"


@q("o130_word_counts", f"select doc_id, {WORDS}::int as words, len(regexp_extract_all(text, '\\S+'))::int as split_words from documents")
def o130(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.split_words(F.col("text")).alias("split_words"))


_COUNTED = f"w as (select doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD}')) as word from documents), c as (select doc_id, word, count(*) as n from w group by all), s as (select *, sum(n) over (partition by doc_id) as total from c)"


def entropies(spark, d):
    """A document's words are sorted and counted within the row, so nothing moves."""
    words = F.array_sort(T.words(F.col("text")))
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("s"))
    closed = lambda a: a["s"] + F.when(a["run"] > 1, a["run"] * F.log2(a["run"])).otherwise(0.0)

    def step(a, word):
        same = a["word"] == word
        return F.struct(word.alias("word"), F.when(same, a["run"] + 1).otherwise(1.0).alias("run"), F.when(same, a["s"]).otherwise(closed(a)).alias("s"))

    rows = once(table(spark, d, "documents").select("doc_id", words.alias("w")), "doc_id", "w").where(F.size("w") > 0)
    total = F.size("w").cast("long")
    # -sum(n/t log2(n/t)) = log2(t) - sum(n log2 n)/t
    return rows.select("doc_id", total.alias("total"), F.bround(F.log2(total.cast("double")) - F.aggregate("w", start, step, closed) / total, 4).alias("entropy"))


@q("o077_token_entropy", f"with {_COUNTED} select doc_id, total::bigint as total, round_even(log2(total) - sum(n * log2(n)) / total, 4) as entropy from s group by doc_id, total")
def o077(spark, d):
    return entropies(spark, d)


@q("o078_pronouns", f"with w as (select doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD}')) as word from documents), t as (select doc_id, count(*) as total, count(*) filter (word in {sql_in(T.PRONOUNS)}) as pronouns from w group by doc_id), p as (select doc_id, word, count(*) as n from w where word in {sql_in(T.PRONOUNS)} group by all), r as (select *, row_number() over (partition by doc_id order by n desc, word) as k from p) select t.doc_id, total, pronouns, round_even(pronouns * 100.0 / total, 4) as density, coalesce((select string_agg(word, ' ' order by k) from r where r.doc_id = t.doc_id and k <= 3), '') as top from t")
def o078(spark, d):
    """Pronoun share and the three most frequent; ties by word.  Counted within the row."""
    words = T.words(F.col("text"))
    rows = once(table(spark, d, "documents").select("doc_id", F.size(words).alias("total"), F.filter(words, lambda x: x.isin(T.PRONOUNS)).alias("p")), "doc_id", "total", "p").where("total > 0")
    counts = F.array(*(F.struct((F.size(F.array_remove("p", w)) - F.size("p")).alias("minus"), F.lit(w).alias("word")) for w in T.PRONOUNS))
    best = F.slice(F.array_sort(F.filter(counts, lambda x: x["minus"] < 0)), 1, 3)
    return rows.select("doc_id", F.col("total").cast("long").alias("total"), F.size("p").cast("long").alias("pronouns"), F.bround(F.size("p") * 100.0 / F.col("total"), 4).alias("density"), F.array_join(best["word"], " ").alias("top"))


@q("o079_depth_score", f"select doc_id, {DEPTH} as depth from documents")
def o079(spark, d):
    return table(spark, d, "documents").select("doc_id", T.depth_score(F.col("text")).alias("depth"))


@q("o080_passages", f"with p as (select doc_id, unnest(string_split(text, chr(10))) as text from documents), c as (select doc_id, {WORDS} as n from p) select doc_id, count(*) as passages, round_even(avg(n), 4) as avg_words, round_even(count(*) filter (n > 250) * 1.0 / count(*), 4) as long_share, round_even(count(*) filter (n < 45) * 1.0 / count(*), 4) as short_share from c where n >= 20 group by doc_id")
def o080(spark, d):
    n = F.filter(F.transform(F.split(F.col("text"), "\n"), T.word_count), lambda x: x >= 20)
    c = table(spark, d, "documents").select("doc_id", n.alias("n")).where(F.size("n") > 0)
    share = lambda f: F.bround(F.size(F.filter("n", f)) * 1.0 / F.size("n"), 4)
    return c.select("doc_id", F.size("n").cast("long").alias("passages"), F.bround(F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.size("n"), 4).alias("avg_words"), share(lambda x: x > 250).alias("long_share"), share(lambda x: x < 45).alias("short_share"))


@q("o131_statistics", f"select doc_id, {STATS}::int as statistics from documents")
def o131(spark, d):
    return table(spark, d, "documents").select("doc_id", T.statistic_count(F.col("text")).alias("statistics"))


@q("o133_compression_ratio")
def o133(spark, d):
    return table(spark, d, "documents").select("doc_id", zlib_ratio(F.col("text")).alias("ratio"))


@F.arrow_udf(DoubleType())
def zlib_ratio(texts):
    """Compressed over raw bytes, two decimals; 0 for blank text."""
    import zlib

    import pyarrow as pa

    def ratio(t):
        raw = t.encode() if t else b""
        return round(len(zlib.compress(raw)) / len(raw), 2) if raw.strip() else 0.0

    return pa.array([ratio(t) for t in texts.to_pylist()], pa.float64())


_STEMS = ["pricing_plan_details", "return_shipping_policy", "what_that_from", "support_contact_hours"]


@q("o134_rubric_stems", f"with r as (select unnest({_STEMS}) as component), s as (select component, list_filter(string_split(component, '_'), lambda x: length(x) > 3) as stems from r), c as (select doc_id, component, len(list_filter(stems, lambda x: contains(lower(substr(text, 1, 5000)), x))) > 0 as present from documents, s) select doc_id, count(*) filter (present) as present, round_even(count(*) filter (present) * 1.0 / count(*), 4) as coverage, count(*) filter (present) * 1.0 / count(*) < 0.4 as flagged from c group by doc_id")
def o134(spark, d):
    """Components of which some stem occurs in the first 5000 characters (that bound is the rubric's own)."""
    low = F.lower(F.substring(F.col("text"), 1, 5000))
    present = F.lit(0)
    for component in _STEMS:
        hit = F.lit(False)
        for stem in component.split("_"):
            if len(stem) > 3:
                hit = hit | low.contains(stem)
        present = present + hit.cast("int")
    n = len(_STEMS)
    return table(spark, d, "documents").select("doc_id", present.cast("long").alias("present"), F.bround(present * 1.0 / n, 4).alias("coverage"), (present * 1.0 / n < 0.4).alias("flagged"))


@q("r61_query_rubric", f"with r as (select unnest({_STEMS}) as component), s as (select component, list_filter(string_split(component, '_'), lambda x: length(x) > 3) as stems from r), c as (select doc_id, component, len(list_filter(stems, lambda x: contains(lower(substr(text, 1, 5000)), x))) > 0 as present from documents, s) select doc_id, 'QUERY_RUBRIC.GENERIC' as id, count(*) filter (not present) as missing from c group by doc_id having count(*) filter (present) * 1.0 / count(*) < 0.4")
def r61(spark, d):
    flagged = o134(spark, d).where("flagged")
    return flagged.select("doc_id", F.lit("QUERY_RUBRIC.GENERIC").alias("id"), (len(_STEMS) - F.col("present")).alias("missing"))


def content_facts(spark, d, *more):
    """Per document: words, depth, statistics, credentials, question lines, and further columns of the table."""
    lines = F.split(F.col("text"), "\n")
    return table(spark, d, "documents").select(
        "doc_id", *more, T.word_count(F.col("text")).alias("words"), T.depth_score(F.col("text")).alias("depth"), T.statistic_count(F.col("text")).alias("statistics"), T.has_credentials(F.col("text")).alias("credentials"),
        F.exists(lines, T.is_question).alias("questions"), F.col("text").rlike(r"(?i)https?://").alias("links"), F.col("text").rlike(r"(?m)^\s*(?:\||[-*] )").alias("lists"),
    )


_QUESTION_LINE = rf"^(?:{'|'.join(T.QUESTION_WORDS)})\b|\?$"
_FACTS = rf"""facts as (
    select doc_id, {WORDS}::int as words, {DEPTH} as depth, {STATS}::int as statistics, regexp_matches(text, '(?i)\b(?:{T.CREDENTIALS})') as credentials,
           len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(trim(x)), '{_QUESTION_LINE}'))) > 0 as questions, regexp_matches(text, '(?i)https?://') as links, regexp_matches(text, '(?m)^\s*(?:\||[-*] )') as lists
    from documents
)"""
#: Content rules over the facts: name, id, condition (the same in both engines).
RULES = [
    ("r50_content_depth", "CONTENT_DEPTH_INSUFFICIENT", "words > 25 and words < 200"),
    ("r51_mechanisms", "MISSING_IN_DEPTH_MECHANISMS", "depth < 2"),
    ("r52_statistics", "PROACTIVE.GEO.STATISTICAL_EVIDENCE.001", "statistics = 0 and words > 100"),
]


def _rule(name: str, rule_id: str, condition: str) -> None:
    @q(name, f"with {_FACTS} select doc_id, '{rule_id}' as id, words from facts where {condition}")
    def run(spark, d):
        used = sorted({"doc_id", "words"} | {w for w in re.findall("[a-z]+", condition) if w in ("depth", "statistics", "credentials", "questions", "links", "lists")})
        return once(content_facts(spark, d), *used).where(condition).select("doc_id", F.lit(rule_id).alias("id"), "words")


for _name, _id, _condition in RULES:
    _rule(_name, _id, _condition)


@q("r58_information_density", f"with {_COUNTED}, e as (select doc_id, total, round_even(log2(total) - sum(n * log2(n)) / total, 4) as entropy from s group by doc_id, total) select doc_id, total::bigint as words, entropy from e where total >= 150 and entropy < 4.0")
def r58(spark, d):
    return entropies(spark, d).where("total >= 150 and entropy < 4.0").select("doc_id", F.col("total").alias("words"), "entropy")


@q("r59_pronoun_density", f"with c as (select doc_id, regexp_extract_all(lower(text), '{T.WORD}') as w from documents), p as (select doc_id, len(w) as words, len(list_filter(w, lambda x: x in {sql_in(T.PRONOUNS)})) as pronouns from c) select doc_id, words::bigint as words, pronouns::bigint as pronouns from p where words >= 150 and pronouns * 100.0 / words > 3.0")
def r59(spark, d):
    w = T.words(F.col("text"))
    p = table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.filter(w, lambda x: x.isin(T.PRONOUNS))).cast("long").alias("pronouns"))
    return p.where("words >= 150 and pronouns * 100.0 / words > 3.0")


@q("r60_passage_length", f"with p as (select doc_id, unnest(string_split(text, chr(10))) as text from documents), c as (select doc_id, {WORDS} as n from p), s as (select doc_id, count(*) as k, count(*) filter (n > 250) as long, count(*) filter (n < 45) as short from c where n >= 20 group by doc_id), t as (select doc_id, {WORDS} as total from documents) select doc_id, case when long > k * 0.5 then 'dense' else 'fragmented' end as kind, k as passages from s join t using (doc_id) where k >= 2 and (long > k * 0.5 or (short > k * 0.7 and total > 200))")
def r60(spark, d):
    n = F.filter(F.transform(F.split(F.col("text"), "\n"), T.word_count), lambda x: x >= 20)
    s = table(spark, d, "documents").select("doc_id", n.alias("n"), T.word_count(F.col("text")).alias("total"))
    s = s.select("doc_id", "total", F.size("n").cast("long").alias("k"), F.size(F.filter("n", lambda x: x > 250)).alias("long"), F.size(F.filter("n", lambda x: x < 45)).alias("short"))
    return s.where("k >= 2 and (long > k * 0.5 or (short > k * 0.7 and total > 200))").select("doc_id", F.when(F.col("long") > F.col("k") * 0.5, "dense").otherwise("fragmented").alias("kind"), F.col("k").alias("passages"))


@q("q06_fluff_density", rf"select doc_id, len(regexp_extract_all(text, '(?i)\b(?:{T.FLUFF})\b'))::int as fluff from documents")
def q06(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count(F.col("text"), F.lit(as_sql_reads(rf"(?i)\b(?:{T.FLUFF})\b"))).alias("fluff"))


QUERIES, SQL = area.queries, area.sql
