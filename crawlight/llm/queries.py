"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlight.llm.exact_dedup import exact_dedup
from crawlight.llm.fingerprints import fingerprint_edits
from crawlight.llm.jaccard_join import jaccard_components
from crawlight.llm.language_model import score_documents
from crawlight.llm.licenses import scan_licenses
from crawlight.llm.mixing import DIMS, KEEP, MARGINS, ROUNDS, SCALE, TEMPER, TOPIC_ROUNDS, TOPICS, with_probabilities
from crawlight.llm.packing import pack_documents
from crawlight.llm.prefix_trie import conversation_trie
from crawlight.llm.quality import fit_quality, in_fold, score_quality
from crawlight.llm.sharding import shard_documents
from crawlight.llm.substrings import repeated_windows
from crawlight.llm.token_counts import count_tokens
from crawlight.llm.vector_codes import encode_vectors


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = score_quality(docs, model)
    return scores.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


OP4_SQL = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
), links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)
), reach(doc_id, other) as (
    select doc_id, doc_id from documents union select reach.doc_id, links.b from reach join links on links.a = reach.other
)
select d.doc_id, coalesce(any_value(sizes.n), 0)::bigint as n_shingles, min(reach.other) as component_id
from documents d join reach on reach.doc_id = d.doc_id left join sizes on sizes.doc_id = d.doc_id group by d.doc_id
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(_documents(spark, sf_dir))


OP7_SQL = r"""
with words as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from words, unnest(range(1, len(w) - 11)) as t(i)
), firsts as (
    select s, min(doc_id) as first from windows group by s
), covered as (
    select distinct doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (s) where first < doc_id
), kept as (
    select words.doc_id, count(covered.p) as n_removed, coalesce(string_agg(w[t.p], ' ' order by t.p) filter (covered.p is null), '') as text
    from words, unnest(range(1, len(w) + 1)) as t(p) left join covered on covered.doc_id = words.doc_id and covered.p = t.p group by words.doc_id
)
select words.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from words left join kept on kept.doc_id = words.doc_id
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_probabilities(_documents(spark, sf_dir))
    return docs.select(
        "doc_id", F.col("_mix_source").alias("source"), F.col("_mix_lang").alias("lang"), F.col("_mix_topic").alias("topic"), F.col("_mix_tokens").alias("n_tokens"),
        F.round("_mix_weight", 6).alias("weight"), F.round("_mix_probability", 6).alias("probability"), F.col("_mix_kept").alias("kept"),
    )


#: Rounds that the SQL form rakes, as many as the operator, which stops earlier once its margins hold to twelve digits.
SQL_ROUNDS = ROUNDS


def _op8_sql() -> str:
    """Topics and raking in SQL: one step for each round that fits topics, one for each margin of each round that rakes."""
    steps, last = [], "start"
    for k in range(SQL_ROUNDS):
        for m in MARGINS:
            name = f"step_{k}_{m}"
            steps.append(f"{name} as materialized (select source, lang, topic, tokens, goal_source, goal_lang, goal_topic, w * goal_{m} / sum(w) over (partition by {m}) as w from {last})")
            last = name
    goals = ", ".join(f"goals_{m} as (select {m}, power(sum(tokens)::double, {TEMPER}) / sum(power(sum(tokens)::double, {TEMPER})) over () as goal_{m} from cells group by {m})" for m in MARGINS)
    cells = lambda k: ", ".join(f"{SCALE} * (len({k}) - len(replace({k}, '{d:x}', ''))) // greatest(len({k}), 1)" for d in range(DIMS // 2))
    start = ", ".join(f"x[{k + 1}] + x[{k + 1 + TOPICS}]" for k in range(TOPICS))
    fit = []
    for k in range(TOPIC_ROUNDS):
        fit.append(f"""book_{k} as materialized (
    select t, list(s // n order by j) as c from (select t, j, sum(x[j] * n)::bigint as s, sum(n)::bigint as n from near_{k}, unnest(range(1, {DIMS} + 1)) as u(j) group by t, j) group by t
), near_{k + 1} as materialized (
    select r, x, n, t from (select r, x, n, b.t, list_sum(list_transform(range(1, {DIMS} + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) as far from near_{k}, book_{k} b) qualify row_number() over (partition by r order by far, t) = 1
)""")
    return rf"""
with worded as (
    select *, row_number() over () as r, list_transform(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}{{6,}}'), lambda w: md5(w)) as digests from documents
), hashed as (
    select *, array_to_string(list_transform(digests, lambda w: w[1]), '') as v0, array_to_string(list_transform(digests, lambda w: w[2]), '') as v1 from worded
), shared as materialized (
    select *, [{cells("v0")}, {cells("v1")}] as x from hashed
), near_0 as materialized (
    select r, x, n, list_position(starts, list_max(starts)) - 1 as t from (select r, x, len(v0) as n, [{start}] as starts from shared where v0 <> '')
), {", ".join(fit)}, docs as materialized (
    select doc_id, coalesce(source, '<null>') as source, coalesce(lang, '<null>') as lang, coalesce(t::varchar, 'none') as topic,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 as u
    from shared left join near_{TOPIC_ROUNDS} using (r)
), cells as materialized (
    select source, lang, topic, sum(n_tokens)::bigint as tokens from docs group by all having sum(n_tokens) > 0
), {goals}, start as materialized (
    select cells.*, goal_source, goal_lang, goal_topic, tokens::double as w from cells join goals_source using (source) join goals_lang using (lang) join goals_topic using (topic)
), {", ".join(steps)}, rates as materialized (
    select *, w / tokens as rate from {last}
), factors as (
    select *, ({KEEP} * sum(tokens) over () - coalesce(sum(tokens) over (order by rate desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0))
        / sum(w) over (order by rate desc, source, lang, topic rows between current row and unbounded following) as factor,
        row_number() over (order by rate desc, source, lang, topic) as place
    from rates
), chosen as (
    select min_by(factor, place) as factor from factors where factor > 0 and factor * rate <= 1
), done as (
    select source, lang, topic, rate * sum(tokens) over () / sum(w) over () as weight, coalesce(least(1.0, chosen.factor * rate), 1.0) as probability from rates, chosen
)
select doc_id, docs.source, docs.lang, docs.topic, n_tokens, round(coalesce(weight, 0.0), 6) as weight, round(coalesce(probability, 1.0), 6) as probability,
       u < round(coalesce(probability, 1.0), 9) as kept
from docs left join done on docs.source = done.source and docs.lang = done.lang and docs.topic = done.topic
"""


OP8_SQL = _op8_sql()


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), keep="largest")


OP9_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _op11_sql() -> str:
    """Codebooks as lists per position and entry, one pair of steps a round."""
    steps = []
    for k in range(7):
        steps.append(f"""apart_{k} as materialized (
    select vec_id, p, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) as d from parts join book_{k} using (p)
), near_{k} as materialized (
    select vec_id, p, e, d from apart_{k} qualify row_number() over (partition by vec_id, p order by d, e) = 1
)""")
        if k < 6:
            steps.append(f"""sums_{k} as (
    select p, e, i, sum(v[i])::bigint as s, count(*) as n from near_{k} join parts using (vec_id, p), unnest(range(1, len(v) + 1)) as t(i) group by p, e, i
), means_{k} as (
    select p, e, list((s - ((s % n) + n) % n) // n order by i) as w from sums_{k} group by p, e
), book_{k + 1} as materialized (
    select p, e, coalesce(means_{k}.w, book_{k}.w) as w from book_{k} left join means_{k} using (p, e)
)""")
    return f"""
with kept as (
    select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
    select vec_id, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] as v from kept, unnest(range(8)) as t(p)
), seeds as (
    select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 16
), book_0 as materialized (
    select p, e, v as w from parts join seeds using (vec_id)
), {", ".join(steps)}, coded as (
    select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near_6 group by vec_id
), final as (
    select sha256(string_agg(array_to_string(w, ','), ',' order by p, e)) as codebooks_sha256 from book_6
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join coded using (vec_id), final
"""


OP11_SQL = _op11_sql()


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = """
with turns as (
    select conv_id, coalesce(role, '') as role, len(coalesce(text, '')) as chars, md5(len(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as t,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(len(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
    from conversations where conv_id is not null
), bits as (
    -- CRC-32: a byte is taken in, then eight shifts
    select distinct conv_id, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as steps from turns
), convs as (
    select conv_id, conv_id - conv_id % 100 as base,
           xor(list_reduce(steps, lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end, 4294967295::bigint), 4294967295::bigint) % 6 as h
    from bits
), moved as (
    select convs.conv_id, pos, t, chars from convs join turns on turns.conv_id = base where pos < h
    union all
    select convs.conv_id, pos, t, chars from convs join turns on turns.conv_id = convs.conv_id where pos >= h
), rebuilt as (
    select conv_id, coalesce(list(t order by pos) filter (t is not null), []) as s, coalesce(list(chars order by pos) filter (t is not null), []) as chars from convs left join moved using (conv_id) group by conv_id
), prefixes as (
    select conv_id, s[1:d] as node, d, chars[d] as chars, d = len(s) as ends from rebuilt, unnest(range(0, len(s) + 1)) as x(d)
), nodes as materialized (
    select node, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ends
    from prefixes group by node
), children as (
    select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by all
), linked as materialized (
    select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (node)
), sums as (
    select node[1:d] as node, count_if(n_children = 0) as n_leaves, sum(case when depth = 0 then 0 else (n_convs - 1) * chars end)::bigint as saved_tokens
    from linked, unnest(range(0, depth + 1)) as x(d) group by all
)
select a.conv_id, a.depth, b.conv_id as parent_conv_id, a.n_convs, a.n_children, n_leaves::bigint as n_leaves, saved_tokens, sha256(a.ends) as ends_sha256
from linked a join sums using (node) left join nodes b on a.depth > 0 and b.node = a.node[1:a.depth - 1]
"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return shard_documents(_documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lm_scoring": op1_lm_scoring, "op2_packing": op2_packing, "op3_quality": op3_quality, "op10_license_scans": op10_license_scans, "op4_jaccard_join": op4_jaccard_join, "op5_fingerprints": op5_fingerprints, "op8_mixing": op8_mixing, "op6_token_counts": op6_token_counts, "op7_substring_dedup": op7_substring_dedup, "op9_exact_dedup": op9_exact_dedup, "op11_vector_codes": op11_vector_codes, "op12_prefix_trie": op12_prefix_trie, "op13_sharding": op13_sharding}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_prefix_trie": OP12_SQL}
