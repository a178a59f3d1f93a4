"""Candidates, evidence, merge, ranking, scores and validation over document findings.

A document's source is the site, the document the artifact; findings come
from four content rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlight.functions import text as T
from crawlight.operators.ranks import BLOCK, digest_of_digests, placed
from crawlight.plans import catalogue as C
from crawlight.plans import report as P
from crawlight.plans.evidence import resolved
from crawlight.plans.schema import schema_violations
from crawlight.queries.content import _FACTS, content_facts
from crawlight.queries.registry import Area, once, sql_in
from crawlight.sources.tables import table

area = Area()
q = area.query

#: Cause, severity, condition over the content facts.
SOURCES = [
    ("CONTENT_DEPTH_INSUFFICIENT", "medium", "words > 25 and words < 200"), ("MISSING_IN_DEPTH_MECHANISMS", "high", "depth < 1 and words > 400"),
    ("PROACTIVE.GEO.STATISTICAL_EVIDENCE.001", "low", "statistics = 0 and words > 100"), ("UNMAPPED_CAUSE", "critical", "words > 3000"),
]


def _case_sql(column: str, mapping: dict, default: str = "null") -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {v if not isinstance(v, str) else repr(v)}" for k, v in mapping.items()) + f" else {default} end"


_FINDINGS = f"{_FACTS}, findings as (" + " union all ".join(f"select doc_id, '{cause}' as cause, '{severity}' as severity from facts where {condition}" for cause, severity, condition in SOURCES) + ")"
_CANDIDATES = f"""{_FINDINGS}, candidates0 as (
    select d.source as site, 'doc-' || f.doc_id as scope, 'page_' || f.doc_id as artifact, f.cause, f.severity, {_case_sql('f.cause', C.CAUSES)} as check_id, {_case_sql('f.severity', C.BANDS, "'S1'")} as band,
           case when f.severity in ('critical', 'high') then 'confirmed_problem' else 'advisory' end as kind, case when f.severity in ('critical', 'high') then 'confirmed' else 'advisory' end as queue, 2 as difficulty,
           case when f.doc_id % 13 = 0 then 'bad locator' else 'text' end as locator, f.doc_id % 17 <> 0 as complete, d.text as artifact_text,
           case when f.doc_id % 11 = 0 then 'made up quote' else coalesce(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda w: length(w) > 4)[1], left(d.text, 20)) end as quote
    from findings f join documents d using (doc_id)
), catalogue0 as (select * from {C.values_sql()}), gated as (
    select c.*, k.owner, k.domain, case when k.owner is null then 'unknown_check' when locator <> 'text' then 'locator_grammar' when quote = '' then 'quote_missing' when not contains(artifact_text, quote) then 'quote_not_found' when kind = 'confirmed_problem' and not complete then 'incomplete_scope' end as drop_reason
    from candidates0 c left join catalogue0 k using (check_id)
), merged as (
    select site, scope, kind, cause, list_sort(list_distinct(list(check_id))) as check_ids, count(distinct artifact) as artifacts, max(band) as band, min(queue) as queue, min(difficulty) as difficulty from gated where drop_reason is null group by all
), ranked as (
    select *, row_number() over (partition by site order by case queue when 'confirmed' then 0 when 'advisory' then 1 else 2 end, band desc, difficulty, artifacts desc, cause, scope) as place, 5 * substr(band, 2, 1)::int + (6 - difficulty) as priority_index from merged
)"""


def findings(spark, d, *more):
    """O-100: the rules' findings as one table; all rules read a document's facts in one pass."""
    each = F.array_compact(F.array(*(F.when(F.expr(condition), F.struct(F.lit(cause).alias("cause"), F.lit(severity).alias("severity"))) for cause, severity, condition in SOURCES)))
    return once(content_facts(spark, d, *more), "doc_id", *more, "words", "depth", "statistics").select("doc_id", *more, F.explode(each).alias("f")).select("doc_id", *more, "f.*")


def candidates(spark, d):
    """Findings with quotes in one pass over documents: no text is shuffled, and whether the quote holds is known at once."""
    each = F.array_compact(F.array(*(F.when(F.expr(condition), F.struct(F.lit(cause).alias("cause"), F.lit(severity).alias("severity"))) for cause, severity, condition in SOURCES)))
    facts = once(content_facts(spark, d, "source", "text"), "doc_id", "source", "text", "words", "depth", "statistics").withColumn("f", each).where(F.size("f") > 0)
    key = F.col("doc_id").cast("string")
    quote = F.when(F.col("doc_id") % 11 == 0, "made up quote").otherwise(P.grounded_quote(F.col("text"), []))
    quoted = once(facts.select("doc_id", "source", "f", "text", quote.alias("quote")), "doc_id", "source", "f", "text", "quote").withColumn("held", F.contains("text", F.col("quote"))).drop("text")
    rows = quoted.select(
        F.col("source").alias("site"), F.concat(F.lit("doc-"), key).alias("scope"), F.concat(F.lit("page_"), key).alias("artifact"), F.explode("f").alias("f"),
        F.when(F.col("doc_id") % 13 == 0, "bad locator").otherwise("text").alias("locator"), (F.col("doc_id") % 17 != 0).alias("complete"), "quote", "held",
    )
    return P.candidates(rows.select("*", "f.cause", "f.severity").drop("f"))


def gated(spark, d):
    return P.gated(candidates(spark, d), None, C.catalogue(spark))


def merged(spark, d):
    return P.merged(gated(spark, d).where("drop_reason is null"))


@q("o100_findings_union", f"with {_FINDINGS} select doc_id, cause, severity from findings")
def o100(spark, d):
    return findings(spark, d)


@q("o003_sensor_outputs", f"with {_FINDINGS} select cause as id, severity, count(*) as findings from findings group by all")
def o003(spark, d):
    """Sensor payloads as JSON texts, findings at top level or one block below, read back through variants (files go through read_findings)."""
    f = findings(spark, d).select("doc_id", F.array(F.struct(F.col("cause").alias("id"), "severity")).alias("findings"))
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("findings"))).otherwise(F.to_json(F.struct(F.struct("findings").alias("block"))))
    v = f.select(F.try_parse_json(text).alias("v"))
    found = F.expr("coalesce(try_variant_get(v, '$.findings'), try_variant_get(v, '$.block.findings'))")
    rows = v.select(F.explode(F.from_json(F.to_json(found), "array<struct<id: string, severity: string>>")).alias("f")).select("f.*")
    return rows.groupBy("id", "severity").agg(F.count("*").alias("findings"))


@q("o114_candidates", f"with {_CANDIDATES} select site, scope, cause, coalesce(check_id, '') as check_id, band, kind, queue, difficulty from candidates0")
def o114(spark, d):
    return candidates(spark, d).select("site", "scope", "cause", F.coalesce("check_id", F.lit("")).alias("check_id"), "band", "kind", "queue", "difficulty")


@q("o060_catalogue_join", f"with {_CANDIDATES} select coalesce(owner, 'unknown') as owner, count(*) as candidates from gated group by all")
def o060(spark, d):
    return gated(spark, d).groupBy(F.coalesce("owner", F.lit("unknown")).alias("owner")).agg(F.count("*").alias("candidates"))


@q("o061_evidence_join", f"with {_CANDIDATES} select artifact, count(*) as refs, bool_and(contains(artifact_text, quote)) as grounded from candidates0 group by artifact")
def o061(spark, d):
    return candidates(spark, d).groupBy("artifact").agg(F.count("*").alias("refs"), F.bool_and("held").alias("grounded"))


@q("o149_grounded_quote", "select doc_id, coalesce(case when contains(text, 'the') then 'the' end, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 4)[1], left(text, 20)) as quote from documents")
def o149(spark, d):
    return table(spark, d, "documents").select("doc_id", P.grounded_quote(F.col("text"), [F.lit("the"), F.lit("no")]).alias("quote"))


@q("o110_evidence_gate", f"with {_CANDIDATES} select site, scope, cause, coalesce(drop_reason, 'kept') as outcome from gated")
def o110(spark, d):
    return gated(spark, d).select("site", "scope", "cause", F.coalesce("drop_reason", F.lit("kept")).alias("outcome"))


@q("o045_candidate_guards", f"with {_CANDIDATES}, g as (select scope, cause, case when scope like '%7' then 'S9' when scope like '%8' then 'U' else band end as band, kind from candidates0) select scope, cause, case when band not in ('S4', 'S3', 'S2', 'S1', 'S0', 'U') then 'invalid_band' when kind = 'confirmed_problem' and band in ('S0', 'U') then 'unassessable' end as reason from g where band not in ('S4', 'S3', 'S2', 'S1', 'S0', 'U') or (kind = 'confirmed_problem' and band in ('S0', 'U'))")
def o045(spark, d):
    band = F.when(F.col("scope").endswith("7"), "S9").when(F.col("scope").endswith("8"), "U").otherwise(F.col("band"))
    c = candidates(spark, d).withColumn("band", band).withColumns({"check_id": F.lit("N1"), "locator": F.lit("text")})
    g = P.gated(c, None, C.catalogue(spark)).where("drop_reason in ('invalid_band', 'unassessable')")
    return g.select("scope", "cause", F.col("drop_reason").alias("reason"))


#: Locators of pages, made alike by both engines from the address: dots for slashes, some with indexes, gaps or other faults.
_LOCATED = """located as (select page_id, regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*/[^?#]*)', 1), '/+', '.'{every}) || case page_id % 8
 when 0 then '[' || page_id || ']'
 when 1 then '[2].c'
 when 2 then '..b'
 when 3 then '[y]'
 when 4 then '.'
 when 5 then ' body'
 when 6 then '.source.canonicals'
 else '' end as locator from {pages})"""


@q("o046_locator_grammar", f"with {_LOCATED.format(pages='pages', every=', ' + repr('g'))} select page_id, locator, regexp_full_match(locator, '{C.LOCATOR}') as valid from located")
def o046(spark, d):
    made = spark.sql(f"with {_LOCATED.format(pages='{pages}', every='')} select * from located", pages=table(spark, d, "pages"))
    return made.select("page_id", "locator", F.col("locator").rlike(rf"\A(?:{C.LOCATOR})\z").alias("valid"))


@q("o111_observations", f"with {_CANDIDATES} select scope, cause, band = 'S1' as observation from gated where drop_reason is null")
def o111(spark, d):
    """Low bands are split off as observations."""
    return gated(spark, d).where("drop_reason is null").select("scope", "cause", (F.col("band") == "S1").alias("observation"))


@q("o088_cause_merge", f"with {_CANDIDATES} select site, scope, kind, cause, array_to_string(check_ids, ',') as check_ids, artifacts, band from merged")
def o088(spark, d):
    return merged(spark, d).select("site", "scope", "kind", "cause", F.array_join("check_ids", ",").alias("check_ids"), "artifacts", "band")


@q("o092_finding_order", f"with {_CANDIDATES} select site, scope, cause, place::int as place, printf('F-%03d', place) as finding_id, priority_index from ranked")
def o092(spark, d):
    """O-092, O-094, O-095: order, ids and priority."""
    return P.ranked(merged(spark, d)).select("site", "scope", "cause", F.col("place").cast("int").alias("place"), "finding_id", "priority_index")


@q("o085_severity_summary", f"with {_CANDIDATES} select site, count(*) as total, count(*) filter (band = 'S4') as critical, count(*) filter (band = 'S3') as high, count(*) filter (band = 'S2') as medium, count(*) filter (band = 'S1') as low from merged group by site")
def o085(spark, d):
    return merged(spark, d).groupBy("site").agg(F.count("*").alias("total"), *(F.count_if(F.col("band") == b).alias(n) for n, b in C.BANDS.items()))


@q("o113_report_invariants", f"with {_CANDIDATES} select site, count(*) = count(distinct place) as unique_ids, max(place) = count(*) as gapless from ranked group by site")
def o113(spark, d):
    return P.ranked(merged(spark, d)).groupBy("site").agg((F.count("*") == F.count_distinct("finding_id")).alias("unique_ids"), (F.max("place") == F.count("*")).alias("gapless"))


@q("o115_sources", f"with {_CANDIDATES} select site, scope, cause, artifact as url, left(quote, 300) as observation from gated where drop_reason is null")
def o115(spark, d):
    return gated(spark, d).where("drop_reason is null").select("site", "scope", "cause", F.col("artifact").alias("url"), F.left("quote", F.lit(300)).alias("observation"))


@q("o116_eligibility", f"with {_CANDIDATES}, e as (select distinct kind || ':' || cause || ':' || scope as fingerprint, case when severity in ('critical', 'high') and length(quote) < 10 then 'medium' else severity end as severity from candidates0 where length(quote) >= 8) select * from e")
def o116(spark, d):
    """Evidence of eight characters at least; strong severities need more; equal fingerprints once."""
    c = candidates(spark, d).where(F.length("quote") >= 8)
    severity = F.when(F.col("severity").isin("critical", "high") & (F.length("quote") < 10), "medium").otherwise(F.col("severity"))
    return c.select(F.concat_ws(":", "kind", "cause", "scope").alias("fingerprint"), severity.alias("severity")).distinct()


@q("o148_action_text", f"with {_CANDIDATES} select scope, cause, 'Fix ' || lower(replace(cause, '_', ' ')) || ' on ' || scope || ' (' || coalesce(owner, 'unassigned') || ')' as action from gated")
def o148(spark, d):
    text = F.format_string("Fix %s on %s (%s)", F.lower(F.replace("cause", F.lit("_"), F.lit(" "))), F.col("scope"), F.coalesce("owner", F.lit("unassigned")))
    return gated(spark, d).select("scope", "cause", text.alias("action"))


_WEIGHTS = "weights(domain, weight) as (values " + ", ".join(f"('{k}', {w}::double)" for k, w in C.WEIGHTS.items()) + ")"
_STEP = lambda column, steps: "case " + " ".join(f"when {column} >= {n} then '{v}'" for n, v in steps) + " end"
_SCORES = f"""{_FINDINGS}, f as (select distinct d.source as site, cause || ':' || doc_id as finding, severity, {_case_sql('cause', C.CAUSES)} as check_id from findings join documents d using (doc_id)),
hit as (select f.site, finding, severity, coalesce(catalogue.domain, 'discoverability') as domain from f left join {C.values_sql()} using (check_id)),
lost as (select site, domain, sum({_case_sql('severity', C.DEDUCTIONS, '5')}) as lost, count(*) as findings from hit group by all), {_WEIGHTS},
scores as (select s.site, w.domain, w.weight, greatest(0, 100 - coalesce(lost, 0))::int as score, coalesce(findings, 0) as findings from (select distinct site from f) s cross join weights w left join lost l on l.site = s.site and l.domain = w.domain)"""


def domain_scores(spark, d):
    f = findings(spark, d, "source").withColumnRenamed("source", "site")
    f = f.select("site", F.concat_ws(":", "cause", F.col("doc_id").cast("string")).alias("finding"), "severity", F.array(F.coalesce(P.case(F.col("cause"), C.CAUSES), F.lit("?"))).alias("check_ids")).distinct()
    return P.domain_scores(f, C.catalogue(spark))


@q("o083_domain_scores", f"with {_SCORES} select site, domain, weight, score, findings, {_STEP('score', C.GRADES)} as grade from scores")
def o083(spark, d):
    return domain_scores(spark, d)


@q("o08c_readiness_index", f"with {_SCORES}, c as (select site, round_even(sum(score * weight) / sum(weight), 0)::int as readiness_index from scores group by site) select site, readiness_index, {_STEP('readiness_index', C.TIERS)} as tier, {_STEP('readiness_index', C.GRADES)} as grade from c")
def o08c(spark, d):
    return P.composite(domain_scores(spark, d))


@q("o068_finding_domains", f"with {_FINDINGS}, f as (select doc_id, {_case_sql('cause', C.CAUSES)} as check_id from findings) select catalogue.domain, count(distinct doc_id) as documents from f join {C.values_sql()} using (check_id) group by catalogue.domain")
def o068(spark, d):
    f = findings(spark, d).select("doc_id", P.case(F.col("cause"), C.CAUSES).alias("check_id"))
    return f.join(F.broadcast(C.catalogue(spark)), "check_id").groupBy("domain").agg(F.count_distinct("doc_id").alias("documents"))


_USED = f"with {_CANDIDATES}, used as (select check_id, band, count(*) as n from gated where drop_reason is null group by all)"


@q("o08d_catalogue_stats", f"{_USED}, checks as (select owner, count(*) as checks, count(*) - count(distinct check_id) as repeated from catalogue0 group by owner), met as (select owner, count(distinct check_id) as met, sum(n)::bigint as findings, sum(n) filter (band in ('S3', 'S4'))::bigint as severe from used join (select distinct check_id, owner from catalogue0) using (check_id) group by owner) select owner, checks, repeated, coalesce(met, 0) as met, coalesce(findings, 0) as findings, coalesce(severe, 0) as severe from checks left join met using (owner)")
def o08d(spark, d):
    """How each owner's checks are spread and met: findings are counted by check before they meet the catalogue."""
    used = gated(spark, d).where("drop_reason is null").groupBy("check_id", "band").agg(F.count("*").alias("n"))
    k = C.catalogue(spark)
    met = used.join(F.broadcast(k.select("check_id", "owner").distinct()), "check_id").groupBy("owner").agg(F.count_distinct("check_id").alias("met"), F.sum("n").alias("findings"), F.sum(F.when(F.col("band").isin("S3", "S4"), F.col("n"))).alias("severe"))
    checks = k.groupBy("owner").agg(F.count("*").alias("checks"), (F.count("*") - F.count_distinct("check_id")).alias("repeated"))
    return checks.join(met, "owner", "left").select("owner", "checks", "repeated", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("met", "findings", "severe")))


_EVIDENCE = "e as (select event_type as site, sha256(event_type || '|' || coalesce(json_extract_string(props, '$.k'), '')) as key, user_id as page, event_id from events), g as (select site, key, count(distinct page) as occurrences, min(event_id) as first from e group by site, key), n as (select *, row_number() over (partition by site order by first) as k from g)"


def evidence(spark, d):
    """O-086: items of equal value and kind are one; ids follow first sight within a site (here an event type)."""
    e = table(spark, d, "events").select(F.col("event_type").alias("site"), F.sha2(F.concat("event_type", F.lit("|"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))), 256).alias("key"), "user_id", "event_id")
    g = e.groupBy("site", "key").agg(F.count_distinct("user_id").alias("occurrences"), F.min("event_id").alias("first"))
    return placed(g, "site", [F.col("first")]).withColumn("id", F.format_string("E%06d", "place"))


@q("o086_evidence_registry", f"with {_EVIDENCE} select site, key, occurrences, printf('E%06d', k) as id from n")
def o086(spark, d):
    return evidence(spark, d).select("site", "key", "occurrences", "id")


@q("o087_registry_fingerprint", f"with {_EVIDENCE}, b as (select site, (k - 1) // {BLOCK} as b, count(*) as n, sha256(string_agg(key, ',' order by k)) as digest from n group by all) select site, sum(n)::bigint as items, sha256(string_agg(digest, ',' order by b)) as fingerprint from b group by site")
def o087(spark, d):
    return digest_of_digests(evidence(spark, d), "site", "key")


@q("o152_evidence_lookup", f"with {_EVIDENCE} select site, printf('E%06d', k) as id, occurrences from n where k in (1, 3)")
def o152(spark, d):
    return evidence(spark, d).where(F.col("id").isin("E000001", "E000003")).select("site", "id", "occurrences")


@q("o06b_dependencies", "with t as (select p_partkey as id, p_partkey - p_size as dep, p_size % 3 as queue from part), j as (select t.id, t.dep, t.queue, o.queue as dep_queue from t left join t o on o.id = t.dep) select id, case when dep_queue is null then 'unknown_prerequisite' when dep_queue > queue then 'later_queue' end as error from j where dep_queue is null or dep_queue > queue")
def o06b(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_size")).alias("dep"), (F.col("p_size") % 3).alias("queue"))
    j = t.join(t.select(F.col("id").alias("dep"), F.col("queue").alias("dep_queue")), "dep", "left")
    return j.where("dep_queue is null or dep_queue > queue").select("id", F.when(F.col("dep_queue").isNull(), "unknown_prerequisite").otherwise("later_queue").alias("error"))


@q("o093_topological_order")
def o093(spark, d):
    """All parts of a brand as tasks that depend on the brand's part ten numbers before; a brand is ordered in one task."""
    p = table(spark, d, "part")
    band = F.concat(F.lit("S"), (1 + F.col("p_size") % 4).cast("string"))
    return P.topological(p.select(F.col("p_brand").alias("site"), F.col("p_partkey").cast("string").alias("id"), F.array((F.col("p_partkey") - 10).cast("string")).alias("depends_on"), F.lit("confirmed").alias("queue"), band.alias("band"), (F.col("p_size") % 5).alias("difficulty")))


#: A Draft-07 schema of event properties.
EVENT_SCHEMA = {"type": "object", "required": ["k", "z"], "properties": {"k": {"type": "integer", "maximum": 50}}, "additionalProperties": False}


@q("o112_schema_violations", """with e as (select event_id, props::json as p from events where props is not null), v as (
    select event_id, case when json_type(p) <> 'OBJECT' then [{'path': '$', 'rule': 'type'}] else
        list_transform(list_filter(['k', 'z'], lambda x: not list_contains(json_keys(p), x)), lambda x: {'path': '$.' || x, 'rule': 'required'})
        || list_transform(list_filter(json_keys(p), lambda x: x <> 'k'), lambda x: {'path': '$.' || x, 'rule': 'additionalProperties'})
        || case when list_contains(json_keys(p), 'k') and json_type(p, '$.k') not in ('BIGINT', 'UBIGINT', 'INTEGER') then [{'path': '$.k', 'rule': 'type'}] when json_type(p, '$.k') in ('BIGINT', 'UBIGINT', 'INTEGER') and json_extract(p, '$.k')::bigint > 50 then [{'path': '$.k', 'rule': 'maximum'}] else [] end end as found from e)
    select event_id, x.path as path, x.rule as rule from (select event_id, unnest(found) as x from v)""")
def o112(spark, d):
    """Draft-07 checks of JSON values; here of event properties."""
    e = table(spark, d, "events").where("props is not null").select("event_id", F.parse_json("props").alias("v"))
    return schema_violations(e, "event_id", "v", EVENT_SCHEMA)


#: A JSON text of a part that both engines make alike: names with dots, arrays of texts and of objects, a time.
_DOCUMENT = """'{"id.part":' || case when p_partkey % 7 = 0 then '"x"' else p_partkey::varchar end || ',"tags":[' || case when p_partkey % 5 = 0 then '' else '"' || p_brand || '","' || left(p_type, p_size % 9) || '"' end || '],"when":"' || case when p_partkey % 3 = 0 then '2024-01-02' else '2024-01-02T03:04:05Z' end || '","dims":[{"w":' || p_size::varchar || '},{"w":"' || p_size::varchar || '","h.x":1},7]' || case when p_partkey % 11 = 0 then ',"more":{"w":1}' else '' end || '}'"""
PART_SCHEMA = {
    "type": "object", "required": ["id.part", "tags", "more"], "additionalProperties": False,
    "properties": {
        "id.part": {"type": "integer", "minimum": 3}, "tags": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 4}}, "when": {"type": "string", "format": "date-time"},
        "dims": {"type": "array", "minItems": 3, "items": {"type": "object", "required": ["w"], "properties": {"w": {"type": "integer", "maximum": 40}}, "additionalProperties": False}},
    },
}


@q("o112_nested_violations", rf"""with docs as (select p_partkey, ({_DOCUMENT})::json as j from part),
tags as (select p_partkey, unnest(range(json_array_length(j, '$.tags')::int)) as k, unnest(from_json(json_extract(j, '$.tags'), '["json"]')) as x from docs),
dims as (select p_partkey, unnest(range(json_array_length(j, '$.dims')::int)) as k, unnest(from_json(json_extract(j, '$.dims'), '["json"]')) as x from docs),
names as (select p_partkey, unnest(json_keys(j)) as name from docs), inner_names as (select p_partkey, k, x, unnest(json_keys(x)) as name from dims where json_type(x) = 'OBJECT')
select p_partkey, '$.id.part' as path, 'type' as rule from docs where json_type(j, '$."id.part"') not in ('BIGINT', 'UBIGINT', 'INTEGER')
union all select p_partkey, '$.id.part', 'minimum' from docs where try_cast(json_extract_string(j, '$."id.part"') as bigint) < 3
union all select p_partkey, '$.' || r, 'required' from docs, (values ('id.part'), ('tags'), ('more')) t(r) where not list_contains(json_keys(j), r)
union all select p_partkey, '$.' || name, 'additionalProperties' from names where name not in ('id.part', 'tags', 'when', 'dims')
union all select p_partkey, '$.tags', 'minItems' from docs where json_array_length(j, '$.tags') < 1
union all select p_partkey, '$.tags[' || k || ']', 'minLength' from tags where length(json_extract_string(x, '$')) < 4
union all select p_partkey, '$.when', 'format' from docs where not regexp_full_match(json_extract_string(j, '$.when'), '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?(?:Z|[+-]\d{{2}}:\d{{2}})')
union all select p_partkey, '$.dims[' || k || ']', 'type' from dims where json_type(x) <> 'OBJECT'
union all select p_partkey, '$.dims[' || k || '].w', 'required' from dims where json_type(x) = 'OBJECT' and not list_contains(json_keys(x), 'w')
union all select p_partkey, '$.dims[' || k || '].' || name, 'additionalProperties' from inner_names where name <> 'w'
union all select p_partkey, '$.dims[' || k || '].w', case when json_type(x, '$.w') not in ('BIGINT', 'UBIGINT', 'INTEGER') then 'type' else 'maximum' end from inner_names where name = 'w' and (json_type(x, '$.w') not in ('BIGINT', 'UBIGINT', 'INTEGER') or try_cast(json_extract_string(x, '$.w') as bigint) > 40)""")
def o112_nested(spark, d):
    """Arrays, objects within them, a time and names with dots."""
    p = table(spark, d, "part").select("p_partkey", F.parse_json(F.expr(_DOCUMENT.replace("::varchar", "::string"))).alias("v"))
    return schema_violations(p, "p_partkey", "v", PART_SCHEMA)


_REFERENCES = """refs as (select p_partkey, k, case when p_partkey % 17 = 0 then 'gone-' || p_partkey else 'part-' || p_partkey end as artifact, case k when 0 then 'tags[0]' when 1 then 'dims[1].w' when 2 then case when p_partkey % 2 = 0 then 'when' else 'when.x' end when 3 then 'dims' else 'a..b' end as locator,
    case k when 0 then p_brand when 1 then p_size::varchar when 2 then case when p_partkey % 4 = 0 then '' else '2024-01' end when 3 then case when p_partkey % 3 = 0 then '"w":' else 'made up' end else 'x' end as quote from part, unnest(range(5)) as t(k))"""


@q("o061_evidence_paths", rf"""with arts as (select 'part-' || p_partkey as artifact, ({_DOCUMENT})::json as j from part where p_partkey % 19 <> 0), {_REFERENCES},
met as (select p_partkey, k, locator, quote, arts.artifact is not null as known, regexp_full_match(locator, '{C.LOCATOR}') as fits, case when regexp_full_match(locator, '{C.LOCATOR}') then json_extract_string(j, '$.' || locator) end as value from refs left join arts using (artifact))
select p_partkey, k, case when not known then 'artifact_missing' when not fits then 'locator_grammar' when value is null then 'locator_unresolved' when quote = '' then 'quote_missing' when not contains(value, quote) then 'quote_not_found' else 'ok' end as outcome from met""")
def o061_paths(spark, d):
    """References to places within JSON documents of parts, joined to an index of their paths."""
    p = table(spark, d, "part")
    artifacts = p.where("p_partkey % 19 != 0").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("artifact"), F.expr(_DOCUMENT.replace("::varchar", "::string")).alias("body"))
    k, i, three = F.col("k"), F.col("p_partkey"), F.col("p_partkey") % 3 == 0
    artifact = F.concat(F.when(i % 17 == 0, "gone-").otherwise("part-"), i.cast("string"))
    locator = F.when(k == 0, "tags[0]").when(k == 1, "dims[1].w").when(k == 2, F.when(i % 2 == 0, "when").otherwise("when.x")).when(k == 3, "dims").otherwise("a..b")
    quote = F.when(k == 0, F.col("p_brand")).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.when(i % 4 == 0, "").otherwise("2024-01")).when(k == 3, F.when(three, '"w":').otherwise("made up")).otherwise("x")
    refs = p.select("p_partkey", "p_brand", "p_size", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("p_partkey", "k", artifact.alias("artifact"), locator.alias("locator"), quote.alias("quote"))
    return resolved(refs, artifacts).select("p_partkey", F.col("k").cast("long").alias("k"), "outcome")


@q("o103_signal_dedup", "with r as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) select user_id, event_type, event_id from r where k = 1")
def o103(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_RUBRICS = [("ECOMMERCE", "What does it cost?"), ("GENERIC", "What is it?"), ("SAAS", "Is there a trial?")]


@q("o06a_rubric_join", "with r(category, question) as (values ('ECOMMERCE', 'What does it cost?'), ('GENERIC', 'What is it?'), ('SAAS', 'Is there a trial?')), s as (select distinct source as site, case when length(source) = 4 then 'ECOMMERCE' else 'UNLISTED' end as category from documents) select site, coalesce(r.question, g.question) as question from s left join r using (category) cross join (select question from r where category = 'GENERIC') g")
def o06a(spark, d):
    """A site's category, or the generic one where it has no rubric (O-004: a literal table)."""
    r = spark.createDataFrame(_RUBRICS, "category string, question string")
    s = table(spark, d, "documents").select(F.col("source").alias("site")).distinct().withColumn("category", F.when(F.length("site") == 4, "ECOMMERCE").otherwise("UNLISTED"))
    generic = r.where("category = 'GENERIC'").select(F.lit(True).alias("any"), F.col("question").alias("generic"))
    out = s.join(F.broadcast(r), "category", "left").withColumn("any", F.lit(True)).join(F.broadcast(generic), "any")
    return out.select("site", F.coalesce("question", "generic").alias("question"))


@q("extra_rollup", f"with {_FINDINGS} select coalesce(d.source, 'all') as site, coalesce(severity, 'all') as severity, count(*) as findings from findings join documents d using (doc_id) group by rollup (d.source, severity)")
def rollup(spark, d):
    f = findings(spark, d, "source")
    return f.rollup("source", "severity").agg(F.count("*").alias("findings")).select(F.coalesce("source", F.lit("all")).alias("site"), F.coalesce("severity", F.lit("all")).alias("severity"), "findings")


@q("extra_cube", f"with {_FINDINGS} select coalesce(cause, 'all') as cause, coalesce(severity, 'all') as severity, count(*) as findings from findings group by cube (cause, severity)")
def cube(spark, d):
    return findings(spark, d).cube("cause", "severity").agg(F.count("*").alias("findings")).select(F.coalesce("cause", F.lit("all")).alias("cause"), F.coalesce("severity", F.lit("all")).alias("severity"), "findings")


@q("extra_approx_distinct")
def approx(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


QUERIES, SQL = area.queries, area.sql
