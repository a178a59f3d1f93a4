"""Candidates, evidence gate, merge, ranking, scores, report.

Everything is keyed by site, so any number of sites is assembled in one plan.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlight.operators.ranks import placed
from crawlight.plans import catalogue as C


def case(column: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(column == k, v).otherwise(out)
    return out


def grounded_quote(text: Column, preferred: list[Column]) -> Column:
    """The first preferred text that occurs, else the first word over four characters, else the start."""
    given = F.filter(F.array(*preferred), lambda p: (F.length(p) >= 3) & F.contains(text, p)) if preferred else F.array().cast("array<string>")
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 4)
    return F.coalesce(F.try_element_at(given, F.lit(1)), F.try_element_at(words, F.lit(1)), F.left(text, F.lit(20)))


def candidates(findings: DataFrame) -> DataFrame:
    """Adds check_id, band, kind, queue and difficulty to (site, scope, cause, severity, ...) rows."""
    band = case(F.col("severity"), C.BANDS, "S1")
    kind = F.when(F.col("severity").isin("critical", "high"), "confirmed_problem").otherwise("advisory")
    return findings.withColumns({"check_id": case(F.col("cause"), C.CAUSES), "band": band, "kind": kind, "queue": F.when(kind == "confirmed_problem", "confirmed").otherwise("advisory"), "difficulty": F.lit(2)})


def gated(c: DataFrame, artifacts: DataFrame | None, checks: DataFrame) -> DataFrame:
    """The candidates with drop_reason, null if they may stay; ``checks`` is small.

    Artifacts join by key; without them candidates bring ``held``: whether the quote is in its artifact, null if that is missing.
    """
    known = F.broadcast(checks.select("check_id", "domain", "owner"))
    if artifacts is not None:
        texts = artifacts.select("artifact", F.col("text").alias("artifact_text"))
        c = c.join(texts, "artifact", "left").withColumn("held", F.contains("artifact_text", F.coalesce(F.col("quote"), F.lit("")))).drop("artifact_text")
    out = c.join(known, "check_id", "left")
    band, confirmed = F.col("band"), F.col("kind") == "confirmed_problem"
    reason = (
        F.when(F.col("owner").isNull(), "unknown_check").when(~band.isin("S4", "S3", "S2", "S1", "S0", "U"), "invalid_band").when(~F.col("kind").isin(*C.KINDS), "unknown_kind")
        .when(confirmed & band.isin("S0", "U"), "unassessable").when(F.col("held").isNull(), "artifact_missing").when(F.coalesce(F.col("quote"), F.lit("")) == "", "quote_missing")
        .when(~F.col("locator").rlike(f"^(?:{C.LOCATOR})$"), "locator_grammar").when(~F.col("held"), "quote_not_found")
        .when(confirmed & ~F.col("complete"), "incomplete_scope").when((F.coalesce(F.col("scope"), F.lit("")) == "") | F.col("severity").isNull(), "scope_or_reason_missing")
    )
    return out.withColumn("drop_reason", reason).drop("held")


def merged(kept: DataFrame) -> DataFrame:
    """One row per site, scope, kind and cause: united checks and artifacts, the highest band."""
    return kept.groupBy("site", "scope", "kind", F.coalesce("cause", "check_id").alias("cause")).agg(
        F.array_sort(F.collect_set("check_id")).alias("check_ids"), F.count_distinct("artifact").alias("artifacts"), F.max("band").alias("band"), F.min("queue").alias("queue"), F.min("difficulty").alias("difficulty")
    )


def priority(band: Column, difficulty: Column) -> Column:
    return 5 * F.substring(band, 2, 1).try_cast("int") + (6 - difficulty)


def ranked(m: DataFrame) -> DataFrame:
    """Findings of each site in order of queue, severity, difficulty, spread and name, with ids; a site may have any number."""
    order = [case(F.col("queue"), C.QUEUES, 0), -F.coalesce(F.substring("band", 2, 1).try_cast("int"), F.lit(9)), F.col("difficulty"), -F.col("artifacts"), F.col("cause"), F.col("scope")]
    out = placed(m, "site", order).withColumn("priority_index", priority(F.col("band"), F.col("difficulty")))
    return out.withColumn("finding_id", F.format_string("F-%03d", "place"))


def evidence_fault(artifact: Column, locator: Column, quote: Column) -> Column:
    """Why a quote is no evidence, null if it is: grammar, resolution of a.b[2].c in the artifact's JSON, containment.

    What a locator selects is text as it stands or else JSON; the quote may be in it as it is or JSON-escaped,
    and canonicals may be quoted one by one, split by " | ".
    """
    response = locator.isin("response body", "response")
    path = F.when(response, "$.text").when(locator.rlike(f"^(?:{C.LOCATOR})$"), F.concat(F.lit("$."), locator))
    selected = F.call_function("get_json_object", artifact, path)
    escaped = F.to_json(F.struct(quote.alias("q")))
    escaped = escaped.substr(F.lit(7), F.length(escaped) - 8)  # without {"q":" and "}
    parts = F.split(quote, r" \| ")
    found = F.contains(selected, quote) | F.contains(selected, escaped) | ((locator == "source.canonicals") & F.forall(parts, lambda x: F.contains(selected, x)))
    return F.when(F.coalesce(quote, F.lit("")) == "", "quote_missing").when(path.isNull(), "locator_grammar").when(selected.isNull(), "locator_unresolved").when(~found, "quote_not_found")


def fallback_domain(identity: Column, category: Column) -> Column:
    """Where a finding counts whose checks are unknown."""
    rendering = identity.contains("STATIC_HTML") | identity.contains("CITATION_READABILITY") | (category == "rendering")
    entity = identity.contains("ENTITY") | category.isin("entity-identity", "product-answerability")
    return F.when(F.coalesce(rendering, F.lit(False)), "discoverability").when(F.coalesce(entity, F.lit(False)), "entity_content").otherwise("discoverability")


def domain_scores(findings: DataFrame, checks: DataFrame, archetype: str | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """site, domain, score, grade: 100 less the deductions of findings whose checks fall into the domain.

    Findings may have ``id`` and ``category``, which place those of unknown checks.  ``coverage`` (site, rate)
    takes two fifths of a static rate's shortfall from discoverability where it is below 90.
    """
    placed = {c: (F.col(c) if c in findings.columns else F.lit("")) for c in ("id", "category")}
    hit = findings.select("site", "finding", "severity", fallback_domain(placed["id"], placed["category"]).alias("fallback"), F.explode("check_ids").alias("check_id")).join(F.broadcast(checks.select("check_id", "domain")), "check_id", "left")
    # a finding is one row whatever its checks: no finding is larger than its list
    domains = hit.groupBy("site", "finding", "severity", "fallback").agg(F.collect_set("domain").alias("domains"))
    each = domains.select("site", "finding", "severity", F.explode(F.when(F.size("domains") > 0, F.col("domains")).otherwise(F.array("fallback"))).alias("domain"))
    lost = each.groupBy("site", "domain").agg(F.sum(case(F.col("severity"), C.DEDUCTIONS, 5)).alias("lost"), F.count("*").alias("findings"))
    weights = {k: C.ARCHETYPE_WEIGHTS.get(archetype or "", {}).get(k, w) for k, w in C.WEIGHTS.items()}
    sites = findings.select("site") if coverage is None else findings.select("site").unionByName(coverage.select("site"))
    every = sites.distinct().join(F.broadcast(findings.sparkSession.createDataFrame(list(weights.items()), "domain string, weight double")))
    out = every.join(lost, ["site", "domain"], "left")
    score = F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0)))
    if coverage is not None:
        out = out.join(coverage.select("site", "rate"), "site", "left")
        penalty = F.when((F.col("domain") == "discoverability") & (F.col("rate") < 90), F.floor((100 - F.col("rate")) * 0.4)).otherwise(0)
        score = F.greatest(F.lit(0), score - penalty)
    out = out.select("site", "domain", "weight", score.cast("int").alias("score"), F.coalesce("findings", F.lit(0)).alias("findings"))
    return out.withColumn("grade", step(F.col("score"), C.GRADES))


def step(value: Column, table: list[tuple[int, str]]) -> Column:
    out = F.lit(table[-1][1])
    for least, name in reversed(table):
        out = F.when(value >= least, name).otherwise(out)
    return out


def composite(scores: DataFrame) -> DataFrame:
    index = F.bround(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 0).cast("int")
    return scores.groupBy("site").agg(index.alias("readiness_index")).withColumn("tier", step(F.col("readiness_index"), C.TIERS)).withColumn("grade", step(F.col("readiness_index"), C.GRADES))


def topological(tasks: DataFrame) -> DataFrame:
    """site, id, place: the least ready task by (queue, band, difficulty, id) comes next; place is null on a cycle.

    A site's tasks are its merged findings, at most a few per check.
    """

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        import heapq

        known = set(rows["id"])
        needs = {r.id: known.intersection(r.depends_on) for r in rows.itertuples()}
        key = {r.id: (C.QUEUES.get(r.queue, 0), -int(r.band[1:]), r.difficulty, r.id) for r in rows.itertuples()}
        after: dict[str, list[str]] = {}
        for task, deps in needs.items():
            for dep in deps:
                after.setdefault(dep, []).append(task)
        ready = [key[t] for t, deps in needs.items() if not deps]
        heapq.heapify(ready)
        place: dict[str, int] = {}
        while ready:
            task = heapq.heappop(ready)[3]
            place[task] = len(place) + 1
            for later in after.get(task, ()):
                needs[later].discard(task)
                if not needs[later]:
                    heapq.heappush(ready, key[later])
        return pd.DataFrame({"site": rows["site"], "id": rows["id"], "place": [place.get(t) for t in rows["id"]]})

    return tasks.groupBy("site").applyInPandas(order, "site string, id string, place int")


def violation_array(value: Column, schema: dict, path: str = "$") -> Column:
    """(path, rule) of each breach of a fixed schema by a variant, as one array: type, required, properties, enum, minimum, maximum, lengths, pattern, additionalProperties."""
    kinds = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "null": "VOID"}
    breach = lambda where, rule: F.struct(where.alias("path"), F.lit(rule).alias("rule"))
    none = F.array().cast("array<struct<path:string,rule:string>>")
    when = lambda condition, rule: F.when(F.coalesce(condition, F.lit(False)), F.array(breach(F.lit(path), rule))).otherwise(none)
    form = F.schema_of_variant(value)
    out = []
    kind = schema.get("type")
    if kind is None:
        fits = F.lit(True)
    else:
        names = [kind] if isinstance(kind, str) else kind
        fits = F.lit(False)
        for k in names:
            fits = fits | (form.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)") if k == "number" else form.startswith(kinds[k]))
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    if "enum" in schema:
        out.append(when(~text.isin([str(x) for x in schema["enum"]]), "enum"))
    if "minimum" in schema:
        out.append(when(number < schema["minimum"], "minimum"))
    if "maximum" in schema:
        out.append(when(number > schema["maximum"], "maximum"))
    if "minLength" in schema:
        out.append(when(F.length(text) < schema["minLength"], "minLength"))
    if "maxLength" in schema:
        out.append(when(F.length(text) > schema["maxLength"], "maxLength"))
    if "pattern" in schema:
        out.append(when(~text.rlike(schema["pattern"]), "pattern"))
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    where = lambda k: F.concat(F.lit(f"{path}."), k)
    if "required" in schema:
        out.append(F.transform(F.filter(F.array(*map(F.lit, schema["required"])), lambda k: ~F.array_contains(keys, k)), lambda k: breach(where(k), "required")))
    if schema.get("additionalProperties") is False:
        known = list(schema.get("properties", {}))
        out.append(F.transform(F.filter(keys, lambda k: ~k.isin(known)), lambda k: breach(where(k), "additionalProperties")))
    for name, inner in schema.get("properties", {}).items():
        child = F.try_variant_get(value, f"$.{name}", "variant")
        out.append(F.when(F.array_contains(keys, name), violation_array(child, inner, f"{path}.{name}")).otherwise(none))
    return F.when(fits, F.concat(none, *out)).otherwise(F.array(breach(F.lit(path), "type")))


def violations(value, schema: dict, path: str = "$") -> Iterable[tuple[str, str]]:
    """(path, rule) of a Draft-07 subset: type, required, properties, items, enum, minimum, maximum, lengths, additionalProperties, format, pattern."""
    import re
    from datetime import datetime

    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def fits(kind: str) -> bool:
        if kind in ("integer", "number"):
            return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
        return isinstance(value, kinds[kind])

    kind = schema.get("type")
    if kind is not None and not any(map(fits, [kind] if isinstance(kind, str) else kind)):
        yield path, "type"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield path, "enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from ((f"{path}.{k}", "required") for k in schema.get("required", ()) if k not in value)
        for k, v in value.items():
            if k in known:
                yield from violations(v, known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{path}.{k}", "additionalProperties"
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield path, "minItems"
        for k, v in enumerate(value):
            yield from violations(v, schema.get("items", {}), f"{path}[{k}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            yield path, "minLength"
        if len(value) > schema.get("maxLength", len(value)):
            yield path, "maxLength"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield path, "pattern"
        if schema.get("format") == "date-time":
            try:
                if datetime.fromisoformat(value.replace("Z", "+00:00")).tzinfo is None:
                    yield path, "format"
            except ValueError:
                yield path, "format"
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            yield path, "minimum"
        if value > schema.get("maximum", value):
            yield path, "maximum"
