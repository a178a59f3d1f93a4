"""JSON values against a schema, level by level.

A Draft-07 subset is compiled to states, one for each place of the schema; a
property name or an array step leads from a state to the next.  All values of
a level are checked in one pass and taken apart by ``variant_explode`` for the
next, so there are as many passes as the schema is deep, and a value of any
width is as many rows.  Names may have dots and brackets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FORMS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "boolean": "^BOOLEAN", "integer": "^BIGINT", "number": "^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)", "null": "^VOID"}
_MOMENT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})$"


@dataclass
class State:
    """One place of a schema: what holds there, and where names and array steps lead."""

    number: int
    level: int
    schema: dict
    names: dict[str, int] = field(default_factory=dict)
    items: int | None = None

    @property
    def closed(self) -> bool:
        return self.schema.get("additionalProperties") is False


def compiled(schema: dict) -> list[State]:
    """The states of a schema, the root first."""
    states: list[State] = []

    def add(s: dict, level: int) -> int:
        state = State(len(states), level, s)
        states.append(state)
        for name, inner in s.get("properties", {}).items():
            state.names[name] = add(inner, level + 1)
        if "items" in s:
            state.items = add(s["items"], level + 1)
        return state.number

    add(schema, 0)
    return states


def _fits(state: State, form: Column) -> Column:
    kind = state.schema.get("type")
    out = F.lit(kind is None)
    for k in [kind] if isinstance(kind, str) else kind or ():
        out = out | form.rlike(_FORMS[k])
    return out


def _has(value: Column, name: str) -> Column:
    quoted = name.replace("'", "\\'")
    return F.try_variant_get(value, f"$['{quoted}']", "variant").isNotNull()


def _breaches(state: State, value: Column, path: Column) -> Column:
    """(path, rule) of what a value of the right type breaks at this place itself."""
    s, form = state.schema, F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text, is_number = form.startswith("STRING"), form.rlike(_FORMS["number"])
    found = []

    def when(condition: Column, rule: str, at: Column = path) -> None:
        found.append(F.when(F.coalesce(condition, F.lit(False)), F.struct(at.alias("path"), F.lit(rule).alias("rule"))))

    if "enum" in s:
        when(~text.isin([str(x) for x in s["enum"]]), "enum")
    for rule, broken in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x)):
        if rule in s:
            when(is_number & broken(s[rule]), rule)
    for rule, broken in (("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x), ("pattern", lambda x: ~text.rlike(x))):
        if rule in s:
            when(is_text & broken(s[rule]), rule)
    if s.get("format") == "date-time":
        # the date and the time must exist; seconds may be left out
        moment = F.regexp_replace(F.regexp_replace(text, r"[ T](\d{2}:\d{2})(?=[Z+-])", "T$1:00"), "Z$", "+00:00")
        when(is_text & (~text.rlike(_MOMENT) | F.try_to_timestamp(moment).isNull()), "format")
    if "minItems" in s:
        # the last item that has to be there is absent
        when(form.startswith("ARRAY") & F.try_variant_get(value, f"$[{s['minItems'] - 1}]", "variant").isNull() & F.lit(s["minItems"] > 0), "minItems")
    for name in s.get("required", ()):
        when(form.startswith("OBJECT") & ~_has(value, name), "required", F.concat(path, F.lit(f".{name}")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<path:string,rule:string>>")


def schema_violations(df: DataFrame, key: str, value: str, schema: dict) -> DataFrame:
    """``key``, path, rule: every breach of the schema by the rows' variants.

    Knows type, enum, minimum, maximum, minLength, maxLength, pattern, format date-time, minItems, items, required,
    properties and additionalProperties: false.  A value of a wrong type is not looked into; null variants of the table
    (not JSON null) give nothing.
    """
    spark, states = df.sparkSession, compiled(schema)
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_v"), F.lit("$").alias("_path"), F.lit(0).alias("_state"))
    out = []
    for level in range(max(s.level for s in states) + 1):
        here = [s for s in states if s.level == level]
        form, at = F.schema_of_variant("_v"), F.col("_path")
        fits, breaches = F.lit(True), F.array().cast("array<struct<path:string,rule:string>>")
        for s in here:
            mine = F.col("_state") == s.number
            fits = F.when(mine, _fits(s, form)).otherwise(fits)
            breaches = F.when(mine, _breaches(s, F.col("_v"), at)).otherwise(breaches)
        wrong = F.array(F.struct(at.alias("path"), F.lit("type").alias("rule")))
        checked = rows.withColumn("_fits", fits)
        out.append(checked.select("_key", F.explode(F.when(F.col("_fits"), breaches).otherwise(wrong)).alias("_x")).select("_key", "_x.path", "_x.rule"))
        deeper = [s for s in here if s.names or s.closed or s.items is not None]
        if not deeper:
            break
        parts = checked.where(F.col("_fits") & F.col("_state").isin([s.number for s in deeper])).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(at, F.lit("."), "key")).otherwise(F.concat(at, F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        following, closed = F.lit(None).cast("int"), F.lit(False)
        for s in deeper:
            mine = F.col("_state") == s.number
            named = F.lit(None).cast("int")
            for name, number in s.names.items():
                named = F.when(F.col("key") == name, number).otherwise(named)
            following = F.when(mine, F.when(F.col("key").isNull(), F.lit(s.items).cast("int")).otherwise(named)).otherwise(following)
            closed = F.when(mine, F.lit(s.closed)).otherwise(closed)
        parts = parts.select("_key", F.col("value").alias("_v"), step.alias("_path"), following.alias("_state"), (closed & F.col("key").isNotNull()).alias("_closed"))
        out.append(parts.where("_closed and _state is null").select("_key", F.col("_path").alias("path"), F.lit("additionalProperties").alias("rule")))
        rows = parts.where("_state is not null").drop("_closed")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.withColumnRenamed("_key", key)
