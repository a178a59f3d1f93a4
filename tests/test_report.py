import json

from crawlight.plans import catalogue as C
from crawlight.plans import report as P
from crawlight.queries import report as R
from crawlight.sources.tables import inventory_pages, read_findings, read_inventory
from crawlight.streaming import events as E
from tests.conftest import DATA


def test_catalogue():
    ids = [c for c, _, _ in C.checks()]
    assert len(ids) == 134 == len(set(ids))
    assert set(C.CAUSES.values()) <= set(ids)


def candidate(**more):
    return {"site": "s", "scope": "p", "cause": "X", "severity": "high", "check_id": "A1", "band": "S3", "kind": "confirmed_problem", "queue": "confirmed", "difficulty": 1, "artifact": "a", "locator": "text", "quote": "found", "complete": True} | more


def test_gate_and_merge(spark):
    rows = [candidate(), candidate(check_id="A2", band="S4"), candidate(quote="invented"), candidate(check_id="ZZ"), candidate(artifact="none"), candidate(complete=False), candidate(locator="1 x"), candidate(scope="")]
    gate = P.gated(spark.createDataFrame(rows), spark.createDataFrame([("a", "found it")], "artifact string, text string"), C.catalogue(spark))
    reasons = sorted(r.drop_reason or "kept" for r in gate.collect())
    assert reasons == sorted(["kept", "kept", "quote_not_found", "unknown_check", "artifact_missing", "incomplete_scope", "locator_grammar", "scope_or_reason_missing"])
    out = P.ranked(P.merged(gate.where("drop_reason is null"))).collect()
    assert len(out) == 1 and out[0].check_ids == ["A1", "A2"] and out[0].band == "S4" and out[0].finding_id == "F-001" and out[0].priority_index == 25


def test_topological_order_and_cycle(spark):
    rows = [("s", "a", ["b"], "confirmed", "S4", 1), ("s", "b", [], "confirmed", "S1", 1), ("s", "c", [], "confirmed", "S2", 1), ("t", "x", ["y"], "confirmed", "S1", 1), ("t", "y", ["x"], "confirmed", "S1", 1)]
    got = {(r.site, r.id): r.place for r in P.topological(spark.createDataFrame(rows, "site string, id string, depends_on array<string>, queue string, band string, difficulty int")).collect()}
    assert got[("s", "c")] == 1 and got[("s", "b")] == 2 and got[("s", "a")] == 3
    assert got[("t", "x")] is None


def test_topological_order_places_every_part(spark):
    parts = R.table(spark, str(DATA), "part").select("p_partkey", "p_brand").toPandas()
    rows = R.o093(spark, str(DATA)).toPandas()
    assert sorted(rows["id"].astype(int)) == sorted(parts["p_partkey"])
    brand = dict(zip(parts["p_partkey"].astype(str), parts["p_brand"], strict=True))
    place = dict(zip(rows["id"], rows["place"], strict=True))
    for site, places in rows.groupby("site")["place"]:
        assert sorted(places) == list(range(1, len(places) + 1)), site
    pairs = [(k, str(int(k) - 10)) for k in place if brand.get(str(int(k) - 10)) == brand[k]]
    assert pairs and all(place[a] > place[b] for a, b in pairs)


def test_domain_scores(spark):
    rows = [("s", "f1", "critical", ["A1", "A2"]), ("s", "f2", "low", ["E1"]), ("s", "f3", "medium", ["?"])]
    got = {r.domain: r.score for r in P.domain_scores(spark.createDataFrame(rows, "site string, finding string, severity string, check_ids array<string>"), C.catalogue(spark)).collect()}
    assert got["discoverability"] == 45 and got["entity_content"] == 95 and got["geo_citability"] == 100


def test_domain_scores_take_every_finding(spark):
    found = R.findings(spark, str(DATA)).toPandas().merge(R.table(spark, str(DATA), "documents").select("doc_id", "source").toPandas(), on="doc_id")
    domain = {r.check_id: r.domain for r in C.catalogue(spark).collect()}
    want: dict = {}
    for r in found.drop_duplicates().itertuples():
        key = (r.source, domain.get(C.CAUSES.get(r.cause), "discoverability"))
        lost, n = want.get(key, (0, 0))
        want[key] = lost + C.DEDUCTIONS[r.severity], n + 1
    got = {(r.site, r.domain): (r.score, r.findings) for r in R.o083(spark, str(DATA)).collect()}
    assert got == {(s, k): (max(0, 100 - want.get((s, k), (0, 0))[0]), want.get((s, k), (0, 0))[1]) for s in set(found["source"]) for k in C.WEIGHTS}
    assert {r.site for r in R.o08c(spark, str(DATA)).collect()} == set(found["source"])


def test_schema_violations():
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0}, "d": {"type": "string", "format": "date-time"}, "c": {"type": ["string", "null"]}}, "additionalProperties": False}
    assert list(P.violations({"n": 1, "d": "2024-01-01T00:00:00Z", "c": None}, schema)) == []
    assert set(P.violations({"n": -1, "d": "yesterday", "x": 1}, schema)) == {("$.n", "minimum"), ("$.d", "format"), ("$.x", "additionalProperties")}
    assert list(P.violations({"n": True}, schema)) == [("$.n", "type")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "inv.json").write_text(json.dumps({"site": "s", "pages": [{"url": "https://s/", "status": 200, "html": "<p>x"}, {"url": "https://s/a"}], "robots_txt": "User-agent: *"}))
    (tmp_path / "bad.json").write_text("{nope")
    assert inventory_pages(read_inventory(spark, str(tmp_path / "inv.json"))).count() == 2
    assert read_inventory(spark, str(tmp_path / "bad.json")).where("site is not null").count() == 0
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text(json.dumps({"status": "ok", "findings": [{"id": "X", "severity": "low", "related_check_ids": ["A1"]}]}))
    (tmp_path / "s/b.json").write_text(json.dumps({"block": {"findings": [{"id": "Y"}]}}))
    found = read_findings(spark, f"{tmp_path}/s/*.json")
    assert {(r.block, r.id) for r in found.collect()} == {(None, "X"), ("block", "Y")}
    found.write.json(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_streams_end_as_batches(spark, tmp_path):
    if not DATA.exists():
        return
    source = spark.read.parquet(f"{DATA}/events.parquet")
    source.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, f in (("error", E.error_rate), ("slide", lambda e: E.error_rate(e, "6 hours", "1 hour")), ("visits", E.sessions)):
        q = f(E.stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        batch = f(source.withColumn("ts", source["ts"].cast("timestamp")))
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))
    q = E.price_alerts(E.stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("alerts").count() > 0
    q = E.first_seen(E.stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("first").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first").count() >= source.dropDuplicates(["user_id", "event_type"]).count()


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "state")
    E.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0, path, ["k"])
    E.upsert(spark.createDataFrame([("a", 2)], "k string, v int"), 1, path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{path}/batch=1").collect()) == [("a", 2), ("b", 1)]


def test_topological_order_grows_with_the_tasks(spark):
    """One site of many tasks in a chain: the time is near their number, not its square."""
    import time

    n = 30000
    rows = spark.range(n).selectExpr("'s' as site", "cast(id as string) as id", "array(cast(id + 1 as string)) as depends_on", "'confirmed' as queue", "'S1' as band", "1 as difficulty")
    start = time.monotonic()
    got = {int(r.id): r.place for r in P.topological(rows).collect()}
    assert got == {k: n - k for k in range(n)} and time.monotonic() - start < 30
