"""Tables, policies, budgets, sync of two simulated CRMs, erasure, the command line, and life without the subpackage llm."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from entityflow import cli, testing
from entityflow.operators import budget, clusters, enrich, resolve, store, sync
from entityflow.plans.pipeline import MatchPolicy, Pipeline
from entityflow.sources import crm, policies
from entityflow.sources.database import Database, from_iso, iso

T = testing.EPOCH_US
ROOT = Path(__file__).parent.parent


def rows_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_tables_are_appended_upserted_and_queried(spark):
    db = Database(spark)
    assert db.table("claims").count() == 0 and db.scalar("select count(*) from {claims}") == 0
    db.append("claims", rows_of(spark, [("a", 1), ("b", 2)], "key string, claimed_us bigint"))
    db.upsert("claims", rows_of(spark, [("b", 5), ("c", 6)], "key string, claimed_us bigint"), ["key"])
    assert {r.key: r.claimed_us for r in db.query("select * from {claims}").collect()} == {"a": 1, "b": 5, "c": 6}
    assert db.update("claims", F.col("key") == "a", {"claimed_us": F.lit(9)}) == 1 and db.one("select max(claimed_us) as m from {claims}").m == 9
    assert db.delete("claims", F.col("claimed_us") > 5) == 2 and db.table("claims").count() == 1
    at = spark.range(1).select(iso(F.lit(T)).alias("t")).select("t", from_iso(F.col("t")).alias("u")).first()
    assert (at.t, at.u) == ("2026-01-01T00:00:00.000000+00:00", T)


def test_policy_file():
    p = policies.PolicySet.load(policies.find_policy_path())
    assert p.validate() == [] and p.for_field("email").strategy == "source_priority" and p.for_field("unknown").strategy == "human_wins"
    assert p.synced_fields("hubspot") == ["email", "first_name", "job_title", "last_name", "phone"]
    assert p.ttl_map()["job_title"] == 90 and p.ttl_map("company")["founded_year"] is None and "notes" in p.fields()
    lifecycle = p.for_field("lifecycle_stage")
    assert lifecycle.writes_to("salesforce") and not lifecycle.writes_to("hubspot")
    assert [lifecycle.accepts_from(*x) for x in (("hubspot",), ("salesforce",), ("salesforce", "user"), ("enrichment",))] == [True, False, True, True]


def test_policies_with_problems():
    bad = policies.PolicySet.from_mapping({"objects": {"contact": {"fields": {
        "a": {"direction": "bidirectional", "strategy": "most_recent"}, "b": {"strategy": "source_priority"}, "c": {"master": "x", "source_ranking": ["y"]}, "d": None}}}})
    assert [p.split(":")[0] for p in bad.validate()] == ["contact.a", "contact.b", "contact.c"]
    with pytest.raises(ValueError, match="unknown strategy"):
        policies.FieldPolicy("x", strategy="coin")


def test_clocks_of_two_sources_are_not_compared(spark):
    obs = testing.seed_observations(spark, [(1, "e", "f", "old", "salesforce", "crm", 0.5, 0, None), (2, "e", "f", "new", "hubspot", "crm", 0.9, 5, None)])
    one = resolve.resolve(obs, "most_recent").first()
    assert (one.value, one.needs_review) == ("old", True) and "ranking (salesforce)" in one.reason
    assert resolve.resolve(obs, "most_recent", ranking=()).first().value == "new"
    assert resolve.resolve(obs.filter("source = 'hubspot'"), "most_recent").first().needs_review is False
    unranked = resolve.resolve(obs, "source_priority", ranking=("other",)).first()
    assert (unranked.value, unranked.needs_review) == ("new", True)


def test_a_policy_change_is_replayable(spark):
    obs = testing.seed_observations(spark, [(1, "e", "f", "a", "salesforce", "crm", 0.2, 0, None), (2, "e", "f", "b", "hubspot", "crm", 0.9, 1, 30), (3, "e", "f", "c", "enrichment", "user", 0.1, 2, None)])
    values = {s: resolve.resolve(obs, s).first().value for s in policies.STRATEGIES}
    assert values == {"source_priority": "a", "most_recent": "a", "most_confident": "b", "human_wins": "c", "never_overwrite": "a", "manual": "c"}
    assert resolve.resolve(resolve.live(obs, T + 40 * resolve.DAY_US), "most_confident").first().value == "a"


def test_entities_merge_and_come_apart(spark):
    db = Database(spark)
    entities, observations = store.Entities(db), store.Observations(db)
    entities.create(rows_of(spark, [(x, "person") for x in "abc"], "id string, type string"), T)
    entities.create(rows_of(spark, [("a", "person")], "id string, type string"), T)
    entities.link(rows_of(spark, [("a", "s", "1"), ("b", "s", "2"), ("c", "s", "3")], "entity_id string, source string, source_record_id string"), T)
    made = [(x, "email", f"{x}@x", "s", "crm", str(i + 1), T, T) for i, x in enumerate("abc")]
    observations.append(rows_of(spark, made, "entity_id string, field string, value string, source string, kind string, source_record_id string, observed_us bigint, recorded_us bigint"))
    pair = lambda *p: rows_of(spark, list(p), "surviving_id string, merged_id string")
    entities.merge(pair(("a", "b")), T + 1)
    entities.merge(pair(("b", "c")), T + 2)  # b is a by now
    asked = rows_of(spark, [("s", "3"), ("s", "9")], "source string, source_record_id string")
    assert {r.source_record_id: r.entity_id for r in entities.entity_for_record(asked).collect()} == {"3": "a", "9": None}
    assert {r.id for r in entities.merged_into().collect()} == {"b", "c"} and entities.merges_for("c").count() == 1
    for circle in ([("c", "a")], [("a", "a")]):
        with pytest.raises(store.MergeCycle):
            entities.merge(pair(*circle), T + 3)
    assert entities.unmerge(rows_of(spark, [("c", "wrong")], "merged_id string, reason string"), T + 4) == 1
    assert {r.source_record_id: r.entity_id for r in entities.links_for().collect()} == {"1": "a", "2": "a", "3": "c"}
    assert entities.all_ids("person").count() == 3 and observations.count("b") == 1 and entities.get("a").count() == 1
    assert observations.entity_ids().count() == 3 and observations.by_source_record("s", "2").first().value == "b@x"
    assert {r.place: r.n for r in entities.search("a").collect()} == {"entities": 1, "entity_links": 2, "merges": 2}


def test_reviews_measure_and_label(spark):
    reviews = store.Reviews(Database(spark))
    assert reviews.promotion_report().first().verdict == "HOLD"
    reviews.enqueue_pairs(rows_of(spark, [("a", "b", 0.52), ("a", "c", 0.99), ("b", "c", 0.7)], "l string, r string, score double"), T)
    reviews.enqueue_clusters(rows_of(spark, [("x", "x", "TOO_LARGE"), ("x", "y", "TOO_LARGE")], "cluster string, node string, review string"), T)
    reviews.enqueue_deletes(rows_of(spark, [("crm", "7")], "source string, record_id string"), T)
    assert [r.kind for r in reviews.pending().collect()] == ["delete", "pair", "cluster", "pair", "pair"]
    assert reviews.pending(1, "cluster").first().payload == '["x","y"]' and reviews.depth() == 5
    first = reviews.pending(1, "pair").first()
    assert (first.left_key, first.right_key) == ("a", "b")
    reviews.decide(rows_of(spark, [(first.id, True, "me", "")], "item_id bigint, human_match boolean, reviewer string, note string"), T)
    reviews.defer(rows_of(spark, [(reviews.pending(1, "cluster").first().id,)], "item_id bigint"))
    assert [tuple(r) for r in reviews.labels().collect()] == [("a", "b", True)] and reviews.depth() == 3
    assert reviews.get(first.id).first().status == "decided" and reviews.decisions().count() == 1
    assert [tuple(r)[:3] for r in reviews.precision_by_band().collect()] == [("0.50-0.55", 1, 1.0)] and reviews.counts_by_band().first().n == 1
    assert "need 500" in reviews.promotion_report().first().reason
    with pytest.raises(KeyError):
        reviews.decide(rows_of(spark, [(-5, True, "me", "")], "item_id bigint, human_match boolean, reviewer string, note string"), T)


def test_deliveries_are_handled_once_and_end_as_dead_letters(spark):
    db = Database(spark)
    work = sync.Processor(db, max_attempts=3)
    events = rows_of(spark, [(1, "s", "r", "f", "v", T, "c1"), (2, "s", "r", "f", "v", T, "c1"), (3, "s", "q", "f", "bad", T, "c2")], "seq bigint, source string, record_id string, field string, value string, observed_us bigint, change_id string")
    run = lambda rows: rows.select("seq", F.when(F.col("value") == "bad", "broken").alias("error"))
    tries = [sorted((r.attempts, r.dead, r.backoff) for r in work.handle(events, run, T + i).collect()) for i in range(5)]
    assert tries == [[(1, False, 1.0)], [(2, False, 2.0)], [(3, True, 4.0)], [], []]
    dead = store.DeadLetters(db, alert_at=1)
    assert dead.depth() == 1 and dead.search("q").count() == 1 and work.seen("s:r:c1") and work.count() == 2
    assert dead.resolve(dead.entries().first().id, T) == 1 and dead.depth() == 0
    assert dead.send(rows_of(spark, [("k", "{}", "e", 9)], "key string, payload string, error string, attempts bigint"), T) and dead.delete_for_entity("nobody") == 0
    checkpoints = store.Checkpoints(db)
    checkpoints.set("x", "5")
    checkpoints.set("x", "6")
    assert checkpoints.get("x") == "6" and checkpoints.clear("x") == 1 and checkpoints.get("x") is None


def test_budgets():
    clock = testing.SimulatedClock()
    b = budget.ApiBudget("salesforce", 15_000, window_start_us=clock())
    manager = budget.BudgetManager([b], clock_us=clock)
    assert b.usable == 10_500 and b.available_for("BACKFILL") == 3674
    assert manager.reserve("salesforce", 3000, "BACKFILL") and not manager.reserve("salesforce", 1000, "BACKFILL")
    assert manager.grant("salesforce", 1000, "BACKFILL") == 674
    manager.observe_headers("salesforce", {"SFORCE-LIMIT-INFO": "api-usage=11000/15000"})
    assert manager.paused == {"salesforce"} and not manager.reserve("salesforce") and b.available == 0 and manager.snapshot()["salesforce"]["paused"]
    with pytest.raises(budget.BudgetExhausted):
        manager.spend_or_raise("salesforce")
    clock.advance(86_400)
    assert manager.reserve("salesforce", 1, "REALTIME") and "used by us" in manager.report("salesforce")
    assert budget.salesforce_daily_limit("Enterprise", 10) == 110_000 and budget.salesforce_daily_limit("developer", 0, 5) == 15_000
    assert budget.hubspot_daily_limit("professional") == 625_000 and budget.bulk_job_count(500_000) == 50
    assert budget.parse_headers("hubspot", {"x-hubspot-ratelimit-daily": "10", "X-HubSpot-RateLimit-Daily-Remaining": "4"}) == (6, 10)
    now = [0.0]
    bucket = budget.BurstLimiter.search(lambda: now[0])
    assert [bucket.try_acquire() for _ in range(6)] == [True] * 5 + [False] and abs(bucket.delay_for() - 0.2) < 1e-9
    now[0] = 0.1
    assert bucket.acquire(1, lambda s: now.__setitem__(0, now[0] + s)) > 0


def test_admission_in_order(spark):
    rows = [("p", i, "BACKFILL" if i % 2 else "REALTIME", 10) for i in range(20)] + [("q", 1, "REALTIME", 80), ("q", 2, "REALTIME", 60), ("q", 3, "REALTIME", 50), ("q", 4, "REALTIME", 10)]
    limits = rows_of(spark, [("p", 100), ("q", 200)], "provider string, daily_limit bigint")
    got = {(r.provider, r.seq): r.granted for r in budget.admit(rows_of(spark, rows, "provider string, seq bigint, priority string, calls bigint"), limits).collect()}
    assert [k for k in range(20) if got["p", k]] == [0, 1, 2, 3, 4, 6, 8] and [got["q", k] for k in (1, 2, 3, 4)] == [True, True, False, False]


def test_backfill_stops_and_goes_on(spark):
    db, clock = Database(spark), testing.SimulatedClock()
    manager = budget.BudgetManager([budget.ApiBudget("salesforce", 300, window_start_us=clock())], clock_us=clock)
    data = list(range(95))
    fetch = lambda at, n: (data[int(at or 0) : int(at or 0) + n], str(int(at or 0) + n) if int(at or 0) + n < len(data) else None)
    job = budget.Backfill("load", "salesforce", manager, store.Checkpoints(db), fetch, size=10)
    got = [x for rows in job.run(3) for x in rows]
    assert len(got) == 30 and job.paused_reason == "batch limit for this run reached" and store.Checkpoints(db).get("load") == "30"
    got += [x for rows in job.resume() for x in rows]
    assert got == data and job.finished and store.Checkpoints(db).get("load") is None
    keys = {r.batch: r["keys"] for r in budget.batched(spark.range(450).repartition(1), "id").collect()}
    assert sorted(map(len, keys.values())) == [50, 200, 200]


def test_an_edit_reaches_the_other_system_once(spark):
    env = testing.SyncTestEnv(spark)
    env.seed_entity_everywhere("e1", {"salesforce": "sf1", "hubspot": "hs1"}, {"first_name": "Ann", "last_name": "Lee"})
    env.user_edit("salesforce", "sf1", "FirstName", "Anna")
    for _ in range(3):
        env.cycle()
    held = {(r.record_id, r.field): r.value for r in env.hubspot.records.collect()}
    assert held["hs1", "firstname"] == "Anna" and env.engine.stats["writes"] == 1 and env.engine.stats["echo_actor"] == 1
    assert env.engine.stats.get("trips", 0) == 0 and env.db.table("outbox").count() == 1 and store.WriteLog(env.db).count() == 1
    report = sync.Reconciler(env.engine).run("hubspot", env.clock())
    assert report["discrepancies"] == 0
    env.hubspot.write(rows_of(spark, [("hs1", "lastname", "Leigh")], "record_id string, field string, value string"), env.clock.advance(60))
    env.inbox.clear()  # the event is lost
    reconciler = sync.Reconciler(env.engine, last_run={"hubspot": env.clock() - 1}, rates={"hubspot": [0.01]})
    assert reconciler.run("hubspot", env.clock())["discrepancies"] == 1 and reconciler.alerts
    assert env.engine.observations.rows(field="last_name").first().value == "Leigh"
    env.engine.ingest_deletes(rows_of(spark, [("hubspot", "hs1")], "source string, record_id string"), env.clock())
    assert env.engine.reviews.pending(1, "delete").count() == 1


def test_the_write_log_catches_what_has_no_actor_and_the_breaker_latches(spark):
    env = testing.SyncTestEnv(spark, {"anonymous_rate": 1.0})
    env.seed_entity_everywhere("e1", {"salesforce": "sf1", "hubspot": "hs1"}, {"phone": "1"})
    env.user_edit("salesforce", "sf1", "Phone", "2")
    for _ in range(3):
        env.cycle()
    assert env.engine.stats["echo_log"] == 1 and env.engine.stats["writes"] == 1
    flood = [(1000 + i, "salesforce", "sf1", "Phone", str(i), env.clock() + i, env.clock() + i, f"x{i}", None, "crm") for i in range(15)]
    out = env.engine.ingest(spark.createDataFrame(flood, crm.EVENTS))
    assert out.filter("outcome = 'quarantined'").count() > 0 and env.engine.is_quarantined("salesforce", "sf1") and env.engine.alerts
    assert env.engine.release("salesforce", "sf1", env.clock()) == 1 and not env.engine.is_quarantined("salesforce", "sf1")
    late = [(2000, "hubspot", "new", "phone", "9", T - 5, env.clock(), "l1", None, "crm"), (2001, "hubspot", "new", "phone", "8", T - 9, env.clock(), "l2", None, "crm"), (2002, "hubspot", "new", "nope", "8", T, env.clock(), "l3", None, "crm")]
    got = {r.seq: (r.outcome, r.result) for r in env.engine.ingest(spark.createDataFrame(late, crm.EVENTS)).collect()}
    assert got == {2000: ("kept", "APPLIED"), 2001: ("kept", "SUPERSEDED"), 2002: ("unmapped", None)}
    again = {r.seq: r.result for r in env.engine.ingest(spark.createDataFrame(late[:1], crm.EVENTS)).collect()}
    assert again == {2000: "DUPLICATE"}


def test_a_stream_runs_the_engine(spark, tmp_path):
    from entityflow.streaming.sync import loops, run_stream

    env = testing.SyncTestEnv(spark)
    env.seed_entity_everywhere("e1", {"salesforce": "sf1", "hubspot": "hs1"}, {"phone": "1"})
    rows = spark.createDataFrame([(i, "salesforce", "sf1", "Phone", "77", T + i, T + i, f"c{i}", None, "user") for i in range(3)], crm.EVENTS)
    rows.withColumn("received_at", F.timestamp_micros("received_us")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(crm.EVENTS + ", received_at timestamp").parquet(str(tmp_path / "in"))
    run_stream(stream.drop("received_at"), env.engine, str(tmp_path / "state")).awaitTermination(120)
    assert env.engine.stats["writes"] == 1 and {r.value for r in env.hubspot.records.filter("field = 'phone'").collect()} == {"77"}
    query = loops(stream, limit=2).writeStream.format("memory").queryName("loops").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("loops").filter("changes = 3").count() > 0


def test_connectors(spark):
    sf = crm.SimulatedSalesforce(spark)
    fields = lambda *r: rows_of(spark, list(r), "record_id string, field string, value string")
    sf.seed(fields(("1", "Email", "a"), ("2", "Email", "b")), T)
    assert sf.write(fields(("1", "Email", "a")), T + 1).count() == 0 and sf.write(fields(("1", "Email", "c")), T + 2, actor="me").first().actor == "me"
    assert {r.record_id for r in sf.updated_since(T + 1).collect()} == {"1"} and sf.headers() == {"Sforce-Limit-Info": "api-usage=3/15000"}
    sf.system_touch("2", T + 9)
    sf.delete("1")
    assert [r.record_id for r in sf.updated_since(T + 8).collect()] == ["2"] and not sf.exists("1") and sf.read(fields(("1", "", ""), ("2", "", ""))).count() == 1
    with pytest.raises(crm.SchemaDrift):
        sf.write(fields(("2", "LeadSource", "Fax")), T)
    sf.add_picklist_value("LeadSource", "Fax")
    assert sf.write(fields(("2", "LeadSource", "Fax")), T).count() == 1
    mapping = crm.Mapping("salesforce", crm.MAPPINGS["salesforce"])
    mapping.validate(sf.describe())
    sf.rename_field("Title", "JobTitle")
    with pytest.raises(crm.SchemaDrift, match="Title"):
        mapping.validate(sf.describe())
    assert mapping.canonical("Email") == "email" and mapping.remote("nothing") is None
    hub = crm.SimulatedHubSpot(spark, limiter=budget.BurstLimiter(1, 1e9), drop_rate=1.0)
    hub.seed(fields(("1", "email", "a")))
    assert hub.search(lambda: F.col("value") == "a").count() == 1 and hub.search(lambda: F.col("value") == "a").count() == 0 and hub.throttled == 1
    assert hub.user_edit(fields(("1", "email", "z")), T).count() == 0 and hub.dropped >= 1 and hub.modified_since(T - 1).count() == 1
    assert crm.mapping_frame(spark).count() == 12


def test_erasure_leaves_nothing_and_stays_erased(spark):
    pipeline = Pipeline(Database(spark))
    raw = testing.synthetic_corpus(spark, 5).drop("person").withColumn("phone_verified", F.col("phone_verified").cast("string"))
    held = pipeline.ingest_records(raw, T).select("entity_id", "source", "source_record_id").collect()
    gone = held[0]
    store.DeadLetters(pipeline.db).send(rows_of(spark, [("k", f'{{"who":"{gone.entity_id}"}}', "e", 1)], "key string, payload string, error string, attempts bigint"), T)
    report = store.erase(pipeline.db, gone.entity_id, "asked", T + 1, identifiers=("a@b.c",))
    assert report.complete and report.deleted["observations"] > 0 and report.deleted["dead_letters"] == 1 and report.requests == [(gone.source, gone.source_record_id)]
    assert pipeline.suppressions.contains("a@b.c") and pipeline.suppressions.keys().count() == 3
    again = pipeline.ingest_records(raw, T + 2)
    assert again.count() == len(held) - 1 and pipeline.observations.count(gone.entity_id) == 0
    assert pipeline.record_for(held[1].entity_id, T + 3)["last_name"]
    health = pipeline.health()
    assert health["entities"] == len(held) - 1 and health["dlq_depth"] == 0 and health["observations"] > 0


def test_the_pipeline_merges_only_when_it_may(spark):
    corpus = testing.synthetic_corpus(spark, 12).withColumn("phone_verified", F.col("phone_verified").cast("boolean"))
    for allowed in (False, True):
        pipeline = Pipeline(Database(spark), match_policy=MatchPolicy(auto_merge=0.9, auto_merge_enabled=allowed))
        pipeline.ingest_records(corpus.drop("person", "phone_verified"), T)
        found = pipeline.match(corpus.drop("person"), T, labels=testing.labelled_pairs(corpus))
        merged = pipeline.apply_merges(found, T + 1)
        assert (merged > 0) == allowed
    assert pipeline.entities.merged_into().count() == merged and pipeline.reviews.depth() >= 0
    with pytest.raises(ValueError, match="thresholds"):
        MatchPolicy(auto_merge=0.5)
    assert clusters.verdict({"a"}, [], clusters.ClusterConfig()) == "OK"


def test_bake_off_report(spark):
    scores = rows_of(spark, [("a", "f", 10, 0, 9, 1.0, 0.9, 10.0), ("b", "f", 5, 5, 5, 0.5, 1.0, 1.0), ("c", "f", 1, 9, 0, 0.1, 0.0, 1.0)], "provider string, field string, returned bigint, missing bigint, correct bigint, coverage double, accuracy double, cost double")
    assert enrich.recommended_policy(scores).first().ranking == ["b", "a"]
    assert "n/a a correct field" in enrich.render(scores)


def test_command_line(capsys):
    assert cli.main(["policy"]) == 0
    assert "contact.email" in capsys.readouterr().out


def test_the_rest_lives_without_the_training_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'components' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    for keep in (True, False):
        if not keep:
            (copy / "corpus_pipeline.py").unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, check=False)
        assert done.returncode == 0, done.stderr
