"""Two-way sync in batches: events become observations, resolved values become writes, the breaker and the log end loops.

A batch is judged against the tables as they stood before it, and within it in order of arrival (seq). A closed loop, in
which a write's echo is judged against the log, goes through the next batch: writes are logged before they are made.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.functions.text import hash_value
from entityflow.operators import resolve, store
from entityflow.operators.budget import BudgetManager
from entityflow.operators.events import MINUTE_US, idempotency_key
from entityflow.session import materialize
from entityflow.sources import crm
from entityflow.sources.database import Database
from entityflow.sources.policies import PolicySet, with_policy

MAX_CHANGES, WINDOW_US = 10, 5 * MINUTE_US


def own_write_by_actor(source: Column, actor: Column, users: dict[str, str]) -> Column:
    """Whether our own integration user made the change."""
    return F.coalesce(F.try_element_at(crm.as_map(users), source) == actor, F.lit(False)) if users else F.lit(False)


def own_write_by_log(events: DataFrame, log: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """(seq) of events whose value we wrote to that field up to ``window_us`` before."""
    e = events.withColumn("value_hash", hash_value(F.col("value"))).alias("e")
    same = [F.col(f"e.{a}") == F.col(f"w.{b}") for a, b in (("source", "target"), ("record_id", "record_id"), ("field", "field"), ("value_hash", "value_hash"))]
    near = F.col("w.written_us").between(F.col("e.received_us") - window_us, F.col("e.received_us"))
    return e.join(log.alias("w"), [*same, near], "left_semi").select("seq")


def breaker(events: DataFrame, before: DataFrame, held: DataFrame, *, limit: int = MAX_CHANGES, window_us: int = WINDOW_US) -> DataFrame:
    """(seq, stopped, trips): whether an event's record is quarantined by then; ``trips`` marks the event that trips it.

    ``before`` is the change log (source, record_id, seen_us), ``held`` the records in quarantine already. The breaker
    latches: all later events of a tripped record are stopped.
    """
    past = before.select(F.lit(None).cast("bigint").alias("seq"), "source", "record_id", F.col("seen_us").alias("received_us"))
    both = past.unionByName(events.select("seq", "source", "record_id", "received_us"))
    recent = Window.partitionBy("source", "record_id").orderBy("received_us").rangeBetween(-window_us, 0)
    counted = both.withColumn("changes", F.count(F.lit(1)).over(recent)).filter("seq is not null")
    first = counted.filter(F.col("changes") > limit).groupBy("source", "record_id").agg(F.min("seq").alias("_trip"))
    inside = held.select("source", "record_id", F.lit(True).alias("_held")).distinct()
    found = events.select("seq", "source", "record_id").join(first, ["source", "record_id"], "left").join(inside, ["source", "record_id"], "left")
    latched = F.coalesce("_held", F.lit(False))
    return found.select("seq", (latched | F.coalesce(F.col("seq") >= F.col("_trip"), F.lit(False))).alias("stopped"), (~latched & F.coalesce(F.col("seq") == F.col("_trip"), F.lit(False))).alias("trips"))


def ordering(events: DataFrame, known: DataFrame) -> DataFrame:
    """``events`` (entity_id, field, source, observed_us, value, seq) with ``result`` and ``superseded_by``.

    ``known`` has the newest stored observation of each (entity_id, field, source). An event is APPLIED if it is newer
    than all before it, a DUPLICATE if it repeats the newest, else SUPERSEDED: kept, but it does not win. The newest so
    far is a running maximum, which is exact, as a superseded event never raises it.
    """
    keys = ["entity_id", "field", "source"]
    stored = known.select(*keys, F.col("observed_us").alias("_o"), F.col("id").alias("_id"), hash_value(F.col("value")).alias("_h"))
    rows = events.join(stored, keys, "left").withColumn("_hash", hash_value(F.col("value")))
    past = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    place = lambda o, s, h: F.struct(o.alias("o"), s.alias("s"), h.alias("h"))
    inside = F.max(place(F.col("observed_us"), -F.col("seq"), F.col("_hash"))).over(past)
    outside = F.when(F.col("_o").isNotNull(), place(F.col("_o"), F.lit(1).cast("bigint"), F.col("_h")))
    rows = rows.withColumn("_p", F.greatest(inside, outside))
    same = (F.col("observed_us") == F.col("_p.o")) & (F.col("_hash") == F.col("_p.h"))
    late = F.col("observed_us") <= F.col("_p.o")
    result = F.when(same, "DUPLICATE").when(late, "SUPERSEDED").otherwise("APPLIED")
    by = F.when(late & ~same, F.when(F.col("_p.s") == 1, F.col("_id")))
    return rows.withColumns({"result": result, "superseded_by": by}).drop("_o", "_id", "_h", "_p", "_hash")


def ingest_class(events: DataFrame, log: DataFrame, change_log: DataFrame, held: DataFrame, mappings: dict[str, dict[str, str]], users: dict[str, str]) -> DataFrame:
    """``events`` with ``outcome`` (quarantined, echo_actor, echo_log, unmapped or kept), ``ours`` (our name of the field) and ``trips``."""
    found = events.join(breaker(events, change_log, held), "seq").join(own_write_by_log(events, log).select("seq", F.lit(True).alias("_echo")), "seq", "left")
    table = F.create_map(*[F.lit(x) for s, fields in mappings.items() for a, b in fields.items() for x in (f"{s}|{b}", a)]) if any(mappings.values()) else F.create_map().cast("map<string,string>")
    systems = list(mappings) or [""]
    ours = F.when(F.col("source").isin(*systems), F.try_element_at(table, F.concat_ws("|", "source", "field"))).otherwise(F.col("field"))
    outcome = F.when(F.col("stopped"), "quarantined").when(own_write_by_actor(F.col("source"), F.col("actor"), users), "echo_actor")
    outcome = outcome.when(F.col("_echo"), "echo_log").when(ours.isNull(), "unmapped").otherwise("kept")
    return found.withColumns({"ours": ours, "outcome": outcome}).drop("stopped", "_echo")


def outbox(resolved: DataFrame, policies: DataFrame, links: DataFrame, remote: DataFrame, mappings: dict[str, dict[str, str]], targets: tuple[str, ...], held: DataFrame) -> DataFrame:
    """(target, record_id, field, value, entity_id, ours, outcome): what each resolved value would write.

    ``outcome`` is write, no_change, or review (a conflict that the policy can't settle is written nowhere; target null).
    ``links`` has canonical, source and source_record_id; a target in which the entity has no record gets a new one.
    """
    known = resolved.filter("value is not null")
    safe = with_policy(known.filter("not needs_review"), policies).withColumn("target", F.explode(F.array_intersect("writes_to", F.array(*[F.lit(t) for t in targets]))))
    theirs = F.create_map(*[F.lit(x) for s, fields in mappings.items() for a, b in fields.items() for x in (f"{s}|{a}", b)])
    safe = safe.withColumn("remote_field", F.when(F.col("target").isin(*mappings), F.try_element_at(theirs, F.concat_ws("|", "target", "field"))).otherwise(F.col("field"))).filter("remote_field is not null")
    own = links.groupBy(F.col("canonical").alias("entity_id"), F.col("source").alias("target")).agg(F.min("source_record_id").alias("record_id"))
    safe = safe.join(own, ["entity_id", "target"], "left").withColumn("record_id", F.coalesce("record_id", F.concat_ws("-", "target", F.lit("auto"), store.new_id(F.col("entity_id"), F.col("target")))))
    stopped = held.select(F.col("source").alias("target"), "record_id").distinct()
    safe = safe.join(stopped, ["target", "record_id"], "left_anti")
    there = remote.select(F.col("source").alias("target"), "record_id", F.col("field").alias("remote_field"), F.col("value").alias("_there"), F.lit(True).alias("_known"))
    safe = safe.join(there, ["target", "record_id", "remote_field"], "left")
    same = F.coalesce(F.col("_known"), F.lit(False)) & F.col("_there").eqNullSafe(F.col("value"))
    writes = safe.select("target", "record_id", F.col("remote_field").alias("field"), "value", "entity_id", F.col("field").alias("ours"), F.when(same, "no_change").otherwise("write").alias("outcome"))
    none = F.lit(None).cast("string")
    review = known.filter("needs_review").select(none.alias("target"), none.alias("record_id"), F.col("field"), "value", "entity_id", F.col("field").alias("ours"), F.lit("review").alias("outcome"))
    return writes.unionByName(review)


def discrepancies(held: DataFrame, remote: DataFrame) -> DataFrame:
    """(record_id, field, known, value) where a system's value (``held``) is not the one we know of it; an unknown one too."""
    known = remote.select("record_id", "field", F.col("value").alias("known"))
    both = held.select("record_id", "field", "value").join(known, ["record_id", "field"], "left")
    return both.filter("known is null or not (known <=> value)").select("record_id", "field", "known", "value")


@dataclass
class SyncEngine:
    """The tables of a ``Database`` kept in step with CRMs, one batch of events at a time."""

    db: Database
    policies: PolicySet
    clients: dict[str, object] = field(default_factory=dict)
    budget: BudgetManager | None = None
    mappings: dict[str, dict[str, str]] = field(default_factory=lambda: dict(crm.MAPPINGS))
    kind: str = "contact"
    stats: dict[str, int] = field(default_factory=dict)
    alerts: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.entities, self.observations = store.Entities(self.db), store.Observations(self.db)
        self.reviews, self.log, self.conflicts = store.Reviews(self.db), store.WriteLog(self.db), store.Conflicts(self.db)
        self.dirty: DataFrame | None = None

    def _count(self, **n: int) -> None:
        for k, v in n.items():
            self.stats[k] = self.stats.get(k, 0) + v

    def quarantined(self) -> DataFrame:
        return self.db.table("quarantine").filter("released_us is null")

    def is_quarantined(self, source: str, record_id: str) -> bool:
        return not self.quarantined().filter((F.col("source") == source) & (F.col("record_id") == record_id)).isEmpty()

    def quarantine(self, records: DataFrame, at_us: int, reason: str = "suspected echo loop") -> None:
        rows = records.select("source", "record_id").distinct().withColumns({"reason": F.lit(reason), "created_us": F.lit(at_us)})
        self.db.upsert("quarantine", rows, ["source", "record_id"])

    def release(self, source: str, record_id: str, at_us: int) -> int:
        return self.db.update("quarantine", (F.col("source") == source) & (F.col("record_id") == record_id), {"released_us": F.lit(at_us)})

    def ingest(self, events: DataFrame) -> DataFrame:
        """Take in a batch (columns of ``crm.EVENTS``); returns it with its outcome. Echoes and all kept events tell what the CRM holds."""
        users = {n: c.integration_user for n, c in self.clients.items()}
        since = events.agg(F.min("received_us").alias("m"), F.max("received_us").alias("t")).first()
        if since.m is None:
            return events.withColumn("outcome", F.lit(None).cast("string"))
        judged = ingest_class(events, self.log.lookup(since.m), self.db.table("change_log").filter(F.col("seen_us") >= since.m - WINDOW_US), self.quarantined(), self.mappings, users)
        judged = materialize(judged, "judged-events")
        self.db.append("change_log", events.select("seq", "source", "record_id", "field", F.col("received_us").alias("seen_us")))
        tripped = judged.filter("trips")
        n = tripped.count()
        if n:
            self.quarantine(tripped, since.t)
            self._count(trips=n)
            self.alerts.append(f"sync loop detected: {n} records quarantined")
        kept = self._placed(judged.filter("outcome = 'kept'"), since.t)
        rows = kept.filter("result <> 'DUPLICATE'").withColumns({"source_record_id": F.col("record_id"), "recorded_us": F.col("received_us"), "confidence": F.lit(1.0)})
        rows = with_policy(rows.drop("field").withColumnRenamed("ours", "field"), self.policies.frame(self.db.spark, self.kind))
        rows = rows.withColumn("expires_us", F.col("observed_us") + F.col("ttl_days").cast("bigint") * F.lit(resolve.DAY_US))
        self.observations.append(rows)
        seen = judged.filter("outcome in ('kept', 'echo_actor', 'echo_log')")
        newest = seen.groupBy("source", "record_id", "field").agg(F.max_by("value", "seq").alias("value"))
        self.db.upsert("remote_state", newest, ["source", "record_id", "field"])
        touched = kept.select("entity_id", F.col("ours").alias("field")).distinct()
        self.dirty = touched if self.dirty is None else self.dirty.unionByName(touched).distinct()
        counts = {r[0]: r[1] for r in judged.groupBy("outcome").count().collect()} | {r[0].lower(): r[1] for r in kept.groupBy("result").count().collect()}
        self._count(events_in=sum(v for k, v in counts.items() if k in ("quarantined", "echo_actor", "echo_log", "unmapped", "kept")), **{k: v for k, v in counts.items() if k != "kept"})
        self._count(user_edits=events.filter("kind = 'user'").count())
        return judged.join(kept.select("seq", "result", "entity_id"), "seq", "left")

    def _placed(self, kept: DataFrame, at_us: int) -> DataFrame:
        """Kept events with their entity, made provisionally where a record has none, and their place in order."""
        linked = self.entities.entity_for_record(kept.withColumn("source_record_id", F.col("record_id")))
        linked = materialize(linked.withColumn("_new", F.col("entity_id").isNull()).withColumn("entity_id", F.coalesce("entity_id", store.new_id(F.col("source"), F.col("record_id")))), "linked-events")
        new = linked.filter("_new").select("entity_id", "source", "source_record_id").distinct()
        if not new.isEmpty():
            self.entities.create(new.select(F.col("entity_id").alias("id"), F.lit("person").alias("type")), at_us)
            self.entities.link(new.withColumn("linked_by", F.lit("auto:provisional")), at_us)
        known = self.observations.latest().withColumnRenamed("field", "ours")
        named = linked.drop("_new", "field", "source_record_id").withColumnRenamed("ours", "field")
        placed = ordering(named, known.withColumnRenamed("ours", "field")).withColumnRenamed("field", "ours")
        return materialize(placed, "placed-events")

    def ingest_deletes(self, records: DataFrame, at_us: int) -> None:
        """Deleted records (source, record_id) go to review; they are never passed on."""
        self.reviews.enqueue_deletes(records, at_us)
        self._count(deletes_to_review=records.count())

    def push(self, fields: DataFrame, at_us: int, *, priority: str = "INCREMENTAL") -> DataFrame:
        """Write the resolved values of (entity_id, field) to every system that their policy allows; returns the writes."""
        live = self.observations.live(at_us).join(fields.select("entity_id", "field").distinct(), ["entity_id", "field"], "left_semi")
        table = self.policies.frame(self.db.spark, self.kind)
        found = materialize(resolve.resolve_by_policy(live, table), "resolved")
        self.conflicts.record(found, at_us)
        planned = materialize(outbox(found, table, self.entities.links_for(), self.db.table("remote_state"), self.mappings, tuple(self.clients), self.quarantined()), "outbox")
        review = planned.filter("outcome = 'review'")
        if not review.isEmpty():
            payload = F.to_json(F.struct(F.col("ours").alias("field"), "value"))
            self.reviews.enqueue(review.select(F.lit("pair").alias("kind"), F.col("entity_id").alias("left_key"), F.concat(F.lit("unresolved conflict on "), "ours").alias("reason"), payload.alias("payload"), F.lit(0.8).alias("priority")), at_us)
        self._count(no_change_skips=planned.filter("outcome = 'no_change'").count())
        done = None
        for target, client in self.clients.items():
            wanted = planned.filter((F.col("outcome") == "write") & (F.col("target") == target))
            n = wanted.count()
            granted = n if self.budget is None else self.budget.grant(target, n, priority, note="sync")
            self._count(budget_denied=n - granted, writes=granted)
            if not granted:
                continue
            # The budget is the limit: what it denies now is dirty again and goes with the next flush.
            rows = materialize(wanted.orderBy("entity_id", "field").limit(granted) if granted < n else wanted, "writes")
            if granted < n:
                left = wanted.join(rows.select("entity_id", "field"), ["entity_id", "field"], "left_anti").select("entity_id", F.col("ours").alias("field"))
                self.dirty = left if self.dirty is None else self.dirty.unionByName(left).distinct()
            new = rows.select("entity_id", F.col("target").alias("source"), F.col("record_id").alias("source_record_id")).distinct()
            new = new.join(self.db.table("entity_links"), ["source", "source_record_id"], "left_anti")
            if not new.isEmpty():
                self.entities.link(new.withColumn("linked_by", F.lit("auto:sync")), at_us)
            self.log.record(rows, at_us)
            client.write(rows, at_us, actor=client.integration_user, kind="system")
            if self.budget is not None:
                self.budget.observe_headers(target, client.headers())
            self.db.upsert("remote_state", rows.withColumn("source", F.col("target")), ["source", "record_id", "field"])
            self.db.append("outbox", rows.withColumn("written_us", F.lit(at_us)))
            done = rows if done is None else done.unionByName(rows)
        return done if done is not None else planned.filter("false")

    def flush(self, at_us: int, *, priority: str = "INCREMENTAL") -> DataFrame | None:
        """Push what changed since the last flush."""
        if self.dirty is None:
            return None
        dirty, self.dirty = materialize(self.dirty, "dirty"), None
        return self.push(dirty, at_us, priority=priority)

    def run_cycle(self, events: DataFrame, at_us: int) -> DataFrame | None:
        self.ingest(events)
        return self.flush(at_us)

    def reconcile(self, source: str, since_us: int, at_us: int, *, repair: bool = True) -> dict:
        """Compare a CRM's records touched since a time with what we know of them; repairs go through ``ingest``."""
        client = self.clients[source]
        if self.budget is not None and not self.budget.reserve(source, 1, "INCREMENTAL", note="reconcile"):
            return {"source": source, "checked": 0, "discrepancies": 0, "rate": 0.0}
        held = materialize(client.updated_since(since_us), "remote-held")
        wrong = materialize(discrepancies(held, self.db.table("remote_state").filter(F.col("source") == source)), "discrepancies")
        n, checked = wrong.count(), held.count()
        if repair and n:
            stamp = held.groupBy("record_id").agg(F.max("modstamp_us").alias("observed_us"))
            why = F.concat_ws(":", F.lit("reconcile"), "record_id", "field", hash_value(F.col("value")))
            last = self.db.table("change_log").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            repairs = wrong.join(stamp, "record_id").select((F.monotonically_increasing_id() + F.lit(last + 1)).alias("seq"), F.lit(source).alias("source"), "record_id", "field", "value", "observed_us", F.lit(at_us).cast("bigint").alias("received_us"), why.alias("change_id"), F.lit(None).cast("string").alias("actor"), F.lit("crm").alias("kind"))
            self.ingest(materialize(repairs, "repairs"))
        return {"source": source, "checked": checked, "discrepancies": n, "rate": n / checked if checked else 0.0}


@dataclass
class Reconciler:
    """Reconciliation by schedule, with an alert when a system's rate more than doubles."""

    engine: SyncEngine
    interval_us: int = 60 * MINUTE_US
    last_run: dict[str, int] = field(default_factory=dict)
    rates: dict[str, list[float]] = field(default_factory=dict)
    alerts: list[str] = field(default_factory=list)

    def run(self, source: str, now_us: int) -> dict:
        report = self.engine.reconcile(source, self.last_run.get(source, now_us - self.interval_us), now_us)
        history = self.rates.setdefault(source, [])
        if history and history[-1] > 0 and report["rate"] > 2 * history[-1]:
            self.alerts.append(f"{source}: discrepancy rate rose from {history[-1]:.4%} to {report['rate']:.4%}")
        history.append(report["rate"])
        self.last_run[source] = now_us
        return report


@dataclass
class Processor:
    """Deliveries handled once: claimed, run, released for another try, or sent to the dead letters after too many."""

    db: Database
    max_attempts: int = 5
    keep_us: int = 7 * resolve.DAY_US

    def claim(self, events: DataFrame, at_us: int) -> DataFrame:
        """The first event of each key that is not claimed yet; their keys are claimed then."""
        keyed = events.withColumn("key", idempotency_key())
        first = keyed.groupBy("key").agg(F.min("seq").alias("seq"))
        live = self.db.table("claims").filter(F.col("claimed_us") > at_us - self.keep_us)
        new = materialize(first.join(live.select("key"), "key", "left_anti").join(keyed.drop("key"), "seq"), "claimed")
        self.db.upsert("claims", new.select("key", F.lit(at_us).cast("bigint").alias("claimed_us")), ["key"])
        return new

    def seen(self, key: str) -> bool:
        return not self.db.table("claims").filter(F.col("key") == key).isEmpty()

    def count(self) -> int:
        return self.db.table("claims").count()

    def release(self, failed: DataFrame, at_us: int) -> DataFrame:
        """Failed deliveries (key, error, payload): one more attempt, or, from the last on, a dead letter that stays claimed."""
        before = self.db.table("attempts").withColumnRenamed("attempts", "_n")
        tried = materialize(failed.join(before, "key", "left").withColumn("attempts", F.coalesce("_n", F.lit(0)) + 1).drop("_n"), "attempts")
        self.db.upsert("attempts", tried, ["key"])
        dead = tried.filter(F.col("attempts") >= self.max_attempts)
        store.DeadLetters(self.db).send(dead, at_us)
        again = tried.filter(F.col("attempts") < self.max_attempts)
        self.db.replace("claims", self.db.table("claims").join(again.select("key"), "key", "left_anti"))
        wait = F.least(F.lit(300.0), F.pow(F.lit(2.0), F.col("attempts") - 1))
        return tried.withColumns({"dead": F.col("attempts") >= self.max_attempts, "backoff": wait})

    def handle(self, events: DataFrame, run, at_us: int) -> DataFrame:
        """Claim a batch and give it to ``run``, which returns (seq, error); an error of null is a success."""
        claimed = self.claim(events, at_us)
        failed = run(claimed).filter("error is not null").select("seq", "error").join(claimed, "seq")
        return self.release(failed.withColumn("payload", F.to_json(F.struct("source", "record_id", "field", "value"))), at_us)
