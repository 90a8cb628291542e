"""The whole of it: records in, matched and clustered under guards, merged where measurement allows it, read back resolved."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.functions import text
from entityflow.operators import clusters, graph, linkage, matching, resolve, store
from entityflow.operators.budget import ApiBudget, BudgetManager
from entityflow.operators.sync import SyncEngine
from entityflow.session import materialize
from entityflow.sources.database import Database
from entityflow.sources.policies import PolicySet, find_policy_path


@dataclass(frozen=True)
class MatchPolicy:
    """The decision thresholds; automatic merging is off until measured precision allows it."""

    auto_merge: float = 0.995
    review: float = 0.80
    auto_merge_enabled: bool = False

    def __post_init__(self):
        if not 0 < self.review <= self.auto_merge <= 1:
            raise ValueError("thresholds must satisfy 0 < review <= auto_merge <= 1")


@dataclass
class Matched:
    """What matching found: tables, and the model that scored."""

    deterministic: DataFrame
    scored: DataFrame
    links: DataFrame
    blocking: DataFrame
    model: linkage.Model
    clusters: DataFrame | None = None

    def counts(self) -> dict[str, int]:
        rows = self.scored.groupBy("decision").count().collect()
        return {"deterministic": self.deterministic.count(), "scored": sum(r["count"] for r in rows)} | {r.decision: r["count"] for r in rows}


def match(
    records: DataFrame,
    *,
    labels: DataFrame | None = None,
    train: bool = True,
    model: linkage.Model | None = None,
    policy: MatchPolicy = MatchPolicy(),
    cfg: clusters.ClusterConfig = clusters.ClusterConfig(),
    cluster: bool = True,
    max_block: int = matching.MAX_BLOCK,
) -> Matched:
    """Sure rules, then blocking, then scores, then guarded clusters.

    ``records`` has source, source_record_id and raw fields. With ``labels`` (l, r, is_match) the model is fitted to them,
    else by EM over the candidate pairs. An edge's score is the greater of its rule's confidence and its probability.
    """
    keyed = records.withColumn("key", F.concat_ws(":", "source", "source_record_id"))
    held = materialize(text.normalize_record(keyed), "normalized")
    sure = materialize(matching.deterministic_matches(held, matching.deterministic_rules()), "sure")
    rules = matching.blocking_rules()
    pairs = materialize(matching.candidate_pairs(held, rules, max_block), "candidates")
    if train and labels is not None:
        model = linkage.fit_supervised(labels, held, model)
    elif train:
        model = linkage.fit_em(pairs, held, model)
    else:
        model = model or linkage.Model()
    rated = linkage.score_pairs(pairs.select("l", "r"), held, model)
    decision = matching.decide(F.col("score"), auto=policy.auto_merge, review=policy.review, enabled=policy.auto_merge_enabled)
    rated = materialize(rated.withColumns({"decision": decision, "explanation": linkage.explain(model, F.col("levels"))}), "scored")
    named = lambda rows, score: rows.select(F.col("l").alias("a"), F.col("r").alias("b"), F.col(score).alias("score"))
    links = materialize(graph.edges(named(sure, "confidence").unionByName(named(rated, "score"))), "edges")
    out = Matched(sure, rated, links, matching.block_stats(held, rules, max_block), model)
    if cluster:
        out.clusters = materialize(clusters.resolve_clusters(links, cfg, nodes=held.select("key")), "clusters")
    return out


@dataclass
class Pipeline:
    """Tables, policies and engine of one deployment. A policy with problems stops it at the start."""

    db: Database
    policies: PolicySet | None = None
    match_policy: MatchPolicy = MatchPolicy()
    cfg: clusters.ClusterConfig = clusters.ClusterConfig()
    clients: dict[str, object] = field(default_factory=dict)
    budget: BudgetManager | None = None

    def __post_init__(self):
        self.policies = self.policies or PolicySet.load(find_policy_path())
        problems = self.policies.validate()
        if problems:
            raise ValueError("; ".join(problems))
        self.budget = self.budget or BudgetManager([ApiBudget("salesforce", 15_000), ApiBudget("hubspot", 625_000)], db=self.db)
        self.engine = SyncEngine(self.db, self.policies, self.clients, self.budget)
        self.entities, self.observations, self.reviews = self.engine.entities, self.engine.observations, self.engine.reviews
        self.suppressions = store.Suppressions(self.db)

    def ingest_records(self, records: DataFrame, at_us: int, *, kind: str = "contact") -> DataFrame:
        """Load flat records (source, source_record_id, raw fields) as observations; returns them with their entity_id.

        Suppressed records stay out. Null and empty values are no observations. Expiry follows the policy of ``kind``.
        """
        keyed = records.withColumn("key", F.concat_ws(":", "source", "source_record_id"))
        allowed = self.suppressions.filter(keyed)
        linked = self.entities.entity_for_record(allowed).withColumn("_known", F.col("entity_id").isNotNull())
        linked = materialize(linked.withColumn("entity_id", F.coalesce("entity_id", store.new_id(F.col("source"), F.col("source_record_id")))), "ingested")
        types = F.col("type") if "type" in records.columns else F.lit("person")
        new = linked.filter("not _known")
        self.entities.create(new.select(F.col("entity_id").alias("id"), types.alias("type")), at_us)
        self.entities.link(new.select("entity_id", "source", "source_record_id"), at_us)
        fields = [c for c in records.columns if c not in ("source", "source_record_id", "type", "key")]
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields]))
        ttl = self.policies.ttl_map(kind)
        now = F.lit(at_us).cast("bigint")
        rows = linked.select("entity_id", "source", "source_record_id", values.alias("v")).select("entity_id", "source", "source_record_id", "v.*")
        rows = rows.filter("coalesce(value, '') <> ''").withColumns({"kind": F.lit("crm"), "confidence": F.lit(1.0), "observed_us": now, "recorded_us": now})
        self.observations.append(rows.withColumn("expires_us", resolve.expires_us(F.col("field"), now, ttl)))
        return linked.drop("_known", "key")

    def match(self, records: DataFrame, at_us: int, *, labels: DataFrame | None = None, **options) -> Matched:
        """``match``, with the decisions of the queue as labels if there are any, and its open questions queued."""
        known = self.reviews.labels() if labels is None else labels
        found = match(records, labels=None if known.isEmpty() else known, policy=self.match_policy, cfg=self.cfg, **options)
        doubtful = found.scored.filter("decision = 'review'").select("l", "r", "score", F.to_json(F.struct("explanation")).alias("payload"))
        self.reviews.enqueue_pairs(doubtful, at_us)
        if found.clusters is not None:
            self.reviews.enqueue_clusters(found.clusters.filter("review is not null").select("cluster", "node", "review"), at_us)
        return found

    def apply_merges(self, found: Matched, at_us: int, *, decided_by: str = "auto:v1") -> int:
        """Merge what a validated cluster supports with every scored pair; weaker clusters go to review."""
        if found.clusters is None or not self.match_policy.auto_merge_enabled:
            return 0
        owners = self.entities.links_for().select(F.concat_ws(":", "source", "source_record_id").alias("node"), F.col("canonical").alias("entity_id"))
        merges, weak = clusters.plan_merges(found.clusters, found.links, owners, auto_merge=self.match_policy.auto_merge)
        merges = materialize(merges.select("surviving_id", "merged_id"), "merges")
        below = found.clusters.join(weak.select("cluster"), "cluster", "left_semi").select("cluster", "node", F.lit("below auto-merge threshold").alias("review"))
        self.reviews.enqueue_clusters(below, at_us)
        n = merges.count()
        if n:
            self.entities.merge(merges, at_us, decided_by=decided_by)
        return n

    def resolved(self, at_us: int, *, entity_id: str | None = None, kind: str = "contact") -> DataFrame:
        """Every field's current value, logged where it is disputed."""
        live = self.observations.live(at_us, entity_id=entity_id)
        found = materialize(resolve.resolve_by_policy(live, self.policies.frame(self.db.spark, kind)), "resolved")
        self.engine.conflicts.record(found, at_us)
        return found

    def record_for(self, entity_id: str, at_us: int) -> dict[str, str]:
        return {r.field: r.value for r in self.resolved(at_us, entity_id=entity_id).collect()}

    def push_all(self, at_us: int, *, entity_id: str | None = None) -> DataFrame:
        fields = self.observations.fields_for()
        return self.engine.push(fields if entity_id is None else fields.filter(F.col("entity_id") == entity_id), at_us)

    def health(self) -> dict:
        """The few numbers to watch."""
        return {
            "entities": self.entities.all_ids().count(),
            "observations": self.observations.count(),
            "conflicts": self.engine.conflicts.count(),
            "top_conflicting_fields": [tuple(r) for r in self.engine.conflicts.top_conflicting_fields(5).collect()],
            "review_depth": self.reviews.depth(),
            "dlq_depth": store.DeadLetters(self.db).depth(),
            "quarantined": self.engine.quarantined().count(),
            "loop_breaker_trips": self.engine.stats.get("trips", 0),
            "budget": self.budget.snapshot(),
            "sync": dict(self.engine.stats),
        }
