"""The current value of a field from its observations: one aggregation, no window, no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.sources.policies import accepts, with_policy

DAY_US = 86_400_000_000
#: Default order of sources, best first.
RANKING = ("user", "salesforce", "hubspot", "enrichment")


def observations(orders: DataFrame) -> DataFrame:
    """Orders as observations of two fields of a customer; times in microseconds."""
    key = F.col("o_orderkey")
    source = F.element_at(F.array(F.lit("salesforce"), F.lit("hubspot"), F.lit("enrichment")), (key % 3 + 1).cast("int"))
    seen = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    arms = F.explode(
        F.array(
            F.struct(F.lit(0).alias("arm"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"), F.lit(90).alias("ttl")),
            F.struct(F.lit(1).alias("arm"), F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value"), F.lit(None).cast("int").alias("ttl")),
        )
    )
    return orders.select("*", arms.alias("a")).select(
        (key * 2 + F.col("a.arm")).alias("id"),
        F.col("o_custkey").alias("entity_id"),
        F.col("a.field").alias("field"),
        F.col("a.value").alias("value"),
        source.alias("source"),
        F.when(key % 10 == 0, "user").otherwise("crm").alias("kind"),
        (key % 100 / 100).alias("confidence"),
        seen.alias("observed_us"),
        (seen + key % 7 * DAY_US).alias("recorded_us"),
        (seen + F.col("a.ttl") * F.lit(DAY_US)).alias("expires_us"),
    )


def live(obs: DataFrame, at_us: int) -> DataFrame:
    """Observations known and not expired at a time; superseded ones included."""
    return obs.filter((F.col("recorded_us") <= at_us) & (F.col("expires_us").isNull() | (F.col("expires_us") > at_us)))


def resolve(
    obs: DataFrame,
    strategy: str | Column,
    *,
    ranking: tuple[str, ...] | Column = RANKING,
    eligible: Column | None = None,
    fallback: str | Column = "source_priority",
) -> DataFrame:
    """(entity_id, field, value, source, n_candidates, conflicted, needs_review, reason) of each field with a value.

    Only ``eligible`` observations win, unless a field has none. ``strategy``, ``ranking`` and ``fallback`` may be
    columns, constant within a field. The newest value of the best ranked source decides where clocks differ; what no
    rule can order safely asks for review. Ties go to the later arrival. One aggregation with every strategy's winner:
    no window, no self-join; equal (value, source) pairs are pre-aggregated.
    """
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    ranks = ranking if isinstance(ranking, Column) else F.array(*[F.lit(s) for s in ranking]).cast("array<string>")
    live = obs.filter(F.col("value").isNotNull()).withColumns(
        {
            "_e": F.coalesce(eligible, F.lit(False)).cast("int") if eligible is not None else F.lit(1),
            "_strategy": column(strategy),
            "_fallback": column(fallback),
            "_rank": F.array_position(ranks, F.col("source")),
        }
    )
    newest = [F.col("observed_us"), F.col("id")]
    keys = {
        "newest": F.struct("_e", *[c.alias(f"k{i}") for i, c in enumerate(newest)]),
        "oldest": F.struct("_e", (-newest[0]).alias("k0"), (-newest[1]).alias("k1")),
        "sure": F.struct("_e", F.col("confidence").alias("k0"), newest[0].alias("k1"), newest[1].alias("k2")),
        "human": F.when(F.col("kind") == "user", F.struct("_e", newest[0].alias("k0"), newest[1].alias("k1"))),
        "ranked": F.when(F.col("_rank") > 0, F.struct("_e", (-F.col("_rank")).alias("k0"), newest[0].alias("k1"), newest[1].alias("k2"))),
    }
    grouped = live.groupBy("entity_id", "field", "value", "source", "_e").agg(
        *[F.max(k).alias(n) for n, k in keys.items()], F.first("_strategy").alias("_strategy"), F.first("_fallback").alias("_fallback"), F.count(F.lit(1)).alias("n")
    )
    who = F.struct("value", "source")
    sources = lambda e: F.count_distinct(F.when(F.col("_e") >= e, F.col("source")))
    found = grouped.groupBy("entity_id", "field").agg(
        *[F.max_by(who, n).alias(f"{n}_won") for n in keys],
        *[F.max(n).alias(n) for n in keys],
        F.max("_e").alias("_e"),
        sources(1).alias("_s1"),
        sources(0).alias("_s0"),
        F.sum("n").alias("n_candidates"),
        (F.count_distinct("value") > 1).alias("conflicted"),
        F.first("_strategy").alias("_strategy"),
        F.first("_fallback").alias("_fallback"),
    )
    # A winner of the wrong eligibility is none; one clock can order its own values.
    has = {n: F.coalesce(F.col(f"{n}._e") == F.col("_e"), F.lit(False)) for n in ("human", "ranked")}
    one = F.when(F.col("_e") == 1, F.col("_s1")).otherwise(F.col("_s0")) == 1
    plan = F.when((F.col("_strategy") == "human_wins") & has["human"], "human")
    plan = plan.when((F.col("_strategy") == "human_wins") & F.col("_fallback").isin("manual", "human_wins"), "source_priority")
    plan = plan.when(F.col("_strategy") == "human_wins", F.col("_fallback")).otherwise(F.col("_strategy"))
    choices = [  # (when, winner, review, reason)
        ((F.col("_plan") == "manual"), "newest", True, F.lit("manual policy: escalated to review")),
        ((F.col("_plan") == "human"), "human", False, F.lit("human edit")),
        ((F.col("_plan") == "never_overwrite"), "oldest", False, F.lit("first value sticks")),
        ((F.col("_plan") == "most_confident"), "sure", False, F.format_string("highest confidence (%.2f)", "sure.k0")),
        ((F.col("_plan") == "most_recent") & one, "newest", False, F.lit("most recent within source")),
        ((F.col("_plan") == "most_recent") & has["ranked"], "ranked", True, F.concat(F.lit("most_recent across sources: fell back to ranking ("), F.col("ranked_won.source"), F.lit(")"))),
        ((F.col("_plan") == "most_recent"), "newest", True, F.lit("most_recent across sources: clocks are not comparable, escalated")),
        (has["ranked"], "ranked", False, F.concat(F.lit("source priority: "), F.col("ranked_won.source"))),
        (one, "newest", False, F.lit("single source, most recent")),
        (F.lit(True), "sure", True, F.lit("no ranked source present: highest confidence, escalated")),
    ]

    def pick(value) -> Column:
        out = None
        for choice in choices:
            out = F.when(choice[0], value(choice)) if out is None else out.when(choice[0], value(choice))
        return out

    found = found.withColumn("_plan", plan).withColumns(
        {"_won": pick(lambda c: F.col(f"{c[1]}_won")), "needs_review": pick(lambda c: F.lit(c[2])), "reason": pick(lambda c: c[3])}
    )
    return found.select("entity_id", "field", "_won.value", "_won.source", "n_candidates", "conflicted", "needs_review", "reason")


def resolve_by_policy(obs: DataFrame, policies: DataFrame) -> DataFrame:
    """``resolve`` with each field's own strategy, ranking, fallback and sources (``policies`` of ``PolicySet.frame``)."""
    rows = with_policy(obs, policies)
    accepted = accepts(F.col("source"), F.col("kind"), F.col("winners"))
    return resolve(rows, F.col("strategy"), ranking=F.col("ranking"), eligible=accepted, fallback=F.col("fallback"))


def provenance(obs: DataFrame, resolved: DataFrame, at_us: int) -> DataFrame:
    """Every observation with whether it is live and whether its (value, source) is the field's current one."""
    won = resolved.select("entity_id", "field", F.col("value").alias("_value"), F.col("source").alias("_source"), "reason")
    rows = obs.join(won, ["entity_id", "field"], "left")
    current = F.col("value").eqNullSafe(F.col("_value")) & F.col("source").eqNullSafe(F.col("_source"))
    is_live = F.col("expires_us").isNull() | (F.col("expires_us") > at_us)
    return rows.withColumns({"live": is_live, "current": current & is_live}).drop("_value", "_source")


def conflict_log(resolved: DataFrame, at_us: int) -> DataFrame:
    """(entity_id, field, value, source, n_candidates, reason, needs_review, resolved_us, reviewed) of disputed fields."""
    kept = resolved.filter("conflicted").drop("conflicted")
    return kept.withColumns({"resolved_us": F.lit(at_us).cast("bigint"), "reviewed": F.lit(False)})


def current_record(resolved: DataFrame, fields: list[str]) -> DataFrame:
    """One row per entity with a column for each field."""
    columns = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return resolved.groupBy("entity_id").agg(*columns)


def top_conflicting_fields(resolved: DataFrame, k: int) -> DataFrame:
    n = resolved.filter("conflicted").groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "field").limit(k)


def select_observations(obs: DataFrame, *, entity_id=None, field: str | None = None, source: str | None = None, as_of_us: int | None = None, superseded: bool = True) -> DataFrame:
    """Observations by entity, field and source, known at a time, with or without those that newer ones superseded."""
    for column, value in (("entity_id", entity_id), ("field", field), ("source", source)):
        obs = obs if value is None else obs.filter(F.col(column) == value)
    obs = obs if as_of_us is None else obs.filter(F.col("recorded_us") <= as_of_us)
    return obs if superseded else obs.filter(F.col("superseded_by").isNull())


def fields_for(obs: DataFrame) -> DataFrame:
    """(entity_id, field): which fields each entity has."""
    return obs.select("entity_id", "field").distinct()


def expires_us(field: Column, observed_us: Column, ttl_days: dict[str, int | None]) -> Column:
    """When a value of the field goes stale; null: never."""
    known = {k: v for k, v in ttl_days.items() if v is not None}
    if not known:
        return F.lit(None).cast("bigint")
    days = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), field)
    return observed_us + days.cast("bigint") * F.lit(DAY_US)


def apply_ttls(obs: DataFrame, ttl_days: dict[str, int | None]) -> DataFrame:
    """Observations with expires_us filled in where it is null."""
    return obs.withColumn("expires_us", F.coalesce("expires_us", expires_us(F.col("field"), F.col("observed_us"), ttl_days)))
