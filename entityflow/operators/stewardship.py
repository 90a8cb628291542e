"""What keeps a resolved store healthy: merges, staleness, reconciliation, retries, review order and suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.operators.resolve import DAY_US
from entityflow.session import materialize

#: Days after which a field is stale; a field without an entry counts as 365 in re-enrichment.
TTL_DAYS = {
    "job_title": 90, "company": 90, "normalized_company": 90, "email": 180, "phone": 180, "employee_count": 180, "industry": 365,
    "founded_year": None, "first_name": None, "last_name": None,
}


def latest(obs: DataFrame) -> DataFrame:
    """The newest observation of each source per entity and field that none superseded; one aggregation."""
    if "superseded_by" in obs.columns:
        obs = obs.filter("superseded_by is null")
    newest = F.max_by(F.struct("id", "value", "observed_us"), F.struct("observed_us", "id")).alias("o")
    return obs.groupBy("entity_id", "field", "source").agg(newest).select("entity_id", "field", "source", "o.*")


def canonical(merges: DataFrame) -> DataFrame:
    """(id, canonical) of every id merged away, by pointer doubling over its newest merge that was not reverted.

    ``merges`` has merged_id, surviving_id, decided_us and reverted; the newest merges must not form a cycle. Rounds grow
    with the logarithm of the longest chain, each is written to the shared folder.
    """
    newest = merges.filter("not reverted").groupBy(F.col("merged_id").alias("id"))
    hops = materialize(newest.agg(F.max_by("surviving_id", F.struct("decided_us", "surviving_id")).alias("canonical")), "merges")
    while True:
        onward = hops.select(F.col("id").alias("via"), F.col("canonical").alias("end"))
        joined = hops.join(onward, hops["canonical"] == onward["via"], "left")
        moved = joined.select("id", F.coalesce("end", "canonical").alias("canonical"), F.col("end").isNotNull().alias("moved"))
        moved = materialize(moved, "merges")
        hops = moved.select("id", "canonical")
        if moved.filter("moved").isEmpty():
            return hops


def reenrichment(entities: DataFrame, at_us: int, *, field: str = "job_title", budget: int = 100, min_engagement: int = 1) -> DataFrame:
    """The ``budget`` stale entities with most engagement, the longest untouched first, never enriched ones last in a tie."""
    old = at_us - (TTL_DAYS.get(field) or 365) * DAY_US
    stale = entities.filter((F.col("engagement") >= min_engagement) & (F.col("enriched_us").isNull() | (F.col("enriched_us") <= old)))
    return stale.orderBy(F.desc("engagement"), F.asc_nulls_last("enriched_us"), "entity_id").limit(budget)


def reconcile(known: DataFrame, remote: DataFrame) -> DataFrame:
    """(field, checked, discrepancies, rate) of remote values against ours; an unknown value is a discrepancy."""
    ours = known.select("entity_id", "field", F.col("value").alias("ours"))
    both = remote.select("entity_id", "field", "value").join(ours, ["entity_id", "field"], "left")
    wrong = F.count_if(~F.col("value").eqNullSafe(F.col("ours")))
    n = F.count(F.lit(1))
    return both.groupBy("field").agg(n.alias("checked"), wrong.alias("discrepancies"), (wrong / n).alias("rate"))


def retries(failures: DataFrame, *, max_attempts: int = 5, base: int = 1, cap: int = 300) -> DataFrame:
    """(key, attempts, backoff, dead) of failed deliveries; ``backoff`` in seconds doubles up to ``cap``."""
    n = F.col("attempts")
    wait = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(n - 1, F.lit(30)))).cast("bigint")
    counted = failures.groupBy("key").agg(F.count(F.lit(1)).alias("attempts"))
    return counted.withColumns({"backoff": wait, "dead": n >= max_attempts})


def pair_priority(score: Column) -> Column:
    """Pairs near one half first."""
    return 1 - 2 * F.abs(score - 0.5)


def review_queue(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` pairs that review should see first; ``scored`` may bring its ``priority``."""
    if "priority" not in scored.columns:
        scored = scored.withColumn("priority", F.round(pair_priority(F.col("score")), 6))
    return scored.orderBy(F.desc("priority"), "l", "r").limit(k)


def unsuppressed(candidates: DataFrame, suppressed: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not suppressed; a null key is kept."""
    return candidates.join(suppressed.select(key), key, "left_anti")


def distribution_shift(before: DataFrame, after: DataFrame, *, tolerance: float = 0.25) -> DataFrame:
    """(at_least, before, after, alert): shares of clusters of 2, 5, 10 or more in two histograms (size, n)."""
    both = before.select("size", F.col("n").alias("b"), F.lit(0).cast("bigint").alias("a"))
    both = both.unionByName(after.select("size", F.lit(0).cast("bigint").alias("b"), F.col("n").alias("a")))
    share = lambda side, k: F.coalesce(F.try_divide(F.sum(F.when(F.col("size") >= k, F.col(side)).otherwise(0)), F.sum(side)), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(k).alias("at_least"), F.col(f"b{k}").alias("before"), F.col(f"a{k}").alias("after")) for k in (2, 5, 10)])
    shares = both.agg(*[share(side, k).alias(f"{side}{k}") for side in "ba" for k in (2, 5, 10)])
    found = shares.select(F.inline(rows))
    return found.withColumn("alert", (F.col("after") > F.col("before") * (1 + tolerance)) & (F.col("before") > 0))


def alert_if_rising(rates: DataFrame, *, factor: float = 2.0) -> DataFrame:
    """``rates`` (source, run_us, rate) with ``alert`` where a source's rate is over ``factor`` times the run before's."""
    before = F.lag("rate").over(Window.partitionBy("source").orderBy("run_us"))
    return rates.withColumn("alert", F.coalesce((before > 0) & (F.col("rate") > before * factor), F.lit(False)))


def merged_into(merges: DataFrame) -> DataFrame:
    """(survivor, id): every entity that resolves to each survivor, over any number of merges."""
    return canonical(merges).select(F.col("canonical").alias("survivor"), "id")


def unmerge(merges: DataFrame, undo: DataFrame, at_us: int) -> DataFrame:
    """``merges`` with the newest active merge of each ``undo`` (merged_id, reason) marked as reverted."""
    newest = merges.filter("not reverted").groupBy("merged_id").agg(F.max("decided_us").alias("_last"))
    marked = merges.join(newest.join(undo.select("merged_id", F.col("reason").alias("_why")), "merged_id"), "merged_id", "left")
    hit = ~F.col("reverted") & F.coalesce(F.col("decided_us") == F.col("_last"), F.lit(False))
    return marked.withColumns(
        {"reverted": F.col("reverted") | hit, "reverted_us": F.when(hit, F.lit(at_us)), "revert_reason": F.when(hit, F.col("_why"))}
    ).drop("_last", "_why")


def links_for(links: DataFrame, merges: DataFrame) -> DataFrame:
    """``links`` (entity_id, source, source_record_id, ...) with ``canonical``, the entity that survives its merges."""
    top = canonical(merges).select(F.col("id").alias("entity_id"), "canonical")
    return links.join(top, "entity_id", "left").withColumn("canonical", F.coalesce("canonical", "entity_id"))
