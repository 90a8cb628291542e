"""Enrichment: providers' claims as observations, and the bake-off that tells which provider to trust with which field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.operators import resolve
from entityflow.operators.stewardship import TTL_DAYS


@dataclass(frozen=True)
class StaticProvider:
    """A provider backed by a table (key, field, value, confidence): every record asked for costs one call."""

    name: str
    answers: DataFrame
    cost: float = 1.0

    def enrich(self, records: DataFrame) -> DataFrame:
        """(key, provider, field, value, confidence, cost, matched): a row a field, or one without a field if it knows nothing."""
        kinds = dict(self.answers.dtypes)
        confidence = F.coalesce("confidence", F.lit(0.5)) if "confidence" in kinds else F.lit(0.8)
        known = self.answers.select("key", "field", "value", confidence.alias("confidence"), F.lit(True).alias("matched"))
        found = records.select("key").join(known, "key", "left")
        first = F.row_number().over(Window.partitionBy("key").orderBy("field")) == 1
        return found.select(
            "key", F.lit(self.name).alias("provider"), "field", "value", "confidence",
            F.when(first, self.cost).otherwise(0.0).alias("cost"), F.coalesce("matched", F.lit(False)).alias("matched"),
        )


def claims_as_observations(results: DataFrame, observed_us: int, *, ttl_days: dict[str, int | None] | None = None) -> DataFrame:
    """What providers answered, as observations with a confidence and an expiry; which of them wins is the policy's business."""
    told = results.filter("matched and value is not null")
    seen = F.lit(observed_us).cast("bigint")
    return told.select(
        F.col("key").alias("entity_id"), "field", "value", F.col("provider").alias("source"), F.lit("enrichment").alias("kind"),
        "confidence", seen.alias("observed_us"), seen.alias("recorded_us"),
        resolve.expires_us(F.col("field"), seen, {**TTL_DAYS, **(ttl_days or {})}).alias("expires_us"),
    )


def coverage(results: DataFrame) -> DataFrame:
    """(provider, coverage): the share of records for which anything came back."""
    n, hit = F.count_distinct("key"), F.count_distinct(F.when(F.col("matched"), F.col("key")))
    return results.groupBy("provider").agg((hit / n).alias("coverage"))


def tolerant_equal(a: Column, b: Column) -> Column:
    """Texts alike but for case and outer blanks; numbers within a fifth of the larger one, which counts as one at least."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) <= 0.2
    return F.when(x.isNotNull() & y.isNotNull(), near).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))


def cost_per_correct_field(scores: DataFrame) -> DataFrame:
    """(provider, cost, correct, per_correct) over the rows of ``bake_off``; null where nothing was correct."""
    found = scores.groupBy("provider").agg(F.sum("cost").alias("cost"), F.sum("correct").alias("correct"))
    return found.withColumn("per_correct", F.when(F.col("correct") > 0, F.col("cost") / F.col("correct")))


def by_field(scores: DataFrame) -> DataFrame:
    """``scores`` with ``place``: a field's providers by accuracy, then coverage, then name."""
    order = Window.partitionBy("field").orderBy(F.desc("accuracy"), F.desc("coverage"), "provider")
    return scores.withColumn("place", F.row_number().over(order))


def recommended_policy(scores: DataFrame) -> DataFrame:
    """(field, ranking): the providers with any correct value, best first, as a policy's source ranking."""
    placed = by_field(scores).filter("correct > 0")
    ranked = F.array_sort(F.collect_list(F.struct("place", "provider")))
    return placed.groupBy("field").agg(F.transform(ranked, lambda x: x["provider"]).alias("ranking"))


source_ranking = recommended_policy


def render(scores: DataFrame) -> str:
    """A report for people; scores have a row a provider and field."""
    lines = []
    for r in by_field(scores).orderBy("field", "place").collect():
        lines.append(f"{r.field:<16} {r.provider:<14} coverage {r.coverage:6.1%}  accuracy {r.accuracy:6.1%}  ({r.correct} correct / {r.returned} returned)")
    for r in cost_per_correct_field(scores).orderBy("provider").collect():
        lines.append(f"{r.provider:<14} {r.cost:.1f} credits, " + (f"{r.per_correct:.3f}" if r.per_correct is not None else "n/a") + " a correct field")
    return "\n".join(lines)
