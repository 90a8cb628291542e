"""Fellegi-Sunter linkage: comparison levels, term frequencies, training by labels or by EM, scores and explanations.

A comparison is a field with ordered levels of agreement, each with the probabilities m and u of reaching it in a match
and in a pair of different people. Pairs become level patterns in the JVM and two Arrow functions; training reads only the
counts of patterns, of which there are at most the product of the level counts, whatever the number of pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.functions.text import jaro_winkler, token_set_ratio
from entityflow.operators.matching import probability

NULL = -1
_LEAST = 1e-9


@dataclass(frozen=True)
class Level:
    """A level: its name, how it is reached (exact, jw, token_set, local_part, else), its m and u."""

    name: str
    kind: str
    m: float
    u: float
    at: float = 0.0

    @property
    def weight(self) -> float:
        return math.log2(max(self.m, _LEAST) / max(self.u, _LEAST))

    def reached(self, a: Column, b: Column, similarity: Column) -> Column:
        local = lambda c: F.split_part(c, F.lit("@"), F.lit(1))
        return {
            "exact": lambda: a == b,
            "jw": lambda: similarity >= self.at,
            "token_set": lambda: token_set_ratio(a, b) >= self.at,
            "local_part": lambda: local(a) == local(b),
            "else": lambda: F.lit(True),
        }[self.kind]()


@dataclass(frozen=True)
class Comparison:
    field: str
    levels: tuple[Level, ...]
    term_frequencies: bool = True

    def level(self, a: Column, b: Column) -> Column:
        """The first level that is reached; ``NULL`` where a side is null or empty."""
        # One expression for all levels, so that Python compares a pair once.
        similarity = jaro_winkler(a, b) if any(x.kind == "jw" for x in self.levels) else F.lit(0.0)
        out = F.when(F.nullif(a, F.lit("")).isNull() | F.nullif(b, F.lit("")).isNull(), NULL)
        for k, level in enumerate(self.levels[:-1]):
            out = out.when(level.reached(a, b, similarity), k)
        return out.otherwise(len(self.levels) - 1)


def _levels(*levels: tuple) -> tuple[Level, ...]:
    return tuple(Level(*x) for x in levels)


# Levels and their starting m and u.
def name_comparison(column: str, *, tf: bool = True) -> Comparison:
    return Comparison(column, _levels(("exact", "exact", 0.85, 0.02), ("very_close", "jw", 0.08, 0.03, 0.92), ("close", "jw", 0.04, 0.05, 0.85), ("different", "else", 0.03, 0.90)), tf)


def email_comparison(column: str = "email") -> Comparison:
    return Comparison(column, _levels(("exact", "exact", 0.70, 0.001), ("same_local_part", "local_part", 0.10, 0.005), ("close", "jw", 0.05, 0.01, 0.93), ("different", "else", 0.15, 0.984)))


def company_comparison(column: str = "normalized_company") -> Comparison:
    return Comparison(column, _levels(("exact", "exact", 0.70, 0.02), ("jw_0.9", "jw", 0.12, 0.03, 0.90), ("token_overlap", "token_set", 0.08, 0.05, 0.6), ("different", "else", 0.10, 0.90)))


def exact_comparison(column: str, *, m: float = 0.60, u: float = 0.001, tf: bool = True) -> Comparison:
    return Comparison(column, _levels(("exact", "exact", m, u), ("different", "else", 1 - m, 1 - u)), tf)


def default_comparisons() -> tuple[Comparison, ...]:
    return (
        email_comparison(),
        name_comparison("first_name_canonical"),
        name_comparison("last_name"),
        company_comparison(),
        exact_comparison("phone_e164", m=0.45, u=0.0005),
    )


@dataclass(frozen=True)
class Model:
    """Comparisons with their probabilities, the prior share of matches among pairs, and how they were fitted."""

    comparisons: tuple[Comparison, ...] = field(default_factory=default_comparisons)
    prior: float = 1e-4
    report: dict = field(default_factory=dict)

    @property
    def prior_weight(self) -> float:
        return math.log2(self.prior / (1 - self.prior))

    def weights_table(self) -> list[tuple[str, str, float, float, float]]:
        """(field, level, m, u, weight) of every level."""
        return [(c.field, x.name, x.m, x.u, x.weight) for c in self.comparisons for x in c.levels]


def sided(pairs: DataFrame, records: DataFrame, comparisons: tuple[Comparison, ...]) -> DataFrame:
    """``pairs`` (l, r, ...) with a struct of the compared fields of either record; pairs of unknown records go."""
    for side in ("l", "r"):
        values = F.struct(*[F.col(c.field).cast("string").alias(c.field) for c in comparisons])
        pairs = pairs.join(records.select(F.col("key").alias(side), values.alias(f"{side}_values")), side)
    return pairs


def patterns(pairs: DataFrame, records: DataFrame, model: Model) -> DataFrame:
    """``pairs`` with ``levels``, an array with the level of each comparison, and the sides' values."""
    both = sided(pairs, records, model.comparisons)
    levels = [c.level(F.col(f"l_values.{c.field}"), F.col(f"r_values.{c.field}")).cast("int") for c in model.comparisons]
    # Levels are made by a projection of their own, so that Python's part is not repeated by what reads them.
    return both.withColumn("levels", F.array(*levels))


def term_frequencies(records: DataFrame, model: Model) -> DataFrame:
    """(field, value, share): how frequent each value is among a field's values that are not empty."""
    fields = [c.field for c in model.comparisons if c.term_frequencies]
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    counted = records.select(values.alias("v")).select("v.*").filter("coalesce(value, '') <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("field").agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(totals), "field").select("field", "value", (F.col("n") / F.col("total")).alias("share"))


def score_pairs(pairs: DataFrame, records: DataFrame, model: Model) -> DataFrame:
    """(l, r, ..., levels, weight, score): log2 odds of the levels, of the agreeing values' rarity and of the prior."""
    kept = pairs.columns
    found = patterns(pairs, records, model)
    frequencies = term_frequencies(records, model)
    total = F.lit(model.prior_weight)
    for k, c in enumerate(model.comparisons):
        level = F.col("levels")[k]
        for i, x in enumerate(c.levels):
            total = total + F.when(level == i, x.weight).otherwise(0.0)
        if c.term_frequencies:
            share = frequencies.filter(F.col("field") == c.field).select(F.col("value").alias(f"_v{k}"), F.col("share").alias(f"_f{k}"))
            exact = F.when(level == 0, F.col(f"l_values.{c.field}"))
            found = found.withColumn(f"_e{k}", exact).join(share, F.col(f"_e{k}") == F.col(f"_v{k}"), "left")
            rare = F.log2(F.lit(max(c.levels[0].u, _LEAST)) / F.greatest(F.col(f"_f{k}") * F.col(f"_f{k}"), F.lit(1e-12)))
            total = total + F.when(F.col(f"_f{k}").isNotNull(), rare).otherwise(0.0)
    return found.select(*kept, "levels", total.alias("weight")).withColumn("score", probability(F.col("weight")))


def explain(model: Model, levels: Column) -> Column:
    """What a pair agrees and differs on, and what has no data, in words."""
    name = {k: F.when(levels[k] == NULL, "null") for k in range(len(model.comparisons))}
    for k, c in enumerate(model.comparisons):
        for i, x in enumerate(c.levels):
            name[k] = name[k].when(levels[k] == i, x.name)
    said = []
    for text, names in (("matched on ", ("exact", "very_close")), ("differed on ", ("different",)), ("no data for ", ("null",))):
        fields = F.array_compact(F.array(*[F.when(name[k].isin(*names), c.field) for k, c in enumerate(model.comparisons)]))
        said.append(F.when(F.size(fields) > 0, F.concat(F.lit(text), F.array_join(fields, ", "))))
    return F.coalesce(F.nullif(F.concat_ws("; ", *said), F.lit("")), F.lit("no comparable fields"))


def _counted(found: DataFrame, *keys: str) -> list:
    """Rows of (levels, keys, n): at most the product of the comparisons' level counts, so the driver can hold them."""
    return found.groupBy("levels", *keys).agg(F.count(F.lit(1)).alias("n")).collect()


def _fitted(model: Model, counts: list[tuple[tuple[int, ...], float, float]], smoothing: float) -> tuple[Comparison, ...]:
    """Comparisons with smoothed shares of (pattern, weight among matches, weight among others)."""
    out = []
    for k, c in enumerate(model.comparisons):
        sums = [[0.0, 0.0] for _ in c.levels]
        for levels, match, other in counts:
            if levels[k] != NULL:
                sums[levels[k]][0] += match
                sums[levels[k]][1] += other
        totals = [sum(s[j] for s in sums) + smoothing * len(sums) for j in (0, 1)]
        levels = tuple(replace(x, m=(s[0] + smoothing) / totals[0], u=(s[1] + smoothing) / totals[1]) for x, s in zip(c.levels, sums, strict=True))
        out.append(replace(c, levels=levels))
    return tuple(out)


def fit_supervised(labelled: DataFrame, records: DataFrame, model: Model | None = None, *, smoothing: float = 1.0) -> Model:
    """m from labelled matches, u from labelled non-matches, the prior from their share; ``labelled`` has l, r, is_match."""
    model = model or Model()
    rows = [(tuple(r.levels), r.n * bool(r.is_match), r.n * (not r.is_match)) for r in _counted(patterns(labelled.select("l", "r", "is_match"), records, model), "is_match")]
    matches, others = (sum(r[j] for r in rows) for j in (1, 2))
    prior = max(1e-6, min(0.5, matches / (matches + others))) if rows else model.prior
    report = {"method": "supervised", "matches": matches, "non_matches": others, "prior": prior}
    return Model(_fitted(model, rows, smoothing), prior, report)


def fit_em(pairs: DataFrame, records: DataFrame, model: Model | None = None, *, iterations: int = 20, tolerance: float = 1e-6, smoothing: float = 1.0) -> Model:
    """Expectation-maximisation over the counts of patterns, under independence of the comparisons given the class.

    Without a pair the model stays untrained. The log-likelihood reported is that of the iteration before the last.
    """
    model = model or Model()
    rows = [(tuple(r.levels), r.n) for r in sorted(_counted(patterns(pairs.select("l", "r"), records, model)), key=lambda r: r.levels)]
    if not rows:
        return replace(model, report={"method": "em", "pairs": 0})
    total, share, likelihood, done = sum(n for _, n in rows), max(model.prior, 1e-4), None, 0
    for done in range(1, iterations + 1):
        now, split = 0.0, []
        for levels, n in rows:
            p = [share, 1 - share]
            for c, k in zip(model.comparisons, levels, strict=True):
                if k != NULL:
                    p = [p[0] * c.levels[k].m, p[1] * c.levels[k].u]
            match = p[0] / sum(p) if sum(p) else 0.0
            now += n * math.log(max(sum(p), 1e-300))
            split.append((levels, n * match, n * (1 - match)))
        model = replace(model, comparisons=_fitted(model, split, smoothing))
        share = max(1e-6, min(0.5, sum(m for _, m, _ in split) / total))
        if likelihood is not None and abs(now - likelihood) < tolerance:
            break
        likelihood = now
    report = {"method": "em", "pairs": total, "distinct_patterns": len(rows), "iterations": done, "prior": share, "log_likelihood": likelihood}
    return Model(model.comparisons, share, report)


def weights_frame(spark, model: Model) -> DataFrame:
    """(field, level, m, u, weight) as a table."""
    return spark.createDataFrame(model.weights_table(), "field string, level string, m double, u double, weight double")
