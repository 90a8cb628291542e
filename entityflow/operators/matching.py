"""Candidate pairs, Fellegi-Sunter scores, bands and what review says about them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.functions.text import ROLE_LOCAL_PARTS
from entityflow.session import materialize

MAX_BLOCK = 1000
#: Records of a large block that are dealt together.
PART = 1000


def composite(*parts: Column) -> Column:
    """The parts as one key; null if any of them is null or empty."""
    texts = [p.cast("string") for p in parts]
    full = F.forall(F.array(*texts), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(full, F.concat_ws("|", *texts))


def blocking_rules() -> dict[str, Column]:
    """The five blocking keys over the columns of ``normalize_record``."""
    c = F.col
    return {
        "domain_and_surname": composite(c("email_domain"), c("last_name_dm")),
        "company_and_first_initial": composite(c("normalized_company"), c("first_initial")),
        "phone": composite(c("phone_e164")),
        "full_name_phonetic": composite(c("first_name_dm"), c("last_name_dm")),
        "email_local_part": composite(F.split_part(c("email"), F.lit("@"), F.lit(1))),
    }


def deterministic_rules() -> dict[str, tuple[Column, float]]:
    """The four sure rules (key, confidence), surest first: fixed values. Role addresses and unverified phones have no key."""
    local = F.split_part(F.col("email"), F.lit("@"), F.lit(1))
    person = F.col("email").contains("@") & ~local.isin(*ROLE_LOCAL_PARTS)
    return {
        "same_external_id": (composite(F.col("source"), F.col("external_id")), 1.0),
        "normalized_email": (F.when(person, F.col("email")), 0.99),
        "linkedin_url": (composite(F.col("linkedin")), 0.97),
        "verified_phone_and_last_name": (F.when(F.col("phone_verified"), composite(F.col("phone_e164"), F.col("last_name"))), 0.95),
    }


def key_index(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, block, key): which records share which key; a record without a rule's key has no row for it."""
    blocks = F.array(*[F.struct(F.lit(n).alias("rule"), F.nullif(c, F.lit("")).alias("block")) for n, c in rules.items()])
    keyed = records.select("key", F.explode(blocks).alias("b")).filter("b.block is not null")
    return keyed.select("b.rule", "b.block", "key")


def _held(records: DataFrame, rules: dict[str, Column], max_block: int | None) -> DataFrame:
    """(key, held): each key once with its blocks (block, n) of several records and at most ``max_block``, by rule in order of name."""
    keyed = key_index(records, rules)
    sizes = keyed.groupBy("rule", "block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    used = keyed.join(sizes if max_block is None else sizes.filter(F.col("n") <= max_block), ["rule", "block"])
    blocks = [F.sort_array(F.collect_set(F.when(F.col("rule") == n, F.struct("block", "n")))) for n in sorted(rules)]
    return materialize(used.groupBy("key").agg(F.array(*blocks).alias("held")), "blocks")


def _dealt(rows: DataFrame, names: list[str], columns: list[str], name: str, own: str, other: str) -> DataFrame:
    """A side of a join of blocks: a row of ``rows`` for each block and part that it meets, its columns prefixed by ``name``.

    A block of more than ``PART`` records is dealt in parts, and its pairs are made part against part, so that a large
    block is spread over as many keys of the join as it has pairs of parts.
    """
    at = lambda k: F.transform(F.col("held")[k], lambda x: F.struct(F.lit(k).alias("rule"), x["block"].alias("block"), F.ceil(x["n"] / PART).cast("int").alias("parts")))
    used = rows.select("key", *columns, "_same", *[F.get(F.col("held")[k], F.lit(0))["block"].alias(f"_block{k}") for k in range(len(names))], F.explode(F.concat(*map(at, range(len(names))))).alias("at"))
    part, every = F.pmod(F.xxhash64("key"), F.col("at.parts")).cast("int"), F.sequence(F.lit(0), F.col("at.parts") - 1)
    told = [F.col(f"_block{k}").alias(f"{name}_block{k}") for k in range(len(names))]
    carried = [F.col(c).alias(f"{name}_{c}") for c in columns]
    return used.select(F.col("at.rule").alias("_rule"), F.col("at.block").alias("_block"), "_same", part.alias(own), F.explode(every).alias(other), F.col("key").alias(name), *carried, *told)


def _pairs(records: DataFrame, rules: dict[str, Column], max_block: int | None, columns: list[str], within: str | None, of) -> DataFrame:
    """(l, r, ``columns`` of both, ``of`` whether they share a block of each rule): each pair of rows once, l < r."""
    held = rows = _held(records, rules, max_block)
    if columns:  # rows of their own, also where a key has several
        rows = records.select("key", *columns).join(rows, "key")
    return _paired(rows, held, records, sorted(rules), columns, within, of)


def _paired(rows: DataFrame, held: DataFrame, records: DataFrame, names: list[str], columns: list[str], within: str | None, of) -> DataFrame:
    """The pairs of ``rows`` (key, held, ``columns``).

    A key with one block of each rule brings them along, so that a pair is made in the first block it shares, and is
    neither shuffled nor grouped. Pairs with a key of several blocks of one rule, whose rows differ, are grouped.
    """
    rows = rows.withColumn("_same", F.lit(0) if within is None else F.col(within)).filter("_same is not null")
    several = F.greatest(F.lit(0), *[F.size(F.col("held")[k]) for k in range(len(names))]) > 1
    on = ["_rule", "_block", "_same", "_x", "_y"]
    side = lambda rows, *at: _dealt(rows, names, columns, *at)
    plain = rows if (alike := held.filter(several).isEmpty()) else rows.filter(~several)
    both = side(plain, "l", "_x", "_y").join(side(plain, "r", "_y", "_x"), on).filter("l < r")
    shares = [F.coalesce(F.col(f"l_block{k}") == F.col(f"r_block{k}"), F.lit(False)) for k in range(len(names))]
    first = F.lit(len(names) - 1)
    for k in range(len(names) - 2, -1, -1):
        first = F.when(shares[k], k).otherwise(first)
    sides = [f"{s}_{c}" for s in "lr" for c in columns]
    out = both.filter(F.col("_rule") == first).select("l", "r", *of(dict(zip(names, shares, strict=True))), *sides)
    if alike:
        return out
    # The others: distinct keys first, then their rows.
    keys = rows.select("key", "held", "_same").dropDuplicates(["key", "_same"])
    mixed = keys.filter(several)
    ends = lambda x, y: _dealt(x, names, [], "l", "_x", "_y").join(_dealt(y, names, [], "r", "_y", "_x"), on).filter("l < r").select("l", "r", "_rule")
    rest = ends(mixed, keys).unionByName(ends(keys.filter(~several), mixed)).groupBy("l", "r").agg(F.collect_set("_rule").alias("_rules"))
    for s in "lr" if columns else "":
        rest = rest.join(records.select(F.col("key").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]), s)
    rest = rest if within is None else rest.filter(F.col(f"l_{within}") == F.col(f"r_{within}"))
    return out.unionByName(rest.select("l", "r", *of({n: F.array_contains("_rules", k) for k, n in enumerate(names)}), *sides))


def classes(records: DataFrame, rules: dict[str, Column], max_block: int | None = MAX_BLOCK, columns: list[str] | None = None) -> DataFrame:
    """(key, keys, ``columns``, held), written: the records alike in their blocks and ``columns``, as one row.

    They are paired with the same records, and alike, so what is told of pairs can be told of pairs of classes. ``keys``
    is sorted; a class of more than ``PART`` records is dealt in several. ``key`` is a class's own: no two have the same
    least key and columns, as blocks go by key. Records without a block of several records are in no class.
    """
    columns, cores = columns or [], records.sparkSession.sparkContext.defaultParallelism
    if _repeated(records):
        rows = _held(records, rules, max_block)
        rows = records.select("key", *columns).join(rows, "key") if columns else rows
        rows = rows.withColumn("at", F.struct(*columns, "held"))
    else:
        counted = _counted(records, rules, max_block, columns).filter(F.exists("held", lambda x: F.size(x) > 0))
        rows = records.filter("key is not null").select("key", _place(rules, columns)).join(counted.select("at", "held"), "at")
    largest = F.array_max(F.transform(F.flatten("held"), lambda x: x["n"]))
    part = F.pmod(F.xxhash64("key"), F.ceil(largest / PART)).cast("int")
    alike = rows.groupBy("at", part.alias("_part")).agg(F.sort_array(F.collect_list("key")).alias("keys"), F.first("held").alias("held"))
    alike = alike.filter("size(keys) > 0").select("keys", *[F.col("at")[c].alias(c) for c in columns], "held")
    alike = alike.select(F.struct(F.col("keys")[0].alias("_least"), *columns).alias("key"), "*")
    return materialize(alike.repartition(4 * cores), "classes")


def _repeated(records: DataFrame) -> bool:
    """Whether a key has several rows."""
    return not records.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _place(rules: dict[str, Column], columns: list[str]) -> Column:
    """at: a record's ``columns`` and its block of each rule, by rule in order of name."""
    return F.struct(*columns, *[F.nullif(rules[n], F.lit("")).alias(f"_block{k}") for k, n in enumerate(sorted(rules))]).alias("at")


def _counted(records: DataFrame, rules: dict[str, Column], max_block: int | None, columns: list[str]) -> DataFrame:
    """(at, n, held): the records of each place counted, with the blocks that ``_held`` has for their keys, where none repeats.

    Blocks are counted from the places, not from a row for each record and rule.
    """
    counted = materialize(records.groupBy(_place(rules, columns)).agg(F.count(F.lit(1)).alias("every"), F.count("key").alias("n")), "counted")
    for k in range(len(rules)):
        block = F.col("at")[f"_block{k}"]
        sizes = counted.groupBy(block.alias(f"_b{k}")).agg(F.sum("every").alias(f"_n{k}")).filter(f"_b{k} is not null and _n{k} > 1")
        sizes = sizes if max_block is None else sizes.filter(F.col(f"_n{k}") <= max_block)
        counted = counted.join(sizes, block == F.col(f"_b{k}"), "left")
    one = lambda k: F.array(F.struct(F.col(f"_b{k}").alias("block"), F.col(f"_n{k}").alias("n")))
    held = F.array(*[F.filter(one(k), lambda x: x["n"].isNotNull()) for k in range(len(rules))])
    return counted.select("at", "n", held.alias("held"))


def class_pairs(alike: DataFrame, rules: dict[str, Column], of, columns: list[str] | None = None) -> DataFrame:
    """(l_keys, r_keys, own, ``of`` the shared rules, ``columns`` of both) of the pairs of ``classes`` whose records are paired.

    A class of several records is paired with itself too, as ``own``.
    """
    names, columns = sorted(rules), columns or []
    between = _paired(alike, alike, alike, names, [*columns, "keys"], None, lambda shares: [F.lit(False).alias("own"), *of(shares)])
    shares = {n: F.size(F.col("held")[k]) > 0 for k, n in enumerate(names)}
    both = lambda c: [F.col(c).alias(f"{s}_{c}") for s in "lr"]
    own = alike.filter("size(keys) > 1").select(F.lit(True).alias("own"), *of(shares), *[x for c in [*columns, "keys"] for x in both(c)])
    return between.select(*own.columns).unionByName(own)


def each_pair(pairs: DataFrame) -> DataFrame:
    """(l, r, ...): the pairs of records, l < r, of pairs of classes."""
    rest = [c for c in pairs.columns if c not in ("l_keys", "r_keys", "own")]
    one = pairs.select("own", "r_keys", *rest, F.explode("l_keys").alias("_x")).select("own", "_x", *rest, F.explode("r_keys").alias("_y"))
    one = one.filter((F.col("_x") < F.col("_y")) | ~F.col("own") & (F.col("_x") > F.col("_y")))
    return one.select(F.least("_x", "_y").alias("l"), F.greatest("_x", "_y").alias("r"), *rest)


def spanning_links(pairs: DataFrame) -> DataFrame:
    """(a, b): links that connect the records which the pairs of records of pairs of classes connect, and no others.

    The least record of either class meets all the other's: as many links as records, not as pairs.
    """
    star = lambda x, y: F.transform(y, lambda k: F.struct(F.least(x[0], k).alias("a"), F.greatest(x[0], k).alias("b")))
    l, r = F.col("l_keys"), F.col("r_keys")
    return pairs.select(F.explode(F.concat(star(l, r), star(r, l))).alias("e")).select("e.*").filter("a < b")


def first_pairs(pairs: DataFrame, first: Column, k: int) -> DataFrame:
    """The pairs of classes, cut to keys, that hold the ``k`` first of all pairs of records by ``first``, then l and r.

    ``first`` is one for all pairs of two classes. Pairs of classes go by their least pair: each of the ``k`` first holds
    one at least. A key with more than ``k`` before it in its class is in none of the ``k`` least pairs of two classes.
    """
    x, y, z = F.col("_l")[0], F.col("_r")[0], F.least(F.get("_l", F.lit(1)), F.get("_r", F.lit(1)))
    told = pairs.withColumns({"_l": F.array_distinct("l_keys"), "_r": F.array_distinct("r_keys")})
    told = told.withColumns({"_a": F.least(x, y), "_b": F.when(x == y, z).otherwise(F.greatest(x, y))}).filter("_b is not null")
    told = told.orderBy(first, "_a", "_b").limit(k)
    cut = lambda keys, known: F.filter(keys, lambda v: v <= F.coalesce(F.get(known, F.lit(k)), v))
    return told.withColumns({"l_keys": cut("l_keys", "_l"), "r_keys": cut("r_keys", "_r")}).drop("_l", "_r", "_a", "_b")


def candidate_pairs(records: DataFrame, rules: dict[str, Column], max_block: int | None = MAX_BLOCK, *, carry: list[str] | None = None, within: str | None = None) -> DataFrame:
    """(l, r, rules): distinct pairs of ``key`` that share a blocking key of at most ``max_block`` records.

    Larger blocks are left out by definition of the operator, and ``block_stats`` reports them; None leaves out none.
    Sizes are pre-aggregated. With columns to ``carry`` both rows' values come along as l_ and r_, a row for each pair of
    rows; ``within`` keeps the pairs that agree in a column, carried too (blocks are counted over all records).
    """
    columns = [*dict.fromkeys([*(carry or []), *([within] if within is not None else [])])]
    told = lambda shares: [F.concat_ws(",", *[F.when(c, n) for n, c in shares.items()]).alias("rules")]
    return _pairs(records, rules, max_block, columns, within, told)


def block_stats(records: DataFrame, rules: dict[str, Column], max_block: int = MAX_BLOCK) -> DataFrame:
    """(rule, blocks, oversized, skipped_pairs, pairs) of each rule, from block sizes alone."""
    blocks = F.array(*[F.struct(F.lit(n).alias("rule"), F.nullif(c, F.lit("")).alias("block")) for n, c in rules.items()])
    keyed = records.select(F.explode(blocks).alias("b")).select("b.rule", "b.block").filter("block is not null")
    sizes = keyed.groupBy("rule", "block").agg(F.count(F.lit(1)).alias("n"))
    big, n_pairs = F.col("n") > max_block, F.expr("n * (n - 1) div 2")
    return sizes.groupBy("rule").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(big).alias("oversized"),
        F.sum(F.when(big, n_pairs).otherwise(0)).alias("skipped_pairs"),
        F.sum(F.when(big, 0).otherwise(n_pairs)).alias("pairs"),
    )


def exact_weight(a: Column, b: Column, m: float, u: float) -> Column:
    """log2 of the likelihood ratio of an exact comparison; null sides say nothing."""
    same, other = math.log2(m / u), math.log2((1 - m) / (1 - u))
    return F.when(F.nullif(a, F.lit("")).isNull() | F.nullif(b, F.lit("")).isNull(), 0.0).when(a == b, same).otherwise(other)


def by_agreement(sides: dict[str, tuple[Column, Column]], levels: dict[str, tuple[float, float]], prior: float, of) -> Column:
    """``of`` (a weight) of the summed exact comparisons of ``levels`` (m, u), from a literal for each pattern of agreement.

    Weights take three values a field, so 3^n results, folded to literals, serve all pairs: for few fields.
    """
    weights, pattern = [F.lit(prior)], F.lit(0)
    for name, (m, u) in levels.items():
        a, b = sides[name]
        pattern = pattern * 3 + F.when(F.nullif(a, F.lit("")).isNull() | F.nullif(b, F.lit("")).isNull(), 0).when(a == b, 1).otherwise(2)
        cases = [exact_weight(F.lit(x), F.lit(y), m, u) for x, y in (("", ""), ("x", "x"), ("x", "y"))]
        weights = [w + c for w in weights for c in cases]
    return F.get(F.array(*map(of, weights)), pattern)


def probability(weight: Column) -> Column:
    odds = F.pow(F.lit(2.0), F.greatest(F.lit(-200.0), F.least(F.lit(200.0), weight)))
    return odds / (1 + odds)


def fit_exact(pairs: DataFrame, agree: dict[str, Column], label: Column, smooth: float = 1.0) -> DataFrame:
    """(field, m, u): Laplace-smoothed shares of agreement among labelled matches and non-matches; one aggregation."""
    y, one = F.col("_y"), []
    for k, n in enumerate(agree):
        c = F.col(f"_c{k}")
        share = lambda side, c=c: (F.count_if(side & c) + smooth) / (F.count_if(side & c.isNotNull()) + 2 * smooth)
        one.append(F.struct(F.lit(n).alias("field"), share(y).alias("m"), share(~y).alias("u"), F.count(c).alias("known")))
    known = pairs.select(label.alias("_y"), *[c.alias(f"_c{k}") for k, c in enumerate(agree.values())])
    found = known.agg(F.array(*one).alias("all")).select(F.inline("all"))
    return found.filter("known > 0").select("field", "m", "u")


def decide(score: Column, *, auto: float = 0.995, review: float = 0.80, enabled: bool = False) -> Column:
    return F.when(score >= auto, "auto_merge" if enabled else "review").when(score >= review, "review").otherwise("distinct")


def score_band(score: Column) -> Column:
    """Three fine bands from 0.99 on; below it steps of 0.05, whose last label is 0.94-0.99."""
    low = F.least(F.floor(score * 20 + 1e-9) / 20, F.lit(0.94))
    coarse = F.format_string("%.2f-%.2f", low, low + 0.05)
    return F.when(score >= 0.999, "0.999+").when(score >= 0.995, "0.995-0.999").when(score >= 0.99, "0.990-0.995").otherwise(coarse)


def precision_by_band(decisions: DataFrame, *, min_decisions: int = 500, min_precision: float = 0.999) -> DataFrame:
    """(band, decisions, precision, verdict); decisions without a score do not count."""
    n, good = F.count(F.lit(1)), F.count_if(F.col("human_match"))
    out = decisions.filter("model_score is not null").groupBy(score_band(F.col("model_score")).alias("band"))
    out = out.agg(n.alias("decisions"), (good / n).alias("precision"))
    safe = (F.col("decisions") >= min_decisions) & (F.col("precision") >= min_precision)
    return out.withColumn("verdict", F.when(safe, "PROMOTE").otherwise("HOLD"))


def disagreement(claims: DataFrame) -> DataFrame:
    """(field, left, right, n): records where two providers differ; a record has one claim per provider and field."""
    a, b = (claims.select("key", "field", F.col("provider").alias(p), F.col("value").alias(v)) for p, v in (("left", "x"), ("right", "y")))
    pairs = a.join(b, ["key", "field"]).filter("left < right and x <> y")
    return pairs.groupBy("field", "left", "right").agg(F.count(F.lit(1)).alias("n"))


def bake_off(claims: DataFrame, gold: DataFrame) -> DataFrame:
    """(provider, field, returned, missing, correct, coverage, accuracy, cost) against gold."""
    judged = gold.withColumnRenamed("value", "truth").join(claims, ["key", "field"])
    returned = F.count("value")
    correct = F.count_if(F.lower(F.trim("value")) == F.lower(F.trim("truth")))
    return judged.groupBy("provider", "field").agg(
        returned.alias("returned"),
        (F.count(F.lit(1)) - returned).alias("missing"),
        correct.alias("correct"),
        (returned / F.count(F.lit(1))).alias("coverage"),
        F.coalesce(F.try_divide(correct, returned), F.lit(0.0)).alias("accuracy"),
        F.sum("cost").alias("cost"),
    )


def deterministic_matches(records: DataFrame, rules: dict[str, tuple[Column, float]], max_block: int | None = None) -> DataFrame:
    """(l, r, rule, confidence): the surest rule of each pair that shares a key; of equals the rule named first.

    No block is too large unless ``max_block`` is given: large ones are dealt in parts. The rule is found for pairs of
    classes of records with the same keys, and their pairs are listed from it.
    """
    surest = sorted(rules, key=lambda n: -rules[n][1])  # stable

    def best(shares: dict[str, Column]) -> list[Column]:
        first = lambda value: F.coalesce(*[F.when(shares[n], value(n)) for n in surest])
        return [first(F.lit).alias("rule"), first(lambda n: F.lit(rules[n][1])).alias("confidence")]

    keys = {n: c for n, (c, _) in rules.items()}
    return each_pair(class_pairs(classes(records, keys, max_block), keys, best))


def with_blocks(records: DataFrame, rules: dict[str, Column], max_block: int | None = MAX_BLOCK) -> DataFrame:
    """The records with ``blocks``: their key's blocks by rule of which ``candidate_pairs`` makes pairs; null if none."""
    return records.join(_held(records, rules, max_block).select("key", F.transform("held", lambda x: F.transform(x, lambda y: y["block"])).alias("blocks")), "key", "left")


def shared_rules(a: Column, b: Column, rules: list[str]) -> Column:
    """What ``candidate_pairs`` says of two records with these ``blocks``: their shared rules; null if it does not make the pair."""
    at = [(a[k], b[k]) for k in range(len(rules))]
    share = lambda x, y: F.when((F.size(x) == 1) & (F.size(y) == 1), x[0] == y[0]).otherwise(F.arrays_overlap(x, y))
    return F.nullif(F.concat_ws(",", *[F.when(share(x, y), n) for n, (x, y) in zip(sorted(rules), at, strict=True)]), F.lit(""))


def true_classes(records: DataFrame, same: list[str], rules: dict[str, Column], max_block: int | None = MAX_BLOCK) -> DataFrame:
    """(rules, n): the true pairs, records that agree in the columns ``same``, counted by classes of records with the same blocks.

    ``rules`` is what ``shared_rules`` says of them; two rows of one key are no pair.
    """
    if _repeated(records):
        held = with_blocks(records, rules, max_block).filter("key is not null").groupBy("key", *same, "blocks").agg(F.count(F.lit(1)).alias("m"))
        held = held.groupBy(*same, "blocks").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("s"))
    else:
        blocks = F.transform("held", lambda x: F.transform(x, lambda y: y["block"]))
        held = _counted(records, rules, max_block, same).select(*[F.col("at")[c].alias(c) for c in same], blocks.alias("blocks"), "n", F.col("n").alias("s"))
    held = materialize(held.withColumn("id", F.monotonically_increasing_id()), "true-classes")
    l, r = (held.select(*same, *[F.col(c).alias(f"{k}_{c}") for c in ("id", "blocks", "n", "s")]) for k in "lr")
    n = F.when(F.col("l_id") == F.col("r_id"), F.expr("(l_n * l_n - l_s) div 2")).otherwise(F.col("l_n") * F.col("r_n"))
    both = l.join(r, same).filter("l_id <= r_id")
    return both.select(shared_rules(F.col("l_blocks"), F.col("r_blocks"), list(rules)).alias("rules"), n.alias("n"))


def recall(judged: DataFrame) -> DataFrame:
    """(wanted, found, recall) of true pairs with the ``rules`` that made them, null if none did; ``n`` counts for so many."""
    many = F.col("n") if "n" in judged.columns else F.lit(1).cast("bigint")
    n, found = (F.coalesce(F.sum(c), F.lit(0).cast("bigint")) for c in (many, F.when(F.col("rules").isNotNull(), many)))
    return judged.agg(n.alias("wanted"), found.alias("found"), F.coalesce(F.try_divide(found, n), F.lit(1.0)).alias("recall"))


def blocking_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(wanted, found, recall) of the true pairs (l, r)."""
    return recall(truth.join(pairs.select("l", "r", F.lit(1).alias("rules")), ["l", "r"], "left"))


def lost_recall(judged: DataFrame, rules: list[str]) -> DataFrame:
    """(rule, drop) of true pairs with the ``rules`` that made them: the share of pairs found by that rule alone; ``n`` counts for so many."""
    many = F.col("n") if "n" in judged.columns else F.lit(1)
    lost = [F.coalesce(F.try_divide(F.sum(F.when(F.col("rules") == r, many).otherwise(0)), F.sum(many)), F.lit(0.0)).alias(r) for r in rules]
    return judged.agg(*lost).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.round(F.col(r), 6).alias("drop")) for r in rules])))


def rule_contribution(pairs: DataFrame, truth: DataFrame, rules: list[str]) -> DataFrame:
    """(rule, drop): the recall that would be lost without the rule, which is the share of pairs found by it alone."""
    return lost_recall(truth.join(pairs.select("l", "r", "rules"), ["l", "r"], "left"), rules)


def term_frequencies(records: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of the values of a column that are not empty."""
    values = records.select(F.nullif(F.col(column).cast("string"), F.lit("")).alias("value")).filter("value is not null")
    total = max(1, values.count())
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def missed_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """The true pairs (l, r) that blocking does not make."""
    return truth.select("l", "r").join(pairs.select("l", "r"), ["l", "r"], "left_anti")


def reduction_ratio(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(records, pairs_generated, pairs_all, reduction_ratio): the share of all pairs that blocking leaves out."""
    counted = records.agg(F.count(F.lit(1)).alias("records")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("pairs_generated")))  # one row each
    every = F.expr("records * (records - 1) div 2")
    ratio = F.when(F.col("pairs_all") == 0, 0.0).otherwise(1 - F.col("pairs_generated") / F.col("pairs_all"))
    return counted.withColumn("pairs_all", every).withColumn("reduction_ratio", ratio)


def destroyed_records(precision: Column, merges: Column) -> Column:
    """How many records that many merges destroy at a precision."""
    return (1.0 - precision) * merges


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def bands(scores: DataFrame, column: str = "score") -> DataFrame:
    """(band, n) of the scores."""
    return scores.filter(F.col(column).isNotNull()).groupBy(score_band(F.col(column)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def promotion_report(decisions: DataFrame, *, min_decisions: int = 500, min_precision: float = 0.999) -> DataFrame:
    """(band, decisions, precision, verdict, reason) of every band, best first; without a decision one HOLD row."""
    found = precision_by_band(decisions, min_decisions=min_decisions, min_precision=min_precision)
    n, p = F.col("decisions"), F.col("precision")
    few = F.format_string(f"%s: only %d adjudicated decisions, need {min_decisions}", "band", n)
    lost = F.round(destroyed_records(p, F.lit(100_000)), 0).cast("bigint")
    low = F.format_string(f"%s: measured precision %.5f is below {min_precision:.5f}: %d destroyed records per 100000 merges", "band", p, lost)
    good = F.format_string("%s: precision %.5f over %d decisions", "band", p, n)
    return found.withColumn("reason", F.when(n < min_decisions, few).when(p < min_precision, low).otherwise(good))


def precision_at_recall(scored: DataFrame, target: float) -> DataFrame:
    """(threshold, precision) at the highest score whose recall reaches ``target``; ``scored`` has id, score and label.

    Rows are counted by score first; within the decisive score they go by id. The histogram of distinct scores is summed
    by a window over score blocks, so no task sorts all rows: scores are cut into 4096 ranges, whose totals precede.
    """
    block = F.floor(F.col("score") * 4096)
    rows = scored.select(block.alias("block"), "score", "id", F.col("label").cast("int").alias("y"))
    totals = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # 4097 rows at most
    before = totals.select("block", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"))
    everything = totals.agg(F.sum("n").alias("all"), F.sum("p").alias("positives"))
    inside = Window.partitionBy("block").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(F.broadcast(before), "block").withColumns(
        {"n": F.col("n0") + F.count(F.lit(1)).over(inside), "p": F.col("p0") + F.sum("y").over(inside)}
    )
    hit = run.join(F.broadcast(everything)).filter((F.col("positives") > 0) & (F.col("p") / F.col("positives") >= target))
    won = hit.agg(F.min_by(F.struct("score", (F.col("p") / F.col("n")).alias("precision")), "n").alias("w"))
    return won.select(F.coalesce("w.score", F.lit(1.0)).alias("threshold"), F.coalesce("w.precision", F.lit(0.0)).alias("precision"))
