"""Names, linkage and clusters against literal facts and plain second implementations."""

import math
import random
from collections import Counter
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from entityflow import catalog, testing
from entityflow.functions import text
from entityflow.operators import clusters, graph, linkage, matching, stewardship
from entityflow.plans import pipeline

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("a", "b"), [("Smith", "Smyth"), ("Schmidt", "Schmitt"), ("Catherine", "Katherine"), ("Mueller", "Muller"), ("Philips", "Filips"), ("Thompson", "Tompson")])
def test_names_that_sound_alike(a, b):
    assert set(text.metaphone(a)) & set(text.metaphone(b))


@pytest.mark.parametrize(("a", "b"), [("Smith", "Jones"), ("Anderson", "Henderson")])
def test_names_that_do_not(a, b):
    assert not set(text.metaphone(a)) & set(text.metaphone(b))


@pytest.mark.parametrize(
    ("name", "codes"),
    [
        ("", ["", ""]), ("123", ["", ""]), ("Xavier", ["SFR", "SFR"]), ("Knight", ["NT", "NT"]), ("Wagner", ["AKNR", "FNR"]), ("Bridget", ["PRJT", "PRJT"]),
        ("Chorus", ["XRS", "KRS"]), ("Chore", ["KR", "KR"]), ("Chiara", ["KR", "KR"]), ("Schuyler", ["XLR", "SKLR"]), ("Magnani", ["MNN", "MKNN"]), ("José", ["HS", "HS"]), ("Zhou", ["J", "J"]),
    ],
)
def test_phonetic_codes(name, codes):
    assert text.metaphone(name) == codes


def test_jaro_counts_half_transpositions_down():
    assert round(text.jaro("abcdef", "bcadef"), 4) == 0.9444
    assert [round(text.jaro(*p), 4) for p in (("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), ("a", "a"))] == [0.9444, 0.7667, 0.0, 1.0]


def test_normalising_twice_changes_nothing(spark):
    once = text.normalize_record(testing.synthetic_corpus(spark, 20))
    twice = text.normalize_record(once)
    names = ["source_record_id", "email", "first_name", "last_name", "normalized_company", "phone_e164", "domain", "first_name_dm"]
    assert sorted(map(repr, once.select(names).collect())) == sorted(map(repr, twice.withColumn("phone_e164", F.col("phone_e164")).select(names).collect()))


def test_blocking_finds_the_pairs_and_spares_the_rest(spark):
    corpus = testing.synthetic_corpus(spark, 40)
    held = text.normalize_record(corpus.withColumn("key", F.concat_ws(":", "source", "source_record_id")))
    pairs = matching.candidate_pairs(held, matching.blocking_rules())
    truth = testing.true_pairs(corpus)
    assert matching.blocking_recall(pairs, truth).first().recall >= 0.95
    assert matching.reduction_ratio(held, pairs).first().reduction_ratio > 0.8
    assert {(r.l, r.r) for r in matching.missed_pairs(pairs, truth).collect()} == {(r.l, r.r) for r in truth.collect()} - {(r.l, r.r) for r in pairs.collect()}


def test_large_blocks_are_skipped_or_dealt_in_parts(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("key"), F.lit("gmail.com").alias("d"))
    rules = {"domain": F.col("d")}
    assert matching.candidate_pairs(rows, rules, 50).count() == 0
    stats = matching.block_stats(rows, rules, 50).first()
    assert (stats.oversized, stats.skipped_pairs, stats.pairs) == (1, 1770, 0)
    monkeypatch.setattr(matching, "PART", 7)
    got = [(r.l, r.r) for r in matching.candidate_pairs(rows, rules, None).collect()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_composite_keys_need_all_their_parts(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", None), ("", "b"), (None, None)], "x string, y string")
    assert [r[0] for r in rows.select(matching.composite(F.col("x"), F.col("y"))).collect()] == ["a|b", None, None, None]


def test_role_addresses_and_unverified_phones_are_no_identity(spark):
    rows = [("a", "info@acme.com", "+14155550100", False, "Smith"), ("b", "info@acme.com", "+14155550100", False, "Smith"), ("c", "J.Doe@gmail.com", None, True, "Doe"), ("d", "jdoe@googlemail.com", None, True, "Roe")]
    held = text.normalize_record(spark.createDataFrame([(k, "s", *r) for k, *r in rows], "key string, source string, email string, phone string, phone_verified boolean, last_name string"))
    assert [tuple(r) for r in matching.deterministic_matches(held, matching.deterministic_rules()).collect()] == [("c", "d", "normalized_email", 0.99)]


def _corpus(spark):
    corpus = testing.synthetic_corpus(spark, 40)
    held = text.normalize_record(corpus.withColumn("key", F.concat_ws(":", "source", "source_record_id"))).cache()
    return corpus, held, matching.candidate_pairs(held, matching.blocking_rules()).select("l", "r")


def test_em_against_a_plain_one(spark):
    corpus, held, pairs = _corpus(spark)
    model = linkage.Model()
    fields = [c.field for c in model.comparisons]
    rows = {r.key: r for r in held.collect()}

    def level(c, a, b):
        if not a or not b:
            return -1
        for k, x in enumerate(c.levels):
            words = lambda s: set(s.split())
            hit = {"exact": lambda: a == b, "jw": lambda: _jw(a, b) >= x.at, "token_set": lambda: len(words(a) & words(b)) / len(words(a) | words(b)) >= x.at, "local_part": lambda: a.split("@")[0] == b.split("@")[0], "else": lambda: True}
            if hit[x.kind]():
                return k

    counts = Counter(tuple(level(c, rows[p.l][f], rows[p.r][f]) for c, f in zip(model.comparisons, fields, strict=True)) for p in pairs.collect())
    m = [[x.m for x in c.levels] for c in model.comparisons]
    u = [[x.u for x in c.levels] for c in model.comparisons]
    lam, last, steps = 1e-4, None, 0
    for steps in range(1, 21):
        g, ll = {}, 0.0
        for p, n in counts.items():
            a = lam * math.prod(m[i][k] for i, k in enumerate(p) if k >= 0)
            b = (1 - lam) * math.prod(u[i][k] for i, k in enumerate(p) if k >= 0)
            g[p] = a / (a + b)
            ll += n * math.log(a + b)
        for side, w in ((m, lambda p: g[p]), (u, lambda p: 1 - g[p])):
            for i in range(len(side)):
                sums = [sum(n * w(p) for p, n in counts.items() if p[i] == k) + 1 for k in range(len(side[i]))]
                side[i] = [s / sum(sums) for s in sums]
        lam = max(1e-6, min(0.5, sum(n * g[p] for p, n in counts.items()) / sum(counts.values())))
        if last is not None and abs(ll - last) < 1e-6:
            break
        last = ll
    got = linkage.fit_em(pairs, held)
    assert got.report["iterations"] == steps and got.report["distinct_patterns"] == len(counts)
    assert abs(got.prior - lam) < 1e-9 and abs(got.report["log_likelihood"] - last) < 1e-6
    for c, ms, us in zip(got.comparisons, m, u, strict=True):
        assert all(abs(x.m - a) < 1e-9 and abs(x.u - b) < 1e-9 for x, a, b in zip(c.levels, ms, us, strict=True))
    assert linkage.fit_em(pairs.filter("false"), held).report == {"method": "em", "pairs": 0}


def _jw(a, b):
    j = text.jaro(a, b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + 0.1 * same * (1 - j) if j >= 0.7 else j


def test_supervised_scores_tell_people_apart(spark):
    corpus, held, pairs = _corpus(spark)
    model = linkage.fit_supervised(testing.labelled_pairs(corpus), held)
    assert model.report["method"] == "supervised" and model.report["matches"] > 0
    truth = testing.true_pairs(corpus).withColumn("y", F.lit(1))
    rated = linkage.score_pairs(pairs, held, model).join(truth, ["l", "r"], "left")
    mean = {bool(r.y): r.s for r in rated.groupBy("y").agg(F.avg("score").alias("s")).collect()}
    assert mean[True] > 0.9 and mean[False] < 0.1
    words = rated.select(linkage.explain(model, F.col("levels")).alias("e")).distinct().collect()
    assert any(r.e.startswith("matched on ") for r in words) and any("no data for" in r.e for r in words)


def test_rare_values_weigh_more(spark):
    rows = [(str(i), "nguyen") for i in range(50)] + [("a", "featherstone"), ("b", "featherstone")]
    held = spark.createDataFrame(rows, "key string, last_name string")
    model = linkage.Model((linkage.name_comparison("last_name"),))
    pairs = spark.createDataFrame([("0", "1"), ("a", "b"), ("0", "a"), ("0", "unknown")], "l string, r string")
    got = {(r.l, r.r): r.weight for r in linkage.score_pairs(pairs, held, model).collect()}
    assert len(got) == 3 and got["a", "b"] > got["0", "1"] > got["0", "a"]
    assert abs(got["a", "b"] - (model.prior_weight + math.log2(0.85 / 0.02) + math.log2(0.02 / (2 / 52) ** 2))) < 1e-9


def _clusters(spark, links, cfg=clusters.ClusterConfig(), **options):
    rows = clusters.resolve_clusters(graph.edges(links), cfg, **options).collect()
    sets = {}
    for r in rows:
        sets.setdefault(r.cluster, set()).add(r.node)
    return sets, rows


def _clique(spark, names, score):
    return spark.createDataFrame([(a, b, score) for a in names for b in names if a < b], "a string, b string, score double")


def test_a_chain_makes_no_giant(spark):
    sets, rows = _clusters(spark, testing.build_chain(spark, 8, ends=0.05))
    assert max(map(len, sets.values())) <= 3 and all(r.was_split for r in rows)
    naive = graph.components(testing.build_chain(spark, 8).filter("score >= 0.8"))
    assert naive.select("component").distinct().count() == 1
    assert clusters.cohesion(naive, testing.build_chain(spark, 8)).first().cohesion == 7 / 28


def test_dense_clusters_stay_and_large_ones_go_to_review(spark):
    sets, rows = _clusters(spark, _clique(spark, "wxyz", 0.99))
    assert sets == {"w": set("wxyz")} and not any(r.review or r.was_split for r in rows)
    sets, rows = _clusters(spark, _clique(spark, [f"n{i:02}" for i in range(12)], 0.99))
    assert len(sets) == 12 and {r.review for r in rows} == {"TOO_LARGE"}  # no single cut divides it: it falls to pieces
    _, rows = _clusters(spark, _clique(spark, [f"n{i:02}" for i in range(12)], 0.99), clusters.ClusterConfig.for_type("company"))
    assert {(r.verdict, r.size) for r in rows} == {("OK", 12)}


def test_contradictions_are_divided_silently(spark):
    links = spark.createDataFrame([("x", "y", 0.95), ("y", "z", 0.95), ("x", "z", 0.05)], "a string, b string, score double")
    sets, rows = _clusters(spark, links)
    assert max(map(len, sets.values())) <= 2 and not any(r.review for r in rows)
    _, rows = _clusters(spark, links, divide=False)
    assert {(r.verdict, r.review) for r in rows} == {("LOW_COHESION", "LOW_COHESION")}
    dense = replace(clusters.ClusterConfig(), min_cohesion=0.5)
    _, rows = _clusters(spark, links, dense, divide=False)
    assert {r.verdict for r in rows} == {"CONTRADICTED"}


def test_nodes_without_links_are_clusters(spark):
    nodes = spark.createDataFrame([("w",), ("lone",)], "key string")
    sets, _ = _clusters(spark, _clique(spark, "wxyz", 0.99), nodes=nodes)
    assert sets == {"w": set("wxyz"), "lone": {"lone"}}
    got = {r.node: r.component for r in graph.components(_clique(spark, "ab", 1.0), nodes).collect()}
    assert got == {"a": "a", "b": "a", "w": "w", "lone": "lone"}


def test_only_fully_supported_clusters_are_merged(spark):
    links = graph.edges(_clique(spark, "abc", 0.999).unionByName(_clique(spark, "xyz", 0.9)))
    found = clusters.resolve_clusters(links)
    owners = spark.createDataFrame([(n, f"e-{n}" if n != "b" else "e-a") for n in "abcxyz"], "node string, entity_id string")
    merges, weak = clusters.plan_merges(found, links, owners)
    assert [(r.surviving_id, r.merged_id) for r in merges.collect()] == [("e-a", "e-c")]
    assert [(r.cluster, r.weakest) for r in weak.collect()] == [("x", 0.9)]
    assert clusters.largest(found).first()[0] == 3 and [tuple(r) for r in clusters.cluster_sizes(found).collect()] == [(3, 2)]
    assert {(r.node, r.neighbour) for r in graph.neighbours(links).filter("node = 'a'").collect()} == {("a", "b"), ("a", "c")}
    assert graph.nodes(links).count() == 6
    asked = spark.createDataFrame([("c", "a"), ("a", "z")], "a string, b string")
    assert {(r.a, r.b): r.score for r in graph.pair_scores(asked, links).collect()} == {("c", "a"): 0.999, ("a", "z"): None}


def test_matching_end_to_end(spark):
    corpus = testing.synthetic_corpus(spark, 30)
    raw = corpus.drop("person")
    found = pipeline.match(raw, labels=testing.labelled_pairs(corpus))
    counts = found.counts()
    assert counts["deterministic"] > 0 and counts["scored"] > 0 and "auto_merge" not in counts
    person = {r.key: r.person for r in testing.keyed(corpus).collect()}
    sets = {}
    for r in found.clusters.collect():
        sets.setdefault(r.cluster, set()).add(r.node)
    assert {n for s in sets.values() for n in s} == set(person)
    several = [s for s in sets.values() if len(s) > 1]
    # People of one name and company can't be told apart without mail and phone; most clusters are one person.
    assert len(several) > 15 and sum(len({person[n] for n in s}) == 1 for s in several) >= 0.8 * len(several)
    chained = pipeline.match(testing.chain_records(spark, 8))
    assert clusters.largest(chained.clusters).first()[0] <= 10


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_neither_grouped_nor_shuffled(spark):
    rows = spark.range(40).select(F.col("id").alias("key"), (F.col("id") % 4).alias("a"), (F.col("id") % 6).alias("b"))
    pairs = matching.candidate_pairs(rows, {"a": matching.composite(F.col("a")), "b": matching.composite(F.col("b"))})
    assert "Aggregate" not in _plan(pairs)
    want = {(x, y, ",".join(n for n, k in (("a", 4), ("b", 6)) if x % k == y % k)) for x in range(40) for y in range(x + 1, 40)}
    assert sorted(map(tuple, pairs.collect())) == sorted(w for w in want if w[2])


def test_keys_of_several_blocks_are_paired_once(spark, monkeypatch):
    rows = [(1, "x", "p"), (1, "y", "p"), (1, "y", "q"), (2, "x", "q"), (2, "y", "r"), (3, "y", None), (4, "z", "p"), (None, "x", "p"), (5, "w", "s")]
    frame = spark.createDataFrame(rows, "key long, a string, b string")
    monkeypatch.setattr(matching, "PART", 2)
    pairs = matching.candidate_pairs(frame, {"a": F.col("a"), "b": F.col("b")})
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, "a,b"), (1, 3, "a"), (1, 4, "b"), (2, 3, "a")]
    carried = matching.candidate_pairs(frame, {"a": F.col("a"), "b": F.col("b")}, carry=["a"]).select("l", "r", "l_a", "r_a")
    values = {k: [x for key, x, _ in rows if key == k] for k in range(1, 6)}
    assert sorted(map(tuple, carried.collect())) == sorted((l, r, x, y) for l, r in [(1, 2), (1, 3), (1, 4), (2, 3)] for x in values[l] for y in values[r])
    within = matching.candidate_pairs(frame, {"a": F.col("a"), "b": F.col("b")}, within="b").select("l", "r", "l_b")
    assert sorted(map(tuple, within.collect())) == [(1, 2, "q"), (1, 4, "p"), (1, 4, "p")]


def test_sure_pairs_are_not_grouped(spark):
    rows = spark.range(12).select(F.col("id").alias("key"), (F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 6).cast("string").alias("b"))
    found = matching.deterministic_matches(rows, {"a": (F.col("a"), 0.9), "b": (F.col("b"), 0.95)})
    assert "Aggregate" not in _plan(found)
    want = [(x, y, *(("b", 0.95) if x % 6 == y % 6 else ("a", 0.9))) for x in range(12) for y in range(x + 1, 12) if x % 6 == y % 6 or x % 4 == y % 4]
    assert sorted(map(tuple, found.collect())) == want


def test_scored_pairs_are_neither_grouped_nor_joined_again(spark):
    plan = _plan(catalog.queries()["fs_score"](spark, SF))
    assert plan.count("Join") == 3 and "Aggregate" not in plan  # both sides' rows with their blocks, and the sides of a pair
    rows = spark.createDataFrame([("x", "x", "y", "z"), ("x", None, "y", "y"), ("", "x", "y", "y"), (None, None, None, "z")], "a string, b string, c string, d string")
    levels = {"p": (0.7, 0.02), "q": (0.45, 0.0005)}
    summed = F.lit(-3.5) + matching.exact_weight(F.col("a"), F.col("b"), 0.7, 0.02) + matching.exact_weight(F.col("c"), F.col("d"), 0.45, 0.0005)
    told = matching.by_agreement({"p": (F.col("a"), F.col("b")), "q": (F.col("c"), F.col("d"))}, levels, -3.5, lambda w: w)
    assert all(r.x == r.y for r in rows.select(told.alias("x"), summed.alias("y")).collect())


def test_fitting_aggregates_pairs_before_fields(spark):
    rows = [(True, True, None), (True, None, None), (False, True, None), (False, False, None), (None, True, None)]
    pairs = spark.createDataFrame(rows, "y boolean, p boolean, q boolean")
    fitted = matching.fit_exact(pairs, {"p": F.col("p"), "q": F.col("q")}, F.col("y"))
    assert _plan(fitted).index("Generate") < _plan(fitted).index("Aggregate")
    assert [tuple(r) for r in fitted.collect()] == [("p", 2 / 3, 0.5)]


def test_recall_needs_no_candidates(spark):
    rows = [(1, "x", "p"), (1, "y", "p"), (2, "y", "q"), (3, "x", "p"), (4, "z", None), (5, "z", "s"), (6, "w", "t"), *[(k, "big", None) for k in range(7, 12)]]
    frame = spark.createDataFrame(rows, "key long, a string, b string")
    rules = {"b": F.col("b"), "a": F.col("a")}
    held = matching.with_blocks(frame, rules, 4).select("key", "blocks").distinct()
    l, r = (held.select(F.col("key").alias(k), F.col("blocks").alias(f"{k}_b")) for k in "lr")
    judged = l.join(r, F.col("l") < F.col("r")).select("l", "r", matching.shared_rules(F.col("l_b"), F.col("r_b"), list(rules)).alias("rules"))
    pairs = matching.candidate_pairs(frame, rules, 4)
    assert {tuple(x) for x in judged.filter("rules is not null").collect()} == {tuple(x) for x in pairs.collect()} == {(1, 2, "a"), (1, 3, "a,b"), (4, 5, "a")}
    assert tuple(matching.recall(judged).first()) == tuple(matching.blocking_recall(pairs, judged.select("l", "r")).first()) == (55, 3, 3 / 55)
    plan = _plan(catalog.queries()["blocking_recall"](spark, SF))
    assert plan.count("Aggregate") == 1


def test_contribution_of_rules_needs_no_candidates(spark):
    judged = spark.createDataFrame([(1, 2, "a"), (1, 3, "a,b"), (4, 5, None), (6, 7, "b"), (6, 8, "a")], "l long, r long, rules string")
    want = [("a", 0.4), ("b", 0.2)]
    assert [tuple(r) for r in matching.lost_recall(judged, ["a", "b"]).collect()] == want
    assert [tuple(r) for r in matching.rule_contribution(judged.filter("rules is not null"), judged.select("l", "r"), ["a", "b"]).collect()] == want
    assert _plan(catalog.queries()["rule_contribution"](spark, SF)).count("Aggregate") == 1


def test_review_takes_the_priority_that_pairs_bring(spark):
    rows = spark.createDataFrame([(1, 2, 0.5, 0.1), (3, 4, 0.9, 0.7)], "l long, r long, score double, priority double")
    assert [r.l for r in stewardship.review_queue(rows, 2).collect()] == [3, 1]
    assert [r.l for r in stewardship.review_queue(rows.drop("priority"), 2).collect()] == [1, 3]
    assert "Aggregate" not in _plan(catalog.queries()["review_queue"](spark, SF))


def test_links_of_components_are_not_grouped_first(spark):
    assert "Aggregate" not in _plan(catalog._linked(spark, SF))


def test_clusters_look_at_pairs_inside_alone(spark):
    links = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.95), ("a", "c", 0.1), ("c", "x", 0.5), ("x", "y", 0.99)], "a string, b string, score double")
    members = graph.components(links.filter("score >= 0.8"))
    inner = graph.inside(links, members)
    assert inner.count() == 4 and graph.inside(inner, members) is inner
    told = lambda frame: sorted(map(tuple, frame.collect()))
    assert told(graph.verdicts(inner, members=members)) == told(graph.verdicts(links))
    assert told(clusters.cohesion(members, inner)) == told(clusters.cohesion(members, links))
    named = members.withColumnRenamed("component", "cluster")
    assert told(clusters.weakest_edges(named, inner.withColumnRenamed("component", "cluster"))) == told(clusters.weakest_edges(named, links))
    assert told(clusters.resolve_clusters(inner)) == told(clusters.resolve_clusters(links))
    assert _plan(catalog._clustered(spark, SF)[1]).count("Join") == 5  # both sides' members and blocks, and the sides of a pair


def test_weakest_cut_equals_trying_every_edge():
    import random

    def tried(members, edges, cfg):
        rest = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
        while rest:
            tied = [e for e in rest if e[2] <= rest[0][2] + 1e-12]
            cuts = [c for c in (clusters.parts(members, [x for x in rest if x is not e], cfg.threshold) for e in tied) if len(c) > 1]
            if cuts:
                return max(cuts, key=lambda c: len(c[-1]) / len(c[0]))
            rest = rest[len(tied):]
        return [{m} for m in sorted(members)]

    dice, cfg = random.Random(5), clusters.ClusterConfig()
    for _ in range(400):
        names = [f"n{i}" for i in range(dice.randint(2, 9))]
        share = dice.random()
        edges = [(a, b, dice.choice([0.1, 0.5, 0.8, 0.9, 0.95])) for i, a in enumerate(names) for b in names[i + 1 :] if dice.random() < share]
        assert clusters.weakest_cut(set(names), edges, cfg) == tried(set(names), edges, cfg)
    names = [f"n{i:03}" for i in range(150)]
    calls, clusters_parts = [], clusters.parts
    edges = [(a, b, 0.99) for i, a in enumerate(names) for b in names[i + 1 :]]
    try:
        clusters.parts = lambda *x: calls.append(1) or clusters_parts(*x)
        assert clusters.split(set(names), edges, cfg) == [{n} for n in reversed(names)]
    finally:
        clusters.parts = clusters_parts
    assert len(calls) < 5


@pytest.mark.parametrize(("name", "column"), [("cohesion", "component"), ("weakest_edges", "cluster")])
def test_links_of_clusters_bring_their_name(spark, monkeypatch, name, column):
    seen = []
    monkeypatch.setattr(clusters, "inside", lambda links, *x: seen.append(links.columns) or graph.inside(links, *x))
    assert catalog.queries()[name](spark, SF).count() == 5
    assert column in seen[0]


def _odd_parts(spark, rows=300):
    """Parts with copies; of a key with several rows, a null key, and null fields."""
    rng = random.Random(5)
    out = [(k, rng.choice("xyz"), rng.choice(["p", "q", None]), rng.choice("st")) for k in range(rows)]
    return {
        "plain": spark.createDataFrame([*out, (None, "x", "p", "s")], "key long, a string, b string, c string"),
        "repeated": spark.createDataFrame([*out, (None, "x", "p", "s"), (3, "x", "q", "t"), (3, "y", "q", "t"), (4, "x", "p", "s"), (4, "x", "p", "s")], "key long, a string, b string, c string"),
    }


def _odd_rules():
    return {"ab": matching.composite(F.col("a"), F.col("b")), "ac": matching.composite(F.col("a"), F.col("c"))}


@pytest.mark.parametrize("kind", ["plain", "repeated"])
@pytest.mark.parametrize("most", [None, 55])
def test_sure_pairs_are_listed_from_classes(spark, monkeypatch, kind, most):
    rows = _odd_parts(spark)[kind]
    monkeypatch.setattr(matching, "PART", 20)
    found = matching.deterministic_matches(rows, {n: (c, {"ab": 0.9, "ac": 0.95}[n]) for n, c in _odd_rules().items()}, most)
    made = matching.candidate_pairs(rows, _odd_rules(), most).collect()
    want = {(r.l, r.r, *(("ac", 0.95) if "ac" in r.rules else ("ab", 0.9))) for r in made}
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == len(made) > 1000
    assert "explode(l_keys" in _plan(found)


def test_sure_pairs_have_the_bound_of_their_sql(spark, tmp_path):
    rows = spark.range(1200).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "cast(id div 2 as string) as p_type", "1 as p_size")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.queries()["deterministic_matches"](spark, str(tmp_path)).collect()
    assert sorted((r.l, r.r, r.rule) for r in found) == [(k, k + 1, "kind") for k in range(0, 1200, 2)]


def test_sure_pairs_of_blocks_of_any_size_are_listed(spark, tmp_path):
    rows = spark.range(1200).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "cast(id div 2 as string) as p_type", "1 as p_size")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.queries()["deterministic_matches"](spark, str(tmp_path))
    kept = found.filter("l < r and (rule = 'kind') = (l div 2 = r div 2)")
    assert found.count() == kept.select("l", "r").distinct().count() == 1200 * 1199 // 2
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT rule, confidence, count(*), sum(l)::BIGINT, sum(r)::BIGINT FROM ({catalog.oracle_sql()['deterministic_matches']}) GROUP BY 1, 2 ORDER BY 1").fetchall()
    told = found.groupBy("rule", "confidence").agg(F.count(F.lit(1)), F.sum("l"), F.sum("r")).orderBy("rule").collect()
    assert [tuple(r) for r in told] == want and [r[:3] for r in want] == [("brand", 0.95, 718800), ("kind", 0.99, 600)]


@pytest.mark.parametrize("kind", ["plain", "repeated"])
def test_links_of_classes_connect_what_their_pairs_do(spark, monkeypatch, kind):
    rows = _odd_parts(spark)[kind]
    monkeypatch.setattr(matching, "PART", 20)
    strong = (F.col("l_c") == F.col("r_c")) & (F.col("l_b") == F.col("r_b"))
    pairs = matching.candidate_pairs(rows, _odd_rules(), 80, carry=["b", "c"]).filter(strong)
    alike = matching.classes(rows, _odd_rules(), 80, ["b", "c"])
    links = matching.spanning_links(matching.class_pairs(alike, _odd_rules(), lambda shares: [], ["b", "c"]).filter(strong))
    told = lambda frame: sorted(map(tuple, graph.components(frame).collect()))
    assert told(links) == told(pairs.select(F.col("l").alias("a"), F.col("r").alias("b"))) and links.count() < pairs.count() / 2


def test_sizes_of_components_make_no_row_for_a_pair(spark, tmp_path):
    rows = spark.range(900).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    assert catalog._connected(spark, str(tmp_path)).count() < 2 * 900
    assert [tuple(r) for r in catalog.queries()["size_distribution"](spark, str(tmp_path)).collect()] == [(900, 1)]


@pytest.mark.parametrize("kind", ["plain", "repeated"])
@pytest.mark.parametrize("k", [1, 7, 50, 5000])
def test_first_pairs_of_all_come_from_few_classes(spark, kind, k):
    rows = _odd_parts(spark)[kind]
    priority = F.when(F.col("l_c") == F.col("r_c"), 0.5).otherwise(0.7).alias("priority")
    pairs = matching.candidate_pairs(rows, _odd_rules(), carry=["c"]).select("l", "r", priority)
    told = matching.class_pairs(matching.classes(rows, _odd_rules(), columns=["c"]), _odd_rules(), lambda shares: [], ["c"]).select("l_keys", "r_keys", "own", priority)
    first = matching.first_pairs(told, F.desc("priority"), k)
    ranked = lambda frame: [tuple(r) for r in frame.orderBy(F.desc("priority"), "l", "r").limit(k).collect()]
    assert ranked(matching.each_pair(first)) == ranked(pairs)
    assert all(len(set(r.l_keys)) <= k + 1 for r in first.collect())


def test_review_looks_at_classes(spark):
    assert "explode(l_keys" in _plan(catalog.queries()["review_queue"](spark, SF))


@pytest.mark.parametrize("kind", ["plain", "repeated"])
def test_true_pairs_are_counted_by_classes(spark, kind):
    rows = _odd_parts(spark)[kind]
    told = matching.true_classes(rows, ["a", "c"], _odd_rules(), 70)
    held = matching.with_blocks(rows, _odd_rules(), 70)
    l, r = (held.select(F.col("key").alias(k), "a", "c", F.col("blocks").alias(f"{k}_b")) for k in "lr")
    judged = l.join(r, ["a", "c"]).filter("l < r").select("l", "r", matching.shared_rules(F.col("l_b"), F.col("r_b"), list(_odd_rules())).alias("rules"))
    assert tuple(matching.recall(told).first()) == tuple(matching.recall(judged).first())
    drops = lambda frame: sorted(map(tuple, matching.lost_recall(frame, list(_odd_rules())).collect()))
    assert drops(told) == drops(judged) and told.count() < judged.count() / 100
    assert tuple(matching.recall(told.filter("false")).first()) == (0, 0, 1.0) and drops(told.filter("false")) == [("ab", 0.0), ("ac", 0.0)]


def test_contribution_is_told_from_classes(spark):
    assert "n" in catalog._judged(spark, SF).columns
