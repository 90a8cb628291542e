"""Each operator's own method against a second, plain implementation, and the cases that used to fail."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from entityflow.llm import chat, decontaminate, langid, mixing, neardup, quality_model, quality_rules, sharding, substrings
from entityflow.llm.common import BYTES_A_BATCH, ROWS_A_BATCH, materialize

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows, schema="doc_id bigint, text string, source string"):
    return spark.createDataFrame(rows, schema)


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def test_mixing_inverts_the_poisson_distribution(spark):
    rows = [(i, "x" * (10 + i % 50), "abc"[i % 3] if i % 7 else None) for i in range(300)]
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(text)
    weight = {s: b**0.5 for s, b in size.items()}
    got = {(r.doc_id, r.copy_no) for r in mixing.mix(frame(spark, rows)).collect()}
    want = set()
    for i, _, source in rows:
        rate = weight[source] / sum(weight.values()) * sum(size.values()) / size[source]
        u, n, p = uniform(mixing.SEED, i), 0, math.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        want |= {(i, k) for k in range(n)}
    assert got == want


def test_repetitions_of_a_mixture_are_not_neighbours_in_their_shard(spark):
    rows = [(i % 200, f"text {i % 200}", "s") for i in range(600)]
    placed = sharding.assign(frame(spark, rows), shards=4).collect()
    order = sorted(placed, key=lambda r: (r.shard, r.slot))
    together = sum(a.doc_id == b.doc_id and a.shard == b.shard for a, b in zip(order, order[1:], strict=False))
    assert len(placed) == 600 and together < 100  # 400 of 400 if repetitions were sorted by their id
    assert len({r.shard for r in placed if r.doc_id == 7}) == 1
    for shard in range(4):
        slots = sorted(r.slot for r in placed if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_sharding_descends_level_by_level(spark):
    """The tree walked in Python with the draws taken from Spark, one a node, and movement under a changed weight."""
    before, after = sharding.tree(40), sharding.tree(40, {7: 4.0})
    ids = spark.range(1500).select(F.col("id").alias("doc_id"))
    key = F.col("doc_id").cast("string")
    draws = {}
    for level, n in enumerate((2, 8, 40)):
        hashes = [F.xxhash64(key, F.lit(level), F.lit(c)).alias(str(c)) for c in range(n)]
        for r in ids.select("doc_id", *hashes).collect():
            for c in range(n):
                draws[r.doc_id, level, c] = -math.log((((r[str(c)] & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53))

    def walk(doc_id, leaves):
        left = leaves
        for level in range(3):
            weight = Counter()
            for leaf in left:
                weight[leaf[level]] += leaf[3]
            best = min(weight, key=lambda c: draws[doc_id, level, c] / weight[c])
            left = [x for x in left if x[level] == best]
        return left[0][2]

    rows = ids.select("doc_id", sharding.descend(F.col("doc_id"), before).alias("a"), sharding.descend(F.col("doc_id"), after).alias("b")).collect()
    assert all((r.a, r.b) == (walk(r.doc_id, before), walk(r.doc_id, after)) for r in rows)
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    region, rack = lambda s: s // 20, lambda s: s // 5
    assert moved and all(region(b) == 0 for _, b in moved)
    assert all(rack(b) == 1 for a, b in moved if region(a) == 0)
    assert all(b == 7 for a, b in moved if rack(a) == 1)
    flat = [min(range(40), key=lambda c, i=r.doc_id: draws[i, 2, c]) for r in rows]
    assert sum(x != r.a for x, r in zip(flat, rows, strict=True)) > 500  # not the least of 40 leaf draws


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    rows = frame(spark, [(i, f"t{i}", None) for i in range(2000)])
    got = sharding.assign(rows, shards=shards).collect()
    assert all(r.grown_shard in (r.shard, shards) for r in got)
    n = sum(r.grown_shard == shards for r in got)
    assert abs(n - 2000 / (shards + 1)) < 5 * (2000 / (shards + 1)) ** 0.5


def test_expectation_maximisation_finds_the_mixture():
    p = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]])
    counts = 1000 * (p @ np.array([0.3, 0.7]))
    share, gained = langid.Model._mixture(p, counts, 500)
    assert np.allclose(share, [0.3, 0.7], atol=0.02)
    likelihood = lambda a: float(counts @ np.log(p @ np.array([a, 1 - a])))
    assert gained >= max(likelihood(a) for a in np.linspace(0.01, 0.99, 99)) - 0.05


def test_languages_of_corner_cases(spark):
    one, two = "the cat sat on the mat and the dog ran ", "der hund und die katze sind auf dem dach "
    rows = [(i, (one if i % 2 else two) * 5, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 !?", "de"), (103, one * 8 + two * 8, None), (103, one * 8 + two * 8, None), (None, one * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (100, 101, 102))
    assert by[None].lang_pred == "en" and by[3].lang_pred == "en" and by[4].lang_pred == "de"
    assert by[103].languages == sorted(by[103].languages, key=lambda x: -by[103].proportions[by[103].languages.index(x)])
    assert set(by[103].languages) == {"de", "en"} and 0.4 < by[103].score < 0.6
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)


def test_more_languages_than_the_bound_share_its_cells():
    assert [langid.cell_bits(n) for n in (0, 1, 400, 401, 800, 801)] == [16, 16, 16, 15, 15, 14]


def test_follow_the_regularised_leader_by_hand():
    rows = [("good text here", 1), ("bad bad spam", 0), ("good words", 1), ("spam here", 0)]
    z, n, zb, nb, b = defaultdict(float), defaultdict(float), 0.0, 0.0, 0.0
    a, beta, l1, l2 = quality_model.ALPHA, quality_model.BETA, quality_model.L1, quality_model.L2

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / a + l2)

    for _ in range(3):
        for text, y in rows:
            cells, values = (x.tolist() for x in quality_model.features(text))
            w = [weight(i) for i in cells]
            p = 1 / (1 + math.exp(-(sum(x * v for x, v in zip(w, values, strict=True)) + b)))
            for i, v, x in zip(cells, values, w, strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * x
                n[i] += g * g
            d = p - y
            zb += d - (math.sqrt(nb + d * d) - math.sqrt(nb)) / a * b
            nb += d * d
            b = -zb / ((beta + math.sqrt(nb)) / a + l2)
    got = quality_model.train(rows, 3)
    assert abs(got[-1] - b) < 1e-6
    assert all(abs(got[i] - weight(i)) < 1e-6 for i in list(z)) and np.count_nonzero(got[:-1]) <= len(z)
    assert quality_model.train([]) is None


def test_quality_of_corner_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "again"), (3, "x"), (None, "y")], "doc_id bigint, text string").withColumn("predicted", F.lit("clash"))
    none = spark.createDataFrame([(1, None), (9, 1)], "doc_id bigint, quality int")
    got = quality_model.classify(docs, none).collect()
    assert len(got) == 5 and all((r.score, r.predicted) == (0.5, 1) for r in got)
    some = spark.createDataFrame([(i, q) for i in (1, 2, 3) for q in (1, 1)], "doc_id bigint, quality int")
    got = quality_model.classify(docs, some).collect()
    assert all(0.5 < r.score < 1 for r in got)


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{k}" for k in range(40)), "too short"
    rows, host = [], 0
    for failures, n in [(0, 20), (1, 20), (2, 20), (19, 20), (1, 1), (0, 1), (10, 10)]:
        rows += [(len(rows) + k, bad if k < failures else f"{good} {host} {k}", f"h{host}" if host else None) for k in range(n)]
        host += 1
    got = quality_rules.judge(quality_rules.measure(frame(spark, rows))).collect()
    hosts = defaultdict(list)
    for r in got:
        assert r.rule_failed == (r.text == bad)
        hosts[r.source].append(r)
    # The prior of all hosts by moments, as the operator's text says, in plain numbers.
    size, failed = ([f(rows_of) for rows_of in hosts.values()] for f in (len, lambda x: sum(r.rule_failed for r in x)))
    total, mean = sum(size), sum(failed) / sum(size)
    between = sum(n * (f / n - mean) ** 2 for n, f in zip(size, failed, strict=True)) - mean * (1 - mean) * (len(size) - 1)
    spread = between / (total - sum(n * n for n in size) / total)
    strength = min(1e6, max(2.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    for rows_of in hosts.values():
        rate = (sum(r.rule_failed for r in rows_of) + mean * strength) / (len(rows_of) + strength)
        rejected = rate > quality_rules.MAX_HOST_RATE
        for r in rows_of:
            assert r.kept == (not r.rule_failed and not rejected)
            assert (r.host_rate is None) != rejected and (not rejected or abs(r.host_rate - rate) < 1e-9)
    assert any(r.host_rate is not None and not r.rule_failed for r in got)  # a clean document of a rejected host
    assert all(r.host_rate is None for r in hosts["h5"])


def test_spans_point_into_the_original(spark):
    item = " ".join(f"k{i}" for i in range(15))
    text = "Émile said:  " + item.upper().replace(" ", " ,") + "! \U0001f600 end"
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    docs = frame(spark, [(1, text, None), (2, "k1 k2", None), (3, None, None)]).withColumn("spans", F.lit("clash"))
    for block in (1, 1 << 20):
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()}
        (span,) = got[1].spans
        assert WORD.findall(text[span.first : span.last].lower()) == item.split()
        assert text[span.first] == "K" and text[span.last] == "!" and got[2].spans == got[3].spans == []


def test_contamination_shares_are_exact(spark):
    words = [f"v{k}" for k in range(50)]
    bench = spark.createDataFrame([("q", " ".join(words[:15]))], "item_id string, text string")
    docs = frame(spark, [(1, " ".join(words), None)])
    verdict = lambda share: decontaminate.decontaminate(docs, bench, min_share=share).first().contaminated
    assert [verdict(x) for x in (0.05, 0.3, 0.301, 0.31)] == [True, True, False, False]


def test_tool_messages_that_json_makes_hard(spark):
    call = lambda arguments, name="f": '{"tool_calls":[{"id":"a","name":"%s","arguments":%s}]}' % (name, arguments)
    rows = [
        (1, 0, "tool", r'{"tool_call_id":"a","content":"\ud800"}'),
        (2, 0, "assistant", call('{"x":1' + "0" * 400 + "}")),
        (3, 0, "assistant", call('{"x":1e400}')),
        (4, 0, "assistant", call('{"x":NaN}')),
        (5, 0, "assistant", call('{"x":null}')),
        (6, 0, "assistant", call('{"x":2.5}')),
        (7, 0, "assistant", "{" + '"a":{' * 200_000),
        (8, 0, "assistant", call('{"x":2.0}')),
        (9, 0, "assistant", call('{"x":1}', "odd")),
    ]
    schemas = {"f": {"properties": {"x": {"type": ["integer", "null"]}}}, "odd": {"properties": {"x": {"type": "no such"}}}}
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.link(docs, schemas=schemas).collect()}
    assert json.loads(got[1].json)["content"] == "\ud800" and r"\ud800" in got[1].json
    assert [got[k].kind for k in (3, 4, 7)] == ["message"] * 3
    assert got[2].errors == got[5].errors == got[8].errors == ""
    assert got[6].errors == "$.x: not integer/null" and got[9].errors == "$.x: not no such"


def test_conversations_as_tools_have_needs_cycles_and_bad_arguments(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", {2: "why?", 4: "7 days", 10: "x" * 120}.get(t, "hello")) for t in range(14)]
    talk = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: r for r in chat.link(chat.from_turns(talk), schemas=chat.ANSWER).collect()}
    assert len(got) == 14 and all(r.linked for r in got.values())
    assert {t for t, r in got.items() if "cycle" in r.errors} == {2, 4, 6}  # in the cycle of 2 and 4, or behind it
    assert "$.limit: not integer/null" in got[4].errors and "$.length: unknown" in got[10].errors
    assert json.loads(got[12].json)["depends_on"] == ["turn:10"]


@pytest.mark.parametrize("piece", ["a", "ab", "abc" * 3 + "d"])
def test_periodic_texts_make_few_rows(spark, piece):
    text = (piece * 30_000)[:30_000]
    names, contexts, first, last = substrings.sample(text.encode(), 200)
    assert len(names) < 200 and first[0] == 0 and last[-1] == len(text) - 200
    assert (first[1:] == last[:-1] + 1).all() and (last - first < substrings.REACH).all()
    got = substrings.remove_repeats(frame(spark, [(1, text, None), (2, "x" * 150, None)]), texts=False).collect()
    period = len(re.match(r"(.+?)\1*$", piece)[1])
    want = {1: 30_000 if period < 29_800 else 0, 2: 0}
    assert {r.doc_id: r.n_removed for r in got} == want


def test_document_keys_tell_documents_apart(spark):
    docs = frame(spark, [(1, "a", None), (1, "a", None), (1, "b", None), (None, "a", None)])
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "text", substrings.document_key(docs, data).alias("k")).collect()
    assert len({r.k for r in rows}) == 3


def test_further_links_join_known_components(spark):
    key = lambda n: bytearray(bytes([n]) * 16)
    roots = spark.createDataFrame([(key(h), key(r)) for h, r in ((1, 1), (2, 1), (3, 1), (5, 5), (6, 5))], "h binary, root binary")
    more = spark.createDataFrame([(key(a), key(b)) for a, b in ((3, 6), (6, 9), (10, 11))], "a binary, b binary")
    found = sorted((row.h[0], row.root[0]) for row in neardup._merged(roots, more).collect())
    assert found == [(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (9, 1), (10, 10), (11, 10)]


def test_written_tables_take_short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @F.arrow_udf("bigint")
    def rows(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int64())

    most = lambda: materialize(spark.range(0, 3000, 1, 1).select(rows("id").alias("n")), "batches").agg(F.max("n")).first()[0]
    own = spark.conf.get(key)
    assert most() == ROWS_A_BATCH < int(own) and spark.conf.get(key) == own
    spark.conf.set(key, "100")
    try:
        assert most() == 100 and spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, own)


def test_filtered_comparisons_run_once(spark):
    pairs = spark.createDataFrame([(b"a" * 256, b"a" * 256)], "x binary, y binary").repartition(2)
    runs = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    rated = pairs.select(neardup._estimate("x", "y").alias("e")).filter("e > 0.5")
    assert runs(rated) == 1 and rated.first().e == 1.0
    words = [f"w{i}" for i in range(100)]
    docs = frame(spark, [(1, " ".join(words), None), (2, " ".join(words[:-8]), None), (3, " ".join(words[50:]), None)])
    texts = docs.select(F.unhex(F.md5("text")).alias("h"), F.col("doc_id").alias("id"))
    h = {r.id: r.h for r in texts.collect()}
    near = spark.createDataFrame([(h[1], h[2], 0.8), (h[1], h[3], 0.8)], "a binary, b binary, e double")
    linked = neardup._settled(near, texts, docs, 0.8)
    assert runs(linked) == 1 and [(r.a, r.b) for r in linked.collect()] == [(h[1], h[2])]


def test_written_tables_take_batches_of_few_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    @F.arrow_udf("bigint")
    def size(x: pa.Array) -> pa.Array:
        return pa.array([sum(map(len, x.to_pylist()))] * len(x), pa.int64())

    own = spark.conf.get(key)
    long = spark.range(0, 400, 1, 1).select(size(F.repeat(F.lit("x"), 50_000)).alias("n"))
    assert materialize(long, "long-texts").agg(F.max("n")).first()[0] < BYTES_A_BATCH + 100_000
    assert spark.conf.get(key) == own
