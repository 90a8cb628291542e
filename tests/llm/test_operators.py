"""The operators against brute force on small tables, with the corner cases that their docstrings state."""

import hashlib
import json
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from entityflow.llm import chat, decontaminate, langid, licenses, mixing, neardup, quality_model, quality_rules, sharding, substrings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DATA = "/root/testdata/sf0.001"


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def texts(n=40, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Ünï", "été", "cc", "by", "mit", "license", "GNU", "#", "|"]
    long = " ".join(rng.choice(words) for _ in range(4000))
    out = [None, "", " ", "one", long, long, long[:9000] + " x " + long[9000:], "a" * 900, "ab" * 300, "é" * 150]
    return out + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en", "clash") for i, t in enumerate(texts())] + [(None, "null id", None, None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_words string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_decontamination(spark, docs):
    items = [("b1", " ".join(texts()[4].split()[100:130])), ("b2", "one"), ("b3", ""), (None, "w1 w2"), ("b5", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1, 1 << 20):
        got = by_id(decontaminate.decontaminate(docs, bench, block_bytes=block))
        for i, t in [*enumerate(texts()), (None, "null id")]:
            words, hit, ids = WORD.findall(lowered(t)), set(), set()
            for item_id, text in items:
                item = WORD.findall(lowered(text))
                size = min(13, len(item))
                wanted = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)} if item else set()
                for k in range(len(words) - size + 1):
                    if tuple(words[k : k + size]) in wanted:
                        hit.update(range(k, k + size))
                        ids |= {item_id} - {None}
            assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(words), len(hit), sorted(ids))
            assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))


def test_repeated_substrings(docs):
    kept = by_id(substrings.remove_repeats(docs))
    rows = [(i, (t or "").encode()) for i, t in [*enumerate(texts()), (None, "null id")]]
    seen = {}
    for _, b in rows:
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (kept[i].n_bytes, kept[i].n_removed, kept[i].n_spans) == (len(b), sum(gone), spans)
        assert kept[i].kept_sha256 == hashlib.sha256(left).hexdigest() and bytes(kept[i].kept) == left


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"v{k}" for k in range(500)]
    base = [[rng.choice(words) for _ in range(rng.randrange(30, 300))] for _ in range(15)]
    rows = []
    for b in base:
        for _ in range(rng.randrange(1, 6)):
            t = list(b)
            for _ in range(rng.randrange(0, 2)):
                t[rng.randrange(len(t))] = "changed"
            rows.append(" ".join(t))
    rows += ["", "", None, None, "one two", "one two"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame).collect()}
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    cells = [neardup.shingles(t) for t in rows]
    for a in range(len(rows)):
        for b in range(a):
            same = rows[a] is not None and rows[a] == rows[b]
            if same or neardup.similarity(cells[a], cells[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    assert got == {i: top(i) for i in range(len(rows))}
    left = {r.doc_id for r in neardup.deduplicate(frame).collect()}
    assert left == {i for i in got if got[i] == i}


def test_near_duplicates_inside_a_template_family(spark):
    """A template with members at 0.77 to 0.8 of one another, in which pairs at 0.81 must still be found."""
    p, columns = 13, 6
    template, rows, pairs = [f"t{k}" for k in range(p * columns * 5 + 90)], [], []
    for a in range(p):
        for b in range(0, p - 1, 2):
            for line in (b, b + 1):
                words = list(template)
                for j in range(columns):
                    # The pair's texts share one change; any two others meet in one place at most.
                    words[(j * p + (a + line * j) % p) * 5 + 2] = f"p{a}x{b}" if j == 0 else f"m{a}x{line}x{j}"
                rows.append((len(rows), " ".join(words)))
            pairs.append((len(rows) - 2, len(rows) - 1))
    found = [neardup.shingles(t) for _, t in rows]
    near = {(i, j) for j in range(len(rows)) for i in range(j) if neardup.similarity(found[i], found[j]) >= 0.8}
    assert near == set(pairs)
    assert min(neardup.similarity(found[0], f) for f in found) > 0.75
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))
    assert {i: got[i].class_id for i, _ in rows} == {k: i for i, j in pairs for k in (i, j)}


def test_quality_rules(docs):
    got = by_id(quality_rules.judge(quality_rules.measure(docs)))
    for i, t in enumerate(texts()):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places = {}
        for k in range(len(words) - 7):
            places.setdefault(tuple(words[k : k + 8]), []).append(k)
        repeated = len({k + j for p in places.values() if len(p) > 1 for k in p for j in range(8)})
        r = got[i]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeated)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * repeated > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_licenses(spark, docs):
    more = ["The MIT License, see", "CC BY-NC 4.0 licensed under cc by nc 4 0", licenses.TEMPLATES["mit"][0], "submit license", None]
    rows = [(i, t) for i, t in enumerate(texts() + more)]
    got = by_id(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for i, t in rows:
        words = WORD.findall(lowered(t))
        found = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit" in got[len(texts()) + 2].labels


def test_license_word_frequencies_count_every_text(spark):
    prose = ["a person met the following conditions", "software is available; any person, person", "GNU person", "mit license", "", None]
    rows = spark.createDataFrame(list(enumerate(prose)), "doc_id bigint, text string")
    held = [set(WORD.findall(lowered(t))) for t in prose]
    want = {w: math.log((1 + len(prose)) / (1 + sum(w in h for h in held))) for w in licenses.postings()}
    assert licenses.inverse_frequencies(licenses.read(rows)) == want


def test_licenses_of_many_notices_and_stray_words(spark):
    full = [licenses.TEMPLATES[k][0] for k in ("mit", "bsd", "mpl", "epl", "unlicense", "isc", "cc")]
    stray = "mozilla x eclipse x affero x creative x unencumbered x nc x lesser x commons x attribution "
    rows = [(1, " and then ".join(full)), (2, stray + licenses.TEMPLATES["apache"][0]), (3, stray)]
    got = by_id(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [got[k].labels for k in (1, 2, 3)] == ["bsd,cc,epl,isc,mit,mpl,unlicense", "apache", ""]
    assert got[2].score == 1.0


def test_sharding(docs):
    got = sharding.assign(docs.unionByName(docs.filter("doc_id < 5"))).collect()
    slots = {}
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mixing(docs):
    once, again = (sorted((str(r.doc_id), r.copies, r.copy_no) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(5)))
    assert once == again
    assert {r.source for r in mixing.mix(docs, weights={"s1": 1.0, "no such": 2.0}).collect()} <= {"s1"}


def test_mixing_counts_follow_the_rates(spark):
    rows = spark.range(4000).selectExpr("id doc_id", "if(id % 4 = 0, 'a', 'b') source", "'0123456789' text")
    n = {r.source: r["count"] for r in mixing.mix(rows, weights={"a": 0.5, "b": 0.5}).groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 200 and abs(n["b"] - 2000) < 200


def test_mixing_repeats_a_tiny_source_beside_a_huge_one(spark):
    rows = [(i, "x", "tiny") for i in range(20)] + [(100 + i, "y" * 10000, "huge") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs, weights={"tiny": 1.0, "huge": 1.0}).filter("source = 'tiny'").groupBy("doc_id")
    got = got.agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("m"), F.max("copies").alias("c"))
    counts, mean = [r.n for r in got.collect() if r.n == r.d == r.c == r.m + 1], (640000 + 20) / 2 / 20
    assert len(counts) == 20 and len(set(counts)) > 10
    assert abs(sum(counts) / 20 - mean) < 5 * (mean / 20) ** 0.5
    assert 0.3 * mean < sum((n - mean) ** 2 for n in counts) / 20 < 2.5 * mean


def test_language_and_quality_are_learned(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(frame).filter("held_out and lang is not null and text is not null and lang_pred != 'und'")
    assert found.filter("lang = lang_pred").count() > 0.9 * found.count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_model.classify(frame, labels).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    assert rows.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.75


def test_tool_calls(spark):
    call = lambda i, deps=(), a=None: {"id": i, "name": "f", "arguments": {"x": 1} if a is None else a, "depends_on": list(deps)}
    rows = [
        (1, 0, "user", "é \n hi"),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": [2, {"b": 1, "a": 2}]})),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("b", ["a"]), call("a"), call("bad", a={"y": "z"})]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "ok"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})),
        (1, 5, "assistant", json.dumps({"tool_calls": [call("a"), call("p", ["q"]), call("q", ["p"])]})),
        (1, 6, "tool", json.dumps({"tool_call_id": "p", "content": 1})),
        (1, 6, "tool", json.dumps({"tool_call_id": "q", "content": 1})),
        (2, 0, "user", None),
        (None, None, None, "{not json"),
    ]
    schema = {"f": {"required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer"}}}}
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.link(frame, schemas=schema).collect()
    one = {(r.kind, r.call_id, r.turn): r for r in out}
    order = lambda r: (r.order_turn, r.order_depth, r.turn, r.part)
    assert len(out) == 14
    assert order(one["call", "a", 2]) < order(one["result", "a", 1]) < order(one["call", "b", 2]) < order(one["result", "b", 3])
    assert one["call", "a", 2].linked and one["result", "a", 1].linked and not one["call", "bad", 2].linked
    assert one["call", "bad", 2].errors == "$.x: missing; $.y: unknown"
    assert one["result", "lost", 4].errors == "no call" and one["call", "a", 5].errors == "duplicate id"
    assert one["call", "p", 5].errors == "cycle" and one["call", "q", 5].errors == "cycle"
    assert one["result", "a", 1].json == '{"content":[2,{"a":2,"b":1}],"id":"a"}'
    assert one["message", None, 0].json in ('{"role":"user","text":"é \\n hi"}', '{"role":"user","text":null}')


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    chats = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    for frame in (
        decontaminate.decontaminate(empty, bench),
        mixing.mix(empty),
        langid.identify(empty),
        quality_model.classify(empty, labels),
        chat.link(chats),
        neardup.near_duplicates(empty),
        neardup.deduplicate(empty),
        licenses.scan_licenses(empty),
        sharding.assign(empty),
        substrings.remove_repeats(empty),
        quality_rules.judge(quality_rules.measure(empty)),
    ):
        assert frame.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    start = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    left, seen = start, []
    for name, stage in p.STAGES:
        after = p.materialize(stage(spark, left, DATA), name)
        seen.append((name, left, after))
        left = after
    assert all(a.columns == start.columns for _, _, a in seen[:-1])
    judged = {r.doc_id for r in quality_rules.judge(quality_rules.measure(start)).filter("kept").collect()}
    assert {r.doc_id for r in seen[0][2].collect()} == judged
    classes = neardup.near_duplicates(seen[1][1]).collect()
    assert sorted(r.doc_id for r in seen[1][2].collect()) == sorted({r.class_id for r in classes})
    # Brute force: the windows of the benchmark against the texts that the stage got.
    wanted = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = WORD.findall(lowered(r.text))
        wanted |= {tuple(w[k : k + min(13, len(w))]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = set()
    for r in seen[2][1].collect():
        w, hit = WORD.findall(lowered(r.text)), set()
        for size in {len(x) for x in wanted}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wanted:
                    hit.update(range(k, k + size))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in seen[2][2].collect()} == clean
    assert seen[4][2].count() == seen[3][2].count()
