"""Each query of the base library against its SQL, and literal facts of the match keys."""

import duckdb
import pytest

from entityflow import catalog
from entityflow.functions import text
from entityflow.operators import graph

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    order = {d[0]: k for k, d in enumerate(want.description)}
    rows = sorted((tuple(r[order[c]] for c in names) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == rows
    assert rows


@pytest.mark.parametrize(
    ("f", "raw", "want"),
    [
        (text.normalize_email, "J.Smith+news@Gmail.com", "jsmith@gmail.com"),
        (text.normalize_email, "jsmith@googlemail.com", "jsmith@gmail.com"),
        (text.normalize_email, "j.smith@company.com", "j.smith@company.com"),
        (text.normalize_email, "@x.com", None),
        (text.normalize_phone, "+1 (415) 555-0100 x22", "+14155550100"),
        (text.normalize_phone, "415.555.0100", "+14155550100"),
        (text.normalize_phone, "00 44 20 7123 4567", "+442071234567"),
        (text.normalize_phone, "123", None),
        (text.normalize_company, "The Acme Corporation", "acme"),
        (text.normalize_company, "The Co", "the co"),
        (text.normalize_domain, "https://www.Acme.com/a?b", "acme.com"),
    ],
)
def test_match_keys(spark, f, raw, want):
    frame = spark.createDataFrame([(raw,)], "x string")
    assert frame.select(f(frame["x"])).first()[0] == want


def test_long_chain_is_one_component(spark):
    links = spark.range(60).selectExpr("(id * 37) % 61 a", "((id + 1) * 37) % 61 b")
    assert {r.component for r in graph.components(links).collect()} == {0}


def test_clusters_of_the_fixtures(spark):
    rows = [("x", "y", 0.95), ("y", "z", 0.95), ("x", "z", 0.05), *[(f"r{i}", f"r{i+1}", 0.85) for i in range(9)]]
    got = {r.component: (r.size, r.verdict) for r in graph.verdicts(graph.edges(spark.createDataFrame(rows, "a string, b string, score double"))).collect()}
    assert got == {"x": (3, "LOW_COHESION"), "r0": (10, "LOW_COHESION")}


def test_stream_counts_each_key_once(spark, tmp_path):
    from entityflow.operators import events
    from entityflow.session import table
    from entityflow.streaming.dedup import deduplicate_stream

    batch = events.crm_events(table(spark, SF, "events")).selectExpr("*", "timestamp_micros(received_us) as received_at")
    batch.write.parquet(str(tmp_path / "in"))
    stream = deduplicate_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    run.start(str(tmp_path / "out")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("key").distinct().count() == events.deduplicate(batch).count()
