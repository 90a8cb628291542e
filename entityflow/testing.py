"""Synthetic people with known duplicates, chains of weak links, and a simulated deployment of two CRMs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityflow.operators import resolve
from entityflow.operators.sync import SyncEngine
from entityflow.sources.crm import MAPPINGS, SimulatedHubSpot, SimulatedSalesforce
from entityflow.sources.database import Database
from entityflow.sources.policies import PolicySet, find_policy_path

#: 2026-01-01 in microseconds.
EPOCH_US = 1_767_225_600_000_000
FIRST = (("william", "bill"), ("robert", "bob"), ("katherine", "kate"), ("michael", "mike"), ("elizabeth", "liz"), ("thomas", "tom"))
LAST = ("Smith", "Jones", "Garcia", "Nguyen", "Fischer", "Okafor")
COMPANIES = ("Acme Inc", "Globex Corporation", "Initech LLC", "Umbrella Ltd")


def synthetic_corpus(spark: SparkSession, n_people: int = 60, *, seed: int = 11) -> DataFrame:
    """Records (source, source_record_id, person, raw fields): two or three copies of each person, with nicknames, other
    spellings of mail and company, and missing phones, drawn by hash."""
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(f"{seed}{salt}"), "person", "copy"), F.lit(n)).cast("int")
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(f"{seed}{salt}"), "person"), F.lit(n)).cast("int")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    people = spark.range(n_people).select(F.col("id").cast("int").alias("person"))
    copies = people.withColumn("copy", F.explode(F.sequence(F.lit(0), 1 + own("copies", 2))))
    family = own("first", len(FIRST))
    first = F.when(draw("nick", 3) == 0, pick([b for _, b in FIRST], family)).otherwise(pick([a for a, _ in FIRST], family))
    last, company = pick(LAST, own("last", len(LAST))), pick(COMPANIES, own("company", len(COMPANIES)))
    mail = F.concat(pick([a for a, _ in FIRST], family), F.lit("."), F.lower(last), F.col("person").cast("string"), F.lit("@"), F.lower(F.split_part(company, F.lit(" "), F.lit(1))), F.lit(".com"))
    return copies.select(
        pick(("salesforce", "hubspot"), F.col("copy") % 2).alias("source"),
        F.concat(F.lit("p"), F.col("person").cast("string"), F.lit("-"), F.col("copy").cast("string")).alias("source_record_id"),
        "person",
        F.when(draw("mail", 12) > 0, F.when(draw("tag", 4) == 0, F.replace(mail, F.lit("@"), F.lit("+news@"))).otherwise(mail)).alias("email"),
        F.when(draw("phone", 8) > 0, F.concat(F.lit("+1415555"), (F.col("person") + 1000).cast("string"))).alias("phone"),
        F.lit(True).alias("phone_verified"),
        F.initcap(first).alias("first_name"),
        last.alias("last_name"),
        F.when(draw("spell", 3) == 0, F.split_part(company, F.lit(" "), F.lit(1))).otherwise(company).alias("company"),
    )


def keyed(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.concat_ws(":", "source", "source_record_id").alias("key"), "person")


def true_pairs(corpus: DataFrame) -> DataFrame:
    """(l, r) of the same person, l < r."""
    left, right = (keyed(corpus).withColumnRenamed("key", k) for k in ("l", "r"))
    return left.join(right, "person").filter("l < r").select("l", "r")


def labelled_pairs(corpus: DataFrame) -> DataFrame:
    """(l, r, is_match) of all pairs of a small corpus: a fixture for training, quadratic by definition."""
    left, right = (keyed(corpus).select(F.col("key").alias(k), F.col("person").alias(f"p{k}")) for k in ("l", "r"))
    return left.join(right, F.col("l") < F.col("r")).select("l", "r", (F.col("pl") == F.col("pr")).alias("is_match"))


def build_chain(spark: SparkSession, n: int = 8, score: float = 0.85, *, ends: float | None = None) -> DataFrame:
    """Edges r0-r1-...-r(n-1) of one score, and the pair of both ends as distinct."""
    rows = [(f"r{i}", f"r{i + 1}", score) for i in range(n - 1)] + ([("r0", f"r{n - 1}", ends)] if ends is not None else [])
    return spark.createDataFrame(rows, "a string, b string, score double")


def chain_records(spark: SparkSession, n: int = 8) -> DataFrame:
    """Records of which only neighbours resemble each other: each shares its phone or its mail with the next."""
    rows = [("crm", f"r{i}", f"user{(i + 1) // 2}@x.com", f"+1415555{1000 + i // 2}", True, "J", "Smith") for i in range(n)]
    return spark.createDataFrame(rows, "source string, source_record_id string, email string, phone string, phone_verified boolean, first_name string, last_name string")


@dataclass
class SimulatedClock:
    now_us: int = EPOCH_US

    def __call__(self) -> int:
        return self.now_us

    def advance(self, seconds: float) -> int:
        self.now_us += int(seconds * 1e6)
        return self.now_us


@dataclass
class SyncTestEnv:
    """Two simulated CRMs and an engine; events of every write of the engine come back as the next batch."""

    spark: SparkSession
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        self.clock, self.db = SimulatedClock(), Database(self.spark)
        self.inbox: list[DataFrame] = []
        self.salesforce, self.hubspot = SimulatedSalesforce(self.spark, **self.options), SimulatedHubSpot(self.spark, **self.options)
        for client in (self.salesforce, self.hubspot):
            client.write = self._heard(client.write)
        self.engine = SyncEngine(self.db, PolicySet.load(find_policy_path()), {"salesforce": self.salesforce, "hubspot": self.hubspot})

    def _heard(self, write):
        def heard(rows, at_us, **options):
            events = write(rows, at_us, **options)
            self.inbox.append(events)
            return events

        return heard

    def seed_entity_everywhere(self, entity_id: str, records: dict[str, str], values: dict[str, str]) -> None:
        """One entity with a record in each system, holding the same values."""
        self.engine.entities.create(self.spark.createDataFrame([(entity_id, "person")], "id string, type string"), self.clock())
        links = [(entity_id, s, r) for s, r in records.items()]
        self.engine.entities.link(self.spark.createDataFrame(links, "entity_id string, source string, source_record_id string"), self.clock())
        for source, record in records.items():
            rows = [(record, MAPPINGS[source][f], v) for f, v in values.items() if f in MAPPINGS[source]]
            client = {"salesforce": self.salesforce, "hubspot": self.hubspot}[source]
            client.seed(self.spark.createDataFrame(rows, "record_id string, field string, value string"), self.clock())
            self.inbox.clear()
            held = [(source, *r) for r in rows]
            self.db.upsert("remote_state", self.spark.createDataFrame(held, "source string, record_id string, field string, value string"), ["source", "record_id", "field"])

    def user_edit(self, source: str, record_id: str, name: str, value: str) -> None:
        client = {"salesforce": self.salesforce, "hubspot": self.hubspot}[source]
        client.user_edit(self.spark.createDataFrame([(record_id, name, value)], "record_id string, field string, value string"), self.clock())

    def cycle(self, seconds: float = 30) -> None:
        """Deliver what has come in, as one batch numbered by arrival."""
        self.clock.advance(seconds)
        heard, self.inbox = self.inbox, []
        if not heard:
            return
        events = heard[0]
        for more in heard[1:]:
            events = events.unionByName(more)
        last = self.db.table("change_log").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows = sorted(events.collect(), key=lambda r: (r.received_us, r.source, r.seq))  # a handful of simulated events
        numbered = [r.asDict() | {"seq": last + 1 + i} for i, r in enumerate(rows)]
        if numbered:
            self.engine.run_cycle(self.spark.createDataFrame(numbered, events.schema), self.clock())


def seed_observations(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Observations from (id, entity_id, field, value, source, kind, confidence, observed_day, ttl_days)."""
    made = [(i, e, f, v, s, k, c, EPOCH_US + d * resolve.DAY_US, EPOCH_US + d * resolve.DAY_US, None if t is None else EPOCH_US + (d + t) * resolve.DAY_US) for i, e, f, v, s, k, c, d, t in rows]
    return spark.createDataFrame(made, "id bigint, entity_id string, field string, value string, source string, kind string, confidence double, observed_us bigint, recorded_us bigint, expires_us bigint")
