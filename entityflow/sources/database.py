"""Tables in the shared folder: appended in place, rewritten as a new version; every read and write is a DataFrame."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityflow.session import shared_dir

#: The tables and their columns. Times are microseconds since 1970 in UTC; ids grow with arrival.
SCHEMAS = {
    "entities": "id string, type string, created_us bigint",
    "entity_links": "entity_id string, source string, source_record_id string, confidence double, linked_us bigint, linked_by string",
    "merges": "id bigint, surviving_id string, merged_id string, score double, decided_by string, decided_us bigint, reverted boolean, reverted_us bigint, revert_reason string",
    "observations": "id bigint, entity_id string, field string, value string, source string, kind string, source_record_id string, confidence double, observed_us bigint, recorded_us bigint, expires_us bigint, superseded_by bigint",
    "conflicts": "id bigint, entity_id string, field string, value string, source string, n_candidates bigint, reason string, needs_review boolean, resolved_us bigint, reviewed boolean",
    "review_items": "id bigint, kind string, left_key string, right_key string, score double, payload string, reason string, status string, priority double, created_us bigint",
    "review_decisions": "id bigint, item_id bigint, model_score double, human_match boolean, reviewer string, note string, decided_us bigint",
    "dead_letters": "id bigint, key string, payload string, error string, attempts bigint, created_us bigint, resolved_us bigint",
    "write_log": "target string, record_id string, field string, value_hash string, written_us bigint",
    "change_log": "seq bigint, source string, record_id string, field string, seen_us bigint",
    "quarantine": "source string, record_id string, reason string, created_us bigint, released_us bigint",
    "claims": "key string, claimed_us bigint",
    "attempts": "key string, attempts bigint",
    "suppression": "key string, reason string, created_us bigint",
    "api_usage": "provider string, calls bigint, priority string, note string, at_us bigint",
    "checkpoints": "name string, position string, updated_us bigint",
    "remote_state": "source string, record_id string, field string, value string",
    "outbox": "target string, record_id string, field string, value string, entity_id string, written_us bigint",
}


def iso(us: Column) -> Column:
    """Microseconds as an ISO text in UTC."""
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def from_iso(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text))


class Database:
    """The tables of a folder; ``query`` reads them by name in SQL."""

    def __init__(self, spark: SparkSession, folder: str | None = None, schemas: dict[str, str] | None = None):
        self.spark, self.schemas = spark, schemas or SCHEMAS
        self.folder = folder or f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"

    def _versions(self, name: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(path):
            return []
        whole = [s.getPath() for s in files.listStatus(path) if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in whole)

    def table(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}/{versions[-1]:06d}")

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        kind = self.spark.createDataFrame([], self.schemas[name]).schema
        held = {c.lower() for c in rows.columns}
        return rows.select(*[(F.col(f.name) if f.name.lower() in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; columns that they lack are null. A table with an id numbers them after all it has."""
        if "id bigint" in self.schemas[name] and "id" not in rows.columns:
            last = self.table(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            rows = rows.withColumn("id", F.monotonically_increasing_id() + F.lit(last + 1))
        versions = self._versions(name)
        self._shaped(name, rows).write.mode("append").parquet(f"{self.folder}/{name}/{versions[-1] if versions else 0:06d}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a new version; the one before stays, as readers may still hold it."""
        versions = self._versions(name)
        self._shaped(name, rows).write.parquet(f"{self.folder}/{name}/{versions[-1] + 1 if versions else 0:06d}")

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Put rows in place of those with the same keys, which must be unique in ``rows``."""
        old, new = self.table(name), self._shaped(name, rows)
        same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
        self.replace(name, old.alias("o").join(new.select(*keys).alias("n"), same, "left_anti").unionByName(new))

    def update(self, name: str, where: Column, values: dict[str, Column]) -> int:
        rows, hit = self.table(name), F.coalesce(where, F.lit(False))
        n = rows.filter(hit).count()
        if n:
            self.replace(name, rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}))
        return n

    def delete(self, name: str, where: Column) -> int:
        rows, hit = self.table(name), F.coalesce(where, F.lit(False))
        n = rows.filter(hit).count()
        if n:
            self.replace(name, rows.filter(~hit))
        return n

    def query(self, sql: str, **args) -> DataFrame:
        """SQL over the tables named in braces: ``query("select count(*) from {entities}")``; other arguments are bound."""
        named = {n: self.table(n) for n in self.schemas if "{" + n + "}" in sql}
        return self.spark.sql(sql, **named, **args)

    execute = query

    def one(self, sql: str, **args):
        return self.query(sql, **args).first()

    def scalar(self, sql: str, **args):
        row = self.one(sql, **args)
        return None if row is None else row[0]
