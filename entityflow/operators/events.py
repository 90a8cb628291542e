"""Change events: idempotency, arrival order, loops and echoes as windows and range joins over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
RECORD = ["source", "record_id", "field"]


def crm_events(events: DataFrame) -> DataFrame:
    """Events as change events of a CRM; one in 20 is delivered twice. Times in microseconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    one = events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, "salesforce").otherwise("hubspot").alias("source"),
        F.col("user_id").alias("record_id"),
        F.col("event_type").alias("field"),
        F.col("props").alias("value"),
        at.alias("received_us"),
        (at - F.col("event_id") % 5 * MINUTE_US).alias("observed_us"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("change_id"),
    )
    again = one.filter("seq % 20 = 0").withColumns({"seq": F.col("seq") + 1_000_000_000, "received_us": F.col("received_us") + 1_000_000})
    return one.unionByName(again)


def idempotency_key() -> Column:
    """Source, record and change id, or a hash of what changed; delivery time and attempt do not count."""
    what = F.concat_ws("|", *RECORD, F.coalesce("value", F.lit("")), F.col("observed_us").cast("string"))
    last = F.coalesce("change_id", F.substring(F.sha2(what, 256), 1, 32))
    return F.concat_ws(":", F.col("source"), F.col("record_id").cast("string"), last)


def deduplicate(events: DataFrame) -> DataFrame:
    """The first arrival of each idempotency key: a pre-aggregated minimum, not a window."""
    return events.withColumn("key", idempotency_key()).groupBy("key").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("deliveries"))


def order_class(events: DataFrame) -> DataFrame:
    """(seq, class): DUPLICATE, SUPERSEDED or APPLIED against the running latest of the same field."""
    past = Window.partitionBy(*RECORD).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.struct(F.col("observed_us").alias("o"), (-F.col("seq")).alias("s"), F.md5(F.coalesce("value", F.lit(""))).alias("h"))).over(past)
    rows = events.select(*RECORD, "seq", "observed_us", "value", latest.alias("p"))
    same = (F.col("observed_us") == F.col("p.o")) & (F.md5(F.coalesce("value", F.lit(""))) == F.col("p.h"))
    kind = F.when(same, "DUPLICATE").when(F.col("observed_us") <= F.col("p.o"), "SUPERSEDED").otherwise("APPLIED")
    return rows.select("seq", kind.alias("class"))


def loop_counts(events: DataFrame, *, window_us: int = 5 * MINUTE_US, limit: int = 10) -> DataFrame:
    """(seq, changes, tripped): changes of the record within the trailing window, this one included."""
    w = Window.partitionBy("source", "record_id").orderBy("received_us").rangeBetween(-window_us, 0)
    return events.select("seq", F.count(F.lit(1)).over(w).alias("changes")).withColumn("tripped", F.col("changes") > limit)


def echoes(events: DataFrame, writes: DataFrame, *, window_us: int = 5 * MINUTE_US) -> DataFrame:
    """Events whose value we wrote to the same field up to ``window_us`` before; ``writes`` has RECORD, hash, written_us.

    A semi-join on record, field and hash with the interval as a residual condition; no write is paired twice.
    """
    e = events.withColumn("hash", F.md5(F.coalesce("value", F.lit("")))).alias("e")
    on = [F.col(f"e.{c}") == F.col(f"w.{c}") for c in (*RECORD, "hash")]
    near = F.col("w.written_us").between(F.col("e.received_us") - window_us, F.col("e.received_us"))
    return e.join(writes.alias("w"), [*on, near], "left_semi").select("seq")


def plan_reads(n: Column, *, bulk_over: int = 2000, batch: int = 200, job: int = 10_000) -> dict[str, Column]:
    """Method, calls and jobs for reading ``n`` records."""
    jobs = F.ceil(n / job).cast("bigint")
    return {
        "method": F.when(n <= 0, "none").when(n > bulk_over, "bulk").otherwise("batched"),
        "calls": F.when(n <= 0, 0).when(n > bulk_over, 3 * jobs).otherwise(F.ceil(n / batch)).cast("bigint"),
        "jobs": F.when(n > bulk_over, jobs).otherwise(0).cast("bigint"),
    }
