"""Operator 8: sharding with a hierarchical weighted hash tree (law ``key``).

Shards are leaves of a tree: region, rack, shard; a subtree's weight is the sum of its leaves'. A document descends from
the root: at each level every child draws an exponential time -ln(hash of document and child) / weight, and the least
wins, so each child gets documents in proportion to its weight, and only the children on the way are drawn. A changed
weight changes the draws of the nodes above that leaf alone: documents move only into or out of those subtrees, and
inside them only along the changed nodes.

The law: one more shard opens a region of its own, whatever the tree, so all other draws stay as they were and the new
shard takes documents only into itself.

The slot numbers a shard's documents without gaps: each shard is cut into hash buckets, rows are numbered within a
bucket and the buckets' offsets are added, so no task has to sort a whole shard. Rows that repeat an id and text get
places by the number of the repetition, hashed, so repetitions made by a mixture do not stand next to each other.

Scale: the shard is a row expression of about 22 hashes. One count by (shard, bucket), pre-aggregated, makes a table of
shards x buckets rows, one for each ``ROWS_PER_BUCKET`` rows of a shard and one a shuffle partition at least; up to
``MAX_OFFSETS`` of them are broadcast, more are joined. One shuffle by (shard, bucket) brings rows to their place.

Cases: a null doc_id hashes as the empty text. Rows that repeat an id share a shard and get different slots; which of
rows equal in all columns gets which is not told apart. Null and empty texts have size 16 and checksum 0; a very long
text is a row like any other. No rows: no rows. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.llm.common import bind, without

SHARDS = 40
SHARDS_PER_RACK = 5
RACKS_PER_REGION = 4
ROWS_PER_BUCKET = 200_000
MAX_OFFSETS = 2_000_000
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


Leaf = tuple[int, int, int, float]


def tree(shards: int, weights: dict[int, float] | None = None) -> list[Leaf]:
    """(region, rack, shard, weight) of each leaf; shard numbers never change their place."""
    weights = weights or {}
    per_region = SHARDS_PER_RACK * RACKS_PER_REGION
    return [(s // per_region, s // SHARDS_PER_RACK, s, float(weights.get(s, 1.0))) for s in range(shards)]


def grown(leaves: list[Leaf], shard: int, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard in a region and a rack of its own."""
    region, rack = (1 + max((x[k] for x in leaves), default=-1) for k in (0, 1))
    return [*leaves, (region, rack, shard, weight)]


def _children(leaves: list[Leaf], level: int) -> dict[int, list[tuple[int, float]]]:
    """Parent to its (child, weight) pairs on a level: 0 regions (of the root), 1 racks, 2 shards; weightless ones go."""
    out: dict[int, dict[int, float]] = {}
    for leaf in leaves:
        if leaf[3] > 0:
            of = out.setdefault(leaf[level - 1] if level else 0, {})
            of[leaf[level]] = of.get(leaf[level], 0.0) + leaf[3]
    return {parent: sorted(of.items()) for parent, of in out.items()}


def descend(doc_id: Column, leaves: list[Leaf]) -> Column:
    """The shard that the document reaches in the tree: one draw for each child of the nodes on its way."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))

    def draw(level: int, child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child), 11)
        return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53)))

    def winner(level: int, children: Column) -> Column:
        times = F.transform(children, lambda c: F.struct((draw(level, c["id"]) / c["weight"]).alias("time"), c["id"].alias("id")))
        return F.array_min(times)["id"]

    def table(level: int) -> Column:
        lists = [
            f"{parent}, array({','.join(f'named_struct({chr(39)}id{chr(39)},{c},{chr(39)}weight{chr(39)},{w!r}D)' for c, w in of)})"
            for parent, of in _children(leaves, level).items()
        ]
        return F.expr(f"map({','.join(lists)})")

    region = winner(0, F.element_at(table(0), F.lit(0)))
    rack = bind(region, lambda node: winner(1, F.element_at(table(1), node)))
    return bind(rack, lambda node: winner(2, F.element_at(table(2), node)))


def assign(documents: DataFrame, *, shards: int = SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """``documents`` with size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    leaves = tree(shards, weights)
    docs = without(documents, [*RESULT, "_bucket", "_mix", "_nth", "_row", "_first"])
    docs = docs.withColumns(
        {
            "size": (F.octet_length(text) + 16).cast("bigint"),
            "text_crc32": F.crc32(text),
            "law": F.lit("key"),
            "shard": descend(F.col("doc_id"), leaves),
            "grown_shard": descend(F.col("doc_id"), grown(leaves, shards)),
        }
    )
    return number(docs, shards)


def number(docs: DataFrame, shards: int) -> DataFrame:
    """Add slot, gapless from 0 in each shard; ``docs`` has doc_id, size, text_crc32 and shard."""
    rows = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = docs.select("doc_id").count()
    buckets = max(1, -(-int(rows) // shards), -(-n // (ROWS_PER_BUCKET * shards)))
    mix = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size")
    docs = docs.withColumn("_mix", mix).withColumn("_bucket", F.pmod(F.col("_mix"), F.lit(buckets)).cast("int"))
    counts = docs.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # Any order of the repetitions does, if a task that runs again finds the same one: by all that tells rows apart.
    tell = F.xxhash64(*[c for c in docs.columns if c not in ("_bucket", "shard")])
    repeated = Window.partitionBy("shard", "_bucket", "_mix").orderBy("_row")
    within = Window.partitionBy("shard", "_bucket").orderBy("_nth", "_mix", "_row")
    placed = docs.withColumn("_row", tell).repartition("shard", "_bucket")
    placed = placed.withColumn("_nth", F.xxhash64("_mix", F.row_number().over(repeated)))
    placed = placed.withColumn("slot", F.row_number().over(within))
    small = shards * buckets <= MAX_OFFSETS
    out = placed.join(F.broadcast(offsets) if small else offsets, ["shard", "_bucket"])
    return out.withColumn("slot", F.col("slot") - 1 + F.col("_first")).drop("_mix", "_bucket", "_first", "_nth", "_row")
