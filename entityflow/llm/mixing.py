"""Operator 2: mixing sources to target weights by Poisson replication.

A source's mean repetition rate is (its target share) x (bytes of the mixture) / (its bytes). Each document's number
of copies is the Poisson distribution with that mean, inverted at a number in [0, 1) hashed from the seed and the
document (a mean above ``MAX_RATE`` is the sum of as many hashed draws of equal, smaller means): the same document gets the same count in any run, at any parallelism, and whatever else is in the corpus as
long as the rates stay. The copies are exploded and dealt to partitions by a hash of seed, document and copy number,
then sorted by it, which is a uniform global shuffle.

Scale: one pass sums bytes by source (pre-aggregated in the map tasks) into a small table in the shared folder; the
second pass joins the rates (broadcast up to ``BROADCAST_SOURCES`` sources by their count, else a join on the source
and a salt, so that a source with a third of all rows is spread) and shuffles each copy once by a uniform hash.

Cases: a null source is a source of its own. A null doc_id is replaced by the text's MD5 in the hash; rows that repeat
an id get equal counts and shuffle keys. A null or empty text weighs one byte, so that its source has a rate. Sources
without a target weight get none and leave the mixture; weights for sources that do not occur are ignored. No rows:
no rows. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import materialize, unit, without

SEED = 20
TEMPERATURE = 0.5
BROADCAST_SOURCES = 10_000
SALTS = 64
#: A source with a greater mean rate draws its counts as sums of draws of at most this mean.
MAX_RATE = 500.0
#: Copies of one document that are exploded at once.
CHUNK = 10_000


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))


def poisson_cdf(rate: Column) -> Column:
    """Array of P(N <= 0), P(N <= 1), ... far into the tail (12 standard deviations and 20 more)."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def source_rates(
    documents: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float
) -> DataFrame:
    """(_source, rate, _draws, cdf): each source's mean rate, its number of draws and the distribution of one of them."""
    size = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("bigint")
    sizes = documents.groupBy(_key(F.col("source")).alias("_source")).agg(F.sum(size).alias("bytes"))
    sizes = materialize(sizes, "source-sizes")
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(temperature)))
    else:
        given = documents.sparkSession.createDataFrame(
            [("null" if k is None else f"s:{k}", float(v)) for k, v in weights.items()], "_source string, weight double"
        )
        sizes = sizes.join(F.broadcast(given), "_source")
    total = sizes.agg(F.sum("bytes").alias("b"), F.sum("weight").alias("w")).first()
    if not total.b or not total.w:
        return sizes.select("_source", F.lit(0.0).alias("rate"), F.lit(1).alias("_draws"), F.array(F.lit(1.0)).alias("cdf")).limit(0)
    rate = F.col("weight") / F.lit(float(total.w)) * F.lit(float(total.b) * epochs) / F.col("bytes").cast("double")
    rates = sizes.select("_source", rate.alias("rate"))
    rates = rates.withColumn("_draws", F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int"))
    return rates.select("_source", "rate", "_draws", poisson_cdf(F.col("rate") / F.col("_draws")).alias("cdf"))


def mix(
    documents: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """One row per copy: the document's columns, copies (its count), copy_no (from 0) and shuffle_key.

    ``weights`` maps sources to target shares (any scale); without it a source's share is its bytes to the power
    ``temperature``. ``epochs`` is the mixture's expected size over the input's.
    """
    docs = without(documents, ["copies", "copy_no", "shuffle_key", "_source", "_salt", "_u", "_draws", "_chunk", "rate", "cdf"])
    rates = source_rates(docs, weights, temperature, epochs)
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    docs = docs.withColumns({"_source": _key(F.col("source")), "_u": unit(F.lit(seed), who)})
    if rates.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), "_source")
    else:
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("_salt", F.pmod(F.xxhash64("_u"), F.lit(SALTS)).cast("int")).join(
            salted, ["_source", "_salt"]
        )
    drawn = lambda u: F.size(F.filter("cdf", lambda c: c <= u)).cast("bigint")
    more = F.when(F.col("_draws") > 1, F.sequence(F.lit(1), F.col("_draws") - 1)).otherwise(F.array().cast("array<int>"))
    copies = F.aggregate(
        F.transform(more, lambda k: unit(F.lit(seed), who, k)), drawn(F.col("_u")), lambda n, u: n + drawn(u)
    )
    out = (
        joined.withColumn("copies", copies)
        .filter(F.col("copies") > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {CHUNK}"))))
        .withColumn("copy_no", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("copies"), (F.col("_chunk") + 1) * CHUNK) - 1)))
        .withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), who, F.col("copy_no").cast("string"))))
        .drop("_source", "_salt", "_u", "_draws", "_chunk", "rate", "cdf")
    )
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
