"""Operator 10 (native): quality rules with host-level verdicts.

``measure`` counts in each text, row by row, what the rules need; ``judge`` sums the documents and the failures of
each host, shrinks the hosts' failure rates with a beta prior fitted to all hosts by moments, and joins the hosts whose
shrunk rate is too high back to the documents. A document is kept if it fails no rule and its host is not rejected.
DataFrame functions only.

Rules: fewer than 20 words; over 30 % of the words in repeated 8-word windows (these two are the base rules); symbols
at 15 % of the characters in words or more; over half of the lines with words repeating an earlier line (5 lines at
least).

Scale: the counts need no shuffle. Host sums are pre-aggregated in the map tasks, so a host with a third of all rows
sends one row a task. Only rejected hosts are joined back: broadcast up to ``BROADCAST_HOSTS`` of them by their count,
beyond it a join on host and a salt. Repeated windows are found by sorting window hashes within a text, in
O(n log n) also where everything repeats.

Cases: a null text has no words and fails; empty texts too. A null host is a host of its own. Equal rows get equal
verdicts. No rows: no rows. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import bind, materialize, without

WINDOW = 8
MIN_WORDS = 20
MAX_HOST_RATE = 0.5
BROADCAST_HOSTS = 100_000
SALTS = 64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
RESULT = [*COUNTS, "base_failed", "rule_failed", "host_rate", "kept"]

_SPACE = r"[\x20\x09-\x0D]+"


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more, the first occurrence included; ``words`` is bound."""

    def covered(positions: Column) -> Column:
        reach = lambda x, k: F.least(F.lit(window), F.coalesce(F.get(positions, k + 1) - x, F.lit(window)))
        return _total(F.transform(F.transform(positions, reach), lambda x: x.cast("bigint")))

    def repeats(ordered: Column) -> Column:
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        found = F.transform(
            ordered,
            lambda x, k: F.when(same(x, F.get(ordered, k - 1)) | same(x, F.get(ordered, k + 1)), x["i"]),
        )
        return bind(F.sort_array(F.filter(found, lambda i: i.isNotNull())), covered)

    def in_hashes(hashes: Column) -> Column:
        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            bind(F.sort_array(numbered), repeats)
        )

    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, F.lit(0).cast("bigint")).otherwise(bind(hashes, in_hashes))


def measure(documents: DataFrame) -> DataFrame:
    """``documents`` with the counts, base_failed and rule_failed of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def in_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            _total(F.transform(w, lambda x: F.char_length(x).cast("bigint"))).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def in_lines(x: Column) -> Column:
        n = F.size(x).cast("bigint")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    docs = without(documents, [*RESULT, "_words", "_lines"])
    docs = docs.withColumns({"_words": bind(words, in_words), "_lines": bind(lines, in_lines)})
    docs = docs.withColumns(
        {
            "n_words": F.col("_words.n_words"),
            "word_chars": F.col("_words.word_chars"),
            "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint"),
            "n_lines": F.col("_lines.n_lines"),
            "n_dup_lines": F.col("_lines.n_dup_lines"),
            "n_repeat_words": F.col("_words.n_repeat_words"),
        }
    ).drop("_words", "_lines")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rules = base | (100 * F.col("n_symbols") >= 15 * F.col("word_chars"))
    rules = rules | ((F.col("n_lines") >= 5) & (2 * F.col("n_dup_lines") > F.col("n_lines")))
    return docs.withColumns({"base_failed": base, "rule_failed": rules})


def host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h:"), host), F.lit("null"))


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(_host, n, failed, host_rate): the failure rate of each host, shrunk to all hosts' beta prior."""
    hosts = measured.groupBy(host_key(F.col(host)).alias("_host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("bigint")).alias("failed")
    )
    hosts = materialize(hosts, "hosts")
    n, failed = F.col("n"), F.col("failed")
    sums = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count(F.lit(1)).alias("h"),
        F.sum(failed * failed / n).alias("ff"), F.sum(n * n).alias("nn"),
    ).first()
    if not sums.n:
        return hosts.withColumn("host_rate", F.lit(0.0))
    mean = sums.f / sums.n
    # Method of moments for the spread between hosts: what exceeds the binomial spread within them.
    within = mean * (1 - mean) * (sums.h - 1)
    spread = max(0.0, (sums.ff - sums.n * mean * mean - within) / max(1e-9, sums.n - float(sums.nn) / sums.n))
    strength = min(1e6, max(2.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    return hosts.withColumn("host_rate", (failed + F.lit(mean * strength)) / (n + F.lit(strength)))


def judge(measured: DataFrame, *, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``measured`` with host_rate (only of rejected hosts, else null) and kept."""
    rejected = host_rates(measured, host).filter(F.col("host_rate") > max_host_rate).select("_host", "host_rate")
    docs = without(measured, ["host_rate", "kept", "_host", "_salt"]).withColumn("_host", host_key(F.col(host)))
    if rejected.count() <= BROADCAST_HOSTS:
        docs = docs.join(F.broadcast(rejected), "_host", "left")
    else:
        docs = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
        salted = rejected.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.join(salted, ["_host", "_salt"], "left").drop("_salt")
    return docs.drop("_host").withColumn("kept", ~F.col("rule_failed") & F.col("host_rate").isNull())
