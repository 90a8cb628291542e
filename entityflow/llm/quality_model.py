"""Operator 4: quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal.

Features: words and runs of punctuation, singly and in pairs, hashed to ``2 ** BITS`` cells, weighted by 1 + ln(count)
and scaled to unit length. Training follows the regularised leader (per-coordinate rates, L1 and L2); a score is the
logistic function of one sparse dot product.

The model is fitted on a hashed sample of about ``SAMPLE_ROWS`` labelled rows, a documented bound that any corpus
meets, outside the held-out third. The learner is sequential by nature; its one task reads that bounded sample only.

Scale: the sampled labels, at most a few times ``SAMPLE_ROWS`` by construction, are broadcast to select their texts
from the scan; the weights come back as one array of ``2 ** BITS`` floats. Scoring is an Arrow UDF over the scan.

Cases: a null or empty text has no features and gets the logistic function of the intercept. Labels that are null or
whose document is missing train nothing; a doc_id with both labels trains with both, a doc_id with several texts with the
least of them. Without labels every score is 0.5. A null
doc_id hashes as the empty text. Equal texts get equal scores. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import only, unit, without
from entityflow.llm.langid import fold

BITS = 18
SAMPLE_ROWS = 8_000
FOLDS, HELD_OUT = 3, 1
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.5
RESULT = ["held_out", "score", "predicted"]

_TOKENS = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(cells, values) of a text's words and word pairs."""
    tokens = _TOKENS.findall(text.encode("utf-8", "surrogatepass")) if text else []
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    one = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
    two = (one[:-1] * np.uint32(0x9E3779B1)) ^ (one[1:] * np.uint32(0x85EBCA6B))
    mixed = np.concatenate([one, two])
    cells, counts = np.unique((mixed ^ (mixed >> np.uint32(15))) & np.uint32((1 << BITS) - 1), return_counts=True)
    values = 1.0 + np.log(counts)
    return cells.astype(np.int64), values / np.sqrt(values @ values)


def train(rows: Iterable[tuple[str | None, int]], epochs: int = EPOCHS) -> np.ndarray | None:
    """Weights of 2 ** BITS cells and the intercept, by FTRL-proximal over the rows in order; None without rows.

    Only the rows' features are held, each text's at most twice as many as its words.
    """
    n, z, bias_n, bias_z = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    seen = [(*features(text), float(y)) for text, y in rows]

    if not seen:
        return None

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    bias = 0.0
    for _ in range(epochs):
        for cells, values, y in seen:
            w = weights(z[cells], n[cells])
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values + bias, -35, 35)))
            g = (p - y) * values
            sigma = (np.sqrt(n[cells] + g * g) - np.sqrt(n[cells])) / ALPHA
            z[cells] += g - sigma * w
            n[cells] += g * g
            d = p - y
            bias_z += d - (np.sqrt(bias_n + d * d) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += d * d
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)
    return np.append(weights(z, n), bias).astype(np.float32)


def score(text: str | None, weights: np.ndarray) -> float:
    cells, values = features(text)
    return float(1.0 / (1.0 + np.exp(-np.clip(weights[cells] @ values + weights[-1], -35, 35))))


def fit(documents: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Train on a hashed sample of the labelled rows (labels: doc_id, quality) outside the held-out fold."""
    labels = only(labels, "doc_id", "quality")
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    marked = marked.select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    n = marked.count()
    share = min(1.0, sample_rows / n) if n else 1.0
    sample = marked.filter(unit(F.lit("quality"), F.col("doc_id")) < share)
    texts = only(documents, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    order = unit(F.lit("order"), F.col("doc_id"))
    # One text an id, so that an id that repeats in the documents does not grow the sample.
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(order.alias("at"), "doc_id", "text", "y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t.as_py(), y.as_py()) for batch in batches for t, y in zip(batch["text"], batch["y"], strict=True))
        found = train(rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["weights"])

    one = texts.repartition(1).sortWithinPartitions("at", "doc_id", "y").mapInArrow(learn, "weights binary")
    found = one.collect()
    return np.frombuffer(bytes(found[0].weights), np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def classify(documents: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``documents`` with held_out, score and predicted."""
    shipped = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample_rows=sample_rows))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = shipped.value
        for batch in batches:
            yield pa.array([score(x.as_py(), weights) for x in batch], pa.float64())

    docs = without(documents, RESULT)
    docs = docs.withColumns({"held_out": fold(F.col("doc_id"), FOLDS) == HELD_OUT, "score": scored(F.col("text"))})
    return docs.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
