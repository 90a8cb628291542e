"""Operator 3: language identification by multilingual mixture inference.

A text is a bag of hashed byte trigrams, each drawn from one of a few languages. Expectation-maximisation estimates the
languages' proportions from the trigrams' likelihoods; languages are added in the order of their proportions as long as
the penalised log-likelihood (log-likelihood less ``penalty`` x ln(number of trigrams) for each language) rises. The
prediction is the language with the largest proportion in the selected set, and the score is that proportion.

The trigram models (add-half smoothed counts in ``2 ** BITS`` cells a language) are fitted on a hashed sample of about
``SAMPLE_ROWS`` labelled rows, a documented bound that any corpus meets; their training never sees the held-out fifth.

Scale: fitting reads the labels' columns once for a count, then shuffles only the sampled rows into ``FIT_TASKS``
tasks, each of which returns one count table; the driver adds ``FIT_TASKS`` tables of a known size. Prediction is an
Arrow UDF over the scan, without a shuffle, with one model of ``languages x 2 ** BITS`` floats broadcast; beyond
``MAX_LANGUAGES`` languages each has half, a quarter, ... of the cells, so the model keeps its bound and no language goes.

Cases: a null text, or one without a letter, is ``und`` with score 0. Rows without lang or text train nothing. Without
any training row everything is ``und``. A null doc_id hashes as the empty text. Ties go to the language first in
alphabetical order. Equal texts get equal results; a very long text is one bag, in memory of its size. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import unit, without

BITS = 16
SAMPLE_ROWS = 12_000
FIT_TASKS = 6
FOLDS = 5
MAX_LANGUAGES = 400
PENALTY = 4.0
RESULT = ["held_out", "lang_pred", "score", "languages", "proportions"]

#: Lower-case ASCII letters and all other non-ASCII bytes stay; everything else separates words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased words with a space at both ends."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    packed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return packed >> np.uint32(32 - bits)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # cells x languages
    bits: int = BITS

    def infer(self, text: str | None, penalty: float = PENALTY) -> tuple[str, float, list[str], list[float]]:
        """(prediction, score, selected languages, their proportions)."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, [], []
        cells, counts = np.unique(trigrams(text, self.bits), return_counts=True)
        log_p, counts = self.log_p[cells], counts.astype(np.float64)
        single = counts @ log_p
        best = int(np.argmax(single))
        chosen, shares, value = [best], np.ones(1), float(single[best])
        if len(self.languages) > 1:
            top = log_p.max(axis=1)
            p = np.exp(log_p - top[:, None]).astype(np.float64)
            base, price = float(counts @ top), penalty * float(np.log(counts.sum() + 1))
            everything, _ = self._mixture(p, counts, 10)
            order = [best, *[k for k in np.argsort(-everything, kind="stable") if k != best]]
            for size in range(2, len(order) + 1):
                pick = order[:size]
                mixed, gained = self._mixture(p[:, pick], counts, 25)
                if base + gained <= value + price:
                    break
                chosen, shares, value = pick, mixed, base + gained
        ranked = sorted(zip(chosen, shares.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        names, parts = [self.languages[k] for k, _ in ranked], [min(1.0, max(0.0, s)) for _, s in ranked]
        return names[0], parts[0], names, parts

    @staticmethod
    def _mixture(p: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """EM for the mixture's proportions; the log-likelihood relative to p's scale."""
        n, share = counts.sum(), np.full(p.shape[1], 1.0 / p.shape[1])
        for _ in range(rounds):
            new = share * (p.T @ (counts / (p @ share))) / n
            moved, share = np.abs(new - share).max(), new
            if moved < 1e-4:
                break
        return share, float(counts @ np.log(p @ share))


def cell_bits(languages: int) -> int:
    """log2 of the cells of a language, so that all tables together stay within ``MAX_LANGUAGES`` tables of 2 ** BITS."""
    return BITS - max(0, math.ceil(math.log2(max(1, languages) / MAX_LANGUAGES)))


def fit(labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Count trigrams by language over a hashed sample of the rows (doc_id, text, lang) given."""
    named = labelled.filter(F.col("lang").isNotNull())
    seen = named.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("languages")).first()
    n, bits = seen.n, cell_bits(seen.languages)
    share = min(1.0, sample_rows / n) if n else 1.0
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sample = named.filter((unit(F.lit("langid"), who) < share) & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                table = tables.setdefault(lang, np.zeros(1 << bits, np.int64))
                np.add.at(table, trigrams(text.as_py(), bits), 1)
        blobs = [t.astype(np.uint32).tobytes() for t in tables.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.string()), pa.array(blobs, pa.binary())], ["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for row in sample.repartition(FIT_TASKS).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        table = np.frombuffer(bytes(row.counts), np.uint32).astype(np.int64)
        total[row.lang] = total[row.lang] + table if row.lang in total else table
    languages = sorted(total)
    if not languages:
        return Model([], np.zeros((1 << bits, 0), np.float32), bits)
    counts = np.stack([total[k] for k in languages], axis=1).astype(np.float64) + 0.5
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), bits)


def identify(documents: DataFrame, *, sample_rows: int = SAMPLE_ROWS, penalty: float = PENALTY) -> DataFrame:
    """``documents`` with held_out, lang_pred, score, languages and proportions; learns from the rows not held out."""
    out = fold(F.col("doc_id"), FOLDS) == 0
    model = fit(documents.filter(~out), sample_rows=sample_rows)
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct(
        [("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))]
    )

    @F.arrow_udf("struct<lang_pred:string,score:double,languages:array<string>,proportions:array<double>>")
    def infer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shipped.value
        for batch in batches:
            found = [m.infer(x.as_py(), penalty) for x in batch]
            yield pa.array([dict(zip(("lang_pred", "score", "languages", "proportions"), f, strict=True)) for f in found], kind)

    docs = without(documents, [*RESULT, "_lang"])
    docs = docs.withColumns({"held_out": out, "_lang": infer(F.col("text"))})
    return docs.withColumns({k: F.col(f"_lang.{k}") for k in RESULT[1:]}).drop("_lang")
