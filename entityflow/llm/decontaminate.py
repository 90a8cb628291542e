"""Operator 1: benchmark decontamination with one Aho-Corasick automaton over words.

The normalised benchmark texts are cut into windows of 13 words; the automaton's alphabet is the benchmark's
vocabulary (a word's number; 0 for any other word), so it needs 13 nodes a window whatever the words' lengths, and a
match ends at a word's index. Each text is scanned once. The matched word ranges are mapped back to character offsets
of the original text, for the few texts that match.

Scale: no shuffle; the documents stream through an Arrow UDF. What is broadcast is one block of benchmark items of at
most ``block_bytes`` of text, by a running sum of their sizes. A benchmark within that bound (the usual case) is one
block, one automaton and one scan. An automaton takes some 100 bytes of memory a byte of text, so a larger benchmark is
read block by block: a scan for each, with one block on the driver and one automaton in a task at a time, writes the
matched ranges of the texts that match; these are united and joined to the documents by the text's MD5. No window is left
out, and the rows are the same. A single item larger than the bound is a block of its own.

Cases: a null or empty text has no words, is never contaminated and hits no item. An item without words has no
window. A very long text is scanned as one sequence of words, in memory of its own size. Items that share an item_id count once; an item with a null id marks words as hit but is not listed, as it has
no name. An empty benchmark leaves every document clean. Equal rows get equal results. Input columns named like a
result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import WORD_IN_TEXT, materialize, only, to_words, without

WINDOW = 13
BLOCK_BYTES = 1 << 20
RESULT = ["n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated"]

_HIT = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"
_RUNS = "struct<starts:array<int>,ends:array<int>>"
_SPANS = "array<struct<first:bigint,last:bigint>>"


def build_automaton(items: list[tuple[str | None, str | None]], window: int):
    """(automaton, vocabulary, number of windows) of the given items."""
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in to_words(text)]
        size = min(window, len(numbers))
        for at in range(len(numbers) - size + 1 if numbers else 0):
            windows.setdefault(tuple(numbers[at : at + size]), set()).update([item_id] if item_id is not None else [])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, ids in windows.items():
        automaton.add_word(key, (len(key), tuple(ids)))
    if windows:
        automaton.make_automaton()
    return automaton, vocabulary, len(windows)


def scan(text: str | None, automaton, vocabulary: dict[bytes, int], n_windows: int):
    """(number of words, disjoint ranges of hit words, ids of items with occurring windows) of one text."""
    words = to_words(text)
    ranges: list[list[int]] = []
    ids: set[str] = set()
    if n_windows and words:
        number = vocabulary.get
        for end, (size, found) in automaton.iter(tuple([number(w, 0) for w in words])):
            ids.update(found)
            start = end - size + 1
            while ranges and ranges[-1][1] >= start - 1:  # matches come by their ends; unite what overlaps or touches
                start = min(start, ranges.pop()[0])
            ranges.append([start, end])
    return len(words), ranges, sorted(ids)


def _scanner(items, window: int):
    """An Arrow UDF over texts for one broadcast block of items."""

    @F.arrow_udf(_HIT)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = build_automaton(items.value, window)
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("starts", pa.list_(pa.int32())),
                ("ends", pa.list_(pa.int32())),
                ("items", pa.list_(pa.string())),
            ]
        )
        for batch in batches:
            out = []
            for value in batch:
                n, ranges, ids = scan(value.as_py(), *machine)
                out.append({"n_words": n, "starts": [r[0] for r in ranges], "ends": [r[1] for r in ranges], "items": ids})
            yield pa.array(out, kind)

    return hits


def _unite(runs: pa.Array) -> pa.Array:
    """Word ranges of several blocks as disjoint ranges in order."""
    out = []
    for found in runs.to_pylist():
        ranges: list[list[int]] = []
        for start, end in sorted((r["start"], r["end"]) for r in found):
            if ranges and start <= ranges[-1][1] + 1:
                ranges[-1][1] = max(ranges[-1][1], end)
            else:
                ranges.append([start, end])
        out.append({"starts": [r[0] for r in ranges], "ends": [r[1] for r in ranges]})
    return pa.array(out, pa.struct([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))


_unite.__annotations__ = {"runs": pa.Array, "return": pa.Array}


def _to_spans(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Word ranges as character offsets [first, last) of the original text."""
    out = []
    for value, one, other in zip(text, starts.to_pylist(), ends.to_pylist(), strict=True):
        if not one:
            out.append([])
            continue
        offsets = [m.span() for m in WORD_IN_TEXT.finditer(value.as_py())]
        out.append([{"first": offsets[s][0], "last": offsets[e][1]} for s, e in zip(one, other, strict=True)])
    return pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in lists of at most ``block_bytes`` of text each, read one after another."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull())
    block, size = [], 0
    for row in rows.toLocalIterator():
        n = len(row.text.encode("utf-8", "surrogatepass"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    yield block


def _in_blocks(docs: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """``docs`` with _hit, where the items are too many for one automaton: one scan a block, united by the text's MD5."""
    context, found = docs.sparkSession.sparkContext, None
    for block in blocks:
        items = context.broadcast(block)
        hit = docs.select(F.md5("text").alias("_h"), _scanner(items, window)(F.col("text")).alias("hit"))
        hit = hit.filter(F.size("hit.starts") > 0).select("_h", "hit.starts", "hit.ends", "hit.items").dropDuplicates(["_h"])
        hit = materialize(hit, "block-hits")
        items.unpersist()
        found = hit if found is None else found.unionByName(hit)
    runs = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).cast("array<struct<start:int,end:int>>")
    found = found.select("_h", runs.alias("runs"), "items").groupBy("_h").agg(
        F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    found = found.select("_h", F.arrow_udf(_unite, _RUNS)("runs").alias("r"), "items")
    none = _scanner(context.broadcast([]), window)(F.col("text"))
    out = docs.withColumns({"_h": F.md5("text"), "_none": none}).join(found, "_h", "left")
    hit = F.struct(
        F.col("_none.n_words").alias("n_words"),
        F.coalesce("r.starts", "_none.starts").alias("starts"),
        F.coalesce("r.ends", "_none.ends").alias("ends"),
        F.coalesce("items", "_none.items").alias("items"),
    )
    return out.withColumn("_hit", hit).drop("_h", "_none", "r", "items")


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    min_share: float = 0.05,
    spans: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``documents`` with n_words, n_hit, n_items, item_ids, spans (if asked for) and contaminated.

    The spans are [first, last) in characters of the original text. A text is contaminated if at least ``min_share`` of its words, and one at least, lie in windows of the benchmark.
    """
    benchmark = only(benchmark, "item_id", "text")
    docs = without(documents, [*RESULT, "_hit", "_h", "_none", "r", "items"])
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        items = documents.sparkSession.sparkContext.broadcast(first)
        docs = docs.withColumn("_hit", _scanner(items, window)(F.col("text")))
    else:
        docs = _in_blocks(docs, chain([first, second], blocks), window)
    n_hit = F.aggregate(
        F.zip_with("_hit.starts", "_hit.ends", lambda s, e: (e - s + 1).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    out = docs.withColumns(
        {
            "n_words": F.col("_hit.n_words"),
            "n_hit": n_hit,
            "n_items": F.size("_hit.items").cast("bigint"),
            "item_ids": F.col("_hit.items"),
        }
    )
    if spans:
        out = out.withColumn("spans", F.arrow_udf(_to_spans, _SPANS)(F.col("text"), F.col("_hit.starts"), F.col("_hit.ends")))
    share = Fraction(str(min_share))
    enough = F.col("n_hit") * share.denominator >= F.col("n_words") * share.numerator
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & enough).drop("_hit")
