"""Operator 9: removal of byte strings of 200 bytes that occur more than once, over sampled and named positions.

A suffix array sorts every position of the corpus; here, as in difference-cover sorting, only sampled positions are
named and shuffled, and the others get their answer from them. The sample is a string synchronising set, not the
residue classes of a difference cover (see README for the reason): a window of 200 bytes samples the place of its
least 100-byte string, so equal windows sample the same offset, wherever they stand; about one byte in 50 is sampled.

Steps: (1) one pass names each sampled place by a hash of its 100 bytes (``name``) and a hash of all the windows that
sample it (``context``); places whose name occurs once are done. (2) Places of equal name and context are a class,
counted with pre-aggregation; in a class of two or more all windows are repeated. (3) Of each name with several contexts one place a context is expanded into its
windows (at most 101), which are named by their hash and counted; this settles the windows at the ends of matches.
(4) The windows found are joined to their documents, united, and cut out.

Scale: no row a byte. Step 1 yields about one row of 32 bytes for 50 bytes, step 3 rows only where contexts of one name
differ. Classes are pre-aggregated, joins are equi-joins whose large side Spark can split. What is gathered for one
document is bounded by its length. Nothing is collected or broadcast; each table goes once the next ones are written. Places are
named by pairs of 64-bit hashes, windows by 96 bits. A document is carried as a 64-bit hash of its id and text; one
aggregate makes sure that no two share it, else the hash is salted anew. Periodic texts (runs of blanks, dashes) make
one row for up to ``REACH`` windows of a class, not a row a byte. A text's arrays take some 50 bytes a byte of it.

Cases: a null text is the empty one; texts under 200 bytes have no window. Equal rows get equal results and count as
occurrences of each other. A null doc_id is an id. No rows: no rows. Columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import discard, materialize, only, without
from entityflow.llm.neardup import _mixed

WIDTH = 200
#: More than the windows of any sampled place.
REACH = 1024
#: Places whose hashes are made at a time.
BLOCK = 1 << 15
RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

_U64 = np.uint64
_SEED = _U64(0x9E3779B97F4A7C15)
#: Half of a hash is compared, the other half is its place; texts are under 2 GB in Spark.
_UPPER = _U64(0xFFFFFFFF << 32)


@cache
def _numbers(salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each byte, powers of an odd base, powers of its inverse), all modulo 2 ** 64."""
    base = int(_mixed(np.array([salt], _U64) * _SEED)[0]) & ~7 | 5
    table = _mixed(np.arange(1, 257, dtype=_U64) * _SEED + _U64(salt))
    inverse, n = pow(base, -1, 1 << 64), BLOCK + REACH
    powers = [np.cumprod(np.append(_U64(1), np.full(n, x, _U64)), dtype=_U64) for x in (base, inverse)]
    return table, *powers


def string_hashes(data: np.ndarray, sizes: tuple[int, ...], salt: int) -> list[np.ndarray]:
    """For each size the hash of the string of that size at every place: a scrambled polynomial, by blocks of places."""
    table, power, inverse = _numbers(salt)
    out = [np.empty(max(0, len(data) - size + 1), _U64) for size in sizes]
    for low in range(0, len(data), BLOCK):
        piece = data[low : low + BLOCK + max(sizes) - 1]
        sums = np.zeros(len(piece) + 1, _U64)
        np.cumsum(table[piece] * power[: len(piece)], out=sums[1:])
        for size, hashes in zip(sizes, out, strict=True):
            n = min(BLOCK, len(piece) - size + 1)
            if n > 0:
                hashes[low : low + n] = _mixed((sums[size : size + n] - sums[:n]) * inverse[:n])
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost minimum of each ``width`` values in a row, as far as their upper half can tell."""
    low, power = (values & _UPPER) | np.arange(len(values), dtype=_U64), 1
    while power * 2 <= width:
        low = np.minimum(low[:-power], low[power:])
        power *= 2
    n = len(values) - width + 1
    return (np.minimum(low[:n], low[width - power : width - power + n]) & ~_UPPER).astype(np.int64)


def sample(data: bytes, width: int):
    """(names, contexts, first windows, last windows) of the sampled places of one text of ``width`` bytes or more."""
    codes = np.frombuffer(data, np.uint8)
    gram = max(1, width // 2)
    (grams,), (windows,) = string_hashes(codes, (gram,), 1), string_hashes(codes, (width,), 3)
    place = _least(grams, width - gram + 1)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:] - 1, len(place) - 1)
    ahead = (place[first] - first).astype(_U64)
    context = _mixed(_mixed(windows[first] * _SEED + windows[last]) + ((last - first).astype(_U64) << _U64(20)) + ahead)
    return _collapsed(grams[place[first]], context, first, last)


def _collapsed(name: np.ndarray, context: np.ndarray, first: np.ndarray, last: np.ndarray):
    """The sampled places with runs of one class, as periodic texts have them, drawn together: the run's first place
    stays, the others become places of up to ``REACH`` windows, so that the class still occurs twice."""
    again = np.append(False, (name[1:] == name[:-1]) & (context[1:] == context[:-1]))
    if again.sum() < 2:
        return name, context, first, last
    # A place starts a row unless it goes on in a run whose row has windows left to take.
    keep = ~again | np.append(False, ~again[:-1])
    run = np.cumsum(keep)
    begin = np.flatnonzero(keep)[run - 1]
    step = max(1, int((last - first).max()) + 1)
    keep |= (np.arange(len(keep)) - begin) % max(1, REACH // step) == 0
    at = np.flatnonzero(keep)
    return name[at], context[at], first[at], last[np.append(at[1:], len(keep)) - 1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U64).view(np.int64))


def _anchors(keyed: DataFrame, width: int) -> DataFrame:
    """(key, name, context, place) of each sampled place; place is its first window x 1024 and the number after it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch["key"], batch["data"], strict=True):
                data = data.as_py()
                if len(data) >= width:
                    name, context, first, last = sample(data, width)
                    keys = pa.array(np.full(len(name), key.as_py(), np.int64))
                    place = pa.array(first.astype(np.int64) * REACH + (last - first))
                    yield pa.RecordBatch.from_arrays([keys, _signed(name), _signed(context), place], ["key", "name", "context", "place"])

    return keyed.mapInArrow(of, "key bigint, name bigint, context bigint, place bigint")


def _windows(placed: DataFrame, width: int) -> DataFrame:
    """(key, single, window, name, at) of the windows of each wanted place; ``wanted`` is a document's list.

    A window is named by 96 bits: its own hash and half of its place's name.
    """
    names = ["key", "single", "window", "name", "at"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data, wanted in zip(batch["key"], batch["data"], batch["wanted"], strict=True):
                (windows,) = string_hashes(np.frombuffer(data.as_py(), np.uint8), (width,), 2)
                wanted = wanted.values
                place, name = (wanted.field(f).to_numpy() for f in ("place", "name"))
                single = wanted.field("single").to_numpy(zero_copy_only=False)
                first, count = place // REACH, place % REACH + 1
                for low in range(0, len(first), 4096):  # bounded batches, also for very long texts
                    n = count[low : low + 4096]
                    number = int(n.sum())
                    of_place = np.repeat(np.arange(low, low + len(n)), n)
                    at = first[of_place] + np.arange(number) - np.repeat(np.cumsum(n) - n, n)
                    columns = [
                        pa.array(np.full(number, key.as_py(), np.int64)),
                        pa.array(single[of_place]),
                        _signed(windows[at]),
                        pa.array(name[of_place].astype(np.int32)),
                        pa.array(at.astype(np.int32)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(of, "key bigint, single boolean, window bigint, name int, at int")


def cut(data: bytes, starts: list[tuple[int, int]], width: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed) where all windows from ``first`` to ``last`` of each pair go."""
    kept, removed, spans, at = [], 0, 0, 0
    end = -1
    for first, last in sorted(starts):
        if first > end:  # a new run; a run that only touches the one before is part of it
            spans += 1
            kept.append(data[at:first])
            end = first
        removed += max(0, last + width - end)
        end = at = max(end, last + width)
    kept.append(data[at:])
    return b"".join(kept), removed, spans


def document_key(docs: DataFrame, data: Column) -> Column:
    """A 64-bit key that no two different (doc_id, text) share: of hashes by salt the first that is found to tell all apart."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    hashed = docs.select(F.md5(F.concat_ws("|", who, F.md5(data))).alias("whole"))
    for salt in range(16):
        key = F.xxhash64(F.lit(salt), "whole")
        seen = hashed.groupBy(key.alias("key")).agg(F.min("whole").alias("least"), F.max("whole").alias("most"))
        if seen.filter("least <> most").isEmpty():
            return F.xxhash64(F.lit(salt), F.md5(F.concat_ws("|", who, F.md5(data))))
    raise ArithmeticError("no salt tells all documents apart")


def remove_repeats(documents: DataFrame, *, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """``documents`` with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that are left)."""
    if not 0 < width <= REACH:
        raise ValueError(f"width must be from 1 to {REACH}")
    docs = without(documents, [*RESULT, "_key", "_runs", "_cut"])
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = document_key(docs, data)
    keyed = only(docs, "doc_id", "text").select(key.alias("key"), data.alias("data"))
    anchors = materialize(_anchors(keyed, width), "sampled-places")
    # Most names occur once and can't be repeated: only the others go on.
    several = anchors.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    several = materialize(several, "repeated-names")
    live = materialize(anchors.join(several, "name", "left_semi"), "live-places")
    discard(anchors, several)
    # Any place of a class may stand for it: one of the least key. The aggregates are numbers, so they are hashed.
    classes = live.groupBy("name", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min_by("place", "key").alias("place")
    )
    classes = materialize(classes, "place-classes")
    several = classes.groupBy("name").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1").select("name")
    ends = classes.join(several, "name").select("key", F.struct("name", (F.col("n") == 1).alias("single"), "place").alias("w"))
    ends = ends.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    inside = live.join(classes.filter("n > 1").select("name", "context"), ["name", "context"]).select("key", "place")
    inside = materialize(inside, "repeated-places")
    ends = materialize(ends, "wanted-places")
    discard(live, classes)
    windows = materialize(_windows(ends.join(keyed, "key").select("key", "data", "wanted"), width), "end-windows")
    discard(ends)
    twice = windows.groupBy("window", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window", "name")
    at_ends = windows.filter("single").join(twice, ["window", "name"]).select("key", (F.col("at").cast("bigint") * REACH).alias("place"))
    at_ends = materialize(at_ends, "repeated-ends")
    discard(windows)
    runs = inside.unionByName(at_ends).groupBy("key").agg(F.collect_set("place").alias("_runs"))
    runs = materialize(runs, "repeated-runs")
    discard(inside, at_ends)

    def left(texts_: pa.Array, runs_: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts_, runs_, strict=True):
            value = (text.as_py() or "").encode("utf-8", "surrogatepass")
            pairs = found.as_py() or []
            kept, removed, spans = cut(value, [(p // REACH, p // REACH + p % REACH) for p in pairs], width)
            out.append({"n": len(value), "removed": removed, "spans": spans, "sha": hashlib.sha256(kept).hexdigest(), "kept": kept if texts else None})
        kind = [("n", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("sha", pa.string()), ("kept", pa.binary())]
        return pa.array(out, pa.struct(kind))

    left.__annotations__ = {"texts_": pa.Array, "runs_": pa.Array, "return": pa.Array}
    done = F.arrow_udf(left, "struct<n:bigint,removed:bigint,spans:bigint,sha:string,kept:binary>")
    found = docs.withColumn("_key", key).join(runs.withColumnRenamed("key", "_key"), "_key", "left")
    found = found.withColumn("_cut", done("text", "_runs"))
    out = found.withColumns(
        {"n_bytes": F.col("_cut.n"), "n_removed": F.col("_cut.removed"), "n_spans": F.col("_cut.spans"), "kept_sha256": F.col("_cut.sha")}
    )
    return (out.withColumn("kept", F.col("_cut.kept")) if texts else out).drop("_key", "_runs", "_cut")
