"""Operator 6: near-duplicate detection with DartMinHash signatures and banded joining.

A text is the multiset of its 5-word shingles; the similarity of two texts is the weighted Jaccard similarity with the
multiplicities as weights, and texts of 0.8 or more are linked. Classes are the connected components of the links.

DartMinHash: each unit of weight of an element is a cell of width one along an axis of ranks. Darts fall on that axis
as a Poisson process seeded by the cell's hash, slice by slice of fixed bounds, so all texts with that cell see the same
darts. A text throws the darts of its cells up to the rank at which about K (ln K + 2) of them are expected, deals
them to K coordinates by their hashes, and keeps the earliest of each coordinate; coordinates left empty look at
further slices. Two texts agree on a coordinate with the probability of their similarity. The cost is linear in the
text's length plus K ln K, whatever K.

Steps: (1) one pass makes (doc_id, MD5 of the text, 25 band keys of 5 coordinates, one byte for each of 256
coordinates) and writes it; equal texts fall together by their MD5, pre-aggregated. (2) The texts of a band's bucket
are compared with the bucket's leader first. (3) A pair's estimate from 256 coordinates settles it when it
is six standard errors or more away from 0.8; else the shingles of both texts are counted. (4) Components of the links.
(5) Buckets of more than two texts are cut into finer ones by 4 and by 10 more coordinates, whose members are compared
with leaders drawn anew for each bucket; of these pairs only those across components are looked at. (6) Buckets that
still hold several components are compared whole, in blocks of ``PART`` by ``PART`` texts: each text is linked to the
partner of the highest estimate if their shingles agree, then the texts with any likely partner that are still apart
are compared exactly by products of shingle matrices. No link of two texts that share a bucket depends on a leader.
(7) Components of all links; labels join the documents.

Scale: two texts with J >= 0.8 share a band with probability 1 - 5e-5. Every text makes 25 rows of 24 bytes. Steps 2 and
5 make a linear number of pairs and join most of a group. Step 6 makes no row for a pair: a block holds ``2 x PART``
texts at most and returns one row a text. Its time alone grows with the square of a family of texts just under 0.8, as
no estimate tells them from 0.8; its blocks spread over all tasks. Leaders are minima, pre-aggregated and written, so
joins to them are equi-joins whose large side Spark can split. Components use large-star and small-star rounds over
links alone, each written to the shared folder. Nothing is collected or broadcast by us.

Cases: a null text belongs to a class of its own, doc_id. Equal texts are one class, empty ones too. A text without
words is similar to nothing but its copies; a text of one to four words is one shingle. The class id is its smallest
doc_id (null where all are null). Rows that repeat an id are rows of their own. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import discard, materialize, only, to_words, without

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 256
BANDS, ROWS = 25, 5
#: Further coordinates of the finer buckets, by level.
FINER = (4, 10)
#: Six standard errors of a similarity of 0.8 over 256 coordinates.
MARGIN = 0.15
#: Texts, and bytes of shingles, of a bucket that are dealt together when its components are compared.
PART = 256
PART_BYTES = 32 << 20
#: Texts whose shingles go to one file.
TEXTS_PER_FILE = 1 << 12
#: Columns of a shingle matrix at a time.
SLICE = 4096

_SLICES = np.array([0.0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0])
_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _poisson_table(mean: float) -> np.ndarray:
    p, total, out = np.exp(-mean), 0.0, []
    for k in range(18):
        total += p
        out.append(total)
        p *= mean / (k + 1)
    return np.array(out)


_CDF = {w: _poisson_table(w) for w in (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)}


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's shingles, each as often as it occurs; fewer words than a shingle are one."""
    words = to_words(text)
    if not words:
        return np.zeros(0, _U64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), _U64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, _U64)
    for k in range(size):
        total = _mixed(total + h[k : k + n] + _U64(k + 1))
    total.sort()
    return total


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if not len(a) or not len(b):
        return 0.0
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common)


def distinct_cells(found: np.ndarray) -> np.ndarray:
    """A hash of its own for each copy of each element of a sorted multiset."""
    at = np.arange(len(found), dtype=np.int64)
    fresh = np.append(True, found[1:] != found[:-1])
    copy = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(_U64)
    return _mixed(found + (copy + _U64(1)) * _U64(0x9E3779B97F4A7C15))


def signature(cells: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates; ``cells`` is a sorted multiset of element hashes."""
    cells = distinct_cells(cells)
    darts, filled = np.zeros(k, _U64), np.zeros(k, bool)
    target = k * (np.log(k) + 2) / len(cells)
    low = 0.0
    while not filled.all():
        bounds = [low]
        while bounds[-1] < target or len(bounds) == 1:  # slices of fixed bounds, up to the wanted rank
            bounds.append(float(_SLICES[np.searchsorted(_SLICES, bounds[-1], "right")]) if bounds[-1] < 1 else bounds[-1] + 1.0)
        starts, widths = np.array(bounds[:-1]), np.diff(bounds)
        tag = _mixed((starts * 16).astype(_U64) + _U64(0x5851F42D4C957F2D))
        seeds = _mixed(cells[None, :] ^ tag[:, None])
        u = (seeds >> _U64(11)).astype(np.float64) * 2.0**-53
        cdf = np.stack([_CDF[w] for w in widths])
        number = np.zeros(u.shape, np.int64)
        for step in range(cdf.shape[1]):
            more = u > cdf[:, step, None]
            if not more.any():
                break
            number += more
        number = number.ravel()
        from_cell = np.repeat(np.arange(number.size), number)
        nth = np.arange(from_cell.size) - np.repeat(np.cumsum(number) - number, number)
        dart = _mixed(seeds.ravel()[from_cell] + (nth.astype(_U64) + _U64(1)) * _U64(0xD1342543DE82EF95))
        part = from_cell // len(cells)
        rank = starts[part] + widths[part] * ((_mixed(dart) >> _U64(11)).astype(np.float64) * 2.0**-53)
        slot = (dart % _U64(k)).astype(np.int64)
        late_first = np.argsort(-rank, kind="stable")
        late_first = late_first[~filled[slot[late_first]]]
        darts[slot[late_first]] = dart[late_first]  # the earliest dart is written last and stays
        filled[slot] = True
        low, target = bounds[-1], max(2 * target, bounds[-1] + 1.0 if bounds[-1] >= 1 else 0.0)
    return darts


def sketch(text: str | None) -> tuple[bytes, bytes] | None:
    """(band keys as 25 x 8 bytes, one byte for each coordinate), or None for a text without words."""
    found = shingles(text)
    if not len(found):
        return None
    darts = signature(found)
    rows = darts[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=_U64)
    for k in range(ROWS):
        keys = _mixed(keys * _U64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys.astype("<i8").tobytes(), (darts >> _U64(56)).astype(np.uint8).tobytes()


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, h, bands, bytes8) of each document; h is the text's MD5."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("bands", pa.list_(pa.int64())), ("bytes8", pa.binary())])
        for batch in batches:
            out = []
            for value in batch:
                found = sketch(value.as_py())
                out.append(found and {"bands": np.frombuffer(found[0], "<i8"), "bytes8": found[1]})
            yield pa.array(out, kind)

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(of, "struct<bands:array<bigint>,bytes8:binary>")
    docs = only(documents, "doc_id", "text").select("doc_id", F.unhex(F.md5("text")).alias("h"), made("text").alias("s"))
    return docs.select("doc_id", "h", F.col("s.bands").alias("bands"), F.col("s.bytes8").alias("bytes8"))


def _leaders(members: DataFrame, order: Column, rows: int) -> DataFrame:
    """(key, leader, n) of the buckets with more than one text, written: joins to it can be split where a key is hot."""
    lead = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "h")).alias("l"), F.count(F.lit(1)).alias("n"))
    return materialize(lead.filter(F.col("n") > 1).select("key", F.col("l.h").alias("leader"), "n"), "leaders", rows)


def _pairs(led: DataFrame) -> DataFrame:
    return (
        led.filter(F.col("h") != F.col("leader"))
        .select(F.least("h", "leader").alias("a"), F.greatest("h", "leader").alias("b"))
        .distinct()
    )


def _once(f, kind: str):
    """An Arrow function whose result may be filtered: else the filter is pushed below it and calls it a second time, which
    takes a second worker and a second set of batches of each task."""
    return F.arrow_udf(f, kind).asNondeterministic()


def _estimate(x: str, y: str) -> Column:
    """The similarity of two texts by the bytes of their coordinates."""

    def estimate(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        left, right = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, COORDINATES) for v in (x, y))
        return pa.array((((left == right).mean(axis=1)) - 1 / 256) / (1 - 1 / 256), pa.float64())

    estimate.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return _once(estimate, "double")(x, y)


def _verified(pairs: DataFrame, texts: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    bytes8 = texts.select("h", "bytes8")
    both = pairs.join(bytes8.withColumnRenamed("bytes8", "x"), F.col("a") == F.col("h")).drop("h")
    both = both.join(bytes8.withColumnRenamed("bytes8", "y"), F.col("b") == F.col("h")).drop("h")
    rated = both.select("a", "b", _estimate("x", "y").alias("e"))
    rated = materialize(rated.filter(F.col("e") >= threshold - MARGIN), "rated-pairs")
    return _settled(rated, texts, documents, threshold)


def _cells(wanted: DataFrame, texts: DataFrame, documents: DataFrame, rows: int) -> DataFrame:
    """(h, cells) of the wanted texts (h), ``rows`` at most, written: the sorted hashes of their shingles, one a copy."""
    # One row of each wanted text: its document with the smallest id, of which equal rows may repeat.
    firsts = texts.join(wanted, "h", "left_semi").select("h", F.col("id").alias("first"))
    known = only(documents, "doc_id", "text").withColumn("h", F.unhex(F.md5("text")))
    known = known.join(firsts, (known["h"] == firsts["h"]) & known["doc_id"].eqNullSafe(firsts["first"]), "left_semi")

    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.sort(distinct_cells(shingles(v.as_py()))).tobytes() for v in batch], pa.binary())

    cells.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    known = known.dropDuplicates(["h"]).select("h", F.arrow_udf(cells, "binary")("text").alias("cells"))
    return materialize(known, "shingles", rows, TEXTS_PER_FILE)


def _settled(rated: DataFrame, texts: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    """The rated pairs (a, b, e) whose similarity reaches the threshold, by their shingles where e is too near to it."""
    sure = rated.filter(F.col("e") >= threshold + MARGIN).select("a", "b")
    unsure = rated.filter(F.col("e") < threshold + MARGIN).select("a", "b")
    number = unsure.count()
    if not number:
        return sure
    known = _cells(unsure.select(F.explode(F.array("a", "b")).alias("h")).distinct(), texts, documents, 2 * number)
    pair = unsure.join(known.select(F.col("h").alias("a"), F.col("cells").alias("x")), "a")
    pair = pair.join(known.select(F.col("h").alias("b"), F.col("cells").alias("y")), "b")

    def exact(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            left, right = np.frombuffer(p.as_py(), _U64), np.frombuffer(q.as_py(), _U64)
            both = np.concatenate((left, right))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out.append(common / max(len(both) - common, 1))
        return pa.array(out, pa.float64())

    exact.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    linked = pair.select("a", "b", _once(exact, "double")("x", "y").alias("s"))
    return sure.unionByName(linked.filter(F.col("s") >= threshold).select("a", "b"))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(h, root) of every node with a link, by rounds of large-star and small-star until only stars are left.

    ``rows`` is a bound of the links, for the number of files. Each node's least neighbour is written before the links
    join it, so that Spark can split the links of a hub.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links", rows)
    while not _only_stars(edges):
        ends = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", ends)
        large = both.join(near, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u != v").distinct(), "large-star", ends)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least", ends)
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links", 2 * ends)
        discard(edges, near, large, least)
        edges = done
    roots = edges.select(F.col("v").alias("h")).distinct()
    return edges.select(F.col("u").alias("h"), F.col("v").alias("root")).unionByName(roots.select("h", F.col("h").alias("root")))


def _only_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("u").alias("h"), F.lit(1).alias("up")), F.struct(F.col("v").alias("h"), F.lit(0).alias("up")))).alias("s"))
    ends = sides.groupBy("s.h").agg(F.sum("s.up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return ends.filter((F.col("ups") > 1) | (F.col("ups") == 1) & (F.col("n") > 1)).isEmpty()


def _merged(roots: DataFrame, more: DataFrame, rows: int | None = None) -> DataFrame:
    """(h, root) of known components that further links (``rows`` at most) join: only those between their roots go through rounds."""
    links = _rooted(more, roots).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
    top = components(links, rows)
    moved = roots.join(top.select(F.col("h").alias("root"), F.col("root").alias("top")), "root", "left")
    fresh = top.join(roots, "h", "left_anti")
    return moved.select("h", F.coalesce("top", "root").alias("root")).unionByName(fresh.select("h", "root"))


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) with a_root and b_root; a text without a link is its own root."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("h").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
        pairs = pairs.withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    return pairs


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose texts are in different components."""
    return _rooted(pairs, roots).filter("a_root != b_root").select(*pairs.columns)


def _mixed_buckets(buckets: DataFrame, roots: DataFrame, size: Column, rows: int) -> tuple[DataFrame, DataFrame]:
    """(members with their root, (key, most, lefts, rights)) of the buckets that hold several components.

    ``most`` is the component with most members; ``lefts`` is the number of parts of the other components' members,
    ``rights`` of all: of ``PART`` texts and ``PART_BYTES`` of ``size`` each.
    """
    placed = buckets.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    found = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("w"))
    mixed = found.groupBy("key").agg(
        F.max(F.struct("n", "root", "w")).alias("t"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k")
    )
    parts = lambda n, w: F.ceil(F.greatest(n / PART, w / PART_BYTES)).cast("int")
    mixed = mixed.filter("k > 1").select(
        "key",
        F.col("t.root").alias("most"),
        parts(F.col("n") - F.col("t.n"), F.col("w") - F.col("t.w")).alias("lefts"),
        parts(F.col("n"), F.col("w")).alias("rights"),
    )
    return placed, materialize(mixed, "mixed-buckets", rows)


def _blocks(placed: DataFrame, mixed: DataFrame, value: str, compare, schema: str) -> DataFrame:
    """``compare`` applied to each block (key, left part, right part) of the mixed buckets.

    The members outside a bucket's largest component (left) meet all its members (right), part by part; a task holds one
    block at a time. No row is made for a pair: only what ``compare`` returns leaves the block.
    """
    members = placed.join(mixed, "key")
    deal = lambda parts: F.pmod(F.xxhash64("h"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    columns = ["key", "lp", "rp", "is_left", "h", "root", value]
    left = members.filter(F.col("root") != F.col("most")).withColumns({"is_left": F.lit(True), "lp": deal("lefts"), "rp": every("rights")})
    right = members.withColumns({"is_left": F.lit(False), "rp": deal("rights"), "lp": every("lefts")})
    dealt = left.select(*columns).unionByName(right.select(*columns))
    dealt = dealt.repartition("key", "lp", "rp").sortWithinPartitions("key", "lp", "rp", F.desc("is_left"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            groups = np.stack([batch[c].to_numpy() for c in ("key", "lp", "rp")])
            cuts = [0, *(np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high > low:
                    if held and any(held[-1][c][-1] != batch[c][low] for c in ("key", "lp", "rp")):
                        yield from _compared(held, value, compare)
                        held = []
                    held.append(batch.slice(low, high - low))
        if held:
            yield from _compared(held, value, compare)

    return dealt.mapInArrow(run, schema)


def _compared(held: list[pa.RecordBatch], value: str, compare) -> Iterator[pa.RecordBatch]:
    names = ("is_left", "h", "root", value)
    sides, h, root, values = ([x for b in held for x in b[c].to_pylist()] for c in names)
    n = sum(sides)
    apart = np.frombuffer(b"".join(root), _U64).reshape(-1, 2)
    apart = (apart[:n, None] != apart[None, n:]).any(axis=2)
    if n and apart.any():
        yield from compare(h[:n], h[n:], root[n:], values[:n], values[n:], apart)


def _likeliest(threshold: float):
    """Of a block of signatures: (h, other, e) for each text with a likely partner, the likeliest one."""

    def compare(a, b, roots, x, y, apart) -> Iterator[pa.RecordBatch]:
        left, right = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, COORDINATES) for v in (x, y))
        e = ((left[:, None] == right[None]).mean(axis=2) - 1 / 256) / (1 - 1 / 256)
        e[~apart] = -1.0
        out = [(a[i], b[j], float(e[i, j])) for i, j in enumerate(e.argmax(axis=1)) if e[i, j] >= threshold - MARGIN]
        out += [(b[j], a[i], float(e[i, j])) for j, i in enumerate(e.argmax(axis=0)) if e[i, j] >= threshold - MARGIN]
        if out:
            h, other, values = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(other, pa.binary()), pa.array(values)], ["h", "other", "e"])

    return compare


def common_cells(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """How many cells each text of ``x`` shares with each of ``y``: products of their incidence matrices, by slices."""
    sides = [(np.frombuffer(b"".join(v), _U64), np.repeat(np.arange(len(v)), [len(c) // 8 for c in v])) for v in (x, y)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    total = np.zeros((len(x), len(y)))
    placed = []
    for values, owner in sides:
        at = np.searchsorted(shared, values)
        held = at < len(shared)
        held[held] = shared[at[held]] == values[held]
        order = np.argsort(at[held], kind="stable")
        placed.append((at[held][order], owner[held][order]))
    for low in range(0, len(shared), SLICE):
        pieces = []
        for (at, owner), n in zip(placed, (len(x), len(y)), strict=True):
            first, last = np.searchsorted(at, (low, low + SLICE))
            piece = np.zeros((n, min(SLICE, len(shared) - low)), np.float32)
            piece[owner[first:last], at[first:last] - low] = 1.0
            pieces.append(piece)
        total += pieces[0] @ pieces[1].T
    return total


def _linked(threshold: float):
    """Of a block of shingle cells: (a, b), for each text one link at most to each other component."""

    def compare(a, b, roots, x, y, apart) -> Iterator[pa.RecordBatch]:
        common = common_cells(x, y)
        sizes = [np.array([len(c) // 8 for c in v], np.float64) for v in (x, y)]
        near = apart & (common / np.maximum(sizes[0][:, None] + sizes[1][None] - common, 1) >= threshold)
        out = [(a[i], b[j]) for i in np.flatnonzero(near.any(axis=1)) for j in {roots[j]: j for j in np.flatnonzero(near[i])}.values()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in zip(*out, strict=True)], ["a", "b"])

    return compare


def classes(documents: DataFrame, *, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """((doc_id, h) of the documents, (h, id, n, class_id) of the distinct texts); id is a text's smallest doc_id."""
    drawn = materialize(sketches(documents), "sketches")
    number = drawn.count()
    texts = drawn.filter(F.col("h").isNotNull()).groupBy("h").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("bytes8").alias("bytes8")
    )
    texts = materialize(texts, "texts", number)
    number = texts.count()
    members = texts.filter(F.col("bands").isNotNull()).select("h", F.posexplode("bands").alias("band", "key"))
    # The order of the leaders is that of the components' labels: links to leaders are nearly stars from the start.
    lead = _leaders(members, F.col("h"), BANDS * number)
    led = materialize(members.join(lead, "key"), "buckets")
    in_buckets = led.count()
    discard(lead)
    links = materialize(_verified(_pairs(led), texts, documents, threshold), "first-links")
    roots = materialize(components(links, links.count()), "first-classes", number)
    # Finer buckets of those with more than two texts.
    crowd = led.filter(F.col("n") > 2).select("h", "band", F.col("key").alias("coarse")).join(texts.select("h", "bytes8"), "h")
    at = lambda more: F.lit(BANDS * ROWS + 1) + (F.col("band") * 7) % (COORDINATES - BANDS * ROWS - more)
    keys = [F.xxhash64(F.lit(k), "coarse", F.substring(F.col("bytes8"), at(more), F.lit(more))) for k, more in enumerate(FINER)]
    crowd = materialize(crowd.select("h", F.explode(F.array(*keys)).alias("key")), "finer-buckets")
    lead = _leaders(crowd, F.xxhash64("key", "h"), len(FINER) * in_buckets)
    apart = materialize(_across(_pairs(crowd.join(lead, "key")), roots), "further-pairs")
    discard(crowd, lead)
    more = materialize(_verified(apart, texts, documents, threshold), "further-links")
    if found := more.count():
        roots = materialize(_merged(roots, more, found), "further-classes")
    # What still shares a bucket but no component, compared in blocks: first each text with its likeliest partner ...
    buckets = led.select("key", "h")
    placed, mixed = _mixed_buckets(buckets, roots, F.lit(0), in_buckets)
    signed = placed.join(texts.select("h", "bytes8"), "h")
    likely = _blocks(signed, mixed, "bytes8", _likeliest(threshold), "h binary, other binary, e double")
    likely = materialize(likely.groupBy("h").agg(F.max(F.struct("e", "other")).alias("p")).select("h", "p.*"), "likeliest", number)
    rated = likely.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b"), "e").dropDuplicates(["a", "b"])
    more = _settled(materialize(rated, "likely-pairs", number), texts, documents, threshold)
    more = materialize(more, "likely-links")
    if found := more.count():
        roots = materialize(_merged(roots, more, found), "likely-classes")
    # ... then, exactly by their shingles, all texts with a likely partner that are still apart.
    buckets = materialize(buckets.join(likely.select("h"), "h", "left_semi"), "rest-buckets")
    placed, mixed = _mixed_buckets(buckets, roots, F.lit(0), in_buckets)
    cells = _cells(placed.join(mixed, "key", "left_semi").select("h").distinct(), texts, documents, number)
    buckets = materialize(buckets.join(mixed, "key", "left_semi").join(cells, "h"), "rest-members")
    placed, mixed = _mixed_buckets(buckets, roots, F.octet_length("cells"), in_buckets)
    more = materialize(_blocks(placed, mixed, "cells", _linked(threshold), "a binary, b binary"), "rest-links")
    discard(led, buckets, cells)
    if found := more.count():
        roots = _merged(roots, more, found)
    own = texts.select("h", "id", "n").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    own = materialize(own, "classes")
    label = own.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    return drawn.select("doc_id", "h"), own.join(label, "root").select("h", "id", "n", "class_id", "class_size")


def near_duplicates(documents: DataFrame, *, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size) of each document."""
    docs, texts = classes(documents, threshold=threshold)
    out = docs.join(texts.select("h", "class_id", "class_size"), "h", "left")
    own = F.col("h").isNull()
    return out.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
    )


def deduplicate(documents: DataFrame, *, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the smallest id (any one of equal rows), and all with a null text."""
    docs = without(documents, ["_h", "_first"])
    _, texts = classes(docs, threshold=threshold)
    # The text kept of a class is that of its smallest id; of several texts with that id the one with the least MD5.
    kept = texts.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class_id", "class_size").agg(F.min("h").alias("_h"))
    kept = kept.select("_h", F.col("class_id").alias("_first"))
    hashed = docs.withColumn("_h", F.unhex(F.md5("text")))
    found = hashed.filter(F.col("_h").isNotNull()).join(
        kept.withColumnRenamed("_h", "_k"), (F.col("_h") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi"
    )
    once = found.dropDuplicates(["_h", "doc_id"]).drop("_h")
    return once.unionByName(docs.filter(F.col("text").isNull()))
