"""Edges, connected components and the guards that keep clusters small and dense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.session import materialize


def edges(scored: DataFrame) -> DataFrame:
    """(a, b, score) with a < b, no loops, the largest score of each pair."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return scored.filter("a <> b").groupBy(a.alias("a"), b.alias("b")).agg(F.max("score").alias("score"))


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): each node's least reachable node, by rounds of large-star and small-star.

    A round links every node's larger neighbours, then its smaller ones, to the least of them, until only stars are left;
    rounds grow with the logarithm of the size. Least neighbours are pre-aggregated and written, so that the join of a
    hub's links to them can be split. ``nodes`` (key) adds nodes without a link as components of their own.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges_ = materialize(ends, "links")
    while True:
        sides = edges_.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("s"))
        mixed = sides.groupBy("s.x").agg(F.sum("s.up").alias("ups"), F.count(F.lit(1)).alias("n"))
        if mixed.filter("ups > 1 or (ups = 1 and n > 1)").isEmpty():
            break
        both = edges_.unionByName(edges_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "near")
        large = both.join(near, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges_ = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = edges_.select(F.col("v").alias("node")).distinct()
    out = edges_.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    # Links of a node with itself, and nodes without any, are components of one.
    single = links.filter("a = b").select(F.col("a").alias("node"))
    single = single if nodes is None else single.unionByName(nodes.select(F.col("key").alias("node")))
    alone = single.distinct().join(out.select("node"), "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("component")))


def neighbours(links: DataFrame) -> DataFrame:
    """(node, neighbour, score): every edge from both ends."""
    ends = lambda x, y: links.select(F.col(x).alias("node"), F.col(y).alias("neighbour"), "score")
    return ends("a", "b").unionByName(ends("b", "a"))


def nodes(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def pair_scores(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``pairs`` (a, b) in either order with their edge's score; null where there is none."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    known = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "score")
    return pairs.join(known, (low == F.col("_a")) & (high == F.col("_b")), "left").drop("_a", "_b")


def inside(links: DataFrame, members: DataFrame, name: str = "component") -> DataFrame:
    """The links whose ends share a component (``name``) of the members (node, component), with it; links that bring it are such."""
    if name in links.columns:
        return links
    a, b = (members.select(F.col("node").alias(n), F.col(name).alias(f"c_{n}")) for n in ("a", "b"))
    return links.join(a, "a").join(b, "b").filter("c_a = c_b").select(F.col("c_a").alias(name), "a", "b", "score")


def verdicts(
    links: DataFrame, *, threshold: float = 0.80, max_size: int = 10, cohesion: float = 0.7, contradiction: float = 0.2, members: DataFrame | None = None
) -> DataFrame:
    """(component, size, cohesion, verdict): size, then density, then an inner pair scored as a contradiction.

    ``members`` are the components of the strong links, where they are known.
    """
    if members is None:
        members = materialize(components(links.filter(F.col("score") >= threshold)), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    inner = inside(links, members).groupBy("component")
    inner = inner.agg(F.count_if(F.col("score") >= threshold).alias("strong"), F.min("score").alias("weakest"))
    dense = F.col("strong") / (F.col("size") * (F.col("size") - 1) / 2)
    found = sizes.join(inner, "component").withColumn("cohesion", dense)
    verdict = (
        F.when(F.col("size") > max_size, "TOO_LARGE")
        .when(F.col("cohesion") < cohesion, "LOW_COHESION")
        .when(F.col("weakest") <= contradiction, "CONTRADICTED")
        .otherwise("OK")
    )
    return found.select("component", "size", "cohesion", verdict.alias("verdict"))


def size_distribution(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
