"""Clusters that may be merged: components, guards, splitting along the weakest links, merges that every pair supports."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.operators.graph import components, inside, size_distribution
from entityflow.session import materialize

Edge = tuple[str, str, float]


@dataclass(frozen=True)
class ClusterConfig:
    """The guards' starting values."""

    max_size: int = 10
    min_cohesion: float = 0.7
    contradiction: float = 0.2
    threshold: float = 0.80

    @classmethod
    def for_type(cls, kind: str) -> ClusterConfig:
        return cls(max_size=25 if kind == "company" else 10)


def inner(members: set[str], edges: list[Edge]) -> list[Edge]:
    return [e for e in edges if e[0] in members and e[1] in members]


def verdict(members: set[str], edges: list[Edge], cfg: ClusterConfig) -> str:
    """OK, or the first guard that the members fail: size, density of strong edges, a pair known to be distinct."""
    n = len(members)
    if n < 2:
        return "OK"
    if n > cfg.max_size:
        return "TOO_LARGE"
    scores = [s for _, _, s in inner(members, edges)]
    if sum(s >= cfg.threshold for s in scores) < cfg.min_cohesion * (n * (n - 1) // 2):
        return "LOW_COHESION"
    return "CONTRADICTED" if any(s <= cfg.contradiction for s in scores) else "OK"


def parts(members: set[str], edges: list[Edge], threshold: float) -> list[set[str]]:
    """What the edges of the threshold or more hold together, largest first, then by the first member."""
    near = defaultdict(list)
    for a, b, s in edges:
        if s >= threshold:
            near[a].append(b)
            near[b].append(a)
    left, out = set(members), []
    while left:
        grown, front = set(), [left.pop()]
        while front:
            x = front.pop()
            grown.add(x)
            found = left.intersection(near[x])
            left -= found
            front += found
        out.append(grown)
    return sorted(out, key=lambda p: (-len(p), min(p)))


def bridges(members: set[str], edges: list[Edge], threshold: float) -> dict[int, int]:
    """The numbers of the strong edges whose loss divides a part, with the size of one of its sides."""
    near = defaultdict(list)
    for k, (a, b, s) in enumerate(edges):
        if s >= threshold and a != b:
            near[a].append((b, k))
            near[b].append((a, k))
    if len(near) == len(members) and min(map(len, near.values()), default=0) >= max(2, len(members) / 2) and len({frozenset(e[:2]) for e in edges}) == len(edges):
        return {}  # with half of the members as neighbours of each, no single edge holds a side
    order, low, size, found = {}, {}, {}, {}
    for top in near:
        if top in order:
            continue
        order[top] = low[top] = len(order)
        size[top] = 1
        path = [(top, -1, iter(near[top]))]
        while path:
            x, via, rest = path[-1]
            for y, k in rest:
                if k == via:
                    continue
                if y in order:
                    low[x] = min(low[x], order[y])
                else:
                    order[y] = low[y] = len(order)
                    size[y] = 1
                    path.append((y, k, iter(near[y])))
                    break
            else:
                path.pop()
                if path:
                    up = path[-1][0]
                    low[up], size[up] = min(low[up], low[x]), size[up] + size[x]
                    if low[x] > order[up]:
                        found[via] = size[x]
    return found


def weakest_cut(members: set[str], edges: list[Edge], cfg: ClusterConfig) -> list[set[str]]:
    """The parts after cutting the weakest edge that divides the members; of equally weak ones the most even cut.

    Where no single edge of a strength divides them, all of that strength go and the next stronger ones are tried;
    where none is left, every member is a part. Only a bridge of the strong edges divides a part, and the sizes of its
    sides come with it, so that one cut alone is made of all those of a strength.
    """
    rest = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    while rest:
        tied = sum(1 for _ in takewhile(lambda e: e[2] <= rest[0][2] + 1e-12, rest))
        whole = parts(members, rest, cfg.threshold)
        found = bridges(members, rest, cfg.threshold)
        home = {x: k for k, p in enumerate(whole) for x in p} if found and len(whole) > 1 else None
        best, won = -1.0, None
        for k in range(tied):
            if k in found:
                part = home[rest[k][0]] if home else 0
                sides = [found[k], len(whole[part]) - found[k]]
                # Parts are ordered by size: the first and last of the others are their extremes.
                others = whole[:1] * (part > 0) + whole[1:2] * (part == 0) + whole[-1:] * (part < len(whole) - 1) + whole[-2:-1] * (0 < part == len(whole) - 1)
                sizes = sides + [len(p) for p in others]
            elif len(whole) > 1:
                sizes = [len(whole[0]), len(whole[-1])]
            else:
                continue
            if min(sizes) / max(sizes) > best:
                best, won = min(sizes) / max(sizes), k
        if won is not None:
            return parts(members, rest[:won] + rest[won + 1 :], cfg.threshold)
        rest = rest[tied:]
    return [{m} for m in sorted(members)]


def split(members: set[str], edges: list[Edge], cfg: ClusterConfig) -> list[set[str]]:
    """The members divided until each part passes the guards."""
    todo, out = [set(members)], []
    while todo:
        part = todo.pop()
        if verdict(part, edges, cfg) == "OK":
            out.append(part)
        else:
            todo += weakest_cut(part, inner(part, edges), cfg)
    return out


def resolve_clusters(links: DataFrame, cfg: ClusterConfig = ClusterConfig(), *, nodes: DataFrame | None = None, divide: bool = True) -> DataFrame:
    """(component, node, cluster, size, verdict, was_split, review): each node's guarded cluster, named by its least node.

    ``links`` has string a, b and score, each pair once; with a ``component`` they are those inside one. ``review`` names the guard that sends the cluster, or an
    original component above the size limit, to a human. A component that passes all guards stays in the JVM; a failing
    one is divided in one task, as cuts depend on each other, with its own edges alone.
    """
    if "component" in links.columns:
        within = links
        members = within.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    else:
        members = materialize(components(links.filter(F.col("score") >= cfg.threshold)), "members")
        within = inside(links, members)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        edges = list(zip(*(table[c].to_pylist() for c in ("a", "b", "score")), strict=True))
        whole = {x for e in edges for x in e[:2]}
        first = verdict(whole, edges, cfg)
        found = split(whole, edges, cfg) if divide and first != "OK" else [whole]
        rows = []
        for part in found:
            v = verdict(part, edges, cfg)
            reason = v if v != "OK" else first if len(whole) > cfg.max_size else None
            rows += [(key[0].as_py(), node, min(part), len(part), v, len(found) > 1, reason) for node in sorted(part)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    schema = pa.schema([("component", pa.string()), ("node", pa.string()), ("cluster", pa.string()), ("size", pa.int64()), ("verdict", pa.string()), ("was_split", pa.bool_()), ("review", pa.string())])
    kind = "component string, node string, cluster string, size bigint, verdict string, was_split boolean, review string"
    out = within.groupBy("component").applyInArrow(run, kind)
    if nodes is None:
        return out
    alone = nodes.select(F.col("key").alias("node")).distinct().join(members.select("node"), "node", "left_anti")
    return out.unionByName(alone.select(F.col("node").alias("component"), "node", F.col("node").alias("cluster"), F.lit(1).cast("bigint").alias("size"), F.lit("OK").alias("verdict"), F.lit(False).alias("was_split"), F.lit(None).cast("string").alias("review")))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(size, n) of the clusters."""
    return size_distribution(clusters.select("node", F.col("cluster").alias("component")))


def largest(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.coalesce(F.max("size"), F.lit(0)).alias("largest"))


def cohesion(members: DataFrame, links: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(component, size, cohesion) of groups (node, component): the share of their pairs with a strong edge; 1 for one node."""
    strong = inside(links.filter(F.col("score") >= threshold), members)
    counted = strong.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    share = F.when(F.col("size") < 2, 1.0).otherwise(F.coalesce("n", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2))
    return sizes.join(counted, "component", "left").select("component", "size", share.alias("cohesion"))


def weakest_edges(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """(cluster, weakest): the lowest score among the scored pairs of each cluster; 0 where none was scored."""
    scored = inside(links, clusters, "cluster").groupBy("cluster").agg(F.min("score").alias("weakest"))
    return clusters.select("cluster").distinct().join(scored, "cluster", "left").select("cluster", F.coalesce("weakest", F.lit(0.0)).alias("weakest"))


def plan_merges(clusters: DataFrame, links: DataFrame, owners: DataFrame, *, auto_merge: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """((surviving_id, merged_id, cluster), (cluster, weakest) for review): what validated clusters support.

    ``owners`` has node and entity_id. A cluster is merged if no guard flags it and every scored pair of it reaches
    ``auto_merge``; the entity of the least node survives, each other entity is merged into it once.
    """
    open_ = clusters.filter((F.col("size") > 1) & ((F.col("verdict") == "OK")))
    rated = materialize(weakest_edges(open_, links), "weakest")
    good = open_.join(rated.filter(F.col("weakest") >= auto_merge), "cluster").join(owners.select("node", "entity_id"), "node")
    entities = good.groupBy("cluster", "entity_id").agg(F.min("node").alias("node"))
    first = entities.groupBy("cluster").agg(F.min_by("entity_id", "node").alias("surviving_id"))
    merges = entities.join(first, "cluster").filter("entity_id <> surviving_id")
    return merges.select("surviving_id", F.col("entity_id").alias("merged_id"), "cluster"), rated.filter(F.col("weakest") < auto_merge)
