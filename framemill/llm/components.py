"""Connected components by concurrent breadth-first expansion from many seeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framemill.session import broadcast_if_small, cut, stored

#: One vertex in so many starts an expansion at each level.
SEED_EVERY = 4
#: Rounds of expansion at a level; vertices not reached by then become seeds of their own.
ROUNDS = 3
#: Links of a vertex that one task takes; those of a vertex with more are split over slices.
HUB_LINKS = 50_000
#: A label graph of at most so many edges is merged within one task (about 100 MB there).
MERGE_EDGES = 1_000_000


def connected(vertices: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """(v, component) for every vertex; ``component`` is the smallest vertex of the component.

    ``vertices`` has a bigint column v, ``edges`` bigint columns a and b; direction, repeats,
    self-loops and rows with a null are of no account. The adjacency lists are hash-partitioned
    once, those of a vertex with very many links in slices. Seeds spread over all vertices and are expanded at the same time, a hop a round; where
    the regions of two seeds touch, their labels become an edge of a smaller label graph, which is
    solved in the same way until it is small enough (a counted bound) to be merged in one task. A
    vertex without edges is its own component. No round depends on the diameter: unreached
    vertices turn into seeds after ROUNDS rounds.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    ends = ends.select("a", "b").union(ends.select(F.col("b"), F.col("a"))).distinct()
    links = stored(ends, "links")
    inside = links.select(F.col("a").alias("v")).distinct()
    labels = _solve(inside, links, seed, 0)
    least = labels.groupBy("label").agg(F.min("v").alias("component"))
    named = labels.join(least, "label").select("v", "component")
    every = vertices.where("v is not null").select("v").distinct()
    return every.join(named, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def _solve(vertices: DataFrame, links: DataFrame, seed: int, level: int) -> DataFrame:
    """(v, label): the same label for all vertices of a component. ``links`` holds both directions and is stored."""
    if links.limit(2 * MERGE_EDGES + 1).count() <= 2 * MERGE_EDGES and level > 0:
        return _merge(links)
    # at most one hub for each HUB_LINKS links
    hubs = broadcast_if_small(stored(links.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_LINKS).cast("int").alias("slices")).where("slices > 1"), "hubs"), 48)
    part = lambda of, by: F.coalesce(F.pmod(F.xxhash64(by), of), F.lit(0)).cast("int")
    sliced = links.join(hubs, "a", "left").join(hubs.select(F.col("a").alias("b"), F.col("slices").alias("b_slices")), "b", "left")
    sliced = sliced.select("a", "b", part(F.col("slices"), "b").alias("a_slice"), part(F.col("b_slices"), "a").alias("b_slice"))
    adjacency = sliced.repartition("a", "a_slice").persist(StorageLevel.MEMORY_AND_DISK)

    def every_slice(labels: DataFrame, at: str, label: str) -> DataFrame:
        """Labels of vertices once for each slice of their links, as columns ``at``, its slice and ``label``."""
        met = labels.join(hubs.withColumnRenamed("a", "v"), "v", "left")
        return met.select(F.col("v").alias(at), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices") - 1, F.lit(0)))).alias(f"{at}_slice"), F.col("label").alias(label))

    visited = cut(vertices.where(F.pmod(F.xxhash64("v", F.lit(seed + level)), F.lit(SEED_EVERY)) == 0).select("v", F.col("v").alias("label")))
    frontier = visited
    for _ in range(ROUNDS):
        reached = adjacency.join(every_slice(frontier, "a", "label"), ["a", "a_slice"]).groupBy(F.col("b").alias("v")).agg(F.min("label").alias("label"))
        frontier = cut(reached.join(visited.select("v"), "v", "left_anti"))
        visited = visited.union(frontier)
    rest = vertices.join(visited.select("v"), "v", "left_anti").select("v", F.col("v").alias("label"))
    labels = cut(visited.union(rest))
    touching = (
        adjacency.join(every_slice(labels, "a", "la"), ["a", "a_slice"])
        .join(every_slice(labels, "b", "lb"), ["b", "b_slice"])
        .where("la <> lb")
        .select(F.col("la").alias("a"), F.col("lb").alias("b"))
        .distinct()
    )
    smaller = stored(touching, f"labels{level}")
    adjacency.unpersist()
    if smaller.isEmpty():
        return labels
    roots = _solve(smaller.select(F.col("a").alias("v")).distinct(), smaller, seed, level + 1)
    roots = roots.select(F.col("v").alias("label"), F.col("label").alias("root"))
    return cut(labels.join(roots, "label", "left").select("v", F.coalesce("root", "label").alias("label")))


def _merge(links: DataFrame) -> DataFrame:
    """Union-find over a label graph whose size was checked, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        known = list(parent)
        yield pd.DataFrame({"v": known, "label": [find(x) for x in known]}, dtype="int64")

    return cut(links.where("a < b").coalesce(1).mapInPandas(run, "v bigint, label bigint"))
