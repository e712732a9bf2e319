"""Components of links between nodes that meet in buckets, without all pairs of a bucket.

Buckets are never gathered. Each bucket's nodes are first compared with three pivots (an aggregate), which makes stars; the
stars' components are found; then only nodes outside their bucket's largest component are compared with the
rest of the bucket, and only across components. What is skipped is already connected, so no link is lost, and a hot bucket of near
copies costs a few comparisons a node. A bucket of many components is first cut into finer ones, where the caller knows how.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace

#: Far more rounds than any component needs.
ROUNDS = 1000


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of edges (a, b), by minimum labels, hooks and pointer jumping.

    In a round a node takes the least label near it and gives it to the node that its old label names, so all of that label take the least
    near any of them. Each round is written to the shared folder; a chain of a million nodes took 20 rounds in a simulation.
    """
    both = space.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp"))
    labels = space.keep(labels, f"{name}-0")
    for k in range(1, ROUNDS + 1):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        given = low.select("node", "low").union(low.select("comp", "low")).groupBy("node").agg(F.min("low").alias("to"))
        step = labels.withColumnRenamed("comp", "old").join(given, "node")
        step = step.join(given.select(F.col("node").alias("old"), F.col("to").alias("top")), "old").select("node", "old", F.least("to", "top").alias("comp"))
        step = space.keep(step, f"{name}-{k}")
        moved = step.where("comp <> old").limit(1).count()
        space.drop(f"{name}-{k - 1}")
        labels = step.select("node", "comp")
        if not moved:
            return labels
    raise RuntimeError(f"{name} did not settle in {ROUNDS} rounds")


def _mixed(placed: DataFrame, by: list[str]) -> DataFrame:
    """placed with main, the component that most of the bucket's nodes are in, of the buckets of several components."""
    sizes = placed.groupBy(*by, "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy(*by).agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("n", "comp")).alias("main")).where("parts > 1")
    return placed.join(mixed.drop("parts"), by)


def late_pairs(placed: DataFrame, within: Callable[[Column, Column], Column] | None = None, space: Workspace | None = None) -> DataFrame:
    """a, b of different components that meet in a bucket of placed (t, key, node, comp), b outside the bucket's largest component.

    within(node, t) gives the keys of finer buckets: linked nodes of a bucket must share one, at the same place of the array.
    """
    by = ["t", "key"]
    open_ = _mixed(placed, by)
    if within is not None:
        finer = open_.select(*by, "node", "comp", F.posexplode(within(F.col("node"), F.col("t"))).alias("s", "sub"))
        open_ = _mixed(finer, by := [*by, "s", "sub"])
    open_ = space.keep(open_, "open") if space else open_
    few = open_.where("comp <> main").select(*by, F.col("node").alias("b"), F.col("comp").alias("other"))
    return open_.withColumnRenamed("node", "a").join(few, by).where("comp <> other").select("a", "b")


def link_buckets(entries: DataFrame, verify: Callable[[DataFrame], DataFrame], space: Workspace, within: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """node, comp for every node of entries (node, weight, t, key) that has a link to another one.

    Nodes meet in buckets (t, key); verify keeps the linked ones of pairs (a, b). A node must be in a bucket once. within: see late_pairs().
    """
    pivots = (
        entries.groupBy("t", "key")
        .agg(F.count("*").alias("n"), F.max_by("node", F.struct("weight", "node")).alias("heavy"), F.min("node").alias("low"), F.max("node").alias("high"))
        .where("n > 1")
    )
    members = space.keep(entries.drop("weight").join(pivots, ["t", "key"]), "members")
    star = members.select(F.col("node").alias("a"), F.explode(F.array("heavy", "low", "high")).alias("b")).where("a <> b").distinct()
    star = space.keep(verify(star), "stars")
    first = components(star, space, "first")
    placed = members.select("t", "key", "node").join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = space.keep(placed, "placed")
    space.drop("members")
    late = space.keep(verify(late_pairs(placed, within, space)).distinct(), "late")
    space.drop("placed")
    space.drop("open")
    if late.limit(1).count() == 0:
        return first
    spine = first.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return components(spine.union(late.select("a", "b")), space, "second")
