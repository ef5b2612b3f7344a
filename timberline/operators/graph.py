"""Graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def connected_components(vertices: DataFrame, edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], most: int = 100) -> DataFrame:
    """id -> component, the smallest id that it is linked with.

    `vertices` has id; `edges` has src, dst, taken both ways. Each round takes the least of a vertex's label, its neighbours' (partial minima before the
    shuffle) and the label of its label, so that long chains shorten by halves. `cut` writes a round's labels to storage
    that outlives executors and reads them again, once a round; the same run tells whether any moved.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").dropDuplicates(), "edges")
    labels = vertices.select("id", F.col("id").alias("component"))
    for n in range(most):
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left")
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        step = step.join(jump, "component", "left") if n else step.withColumn("next", F.col("component"))  # at first each is its own label
        least = F.least("component", "near", "next")
        moved = Observation()
        found = step.select("id", least.alias("component"), (least != F.col("component")).alias("moved"))
        labels = cut(found.observe(moved, F.max("moved").alias("any")), "labels").select("id", "component")
        if not moved.get["any"]:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")


def least_edges(pairs: DataFrame) -> DataFrame:
    """src, dst, length: the shortest of all rows between two different nodes, either way, as one edge with src < dst."""
    ends = pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "length")
    return ends.groupBy("src", "dst").agg(F.min("length").alias("length"))


def shortest_paths(edges: DataFrame, sources: DataFrame, cut: Callable[[DataFrame, str], DataFrame], most: int = 10_000) -> DataFrame:
    """id, distance, base, pred for each node that a source reaches over undirected `edges` (src, dst, length); sources have distance 0, are their own base and
    have no pred.

    Each round relaxes the edges of the nodes that the last one improved, and keeps the least (distance, base, pred) of each node. Sources
    that no edge touches are left out. Rounds are written to storage that outlives executors, each in one run that also tells whether any node moved:
    the driver keeps the plan of every run, and there are many rounds.
    """
    both = cut(edges.select("src", "dst", "length").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length")), "edges")
    touched = both.select(F.col("src").alias("id")).distinct()
    none = F.lit(None).cast(dict(edges.dtypes)["src"])
    best = cut(sources.select("id").distinct().join(touched, "id", "left_semi").select("id", F.lit(0.0).alias("distance"), F.col("id").alias("base"), none.alias("pred")), "paths")
    front = best
    for _ in range(most):
        offers = both.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("distance") + F.col("length")).alias("distance"), "base", F.col("src").alias("pred"))
        offers = offers.groupBy("id").agg(F.min(F.struct("distance", "base", "pred")).alias("offer"))
        held = best.select("id", F.struct("distance", "base", "pred").alias("held"))
        step = held.join(offers, "id", "full_outer")
        better = F.col("held").isNull() | (F.col("offer") < F.col("held"))
        step = step.select("id", F.when(F.col("offer").isNotNull() & better, F.col("offer")).otherwise(F.col("held")).alias("s"), (F.col("offer").isNotNull() & better).alias("moved"))
        moved = Observation()
        step = cut(step.select("id", "s.distance", "s.base", "s.pred", "moved").observe(moved, F.max("moved").alias("any")), "paths")
        best, front = step.drop("moved"), step.where("moved").drop("moved")
        if not moved.get["any"]:
            return best
    raise RuntimeError(f"paths did not settle in {most} rounds")


def tips(paths: DataFrame) -> DataFrame:
    """Nodes of a path forest (id, pred) that no other node comes after."""
    return paths.join(paths.where("pred IS NOT NULL").select(F.col("pred").alias("id")).distinct(), "id", "left_anti")
