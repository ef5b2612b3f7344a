"""A seeded synthetic forest, by column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.exprs import unit

SPACING = 4.0


def radius_of(tree: Column) -> Column:
    """0.10 to 0.20 m, by the tree's number."""
    return 0.10 + 0.02 * (tree % 6)


def forest(spark: SparkSession, trees: int = 4, seed: int = 0, ground: int = 400, stem: int = 1300, leaves: int = 400, height: float = 4.0) -> DataFrame:
    """pid, x, y, z, true_label, true_tree: a sloping ground with 2 cm of noise, a row of vertical stems (`stem` points a metre), a ball of leaves on
    each, and a fallen log. `ground` is points a square metre."""
    width = SPACING * trees
    rnd = lambda n: unit("i", "part", seed=seed * 100 + n)
    floor = lambda x: 0.05 * x
    none = F.lit(None).cast("int")

    def part(n: int, name: str) -> DataFrame:
        return spark.range(n).select(F.col("id").alias("i"), F.lit(name).alias("part"))

    x, y = rnd(1) * width, rnd(2) * SPACING
    out = part(int(ground * width * SPACING), "ground").select("part", "i", x.alias("x"), y.alias("y"), (floor(x) + 0.04 * rnd(3) - 0.02).alias("z"), F.lit(0).alias("true_label"), none.alias("true_tree"))
    tree = (F.col("i") % trees).cast("int")
    mx, my = SPACING * tree + SPACING / 2, F.lit(SPACING / 2)
    turn, up = rnd(4) * 2 * math.pi, rnd(5) * height
    r = radius_of(tree)
    stems = part(int(trees * stem * height), "stem").select("part", "i", (mx + r * F.cos(turn)).alias("x"), (my + r * F.sin(turn)).alias("y"), (floor(mx) + up).alias("z"), F.lit(3).alias("true_label"), tree.alias("true_tree"))
    far, tilt = 0.7 * F.pow(rnd(6), 1 / 3), F.acos(2 * rnd(7) - 1)
    crown = part(trees * leaves, "leaf").select("part", "i", (mx + far * F.sin(tilt) * F.cos(turn)).alias("x"), (my + far * F.sin(tilt) * F.sin(turn)).alias("y"), (floor(mx) + height + far * F.cos(tilt)).alias("z"), F.lit(1).alias("true_label"), tree.alias("true_tree"))
    along = rnd(8) * 2
    log = part(600, "log").select("part", "i", (0.3 + along).alias("x"), (0.5 + 0.1 * F.cos(turn)).alias("y"), (floor(0.3 + along) + 0.25 + 0.1 * F.sin(turn)).alias("z"), F.lit(2).alias("true_label"), none.alias("true_tree"))
    rows = out.unionByName(stems).unionByName(crown).unionByName(log)
    kinds = F.array_position(F.array(*[F.lit(k) for k in ("ground", "stem", "leaf", "log")]), F.col("part")) - 1
    return rows.withColumn("pid", kinds * 1_000_000_000 + F.col("i")).select("pid", "x", "y", "z", "true_label", "true_tree")
