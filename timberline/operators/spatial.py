"""Voxels, overlapping boxes, distance joins and nearest neighbours, all as equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.functions.exprs import dist2, floor_div

XYZ = ("x", "y", "z")
CELLS = {"x": "ix", "y": "iy", "z": "iz"}


#: How far above the average the densest cell may be, and how often cells are halved for that at most (points at one place can't be told apart by any).
CROWD, HALVINGS = 32, 12


def voxels(points: DataFrame, size: float, dims: Sequence[str] = XYZ) -> DataFrame:
    """Add the voxel's integer indices ix, iy, iz."""
    return points.withColumns({CELLS[d]: floor_div(d, size) for d in dims})


def downsample(points: DataFrame, size: float, method: str = "first", dims: Sequence[str] = XYZ, order: Sequence[Column] | None = None, flag: bool = False) -> DataFrame:
    """One point a voxel: the `first` in order, or the one `nearest` to the voxel's median point (ties by pid).

    With `flag`, all points and a column `downsampled` that is true for that point; else only those. The row chosen is the least
    of its voxel by a window over the voxel's rows.
    """
    rows = voxels(points, size, dims)
    cells = [CELLS[d] for d in dims]
    if method == "first":
        by = list(order or [F.col("pid")])
    elif method == "nearest":
        voxel = Window.partitionBy(*cells)
        rows = rows.withColumns({f"_m{d}": F.median(d).over(voxel) for d in dims})
        by = [dist2(list(dims), [f"_m{d}" for d in dims]), F.col("pid")]
    else:
        raise ValueError(f"no downsampling by {method!r}")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*cells).orderBy(*by)))
    keep = [*points.columns, *cells]
    return rows.select(*keep, (F.col("_n") == 1).alias("downsampled")) if flag else rows.where("_n = 1").select(*keep)


def boxes(points: DataFrame, size: float = 6.0, step: float = 3.0, extent: dict[str, tuple[float, float]] | None = None, dims: Sequence[str] = XYZ) -> DataFrame:
    """A row for each point and box that holds it: bx, by, bz, places on the lattice of `step` that begins one step below the cloud.

    Boxes are cubes of `size`, both ends inclusive, so a point inside lies in (size / step) boxes an axis and one on a lattice plane in one more.
    The boxes of a point follow from its coordinates; nothing is joined.
    """
    if extent is None:
        row = points.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
        if row[f"lo_{dims[0]}"] is None:
            return points.select("*", *[F.lit(0).cast("long").alias(f"b{d}") for d in dims]).limit(0)
        extent = {d: (row[f"lo_{d}"], row[f"hi_{d}"]) for d in dims}
    out = points
    for d in dims:
        lo, hi = math.floor(extent[d][0]) - step, math.ceil(extent[d][1]) + step
        last = max(0, math.ceil((hi - lo) / step) - 1)
        first = F.greatest(F.ceil((F.col(d) - F.lit(lo) - F.lit(float(size))) / F.lit(float(step))), F.lit(0).cast("long"))
        final = F.least(F.floor((F.col(d) - F.lit(lo)) / F.lit(float(step))), F.lit(last).cast("long"))
        out = out.withColumn(f"b{d}", F.explode(F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<bigint>"))))
    return out


def within(left: DataFrame, right: DataFrame, eps: float, dims: Sequence[str] = XYZ, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Pairs (id, other, d2) of rows no farther than eps apart (inclusive) that agree on `by`; both sides have id and the dimensions.

    Cells of just over eps: the left side's 3 ** d neighbouring cells meet the right side's own cell in an equi-join, and the distance decides.
    Columns of `keep` come from the right side.
    """
    cell = eps * (1 + 1e-9)
    a = left.select(F.col("id"), *by, *[F.col(d).alias(f"_a{d}") for d in dims])
    for d in dims:
        a = a.withColumn(f"_c{d}", F.explode(F.array(*[(F.floor(F.col(f"_a{d}") / cell) + k).cast("long") for k in (-1, 0, 1)])))
    b = right.select(F.col("id").alias("other"), *[F.col(c).alias(f"_by_{c}") for c in by], *[F.col(d).alias(f"_b{d}") for d in dims], *[F.floor(F.col(d) / cell).cast("long").alias(f"_d{d}") for d in dims], *[F.col(c).alias(f"_k_{c}") for c in keep])
    cond = F.lit(True)
    for i, m in enumerate([*(F.col(f"_c{d}") == F.col(f"_d{d}") for d in dims), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)]):
        cond = m if i == 0 else cond & m
    d2 = dist2([f"_a{d}" for d in dims], [f"_b{d}" for d in dims])
    return a.join(b, cond).select("id", "other", *by, d2.alias("d2"), *[F.col(f"_k_{c}").alias(c) for c in keep]).where(F.col("d2") <= eps * eps)


def nearest(queries: DataFrame, points: DataFrame, k: int, cut: Callable[[DataFrame, str], DataFrame], dims: Sequence[str] = XYZ, exclude_self: bool = False, most: float | None = None) -> DataFrame:
    """The k nearest of `points` to each of `queries`: id, other, d2, rank (from 1; ties by the other's id). Both have id and the dimensions.

    With `most`, those no farther than it, by one distance join. Else the radius starts at what holds k points on average, or less where some cell of that size holds
    more than CROWD times as many (clouds are dense near the scanner), and queries that found
    fewer than k try again with twice the radius, until all have k or all points: whoever finds k within a radius has the k nearest. So a query meets about as many
    points in a dense place as in a sparse one.
    """
    order = Window.partitionBy("id").orderBy("d2", "other")

    def ranked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("id <> other") if exclude_self else pairs
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if most is not None:
        return ranked(within(queries, points, most, dims))
    size = points.agg(F.count(F.lit(1)).alias("n"), *[f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    reach = queries.agg(*[f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not size.n or reach[f"lo{dims[0]}"] is None:
        return ranked(within(queries, points, 1.0, dims))
    spans = [max(size[f"hi{d}"], reach[f"hi{d}"]) - min(size[f"lo{d}"], reach[f"lo{d}"]) for d in dims]
    whole = math.sqrt(sum(s * s for s in spans)) * (1 + 1e-9) + 1e-9
    flat = [s for s in spans if s > 0] or [1.0]
    radius = min(whole, (math.prod(flat) * (k + 1) / size.n) ** (1 / len(flat)))
    for _ in range(HALVINGS):
        cell = [F.floor(F.col(d) / F.lit(radius)) for d in dims]
        crowd = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if crowd <= CROWD * (k + 1):
            break
        radius /= 2
    found, left = None, queries.select("id", *dims)
    while True:
        got = cut(ranked(within(left, points, radius, dims)), "near")
        if radius >= whole:
            return got if found is None else found.unionByName(got)
        done = got.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("id")
        complete = got.join(done, "id", "left_semi")
        found = complete if found is None else found.unionByName(complete)
        rest = Observation()
        left = cut(left.join(done, "id", "left_anti").observe(rest, F.count(F.lit(1)).alias("n")), "left")
        if not rest.get["n"]:
            return found
        radius = min(whole, 2 * radius)


def tile_neighbours(tiles: DataFrame, n: int, cut: Callable[[DataFrame, str], DataFrame], reach: float | None = None, include_self: bool = False) -> DataFrame:
    """tile, neighbour, distance, rank: the n nearest other tiles of each (or n with itself), no farther than `reach`; `tiles` (tile, x, y) is one row a file."""
    rows = tiles.select(F.col("tile").alias("id"), "x", "y")
    pairs = nearest(rows, rows, n + (not include_self), cut, ("x", "y"), most=reach).select("id", "other", "d2")
    if include_self:  # a tile comes before others at its place
        pairs = pairs.where("id <> other").unionByName(rows.select("id", F.col("id").alias("other"), F.lit(0.0).alias("d2")))
    else:
        pairs = pairs.where("id <> other")
    order = Window.partitionBy("id").orderBy(F.col("id") != F.col("other"), "d2", "other")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(F.col("id").alias("tile"), F.col("other").alias("neighbour"), F.sqrt("d2").alias("distance"), "rank")
