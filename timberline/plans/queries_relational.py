"""Projections, filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.functions import exprs as E
from timberline.operators import classify, fit, graph
from timberline.plans.catalogue import query
from timberline.plans.tables import cut, points, points_sql, table

PTS = points_sql()


def fd(v: str, step: str) -> str:
    """SQL of floor division by remainder."""
    m = f"(CASE WHEN ({v}) % {step} < 0 THEN (({v}) % {step} + {step}) % {step} ELSE ({v}) % {step} END)"
    return f"CAST(round((({v}) - {m}) / {step}) AS BIGINT)"


@query("project_rename", f"SELECT pid, x, y, n_z AS nz FROM ({PTS})")
def _(spark, d):
    return points(spark, d).select("pid", "x", "y", "n_z").withColumnRenamed("n_z", "nz")


@query("cast_narrow", f"SELECT pid, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x32, CAST(label AS SMALLINT) AS label16 FROM ({PTS})")
def _(spark, d):
    return points(spark, d).select("pid", F.col("x").cast("float").cast("double").alias("x32"), F.col("label").cast("smallint").alias("label16"))


@query("filter_class", f"SELECT pid, label, n_z FROM ({PTS}) WHERE label = 3 OR (label = 1 AND n_z >= 2)")
def _(spark, d):
    return points(spark, d).where("label = 3 OR (label = 1 AND n_z >= 2)").select("pid", "label", "n_z")


@query("bbox_crop", f"SELECT pid, x, y, z FROM ({PTS}) WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def _(spark, d):
    return points(spark, d).where(F.col("x").between(2, 6) & F.col("y").between(1, 4)).select("pid", "x", "y", "z")


def _slice(p: DataFrame) -> DataFrame:
    return p.withColumn("n_slice", E.floor_div("n_z", 0.2))


@query("slice_index", f"SELECT pid, n_slice, round(n_slice * 0.2::DOUBLE, 6) AS slice FROM (SELECT pid, {fd('n_z', '0.2::DOUBLE')} AS n_slice FROM ({PTS}))")
def _(spark, d):
    return _slice(points(spark, d)).select("pid", "n_slice", E.rounded(F.col("n_slice") * 0.2, 6).alias("slice"))


SLAB = f"SELECT DISTINCT label, tile FROM ({PTS}) WHERE {fd('n_z', '0.2::DOUBLE')} BETWEEN 7 AND 10"


@query("dbh_semi", f"SELECT pid, tile FROM ({PTS}) p WHERE EXISTS (SELECT 1 FROM ({SLAB}) s WHERE s.label = p.label AND s.tile = p.tile)")
def _(spark, d):
    p = points(spark, d)
    keys = _slice(p).where(F.col("n_slice").between(7, 10)).select("label", "tile").distinct()
    return p.join(keys, ["label", "tile"], "left_semi").select("pid", "tile")


@query("dbh_anti", f"SELECT pid, label FROM ({PTS}) p WHERE NOT EXISTS (SELECT 1 FROM ({PTS}) s WHERE s.label = 0 AND s.tile = p.tile AND s.n_z > 7.5)")
def _(spark, d):
    p = points(spark, d)
    return p.join(p.where("label = 0 AND n_z > 7.5").select("tile").distinct(), "tile", "left_anti").select("pid", "label")


@query("dbh_slab", f"SELECT pid, n_slice FROM (SELECT pid, label, {fd('n_z', '0.2::DOUBLE')} AS n_slice FROM ({PTS})) WHERE label = 3 AND n_slice BETWEEN 7 AND 10")
def _(spark, d):
    from timberline.plans.config import Instance, stem_slices

    lo, hi = stem_slices(Instance())
    return _slice(points(spark, d)).where("label = 3").where(F.col("n_slice").between(lo, hi)).select("pid", "n_slice")


@query("plot_stats", f"SELECT round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax, round(min(x) + (max(x) - min(x)) / 2, 6) AS cx, round(min(y) + (max(y) - min(y)) / 2, 6) AS cy FROM ({PTS})")
def _(spark, d):
    aggs = [E.rounded(F.avg(c), 6).alias(f"m{c}") for c in "xyz"] + [f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    centre = lambda c: E.rounded(F.min(c) + (F.max(c) - F.min(c)) / 2, 6).alias(f"c{c}")
    return points(spark, d).agg(*aggs, centre("x"), centre("y"))


@query("global_shift", f"SELECT pid, round(x - (SELECT avg(x) FROM ({PTS})), 6) AS x, round(y - (SELECT avg(y) FROM ({PTS})), 6) AS y, round(z - (SELECT avg(z) FROM ({PTS})), 6) AS z FROM ({PTS})")
def _(spark, d):
    p = points(spark, d)
    mean = p.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    return p.crossJoin(F.broadcast(mean)).select("pid", *[E.rounded(F.col(c) - F.col(f"m{c}"), 6).alias(c) for c in "xyz"])  # one row is sent


EMB = "SELECT vec_id, label, CAST(embedding[{0}] AS DOUBLE) AS v{0} FROM embeddings"
E4 = "SELECT vec_id, label, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)] AS v FROM embeddings"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 4).cast("array<double>").alias("v"))


@query("argmax_label", f"SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS cls FROM ({E4})")
def _(spark, d):
    return _scores(spark, d).select("vec_id", E.argmax("v").alias("cls"))


@query("softmax", f"SELECT vec_id, round(exp(v[1] - m) / t, 6) AS p0, round(exp(v[2] - m) / t, 6) AS p1, round(exp(v[3] - m) / t, 6) AS p2, round(exp(v[4] - m) / t, 6) AS p3 FROM (SELECT *, exp(v[1] - m) + exp(v[2] - m) + exp(v[3] - m) + exp(v[4] - m) AS t FROM (SELECT *, list_max(v) AS m FROM ({E4})))")
def _(spark, d):
    return _scores(spark, d).select("vec_id", E.softmax("v").alias("p")).select("vec_id", *[E.rounded(F.col("p")[i], 6).alias(f"p{i}") for i in range(4)])


OVERRIDE = f"SELECT vec_id, CASE WHEN v[1] / 10 + 0.5 <= 0.45 THEN 0 WHEN v[4] > 0.2 THEN 3 ELSE CAST(list_position(v, list_max(v)) - 1 AS INTEGER) END AS label FROM ({E4})"


@query("label_override", OVERRIDE)
def _(spark, d):
    v = F.col("v")
    label = F.when(v[0] / 10 + 0.5 <= 0.45, 0).when(v[3] > 0.2, 3).otherwise(E.argmax("v"))
    return _scores(spark, d).select("vec_id", label.cast("int").alias("label"))


BOX = "CAST(floor(x / 3) AS INT)"


@query("block_local_shift", f"SELECT pid, round(x - round_even(avg(x) OVER (PARTITION BY {BOX}), 0), 6) AS x FROM ({PTS})")
def _(spark, d):
    box = Window.partitionBy(F.floor(F.col("x") / 3).cast("int"))
    return points(spark, d).select("pid", E.rounded(F.col("x") - F.rint(F.avg("x").over(box)), 6).alias("x"))


@query("isclose_filter", f"SELECT pid, x FROM ({PTS}) WHERE abs(x - 3.2) <= 0.05 + 1e-5 * abs(3.2)")
def _(spark, d):
    return points(spark, d).where(E.isclose("x", 3.2, atol=0.05)).select("pid", "x")


@query("tree_colour")
def _(spark, d):
    p = points(spark, d)
    colour = [F.pmod(F.xxhash64("tile", F.lit(i)), F.lit(255)).cast("int").alias(c) for i, c in enumerate(("red", "green", "blue"))]
    return p.where("label IN (1, 3)").select("pid", "tile", "label", *colour).select("pid", "tile", *[F.when(F.col("label") == 1, F.least(F.lit(255), (F.col(c) * 1.2).cast("int"))).otherwise(F.col(c)).alias(c) for c in ("red", "green", "blue")])


@query("relabel_cwd", f"SELECT pid, CASE WHEN label = 2 AND NOT bool_or(label = 0) OVER (PARTITION BY tile, floor(z * 40)) THEN 3 ELSE label END AS label FROM ({PTS})")
def _(spark, d):
    block = Window.partitionBy("tile", F.floor(F.col("z") * 40))
    ground = F.max(F.col("label") == 0).over(block)
    return points(spark, d).select("pid", F.when((F.col("label") == 2) & ~ground, 3).otherwise(F.col("label")).alias("label"))


_R, _P, _Y = 0.3, -0.2, 1.1


@query("rotate_points", f"""
SELECT pid, round(x2 * cos({_Y}) - y1 * sin({_Y}), 6) AS x, round(x2 * sin({_Y}) + y1 * cos({_Y}), 6) AS y, round(z2, 6) AS z FROM
(SELECT pid, y1, x * cos({_P}) + z1 * sin({_P}) AS x2, z1 * cos({_P}) - x * sin({_P}) AS z2 FROM
(SELECT pid, x, y * cos({_R}) - z * sin({_R}) AS y1, y * sin({_R}) + z * cos({_R}) AS z1 FROM ({PTS})))""")
def _(spark, d):
    x, y, z = E.rotate(*[F.col(c) for c in "xyz"], F.lit(_R), F.lit(_P), F.lit(_Y))
    return points(spark, d).select("pid", E.rounded(x, 6).alias("x"), E.rounded(y, 6).alias("y"), E.rounded(z, 6).alias("z"))


@query("random_scale")
def _(spark, d):
    s = 0.8 + 0.4 * E.unit("tile", seed=4)
    return points(spark, d).select("pid", "tile", s.alias("scale"), *[(F.col(c) * s).alias(c) for c in "xyz"])


@query("jitter")
def _(spark, d):
    p = points(spark, d).withColumn("sigma", F.when(E.unit("tile", seed=5) < 0.5, 0.01 + 0.015 * E.unit("tile", seed=6)).otherwise(F.lit(0.0)))
    normal = lambda n: F.sqrt(-2 * F.log(1 - E.unit("pid", seed=n))) * F.cos(2 * math.pi * E.unit("pid", seed=n + 1))
    return p.select("pid", "sigma", *[(F.col(c) + F.col("sigma") * normal(10 + 2 * i)).alias(c) for i, c in enumerate("xyz")])


@query("augment_boxes")
def _(spark, d):
    boxed = points(spark, d).withColumns({"bx": F.floor(F.col("x") / 3), "by": F.floor(F.col("y") / 3), "bz": F.lit(0).cast("long")}).select("pid", "x", "y", "z", "label", "bx", "by", "bz")
    return classify.augment(boxed, 11, cut, least=100)


# Joins.


@query("stems_left", "SELECT o_orderkey, o_custkey, c_name, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def _(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").drop("c_custkey")


@query("null_safe_join", f"""
WITH s AS (SELECT pid, CASE WHEN label = 3 THEN tile END AS t FROM ({PTS})), c AS (SELECT t, count(*) AS n FROM s GROUP BY t)
SELECT pid, c.t AS t, n FROM s RIGHT JOIN c ON s.t IS NOT DISTINCT FROM c.t""")
def _(spark, d):
    s = points(spark, d).select("pid", F.when(F.col("label") == 3, F.col("tile")).alias("st"))
    c = s.groupBy(F.col("st").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return s.join(c, F.col("st").eqNullSafe(F.col("t")), "right").select("pid", "t", "n")


@query("points_to_tree", "SELECT l_orderkey, l_linenumber, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")


LEAF = f"SELECT pid, {fd('x', '0.5::DOUBLE')} AS ix, {fd('y', '0.5::DOUBLE')} AS iy, {fd('z', '0.5::DOUBLE')} AS iz, x, y, z, label, n_z FROM ({PTS})"


@query("leaf_attach_join", f"WITH v AS ({LEAF}) SELECT pid, a.n AS n FROM v LEFT JOIN (SELECT ix, iy, iz, count(*) AS n FROM v WHERE label = 3 GROUP BY ALL) a USING (ix, iy, iz) WHERE label = 1")
def _(spark, d):
    from timberline.operators.spatial import voxels

    v = voxels(points(spark, d), 0.5)
    n = v.where("label = 3").groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"))
    return v.where("label = 1").join(n, ["ix", "iy", "iz"], "left").select("pid", "n")


@query("index_join", f"SELECT pid, label, p FROM ({PTS}) LEFT JOIN (SELECT event_id AS pid, round(value / 125, 6) AS p FROM events WHERE event_type <> 'view') USING (pid)")
def _(spark, d):
    probs = table(spark, d, "events").where("event_type <> 'view'").select(F.col("event_id").alias("pid"), E.rounded(F.col("value") / 125, 6).alias("p"))
    return points(spark, d).join(probs, "pid", "left").select("pid", "label", "p")


@query("map_join", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation").groupBy("n_nationkey").agg(F.max("n_name").alias("n_name"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select("s_suppkey", "n_name")


# Aggregates.


@query("skeleton_median", f"SELECT tile, n_slice, round(median(x), 6) AS x, round(median(y), 6) AS y, round(median(z), 6) AS z, count(*) AS n FROM (SELECT *, {fd('n_z', '0.2::DOUBLE')} AS n_slice FROM ({PTS})) GROUP BY ALL")
def _(spark, d):
    return _slice(points(spark, d)).groupBy("tile", "n_slice").agg(*[E.rounded(F.median(c), 6).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))


@query("leaf_voxel_stats", f"SELECT ix, iy, iz, min(x) AS xmin, max(x) AS xmax, round(median(x), 6) AS xmed, min(z) AS zmin, max(z) AS zmax, round(median(z), 6) AS zmed FROM ({LEAF}) WHERE label = 1 GROUP BY ALL")
def _(spark, d):
    from timberline.operators.spatial import voxels

    stats = [g for c in "xz" for g in (F.min(c).alias(f"{c}min"), F.max(c).alias(f"{c}max"), E.rounded(F.median(c), 6).alias(f"{c}med"))]
    return voxels(points(spark, d).where("label = 1"), 0.5).groupBy("ix", "iy", "iz").agg(*stats)


@query("ground_median", f"SELECT pid, round(z - median(z) OVER (PARTITION BY {fd('x', '0.5::DOUBLE')}, {fd('y', '0.5::DOUBLE')}), 6) AS dz FROM ({PTS}) WHERE label = 0")
def _(spark, d):
    from timberline.operators.raster import cells

    cell = Window.partitionBy("ix", "iy")
    return cells(points(spark, d).where("label = 0")).select("pid", E.rounded(F.col("z") - F.median("z").over(cell), 6).alias("dz"))


@query("tree_size_filter", f"SELECT pid, tree, n AS cnt, first AS cclstr FROM (SELECT pid, tree, count(*) OVER (PARTITION BY tree) AS n, min(pid) OVER (PARTITION BY tree) AS first FROM (SELECT pid, CASE WHEN label = 3 THEN tile END AS tree FROM ({PTS})) WHERE tree IS NOT NULL) WHERE n > 300")
def _(spark, d):
    tree = Window.partitionBy("tree")
    p = points(spark, d).select("pid", F.when(F.col("label") == 3, F.col("tile")).alias("tree")).where("tree IS NOT NULL")
    return p.select("pid", "tree", F.count(F.lit(1)).over(tree).alias("cnt"), F.min("pid").over(tree).alias("cclstr")).where("cnt > 300")


@query("min_edges", "SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, min(l_quantity) AS length FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL")
def _(spark, d):
    return graph.least_edges(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("length")))


@query("noise_quantile", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice < (SELECT quantile_cont(l_extendedprice, 0.9) FROM lineitem)")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    q = li.agg(F.percentile("l_extendedprice", 0.9).alias("q"))
    return li.crossJoin(F.broadcast(q)).where("l_extendedprice < q").drop("q")  # one row is sent


@query("coef_variation", "SELECT l_suppkey, round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 6) AS cv FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(E.rounded(F.stddev_pop("l_extendedprice") / F.avg("l_extendedprice"), 6).alias("cv"))


@query("distinct_trees", f"SELECT DISTINCT tile, label FROM ({PTS})")
def _(spark, d):
    return points(spark, d).select("tile", "label").distinct()


@query("box_count_filter", f"SELECT pid, n FROM (SELECT pid, count(*) OVER (PARTITION BY floor(x / 3), floor(y / 3)) AS n FROM ({PTS})) WHERE n > 600")
def _(spark, d):
    box = Window.partitionBy(F.floor(F.col("x") / 3), F.floor(F.col("y") / 3))
    return points(spark, d).select("pid", F.count(F.lit(1)).over(box).alias("n")).where("n > 600")


@query("max_pool", "SELECT label, " + ", ".join(f"max(CAST(embedding[{i + 1}] AS DOUBLE)) AS f{i}" for i in range(8)) + " FROM embeddings GROUP BY label")
def _(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(*[F.max(F.col("embedding")[i].cast("double")).alias(f"f{i}") for i in range(8)])


@query("epoch_accuracy", f"SELECT vec_id % 5 AS epoch, round(avg(CASE WHEN list_position(v, list_max(v)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS acc, count(*) AS n FROM ({E4}) GROUP BY 1")
def _(spark, d):
    rows = _scores(spark, d).select((F.col("vec_id") % 5).alias("epoch"), (E.argmax("v") == F.col("label")).cast("double").alias("ok"))
    return rows.groupBy("epoch").agg(E.rounded(F.avg("ok"), 6).alias("acc"), F.count(F.lit(1)).alias("n"))


# Windows, order and sampling.


@query("shortest_per_cluster", "SELECT l_suppkey, l_extendedprice AS distance, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def _(spark, d):
    first = F.min(F.struct(F.col("l_extendedprice").alias("distance"), "l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(first.alias("s")).select("l_suppkey", "s.distance", "s.l_orderkey")


RADII = "SELECT s_suppkey, s_nationkey AS tile, round((s_acctbal + 1000) / 20000, 4) AS radius FROM supplier"


@query("tree_numbering", f"SELECT s_suppkey, tile, radius, row_number() OVER (PARTITION BY tile ORDER BY radius DESC, s_suppkey) - 1 AS number FROM ({RADII})")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("tile"), E.rounded((F.col("s_acctbal") + 1000) / 20000, 4).alias("radius"))
    return s.withColumn("number", (F.row_number().over(Window.partitionBy("tile").orderBy(F.desc_nulls_last("radius"), F.asc_nulls_last("s_suppkey"))) - 1).cast("long"))


@query("diameter_class", f"SELECT s_suppkey, printf('%.1f', {fd('2 * radius', '0.1::DOUBLE')} / 10.0::DOUBLE) AS diameter_class FROM ({RADII})")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", E.rounded((F.col("s_acctbal") + 1000) / 20000, 4).alias("radius"))
    return s.select("s_suppkey", E.diameter_class("radius").alias("diameter_class"))


ORDER = "((pid % 1000003 + 0) * 48271) % 2147483647"


@query("box_sample", f"SELECT pid, bx FROM (SELECT pid, bx, count(*) OVER (PARTITION BY bx) AS n, row_number() OVER (PARTITION BY bx ORDER BY {ORDER}, pid) AS r FROM (SELECT pid, CAST(floor(x / 3) AS BIGINT) AS bx FROM ({PTS}))) WHERE n > 100 AND r <= 400")
def _(spark, d):
    boxed = points(spark, d).select("pid", F.floor(F.col("x") / 3).cast("long").alias("bx"))
    return classify.sample_boxes(boxed, 100, 400, by=("bx",))


@query("dedupe_rows", f"SELECT DISTINCT round(x, 1) AS x, round(y, 1) AS y, label FROM ({PTS})")
def _(spark, d):
    return points(spark, d).select(E.rounded("x", 1).alias("x"), E.rounded("y", 1).alias("y"), "label").dropDuplicates()


# Set operations.


@query("tile_union", f"SELECT pid, tile, true AS buffer, NULL::DOUBLE AS n_z FROM ({PTS}) WHERE tile IN (1, 2) AND x BETWEEN 2 AND 8 UNION ALL SELECT pid, tile, false, n_z FROM ({PTS}) WHERE tile = 0")
def _(spark, d):
    p = points(spark, d)
    own = p.where("tile = 0").select("pid", "tile", F.lit(False).alias("buffer"), "n_z")
    near = p.where("tile IN (1, 2)").where(F.col("x").between(2, 8)).select("pid", "tile", F.lit(True).alias("buffer"))
    return own.unionByName(near, allowMissingColumns=True)


@query("leaf_union", f"SELECT pid, label FROM ({PTS}) WHERE label = 1 AND n_z >= 2 UNION ALL SELECT pid, label FROM ({PTS}) WHERE label = 3 AND n_z >= 2")
def _(spark, d):
    p = points(spark, d).where("n_z >= 2")
    return p.where("label = 1").unionByName(p.where("label = 3")).select("pid", "label")


FACES = " UNION ALL ".join(
    f"SELECT ix, iy, iz, {', '.join(f'round({e}{c}, 6) AS {c}' if c == a else f'round(m{c}, 6) AS {c}' for c in 'xyz')} FROM v" for a in "xyz" for e in ("lo", "hi")
)


def faces(leaves: DataFrame) -> DataFrame:
    """Six points a voxel (rows have ix, iy, iz): the least and greatest on one axis, at the medians of the other two."""
    stats = [g for c in "xyz" for g in (F.min(c).alias(f"lo{c}"), F.max(c).alias(f"hi{c}"), F.median(c).alias(f"m{c}"))]
    v = leaves.groupBy("ix", "iy", "iz").agg(*stats)
    six = F.array(*[F.struct(*[F.col(f"{e}{c}" if c == a else f"m{c}").alias(c) for c in "xyz"]) for a in "xyz" for e in ("lo", "hi")])
    return v.select("ix", "iy", "iz", F.explode(six).alias("f")).select("ix", "iy", "iz", "f.x", "f.y", "f.z")


@query("voxel_faces", f"WITH v AS (SELECT ix, iy, iz, " + ", ".join(f"min({c}) AS lo{c}, max({c}) AS hi{c}, median({c}) AS m{c}" for c in "xyz") + f" FROM ({LEAF}) WHERE label = 1 GROUP BY ALL) {FACES}")
def _(spark, d):
    from timberline.operators.spatial import voxels

    f = faces(voxels(points(spark, d).where("label = 1"), 0.5))
    return f.select("ix", "iy", "iz", *[E.rounded(c, 6).alias(c) for c in "xyz"])


@query("accept_stems", "SELECT l_suppkey, round(r, 6) AS radius, cnt, round(cv, 6) AS cv FROM (SELECT l_suppkey, avg(l_discount) AS r, count(*) AS cnt, stddev_pop(l_quantity) / avg(l_quantity) AS cv FROM lineitem GROUP BY 1) WHERE r > 0.025 AND cnt > 590 AND cv <= 0.57")
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("radius"), F.count(F.lit(1)).alias("cnt"), (F.stddev_pop("l_quantity") / F.avg("l_quantity")).alias("cv"))
    return accepted(rows, 0.025, 590, 0.57).select("l_suppkey", E.rounded("radius", 6).alias("radius"), "cnt", E.rounded("cv", 6).alias("cv"))


def accepted(cylinders: DataFrame, radius: float, points_: int, cv: float) -> DataFrame:
    return cylinders.where((F.col("radius") > radius) & ~F.isnan("radius") & (F.col("cnt") > points_) & (F.col("cv") <= cv))


@query("cylinder_dispatch", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) < 10 THEN 'mean' WHEN count(*) < 50 THEN 'centre' ELSE 'ransac' END AS kind FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", fit.cylinder_case(F.col("n")))


@query("tile_index", "SELECT CAST(n_nationkey AS INTEGER) AS tile, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y FROM nation")
def _(spark, d):
    from timberline.plans.tables import new_folder
    from timberline.sources.readers import read_tile_index

    tiles = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("tile"), (F.col("n_nationkey") % 5).cast("double").alias("x"), F.expr("n_nationkey div 5").cast("double").alias("y"))
    path = new_folder(spark, "tiles")
    tiles.write.csv(path, sep=" ", header=False)
    return read_tile_index(spark, path)
