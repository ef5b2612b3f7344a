"""Clusters, paths, fits, pipelines, formats and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.functions.exprs import floor_div, rounded
from timberline.operators import classify, fit, graph, spatial
from timberline.operators.cluster import dbscan
from timberline.plans import pipelines
from timberline.plans.catalogue import query
from timberline.plans.config import Instance, Semantic, Training
from timberline.plans.queries_relational import fd
from timberline.plans.tables import cut, new_folder, points, points_sql, table

PTS, FLAT = points_sql(), points_sql(100)
D3 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def dbscan_sql(pts: str, eps: str, least: int, d2: str, same: str = "true", order: str = "0") -> str:
    """`pts` gives id, the dimensions, and what `same` and `order` speak of."""
    return f"""
WITH RECURSIVE w AS ({pts}), e AS (SELECT a.id AS src, b.id AS dst FROM w a JOIN w b ON {same} AND {d2} <= {eps}::DOUBLE * {eps}::DOUBLE),
core AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) >= {least}),
ce AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
cc(id, lab) AS (SELECT id, id FROM core UNION SELECT ce.dst, cc.lab FROM cc JOIN ce ON ce.src = cc.id),
comp AS (SELECT id, min(lab) AS first FROM cc GROUP BY id),
num AS (SELECT first, row_number() OVER (ORDER BY {order}, first) - 1 AS cluster FROM (SELECT DISTINCT c.first, w.* FROM comp c JOIN w ON w.id = c.first)),
inn AS (SELECT id, cluster FROM comp JOIN num USING (first)),
bord AS (SELECT e.dst AS id, min(inn.cluster) AS cluster FROM e JOIN inn ON inn.id = e.src WHERE e.dst NOT IN (SELECT id FROM core) GROUP BY e.dst)
SELECT w.id, CAST(coalesce(inn.cluster, bord.cluster, -1) AS BIGINT) AS cluster FROM w LEFT JOIN inn USING (id) LEFT JOIN bord USING (id)"""


def _wood(spark: SparkSession, d: str, height: int = 40) -> DataFrame:
    return points(spark, d, height).where("label = 3").withColumn("id", F.col("pid")).withColumn("n_slice", floor_div("n_z", 0.2))


@query("slice_dbscan", dbscan_sql(f"SELECT pid AS id, x, y, z, {fd('n_z', '0.2::DOUBLE')} AS n_slice FROM ({PTS}) WHERE label = 3", "0.3", 4, D3, "a.n_slice = b.n_slice", "n_slice"))
def _(spark, d):
    return dbscan(_wood(spark, d).select("id", "x", "y", "z", "n_slice"), 0.3, 4, cut, by=["n_slice"])


@query("stem_dbscan", dbscan_sql(f"SELECT pid AS id, x, y FROM ({PTS}) WHERE label = 3", "0.1", 4, D2))
def _(spark, d):
    return dbscan(_wood(spark, d).select("id", "x", "y"), 0.1, 4, cut, dims=("x", "y"))


GRAPH = f"""w AS (SELECT pid AS id, x, y, z FROM ({FLAT}) WHERE label = 3), e AS (SELECT a.id AS src, b.id AS dst, sqrt({D3}) AS length FROM w a JOIN w b ON a.id <> b.id AND {D3} <= 0.3::DOUBLE * 0.3::DOUBLE),
core AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) >= 4), ce AS (SELECT * FROM e WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
sp(id, s) USING KEY (id) AS (SELECT id, {{'d': 0.0::DOUBLE, 'base': id, 'pred': NULL::BIGINT}} FROM core WHERE id % 50 = 0 AND id IN (SELECT src FROM ce)
  UNION SELECT o.id, o.s FROM (SELECT ce.dst AS id, min({{'d': sp.s.d + ce.length, 'base': sp.s.base, 'pred': ce.src}}) AS s FROM sp JOIN ce ON ce.src = sp.id GROUP BY ce.dst) o LEFT JOIN recurring.sp r ON r.id = o.id WHERE r.id IS NULL OR o.s < r.s)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    w = _wood(spark, d, 100)
    near = cut(spatial.within(w, w, 0.3).where("id <> other"), "near")
    core = near.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("id")
    e = near.join(core, "id", "left_semi").join(core.withColumnRenamed("id", "other"), "other", "left_semi")
    edges = e.where("id < other").select(F.col("id").alias("src"), F.col("other").alias("dst"), F.sqrt("d2").alias("length"))
    return cut(graph.shortest_paths(edges, core.where("id % 50 = 0"), cut), "paths")


@query("multi_source_sp", f"WITH RECURSIVE {GRAPH} SELECT id, round(s.d, 6) AS distance, s.base AS base, s.pred AS pred FROM sp")
def _(spark, d):
    return _paths(spark, d).select("id", rounded("distance", 6).alias("distance"), "base", "pred")


@query("path_tips", f"WITH RECURSIVE {GRAPH} SELECT id FROM sp WHERE id NOT IN (SELECT s.pred FROM sp WHERE s.pred IS NOT NULL)")
def _(spark, d):
    return graph.tips(_paths(spark, d)).select("id")


@query("gap_filter", f"WITH RECURSIVE {GRAPH} SELECT id, s.base AS base FROM sp WHERE s.d <= 0.5")
def _(spark, d):
    return _paths(spark, d).where("distance <= 0.5").select("id", "base")


@query("tree_assignment", f"WITH RECURSIVE {GRAPH} SELECT s.base AS tree, count(*) AS n, round(max(s.d), 6) AS reach FROM sp GROUP BY 1")
def _(spark, d):
    return _paths(spark, d).groupBy(F.col("base").alias("tree")).agg(F.count(F.lit(1)).alias("n"), rounded(F.max("distance"), 6).alias("reach"))


# Fits.


@query("hull_vertices")
def _(spark, d):
    return fit.hull_points(points(spark, d).where("label = 3").select("pid", "x", "y", "z", "tile"), ["tile"])


@query("fit_cylinders")
def _(spark, d):
    """A cylinder for each user, as a stem."""
    p = points(spark, d).withColumn("tree", F.col("tile") * 15 + F.floor("x").cast("int"))
    return fit.fit_cylinders(p.select("tree", "x", "y", "z"), "tree", 100)


@query("fps")
def _(spark, d):
    boxed = points(spark, d).select("pid", "x", "y", "z", F.floor(F.col("x") / 3).alias("bx"), F.floor(F.col("y") / 3).alias("by"))
    return fit.farthest_points(boxed, ["bx", "by"], 0.1)


# Classification and the pipelines, over the whole point view. Its points have classes by chance, so classes by height take their place: there is something to learn,
# and ground. Its stems are sparse (some 70 points), so thresholds in points are lower than the defaults, and distances longer.

TABLE = Instance(slice_points=20, slice_eps=0.3, slice_least=4, stem_height=0.0, stem_thickness=3.0, stem_eps=0.25, stem_least=5, stem_min_points=40, wood_neighbours=60, edge_length=0.5)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).withColumn("label", F.expr("CASE WHEN z < 0.2 THEN 0 WHEN z > 1.5 THEN 1 ELSE 3 END")).drop("n_z", "tile")


SEMANTIC, TRAINING = Semantic(min_points=200, resolution=2.0), Training(min_points=200)


@query("train_classifier")
def _(spark, d):
    return pipelines.train(_labelled(spark, d), TRAINING)[1]


@query("classify_points")
def _(spark, d):
    f = _labelled(spark, d)
    return classify.classify_forest(f, pipelines.train(f, TRAINING)[0], 16, cut)


@query("classify_network")
def _(spark, d):
    boxed = points(spark, d).select("pid", "x", "y", "z", F.floor(F.col("x") / 3).alias("bx"), F.floor(F.col("y") / 3).alias("by"), F.lit(0).cast("long").alias("bz"))
    return classify.classify_network(boxed, classify.PointNetwork.random(1, shrink=64))


@query("semantic_pipeline")
def _(spark, d):
    f = _labelled(spark, d)
    model, _ = pipelines.train(f, TRAINING)
    return pipelines.semantic(f.select("pid", "x", "y", "z", F.lit(False).alias("buffer")), pipelines.forest_classifier(model), SEMANTIC)


def _standing(spark: SparkSession, d: str) -> DataFrame:
    """Leaves are the high points of the class of that number, all else is wood."""
    return points(spark, d).withColumn("label", F.when((F.col("label") == 1) & (F.col("z") >= 2), 1).otherwise(3))


@query("instance_pipeline")
def _(spark, d):
    return pipelines.instance(_standing(spark, d), TABLE)[0]


@query("leaf_attach")
def _(spark, d):
    return pipelines.instance(_standing(spark, d), TABLE, leaves=True)[0].where("NOT wood").select("pid", "t_clstr", "distance")


CENTRES = f"SELECT tile, min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy, (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y FROM ({PTS}) GROUP BY tile"


@query("tile_run", f"""
WITH p AS ({PTS}), t AS ({CENTRES}), n AS (SELECT a.*, b.tile AS neighbour FROM t a JOIN t b ON a.tile <> b.tile QUALIFY row_number() OVER (PARTITION BY a.tile ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.tile) <= 8)
SELECT tile, pid, false AS buffer FROM p UNION ALL
SELECT n.tile, p.pid, true FROM n JOIN p ON p.tile = n.neighbour AND p.x BETWEEN lox - 0.75 AND hix + 0.75 AND p.y BETWEEN loy - 0.75 AND hiy + 0.75""")
def _(spark, d):
    return pipelines.tile_clouds(points(spark, d).select("tile", "pid", "x", "y"), 8, 0.75).select("tile", "pid", "buffer")


@query("tree_files")
def _(spark, d):
    """Tile 0 with a buffer, its trees written as files by diameter class, and read back: the points of each file."""
    from timberline.sources.readers import read_points

    cloud = cut(pipelines.tile_clouds(_standing(spark, d), 8, 0.75).where("tile = 0").drop("tile"), "cloud")
    held, trees = pipelines.instance(cloud, TABLE, leaves=True)
    folder = new_folder(spark, "trees")
    pipelines.tree_files(cut(held, "held"), cut(trees, "numbered"), folder, 0, classes=True)
    read = read_points(spark, f"{folder}/trees.ply/*/*.ply")
    return read.groupBy(F.element_at(F.split("file", "/"), -2).alias("diameter_class"), F.element_at(F.split("file", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("wood").cast("long").alias("n_wood"))


# Formats and streams.


@query("sink_csv", f"SELECT x, y, z FROM ({PTS})")
def _(spark, d):
    from timberline.sources.readers import write_points

    path = new_folder(spark, "points") + ".csv"
    write_points(points(spark, d), path)
    return spark.read.csv(path, sep=" ", schema="x DOUBLE, y DOUBLE, z DOUBLE")


def _round_trip(spark: SparkSession, d: str, ending: str) -> DataFrame:
    """Write points by tile into files of a format, and read them back."""
    from timberline.sources import readers

    p = points(spark, d).select("x", "y", "z", F.col("label").cast("double").alias("label"), "tile")
    folder = f"{new_folder(spark, ending)}.{ending}"
    readers.write_points(p, folder, ["label"], by="tile")
    return readers.read_points(spark, f"{folder}/*.{ending}")


@query("sink_ply", f"SELECT x, y, z, CAST(label AS DOUBLE) AS label FROM ({PTS})")
def _(spark, d):
    return _round_trip(spark, d, "ply").select("x", "y", "z", "label")


@query("scan_ply", f"SELECT count(*) AS n, round(sum(x), 6) AS sx FROM ({PTS})")
def _(spark, d):
    return _round_trip(spark, d, "ply").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x"), 6).alias("sx"))


@query("scan_pcd", f"SELECT count(*) AS n, count(DISTINCT CAST(x AS FLOAT)) AS nx FROM ({PTS})")
def _(spark, d):
    return _round_trip(spark, d, "pcd").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("nx"))


@query("stage_resume", f"SELECT tile, count(*) AS n FROM ({PTS}) GROUP BY tile")
def _(spark, d):
    from timberline.sources.readers import Stages

    folder = new_folder(spark, "stages")
    make = lambda: points(spark, d).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    Stages(spark, folder).run("tiles", make)
    return Stages(spark, folder).run("tiles", lambda: make().where("false"))


HALF = ", ".join(f"{fd(c, '0.5::DOUBLE')} AS i{c}" for c in "xyz")


@query("stream_voxels", f"SELECT {HALF}, count(*) AS n, min(z) AS low FROM ({PTS}) GROUP BY 1, 2, 3")
def _(spark, d):
    from timberline.streaming import tiles

    folder = new_folder(spark, "stream")
    p = points(spark, d).select("pid", "x", "y", "z")
    for i in range(2):
        p.where(F.col("pid") % 2 == i).write.mode("append").parquet(f"{folder}/in")
    return tiles.drain(tiles.voxel_counts(tiles.read_tiles(spark, f"{folder}/in", p.schema), 0.5), folder)


@query("tile_trees", f"SELECT tile, n, number FROM (SELECT tile, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tile) - 1 AS number FROM ({PTS}) WHERE label = 3 GROUP BY tile)")
def _(spark, d):
    n = points(spark, d).where("label = 3").groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("number", (F.row_number().over(Window.orderBy(F.desc("n"), "tile")) - 1).cast("long"))
