"""Voxels, boxes, distance joins, nearest neighbours and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import exprs as E
from timberline.operators import classify, raster, spatial
from timberline.plans.catalogue import query
from timberline.plans.queries_relational import faces, fd
from timberline.plans.tables import cut, new_folder, points, points_sql, table

PTS, HIGH = points_sql(), points_sql(8)
CELL3 = ", ".join(f"{fd(c, '0.2::DOUBLE')} AS i{c}" for c in "xyz")


@query("voxel_stats", f"SELECT ix, iy, iz, count(*) AS n, round(median(x), 6) AS mx, min(pid) AS first FROM (SELECT *, {CELL3} FROM ({HIGH})) GROUP BY ALL")
def _(spark, d):
    v = spatial.voxels(points(spark, d, 8), 0.2)
    return v.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), E.rounded(F.median("x"), 6).alias("mx"), F.min("pid").alias("first"))


@query("voxel_first", f"SELECT pid, ix, iy, iz FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY pid % 2, pid) AS r FROM (SELECT *, {CELL3} FROM ({PTS}))) WHERE r = 1")
def _(spark, d):
    return spatial.downsample(points(spark, d), 0.2, order=[F.col("pid") % 2, F.col("pid")]).select("pid", "ix", "iy", "iz")


MEDOID = f"""
SELECT pid, r = 1 AS downsampled FROM (SELECT pid, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY (x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), pid) AS r FROM
(SELECT *, median(x) OVER v AS mx, median(y) OVER v AS my, median(z) OVER v AS mz FROM (SELECT *, {CELL3} FROM ({PTS})) WINDOW v AS (PARTITION BY ix, iy, iz)))"""


@query("voxel_medoid", f"SELECT pid FROM ({MEDOID}) WHERE downsampled")
def _(spark, d):
    return spatial.downsample(points(spark, d), 0.2, "nearest").select("pid")


@query("voxel_flag", MEDOID)
def _(spark, d):
    return spatial.downsample(points(spark, d), 0.2, "nearest", flag=True).select("pid", "downsampled")


AXIS = "(SELECT floor(min({0})) - 3 AS o, CAST(greatest(ceil((ceil(max({0})) + 3 - (floor(min({0})) - 3)) / 3) - 1, 0) AS BIGINT) AS last FROM p)"


@query("box_explode", f"""
WITH p AS ({PTS}),
{", ".join(f"c{c} AS (SELECT pid, CAST(b AS BIGINT) AS v{c} FROM p, {AXIS.format(c)} e, range(e.last + 1) t(b) WHERE {c} BETWEEN e.o + 3 * b AND e.o + 3 * b + 6)" for c in "xyz")}
SELECT pid, vx AS bx, vy AS "by", vz AS bz FROM cx JOIN cy USING (pid) JOIN cz USING (pid)""")
def _(spark, d):
    return spatial.boxes(points(spark, d)).select("pid", "bx", "by", "bz")


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
WOOD = f"(SELECT pid, x, y, z, tile, {fd('n_z', '0.2::DOUBLE')} AS n_slice FROM ({PTS}) WHERE label = 3)"


def _ids(p):
    return p.withColumn("id", F.col("pid"))


def _wood(spark, d):
    return _ids(points(spark, d).where("label = 3")).withColumn("n_slice", E.floor_div("n_z", 0.2))


@query("eps_pairs", f"WITH w AS {WOOD} SELECT a.pid AS id, b.pid AS other, round(sqrt({D2}), 6) AS distance FROM w a JOIN w b ON {D2} <= 0.3::DOUBLE * 0.3::DOUBLE")
def _(spark, d):
    w = _wood(spark, d)
    return spatial.within(w, w, 0.3).select("id", "other", E.rounded(F.sqrt("d2"), 6).alias("distance"))


@query("eps_pairs_slice", f"WITH w AS {WOOD} SELECT a.pid AS id, b.pid AS other, a.n_slice FROM w a JOIN w b ON a.n_slice = b.n_slice AND {D2} <= 0.3::DOUBLE * 0.3::DOUBLE")
def _(spark, d):
    w = _wood(spark, d)
    return spatial.within(w, w, 0.3, by=["n_slice"]).select("id", "other", "n_slice")


KNN = """
WITH q AS (SELECT pid, x, y, z FROM ({pts}) WHERE {q}), p AS (SELECT * FROM ({pts}) WHERE {p})
SELECT a.pid AS id, b.pid AS other, {d2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {d2}, b.pid) AS rank FROM q a JOIN p b ON {on} QUALIFY rank <= {k}"""


def knn_sql(q: str, p: str, k: int, on: str = "true") -> str:
    return KNN.format(pts=PTS, q=q, p=p, k=k, on=on, d2=D2)


def _knn(spark, d, q, p, k, **more):
    pts = _ids(points(spark, d))
    return spatial.nearest(pts.where(q), pts.where(p), k, cut, **more)


@query("knn_join", f"SELECT id, other, round(sqrt(d2), 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ({knn_sql('label = 0', 'label = 3', 5)})")
def _(spark, d):
    return _knn(spark, d, "label = 0", "label = 3", 5).select("id", "other", E.rounded(F.sqrt("d2"), 6).alias("distance"), "rank")


EDGES = f"""
SELECT least(s, t) AS src, greatest(s, t) AS dst, round(sqrt(min(d2)), 6) AS length FROM
(SELECT a.pid, a.pid % 97 AS s, b.pid % 97 AS t, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r FROM {WOOD} a JOIN {WOOD} b ON a.pid <> b.pid AND {D2} <= 0.25) WHERE r <= 20 AND s <> t GROUP BY ALL"""


@query("knn_edges", EDGES)
def _(spark, d):
    from timberline.operators.graph import least_edges

    w = _wood(spark, d)
    near = spatial.nearest(w, w, 20, cut, exclude_self=True, most=0.5)  # ranks count neighbours of the same cluster too
    pairs = near.select((F.col("id") % 97).alias("src"), (F.col("other") % 97).alias("dst"), F.sqrt("d2").alias("length"))
    return least_edges(pairs).select("src", "dst", E.rounded("length", 6).alias("length"))


@query("knn_noise", f"SELECT id, round(avg(sqrt(d2)), 6) AS score FROM ({knn_sql('label = 3', 'label = 3', 10, 'a.pid <> b.pid')}) WHERE rank BETWEEN 2 AND 10 GROUP BY id")
def _(spark, d):
    near = _knn(spark, d, "label = 3", "label = 3", 10, exclude_self=True)
    return near.where(F.col("rank").between(2, 10)).groupBy("id").agg(E.rounded(F.avg(F.sqrt("d2")), 6).alias("score"))


@query("leaf_entry_points", f"""
WITH v AS (SELECT ix, iy, iz, {', '.join(f'min({c}) AS lo{c}, max({c}) AS hi{c}, median({c}) AS m{c}' for c in 'xyz')} FROM (SELECT *, {', '.join(f"{fd(c, '2.0::DOUBLE')} AS i{c}" for c in 'xyz')} FROM ({PTS}) WHERE label = 1) GROUP BY ALL),
f AS ({" UNION ALL ".join(f"SELECT ix * 1000000 + iy * 1000 + iz * 10 + {2 * j + k} AS fid, {', '.join(f'{e}{c} AS {c}' if c == a else f'm{c} AS {c}' for c in 'xyz')} FROM v" for j, a in enumerate('xyz') for k, e in enumerate(('lo', 'hi')))}),
b AS (SELECT pid, x, y, z FROM ({PTS}) WHERE label = 3)
SELECT DISTINCT pid FROM (SELECT b.pid, row_number() OVER (PARTITION BY a.fid ORDER BY {D2}, b.pid) AS r FROM f a, b) WHERE r <= 2""")
def _(spark, d):
    p = points(spark, d)
    f = spatial.voxels(p.where("label = 1"), 2.0)
    f = faces(f).withColumn("id", F.xxhash64("ix", "iy", "iz", "x", "y", "z"))
    b = _ids(p.where("label = 3"))
    return spatial.nearest(f.dropDuplicates(["id"]), b, 2, cut).select(F.col("other").alias("pid")).distinct()


@query("ball_query", f"WITH w AS {WOOD} SELECT id, other FROM (SELECT a.pid AS id, b.pid AS other, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r FROM w a JOIN w b ON {D2} <= 0.2::DOUBLE * 0.2::DOUBLE) WHERE r <= 4")
def _(spark, d):
    w = _wood(spark, d)
    return classify.ball_query(w, w, 0.2, 4).select("id", "other")


@query("knn_interpolate", f"""
SELECT id, round(sum(n_z / greatest(k.d2, 1e-16)) / sum(1 / greatest(k.d2, 1e-16)), 4) AS v FROM
({knn_sql('label = 0', 'label = 3', 3)}) k JOIN ({PTS}) p ON p.pid = k.other GROUP BY id""")
def _(spark, d):
    near = _knn(spark, d, "label = 0", "label = 3", 3)
    return classify.interpolate(near, _ids(points(spark, d)), "n_z").select("id", E.rounded("n_z", 4).alias("v"))


CLASSIFIED = f"SELECT pid, x, y, z, (pid % 7) / 10.0::DOUBLE AS p_terrain, (pid % 11) / 12.0::DOUBLE AS p_leaf, (pid % 5) / 9.0::DOUBLE AS p_debris, (pid % 13) / 14.0::DOUBLE AS p_wood FROM ({PTS})"


@query("knn16_vote", f"""
WITH q AS (SELECT pid, x, y, z FROM ({PTS}) WHERE pid % 20 = 0), c AS ({CLASSIFIED}),
n AS (SELECT a.pid AS qid, b.*, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r FROM q a, c b),
m AS (SELECT qid AS pid, median(p_terrain) AS a0, median(p_leaf) AS a1, median(p_debris) AS a2, median(p_wood) AS a3, bool_or(p_wood > 0.92) AS w FROM n WHERE r <= 16 GROUP BY qid)
SELECT pid, CASE WHEN w THEN 3 WHEN a0 >= a1 AND a0 >= a2 AND a0 >= a3 THEN 0 WHEN a1 >= a2 AND a1 >= a3 THEN 1 WHEN a2 >= a3 THEN 2 ELSE 3 END AS label, round(a0, 6) AS p_terrain, round(a1, 6) AS p_leaf, round(a2, 6) AS p_debris, round(a3, 6) AS p_wood FROM m""")
def _(spark, d):
    p = points(spark, d)
    probs = [((F.col("pid") % m) / F.lit(float(q))).alias(n) for n, m, q in zip(classify.PROBS, (7, 11, 5, 13), (10, 12, 9, 14), strict=True)]
    c = p.select(F.col("pid").alias("id"), "pid", "x", "y", "z", *probs)
    v = classify.vote(p.where("pid % 20 = 0"), c, 16, 0.92, cut)
    return v.select("pid", "label", *[E.rounded(n, 6).alias(n) for n in classify.PROBS])


TILES = "SELECT CAST(n_nationkey AS INTEGER) AS tile, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y FROM nation"


def _tiles(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("tile"), (F.col("n_nationkey") % 5).cast("double").alias("x"), F.expr("n_nationkey div 5").cast("double").alias("y"))


TD2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query("tile_neighbours", f"WITH t AS ({TILES}) SELECT tile, neighbour, distance, rank FROM (SELECT a.tile, b.tile AS neighbour, round(sqrt({TD2}), 6) AS distance, row_number() OVER (PARTITION BY a.tile ORDER BY {TD2}, b.tile) AS rank FROM t a JOIN t b ON a.tile <> b.tile) WHERE rank <= 8")
def _(spark, d):
    return spatial.tile_neighbours(_tiles(spark, d), 8, cut).withColumn("distance", E.rounded("distance", 6))


@query("tile_buffer9", f"WITH t AS ({TILES}) SELECT tile, neighbour FROM (SELECT a.tile, b.tile AS neighbour, row_number() OVER (PARTITION BY a.tile ORDER BY a.tile <> b.tile, {TD2}, b.tile) AS rank FROM t a JOIN t b ON {TD2} <= 1.5 * 1.5) WHERE rank <= 9")
def _(spark, d):
    return spatial.tile_neighbours(_tiles(spark, d), 9, cut, reach=1.5, include_self=True).select("tile", "neighbour")


# Terrain.

G = f"SELECT *, CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy FROM ({PTS})"
GROUND = f"SELECT ix, iy, median(z) AS z FROM ({G}) WHERE label = 0 GROUP BY ix, iy"
GRID = f"SELECT a.ix, b.iy FROM (SELECT unnest(range((SELECT min(ix) FROM g), (SELECT max(ix) + 1 FROM g))) AS ix) a, (SELECT unnest(range((SELECT min(iy) FROM g), (SELECT max(iy) + 1 FROM g))) AS iy) b"


@query("dtm_cells", f"SELECT ix, iy, round(z, 6) AS z FROM (SELECT ix, iy, median(z) AS z, list(z) AS l FROM ({G}) WHERE label = 0 GROUP BY ix, iy) WHERE list_contains(l, z)")
def _(spark, d):
    return raster.ground_cells(points(spark, d), 1.0, exact_only=True).select("ix", "iy", E.rounded("z", 6).alias("z"))


@query("dtm_grid", f"WITH g AS ({G}), m AS ({GROUND}) SELECT ix, iy, round(z, 6) AS z FROM ({GRID}) LEFT JOIN m USING (ix, iy)")
def _(spark, d):
    return raster.raster(points(spark, d), 1.0).select("ix", "iy", E.rounded("z", 6).alias("z"))


@query("ground_right_join", f"WITH g AS ({G}), m AS ({GROUND}) SELECT pid, round(m.z, 6) AS cell FROM m RIGHT JOIN (SELECT pid, ix, iy FROM g WHERE label = 0) p USING (ix, iy)")
def _(spark, d):
    p = points(spark, d)
    m = raster.ground_cells(p, 1.0).withColumnRenamed("z", "cell")
    return m.join(raster.cells(p.where("label = 0"), 1.0).select("pid", "ix", "iy"), ["ix", "iy"], "right").select("pid", E.rounded("cell", 6).alias("cell"))


MIRROR = "CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END"


def _mirror(i: str, lo: str, hi: str) -> str:
    n = f"({hi} - {lo} + 1)"
    return f"{lo} + " + MIRROR.format(m=f"((({i} - {lo}) % (2 * {n}) + 2 * {n}) % (2 * {n}))", n=n)


def focal_sql(size: int) -> str:
    h = size // 2
    return f"""
SELECT c.ix, c.iy, median(v.z) AS z FROM r c, (SELECT unnest(range(-{h}, {h + 1})) AS dx) a, (SELECT unnest(range(-{h}, {h + 1})) AS dy) b, (SELECT min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM r) e
JOIN r v ON v.ix = {_mirror('(c.ix + a.dx)', 'e.x0', 'e.x1')} AND v.iy = {_mirror('(c.iy + b.dy)', 'e.y0', 'e.y1')} GROUP BY c.ix, c.iy"""


RASTER = f"g AS ({G}), m AS ({GROUND}), r AS (SELECT ix, iy, z FROM ({GRID}) LEFT JOIN m USING (ix, iy))"


@query("focal_median", f"WITH {RASTER} SELECT ix, iy, round(z, 6) AS z FROM ({focal_sql(3)})")
def _(spark, d):
    return raster.focal_median(cut(raster.raster(points(spark, d), 1.0)), 3).select("ix", "iy", E.rounded("z", 6).alias("z"))


@query("height_above_ground", f"WITH {RASTER}, f AS ({focal_sql(3)}) SELECT pid, round(g.z - f.z, 9) AS n_z, CASE WHEN g.z - f.z <= 0.1 THEN 0 ELSE label END AS label FROM g JOIN f USING (ix, iy)")
def _(spark, d):
    p = points(spark, d)
    up = raster.above_ground(p.drop("n_z"), raster.fill(raster.raster(p, 1.0), cut), 1.0)
    return up.select("pid", E.rounded("n_z", 9).alias("n_z"), F.when(F.col("n_z") <= 0.1, 0).otherwise(F.col("label")).alias("label"))


@query("dtm_csv", f"WITH {RASTER}, f AS ({focal_sql(3)}) SELECT ix, iy, round(z, 6) AS z FROM f")
def _(spark, d):
    path = new_folder(spark, "dem")
    raster.fill(raster.raster(points(spark, d), 1.0), cut).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="ix BIGINT, iy BIGINT, z DOUBLE").select("ix", "iy", E.rounded("z", 6).alias("z"))


@query("min_spacing")
def _(spark, d):
    return classify.thin(points(spark, d).where("label = 3"), 0.1, 100, cut).select("pid", "x", "y", "z")
