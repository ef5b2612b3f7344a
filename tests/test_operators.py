import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions import exprs as E
from timberline.operators import classify, cluster, fit, graph, raster, spatial
from timberline.plans import pipelines
from timberline.plans.config import Instance, Training, stem_slices
from timberline.plans.fixtures import forest, radius_of
from timberline.plans.tables import cut


def cloud(spark, rows, names="pid x y z"):
    return spark.createDataFrame(rows, names.split())


@pytest.mark.parametrize(("v", "step", "want"), [(1.0, 0.1, 9), (2.0, 0.2, 9), (-7.5, 2.0, -4), (0.0, 0.5, 0), (-0.2, 0.5, -1), (3.0, 0.5, 6)])
def test_floor_division_is_that_of_remainders(spark, v, step, want):
    assert spark.range(1).select(E.floor_div(F.lit(v), step)).first()[0] == want == int(v // step)


def test_stem_slab_uses_the_same_division():
    assert stem_slices(Instance()) == (7, 10)


def test_diameter_class(spark):
    assert [spark.range(1).select(E.diameter_class(F.lit(r))).first()[0] for r in (0.04, 0.05, 0.12)] == ["0.0", "0.1", "0.2"]


def test_rounding_is_that_of_sql_at_ties(spark):
    import duckdb

    values = [3 / 20000, 0.00465, 0.05, 2.675, -2.5, -0.00015, *(k / 20000 for k in range(1, 2000, 2))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for digits in (0, 1, 4):
        want = [duckdb.execute(f"SELECT round(?::DOUBLE, {digits})", [v]).fetchone()[0] for v in values]
        assert [r.r for r in df.select("i", E.rounded("v", digits).alias("r")).orderBy("i").collect()] == want


def suppliers(spark, folder):
    """Balances whose radius is a tie in its fourth place, and where two of a tile are equal only if rounded as SQL does."""
    rows = [(1, "a", 0, -997.0), (2, "b", 0, -998.0), (3, "c", 0, -971.0), (400, "n", 1, None), *((i, "d", i % 3, -1000 + (i * 37 % 9000 + 0.5) * 2) for i in range(4, 400))]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    import duckdb

    from timberline.plans import catalogue

    catalogue.load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, folder)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall(), key=repr)


def test_diameter_classes_where_radii_are_ties(spark, tmp_path):
    same_as_sql(spark, suppliers(spark, tmp_path), "diameter_class")


def test_even_ground_cells_have_no_value_where_only_exact_medians_count(spark):
    p = spark.createDataFrame([(1, 0.1, 0.1, 1.0, 0), (2, 0.2, 0.2, 2.0, 0), (3, 0.7, 0.1, 5.0, 0)], "pid int, x double, y double, z double, label int")
    assert {(r.ix, r.iy): r.z for r in raster.ground_cells(p).collect()} == {(0, 0): 1.5, (1, 0): 5.0}
    assert {(r.ix, r.iy): r.z for r in raster.ground_cells(p, exact_only=True).collect()} == {(1, 0): 5.0}


def test_fill_grows_the_window_for_all_cells_and_refuses_no_ground(spark):
    rows = [(i, j, float(i + 10 * j) if i == 0 else None) for i in range(6) for j in range(2)]
    cells = spark.createDataFrame(rows, "ix long, iy long, z double")
    got = {(r.ix, r.iy): r.z for r in raster.fill(cells, cut).collect()}
    assert len(got) == 12 and None not in got.values()
    with pytest.raises(ValueError, match="no ground"):
        raster.fill(cells.withColumn("z", F.lit(None).cast("double")), cut)


def test_nearest_is_exact_for_scattered_points(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, 0.05, (60, 3)), rng.uniform(-20, 20, (60, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double")
    got = {}
    for r in spatial.nearest(df, df, 4, cut, exclude_self=True).collect():
        got.setdefault(r.id, {})[r.rank] = r.other
    for i in range(len(p)):
        d = ((p - p[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [got[i][k] for k in range(1, 5)] == list(np.argsort(d, kind="stable")[:4])
    few = spatial.nearest(df.where("id < 3"), df.where("id < 3"), 5, cut, exclude_self=True)
    assert few.count() == 6


def test_a_point_on_lattice_planes_is_in_27_boxes(spark):
    p = cloud(spark, [(1, 0.0, 0.0, 0.0), (2, 30.0, 30.0, 30.0), (3, 15.0, 15.0, 15.0), (4, 16.0, 16.0, 16.0)])
    n = {r.pid: r["count"] for r in spatial.boxes(p).groupBy("pid").count().collect()}
    assert n[3] == 27 and n[4] == 8
    assert spatial.boxes(p.limit(0)).count() == 0


def test_dbscan_border_points_and_numbers(spark):
    xs = [0.7, 0.8, 0.85, 0.9, 0.0, 0.05, 0.1, 0.2, 0.45, 5.0]
    p = spark.createDataFrame(list(enumerate(xs)), "id long, x double")
    got = {r.id: r.cluster for r in cluster.dbscan(p, 0.26, 4, cut, dims=("x",)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1, 8: 0, 9: -1}
    assert cluster.dbscan(p.limit(0), 0.26, 4, cut, dims=("x",)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    v = spark.range(n).select("id")
    e = spark.range(n - 1).where("id <> 149").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r.id: r.component for r in graph.connected_components(v, e, cut).collect()}
    assert all(got[i] == (0 if i < 150 else 150) for i in range(n))


def test_paths_ties_and_untouched_sources(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (5, 3, 2.0), (3, 4, 0.5)], "src long, dst long, length double")
    got = {r.id: (r.distance, r.base, r.pred) for r in graph.shortest_paths(e, spark.createDataFrame([(1,), (5,), (9,)], "id long"), cut).collect()}
    assert got == {1: (0, 1, None), 5: (0, 5, None), 2: (1, 1, 1), 3: (2, 1, 2), 4: (2.5, 1, 3)}


def test_a_round_of_neighbours_is_two_runs(spark):
    rows, runs, written = cut(cloud(spark, [(i, i / 10, 0.0, 0.0) for i in range(60)] + [(99, 500.0, 0.0, 0.0)], "id x y z"), "rows"), spark._jsparkSession.sharedState().statusStore(), []

    def counted(df, name):
        written.append(name)
        return cut(df, name)

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = runs.executionsCount()
    spatial.nearest(rows.where("id > 55"), rows, 2, counted)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert written.count("left") > 1
    assert runs.executionsCount() - before == len(written) + 3  # the extents of both sides, the densest cell


def test_a_round_of_a_graph_is_one_run(spark):
    chain = cut(spark.range(1, 40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("length")), "chain")
    runs, written = spark._jsparkSession.sharedState().statusStore(), []

    def counted(df, name):
        written.append(name)
        return cut(df, name)

    before = runs.executionsCount()
    labels = graph.connected_components(spark.range(1, 42), chain, counted)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert runs.executionsCount() - before == len(written) <= 10
    assert {r.id: r.component for r in labels.collect()} == {i: 1 if i < 41 else 41 for i in range(1, 42)}
    written.clear()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = runs.executionsCount()
    paths = graph.shortest_paths(chain.where("src < 10"), spark.range(1, 2), counted)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert runs.executionsCount() - before == len(written)
    assert {r.id: r.distance for r in paths.collect()} == {i: i - 1.0 for i in range(1, 11)}
    assert graph.connected_components(spark.range(0), chain.limit(0), cut).isEmpty()


def test_hull_keeps_what_is_outside():
    rng = np.random.default_rng(0)
    cube = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    p = np.concatenate([cube, rng.uniform(0.1, 0.9, (200, 3))])
    assert set(fit.hull(p)) == set(range(8))
    q = rng.normal(size=(300, 3))
    kept = set(fit.hull(q))
    for u in rng.normal(size=(50, 3)):
        assert int((q @ u).argmax()) in kept
    assert len(fit.hull(np.zeros((9, 3)))) == 9 and len(fit.hull(np.column_stack([q[:9, :2], np.zeros(9)]))) == 9


def test_cylinder_of_a_noisy_leaning_stem():
    rng = np.random.default_rng(3)
    t, z = rng.uniform(0, 2 * math.pi, 400), rng.uniform(0, 0.6, 400)
    p = np.column_stack([4 + 0.2 * np.cos(t) + 0.1 * z, 7 + 0.2 * np.sin(t), z]) + rng.normal(0, 0.002, (400, 3))
    p = np.concatenate([p, rng.uniform(-0.5, 0.5, (60, 3)) + [4, 7, 0.3]])
    radius, x, y, _, cv, n = fit.fit_stem(p, 100, 1)
    assert abs(radius - 0.2) < 0.01 and abs(x - 4.03) < 0.03 and abs(y - 7) < 0.02 and cv < 0.15 and n == 460
    assert math.isnan(fit.fit_stem(p[:40], 100, 1)[0]) and fit.fit_stem(p[:0], 9, 1)[5] == 0


def test_farthest_points():
    p = np.array([[0.0, 0, 0], [1, 0, 0], [10, 0, 0], [5, 0, 0]])
    assert list(fit.farthest(p, 3)) == [0, 2, 3]


def test_thinning_leaves_no_close_pair(spark):
    rng = np.random.default_rng(5)
    p = cloud(spark, [(i, *map(float, r)) for i, r in enumerate(rng.uniform(0, 1, (150, 3)))])
    rows = np.array([(r.x, r.y, r.z) for r in classify.thin(p, 0.15, 5, cut).collect()])
    d = ((rows[:, None] - rows[None]) ** 2).sum(axis=2) + np.eye(len(rows))
    assert d.min() >= 0.15**2 and classify.thin(p, 5.0, 100, cut).count() == 150


def test_network_gives_probabilities():
    q = classify.PointNetwork.random(0, shrink=64)(np.random.default_rng(0).uniform(0, 2, (120, 3)))
    assert q.shape == (120, 4) and np.allclose(q.sum(axis=1), 1)


def test_thinning_by_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(i, g, *map(float, r), 0.2 if g else 0.0) for g in (0, 1, 2) for i, r in enumerate(rng.uniform(0, 1 if g < 2 else 0.1, (60, 3)))]
    got = classify.thin(spark.createDataFrame(rows, "pid int, g int, x double, y double, z double, s double"), "s", 5, cut, by=["g"]).collect()
    by = {g: np.array([(r.x, r.y, r.z) for r in got if r.g == g]) for g in (0, 1, 2)}
    d = ((by[1][:, None] - by[1][None]) ** 2).sum(axis=2) + np.eye(len(by[1]))
    assert len(by[0]) == 60 == len(by[2]) and 5 <= len(by[1]) < 60 and d.min() >= 0.2**2


def test_augmented_boxes(spark):
    p = spark.range(4000).select((F.col("id") % 8).alias("bx"), F.lit(0).alias("by"), F.lit(0).alias("bz"), F.col("id").alias("pid"), *[E.unit("id", seed=i).alias(c) for i, c in enumerate("xyz")], F.lit(3).alias("label"))
    got = {r.bx: r.n for r in classify.augment(p, 3, cut, least=100).groupBy("bx").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(got) == 8 and all(100 <= n <= 500 for n in got.values()) and sum(n > 450 for n in got.values()) >= 4
    whole = classify.augment(p, 3, cut, least=500)  # boxes of no more than `least` points lose none
    assert whole.count() == 4000 and whole.select("x").join(p.select("x"), "x", "left_semi").count() == 0


def test_network_layers_are_normalised(spark, tmp_path):
    rng = np.random.default_rng(2)
    net = classify.PointNetwork.random(2, shrink=128)
    plain = net(rng.uniform(0, 1, (50, 3)))
    for name in [k for k in net.w if k.endswith(".w") and k != "head.1.w"]:
        n = net.w[name].shape[1]
        net.w |= {name[:-1] + k: v for k, v in zip(classify.NORM, (rng.normal(size=n), rng.uniform(0.5, 2, n), rng.normal(size=n), rng.normal(size=n)), strict=True)}
    (tmp_path / "net.npz").write_bytes(net.to_npz())
    again = classify.PointNetwork.load(spark, f"file://{tmp_path}/net.npz")
    assert again.w.keys() == net.w.keys()
    w, x = again.w, rng.normal(size=(5, 3))
    norm = lambda layer, v: (v - w[f"{layer}.mean"]) / np.sqrt(w[f"{layer}.var"] + 1e-5) * w[f"{layer}.scale"] + w[f"{layer}.shift"]
    want = x
    for i in range(3):
        want = norm(f"sa1.{i}", np.maximum(want @ w[f"sa1.{i}.w"] + w[f"sa1.{i}.b"], 0))
    assert np.allclose(again._layers("sa1", x), want)
    h = rng.normal(size=(5, w["head.0.w"].shape[0]))
    want = np.maximum(norm("head.0", h @ w["head.0.w"] + w["head.0.b"]), 0) @ w["head.1.w"] + w["head.1.b"]
    assert np.allclose(again._layers("head", h), want) and plain.shape == (50, 4)
    q = again(rng.uniform(0, 1, (50, 3)))
    assert np.allclose(q.sum(axis=1), 1)


def test_neighbours_where_half_the_points_are_in_one_place(spark):
    rng = np.random.default_rng(21)
    p = np.concatenate([rng.uniform(0, 100, (1500, 3)), 50 + rng.uniform(0, 0.05, (1500, 3))])
    rows = cloud(spark, [(i, *map(float, r)) for i, r in enumerate(p)], "id x y z")
    got = spatial.nearest(rows, rows, 4, cut, exclude_self=True).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other"))).alias("n")).collect()
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2) + np.diag(np.full(len(p), np.inf))
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert len(got) == 3000 and all([x.other for x in r.n] == want[r.id].tolist() for r in got)


def test_terrain_is_filled_over_a_wide_gap(spark):
    known = {(0, 0): 1.0, (1, 0): 2.0, (11, 6): 5.0, (0, 6): 3.0}
    cells = spark.createDataFrame([(x, y, known.get((x, y))) for x in range(12) for y in range(7)], "ix long, iy long, z double")
    got = {(r.ix, r.iy): r.z for r in raster.fill(cells, cut).collect()}

    def focal(size):
        mirror = lambda i, n: (i % (2 * n)) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
        h = size // 2
        out = {}
        for x in range(12):
            for y in range(7):
                v = [known[c] for a in range(-h, h + 1) for b in range(-h, h + 1) if (c := (mirror(x + a, 12), mirror(y + b, 7))) in known]
                out[x, y] = float(np.median(v)) if v else None
        return out

    size = 3
    while None in focal(size).values():
        size += 2
    assert size > 5 and got == focal(size)


def test_trees_of_a_tile_with_its_buffer(spark, tmp_path):
    f = forest(spark, 2, ground=5, stem=1300, leaves=150).withColumn("label", F.col("true_label")).withColumn("n_z", F.col("z") - 0.05 * F.col("x"))
    f = cut(f.withColumn("tile", F.when(F.col("x") < 4, 1).otherwise(2)))
    clouds = cut(pipelines.tile_clouds(f, 8, 5.0))
    assert {(r.tile, r.buffer) for r in clouds.select("tile", "buffer").distinct().collect()} == {(1, False), (1, True), (2, False), (2, True)}
    p = Instance(edge_length=0.5, wood_neighbours=40, leaf_height=1.0)
    held, trees = pipelines.instance(clouds.where("tile = 1").drop("tile"), p, leaves=True)
    held, trees = cut(held), cut(trees)
    assert trees.count() == 1 and held.where("wood").select("x").where("x > 4").count() == 0 and held.where("NOT wood").count() > 0
    pipelines.tree_files(held, trees, f"file://{tmp_path}/out", 1, classes=True)
    from timberline.sources.readers import read_points

    read = read_points(spark, f"file://{tmp_path}/out/trees.ply/*/*.ply")
    n = {r.file.rsplit("/", 1)[-1]: r.n for r in read.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"001_T0.leafoff.ply": held.where("wood").count(), "001_T0.leafon.ply": held.count()}


def test_trees_are_found_and_told_apart(spark):
    f = cut(forest(spark, 2, ground=5, stem=1300, leaves=150).withColumn("label", F.col("true_label")).withColumn("n_z", F.col("z") - 0.05 * F.col("x")))
    held, trees = pipelines.instance(f, Instance(edge_length=0.5, wood_neighbours=40))
    rows = held.join(f.select("pid", "true_tree"), "pid").groupBy("true_tree", "t_clstr").count().collect()
    assert sum(r["count"] for r in rows) > 0.97 * 2 * 1300 * 4 and len({r.t_clstr for r in rows}) == 2 == len(rows)
    want = sorted(spark.range(2).select(radius_of(F.col("id"))).toPandas().iloc[:, 0], reverse=True)
    assert np.allclose([r.radius for r in trees.orderBy("number").collect()], want, rtol=0.05)
    none, no_trees = pipelines.instance(f.where("label <> 3"), Instance())
    assert none.count() == 0 == no_trees.count()


def test_trees_are_numbered_as_sql_rounds_their_radii(spark, tmp_path):
    same_as_sql(spark, suppliers(spark, tmp_path), "tree_numbering")


def test_many_stems_are_fitted_together(spark):
    """Some 200 sparse stems take seconds (one sample at a time, they took over a minute), are the same as each by itself, and are whole where a batch ends within them."""
    import time

    rng = np.random.default_rng(3)
    turn, height, radius = rng.uniform(0, 2 * np.pi, (200, 70)), rng.uniform(0, 0.5, (200, 70)), np.linspace(0.1, 0.3, 200)[:, None] + rng.normal(0, 0.005, (200, 70))
    clouds = [np.stack([r * np.cos(t) + i, r * np.sin(t), h], axis=1) for i, (r, t, h) in enumerate(zip(radius, turn, height, strict=True))]
    began = time.process_time()
    stems = fit.fit_stems([*clouds, clouds[0][:20], clouds[0][:0]], 100, range(202))
    assert time.process_time() - began < 25
    assert np.allclose([s[0] for s in stems[:200]], np.linspace(0.1, 0.3, 200), rtol=0.05)
    assert math.isnan(stems[200][0]) and stems[200][4:] == (math.inf, 20) and stems[201][4:] == (math.inf, 0)
    assert np.allclose(fit.fit_stem(clouds[7], 100, 7), stems[7], rtol=1e-9)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    try:
        p = spark.createDataFrame([(i, *map(float, r)) for i in range(0, 200, 10) for r in clouds[i]], "tree int, x double, y double, z double")
        got = {r.tree: r for r in fit.fit_cylinders(p, "tree", 20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(got) == 20 and all(r.cnt == 70 for r in got.values())
    assert np.allclose([got[i].radius for i in range(0, 200, 10)], np.linspace(0.1, 0.3, 200)[::10], rtol=0.06)


def test_training_describes_its_points_once(spark, monkeypatch):
    described, plain = [], classify.features
    monkeypatch.setattr(classify, "features", lambda *a: described.append(1) or plain(*a))
    rng = np.random.default_rng(5)
    p = spark.createDataFrame([(i, float(x), float(y), float(z), 0 if z < 1 else 1) for i, (x, y, z) in enumerate(rng.uniform(0, 2, (150, 3)))], "pid long, x double, y double, z double, label int")
    _, history = pipelines.train(p, Training(min_points=20, trees=3, depth=3, neighbours=6))
    row = history.first()
    assert len(described) == 1 and row.epoch == 1 and row.acc > 0.5


def test_a_forest_of_two_classes_is_sent_after_an_observed_run(spark):
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.max("id").alias("most")).collect()
    rows = spark.createDataFrame([(i, *[float(i % 2 + k) for k in range(6)], i % 2) for i in range(40)], ["pid", *classify.FEATURES, "label"])
    got = classify.probabilities(rows, classify.fit_forest(rows, trees=3, depth=2)).collect()
    assert seen.get["most"] == 2 and len(got) == 40 and all((r.p_leaf > 0.5) == (r.pid % 2 == 1) for r in got)


def test_a_cut_gives_back_what_the_driver_has_freed(spark):
    import time

    from timberline.plans import tables

    memory = spark._jvm.java.lang.Runtime.getRuntime()
    held = [spark._jvm.java.nio.ByteBuffer.allocate(256 << 20) for _ in range(5)]
    grown = memory.totalMemory()
    del held
    time.sleep(3)  # the gateway lets go of them once a second
    rows = cut(spark.range(3))
    assert memory.totalMemory() < grown - (400 << 20)
    assert tables.trim_native(spark) and sorted(r.id for r in rows.collect()) == [0, 1, 2]
