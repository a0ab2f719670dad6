import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelake.operators import clouds as C
from capturelake.operators import meshes as M
from capturelake.operators.nearest import nearest_attribute
from capturelake.operators.scale import measure
from capturelake.plans.point_clouds import QUERIES, rounded


def cloud(spark, n=90, seed=3, far=4):
    rnd = np.random.default_rng(seed)
    rows = []
    for k in (1, 2):
        pts = rnd.normal(size=(n // k, 3))
        pts[:far] *= 40
        rows += [(k, i, *map(float, p)) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "cloud_id long, idx long, x double, y double, z double")


def kept(df):
    return sorted((r.cloud_id, r.idx) for r in df.collect())


def by_cloud(df):
    frame = df.toPandas().sort_values(["cloud_id", "idx"])
    return {k: g[["x", "y", "z"]].to_numpy() for k, g in frame.groupby("cloud_id")}


def test_mad_filter(spark):
    df = cloud(spark)
    want = []
    for k, p in by_cloud(df).items():
        d = np.linalg.norm(p - np.median(p, axis=0), axis=1)
        mad = np.median(np.abs(d - np.median(d)))
        limit = min(np.percentile(d, 95), np.median(d) + 3.5 * max(mad, 1e-6))
        want += [(k, i) for i in np.nonzero(d <= limit)[0]]
    for hot in (10**6, 20):
        assert kept(C.filter_outliers_mad(df, 30, hot_rows=hot)) == want
    assert len(want) < df.count()


def test_iqr_filter(spark):
    df = cloud(spark)
    want = []
    for k, p in by_cloud(df).items():
        d = np.linalg.norm(p - np.median(p, axis=0), axis=1)
        q1, q3 = np.percentile(d, [25, 75])
        idx = np.nonzero(d <= q3 + 1.5 * max(q3 - q1, 1e-9))[0]
        q = p[idx]
        mad = np.median(np.abs(q - np.median(q, axis=0)), axis=0) + 1e-9
        ok = (np.abs((q - np.median(q, axis=0)) / (1.4826 * mad)) <= 3.5).all(axis=1)
        want += [(k, i) for i in (idx[ok] if ok.sum() >= 8 else idx)]
    for hot in (10**6, 20):
        assert kept(C.filter_outliers_iqr(df, 20, 8, hot_rows=hot)) == want
    assert len(want) < df.count()


def test_small_clouds_stay_whole(spark):
    df = cloud(spark, n=16)
    for f in (C.filter_outliers_mad, C.filter_outliers_iqr, C.trim_quantiles):
        assert kept(f(df, min_points=17)) == kept(df)
        assert len(kept(f(df))) < df.count()
    assert kept(C.voxel_downsample(df, 100.0, min_points=16)) == kept(df)
    assert len(kept(C.voxel_downsample(df, 100.0))) < df.count()


def test_normalised_bounds(spark):
    df = C.normalize_cloud(cloud(spark))
    for p in by_cloud(df).values():
        assert np.isclose(np.abs(p).max(), 1.0) and np.allclose(p.min(axis=0) + p.max(axis=0), 0.0)


def test_nearest_point_is_exact(spark):
    """Spread points, a dense clump of them and copies of one position."""
    spread = cloud(spark, n=300, seed=5)
    clump = cloud(spark, n=300, seed=7).select("cloud_id", (F.col("idx") + 1000).alias("idx"), *[
        (F.col(a) / 1e4 + 0.3).alias(a) for a in "xyz"])
    copies = spread.filter("idx < 3").select("cloud_id", (F.col("idx") + 5000).alias("idx"), "x", "y", "z")
    pts = spread.unionByName(clump).unionByName(copies).withColumn("r", F.col("idx").cast("int"))
    vertices = cloud(spark, n=80, seed=6).withColumnRenamed("idx", "v_idx")
    got = {(r.cloud_id, r.v_idx): (r.idx, r.r) for r in nearest_attribute(vertices, pts, ["r"]).collect()}
    p = by_cloud(pts)
    names = {k: g.sort_values("idx").idx.tolist() for k, g in pts.toPandas().groupby("cloud_id")}
    for k, v in by_cloud(vertices.withColumnRenamed("v_idx", "idx")).items():
        best = ((v[:, None] - p[k][None]) ** 2).sum(axis=2).argmin(axis=1)
        assert [got[k, i] for i in range(len(v))] == [(names[k][b], names[k][b]) for b in best]


CORNERS = [(x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)]
SIDES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def cube(spark):
    v = spark.createDataFrame([(1, i, *p) for i, p in enumerate(CORNERS)], "cloud_id long, v_idx long, x double, y double, z double")
    f = spark.createDataFrame([(1, i, *t) for i, t in enumerate(SIDES)], "cloud_id long, f_idx long, a long, b long, c long")
    return v, f


def test_cube_diagnostics(spark):
    v, f = cube(spark)
    r = M.mesh_diagnostics(v, f).first()
    assert (r.mesh_volume, r.mesh_surface_area, r.is_watertight, r.mesh_volume_to_bbox_volume_ratio) == (8.0, 24.0, True, 1.0)
    assert M.mesh_diagnostics(v, f.filter("f_idx > 0")).first().is_watertight is False


def test_cube_faces_by_side(spark):
    v, f = cube(spark)
    groups = {r.face_group: r.faces for r in M.face_group_counts(M.face_groups(f, v)).collect()}
    assert groups == dict.fromkeys(("front", "back", "left", "right", "top", "bottom"), 2)
    hot = M.with_corners(f, v, hot_rows=2).orderBy("f_idx").collect()
    assert hot == M.with_corners(f, v).select(hot[0].__fields__).orderBy("f_idx").collect()


def test_a_cloud_of_one_point_stays_one_point(spark):
    df = spark.createDataFrame([(7, 0, 1.0, 2.0, 3.0)], "cloud_id long, idx long, x double, y double, z double")
    v = C.ordered_vertices(df)
    assert [tuple(r) for r in v.collect()] == [(7, 0, 1.0, 2.0, 3.0)]
    assert C.fan_faces(v).count() == 0


def test_midpoints_stand_behind_all_points(spark):
    rows = [(k, i, float(i), 0.0, 1.0, 10 * k + (i > 0)) for k, n in ((1, 5), (2, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "cloud_id long, idx long, x double, y double, z double, r int")
    got = sorted(map(tuple, C.densify_midpoints(df, 4, 100).collect()))
    assert got == sorted(rows + [(1, 5 + i, i + 0.5, 0.0, 1.0, 10) for i in range(4)])


@pytest.mark.parametrize("hot", [10**6, 10])
def test_fan_covers_the_cloud(spark, hot):
    v = C.ordered_vertices(cloud(spark), hot_rows=hot)
    faces = {r.cloud_id: r["count"] for r in C.fan_faces(v, hot).groupBy("cloud_id").count().collect()}
    assert faces == {1: 88, 2: 43}


def test_depth_from_sparse_points(spark):
    rows = [(1, i, 1.2 * (i % 2), 1.0 * (i % 3 == 0), 1.1 * (i % 5 == 0)) for i in range(20)]
    df = spark.createDataFrame(rows, "cloud_id long, idx long, x double, y double, z double")
    assert round(C.depth_ratio(df).first().depth_ratio, 4) == 0.9167


def test_nearest_point_in_a_hot_cloud(spark):
    """One cloud holds nine tenths of all rows over many partitions; vertices lie in it, far outside, and in clouds without points."""
    rnd = np.random.default_rng(8)
    hot, small = np.round(rnd.normal(size=(2_700, 3)), 2), rnd.normal(size=(300, 3))
    rows = [(1, i, *map(float, p)) for i, p in enumerate(hot)] + [(2 + i % 3, i, *map(float, p)) for i, p in enumerate(small)]
    pts = spark.createDataFrame(rows, "cloud_id long, idx long, x double, y double, z double").withColumn("r", F.col("idx") * 2)
    wanted = np.concatenate([np.round(rnd.normal(size=(250, 3)), 2), rnd.normal(size=(50, 3)) * 500, [[1e6, 0, 0]] * 4, hot[:40]])
    corners = [(1, i, *map(float, p)) for i, p in enumerate(wanted)] + [(9, 1, 0.0, 0.0, 0.0), (2, 7, 0.1, 0.1, 0.1), (3, 8, None, 0.1, 0.1)]
    vertices = spark.createDataFrame(corners, "cloud_id long, v_idx long, x double, y double, z double")
    got = {(r.cloud_id, r.v_idx): r for r in nearest_attribute(vertices, pts, ["r"]).collect()}
    places = by_cloud(pts)
    names = {k: g.sort_values("idx").idx.tolist() for k, g in pts.toPandas().groupby("cloud_id")}
    assert set(got) == {(k, i) for k, i, x, *_ in corners if k != 9 and x is not None}
    for k, i, *v in corners:
        if (k, i) in got:
            d2 = ((places[k] - np.array(v)) ** 2 @ np.ones(3))
            d = places[k] - np.array(v)
            d2 = d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2
            best = names[k][int(d2.argmin())]
            assert (got[k, i].idx, got[k, i].r) == (best, 2 * best) and abs(got[k, i].distance - d2.min() ** 0.5) < 1e-9
    assert nearest_attribute(vertices.limit(0), pts, ["r"]).count() == 0
    assert nearest_attribute(vertices, pts.limit(0), ["r"]).count() == 0


def test_few_colours_for_many_vertices(spark):
    sizes, colours = {1: 500, 2: 7, 3: 40, 4: 1}, {1: 1, 2: 3, 3: 60, 4: 2}
    v = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)] + [(9, 0)], "cloud_id bigint, v_idx bigint")
    p = spark.createDataFrame([(k, i, 10 * k + i) for k, n in colours.items() for i in range(n)], "cloud_id bigint, c_idx bigint, r bigint")
    cyclic = {(k, i): 10 * k + i % colours[k] for k, n in sizes.items() for i in range(n)} | {(9, 0): None}
    spread = {(k, i): 10 * k + i * (colours[k] - 1) // max(n - 1, 1) for k, n in sizes.items() for i in range(n)} | {(9, 0): None}
    for hot in (2, 20, 1_000_000):
        for assign, want in ((C.cyclic_assign, cyclic), (C.linspace_assign, spread)):
            got = assign(v, p, hot_rows=hot)
            assert got.columns == assign(v, p).columns
            rows = got.collect()
            assert len(rows) == len(want) and {(r["cloud_id"], r["v_idx"]): r["r"] for r in rows} == want


def test_larger_meshes_take_more_tasks(spark, monkeypatch):
    rows = [(cloud, i, float(np.cos(i)) * (i + 1), float(np.sin(i)) * (i + 2), float(i % 3)) for cloud in (1, 2) for i in range(40)]
    vertices = spark.createDataFrame(rows, "cloud_id int, v_idx bigint, x double, y double, z double")
    faces = spark.createDataFrame([(cloud, i, 0, i + 1, i + 2) for cloud in (1, 2) for i in range(38)],
                                  "cloud_id int, f_idx bigint, a bigint, b bigint, c bigint")
    whole = sorted(map(tuple, rounded(M.mesh_diagnostics(vertices, faces), 5).collect()))
    monkeypatch.setattr(M, "TASK_ROWS", 6)
    for made in (M.with_corners(faces, vertices), M.watertight(faces)):
        assert ", 38)" in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rounded(M.mesh_diagnostics(vertices, faces), 5).collect())) == whole


def test_nearest_point_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pts = cloud(spark).withColumn("r", F.col("idx"))
    points = pts.mapInArrow(counted, pts.schema)
    vertices = pts.select("cloud_id", F.col("idx").alias("v_idx"), "x", "y", "z")
    got = nearest_attribute(vertices, points, ["r"]).collect()
    assert len(got) == 135 and all(r.idx == r.v_idx == r.r and r.distance == 0 for r in got)
    assert read.value == 135


def test_nearest_points_of_whole_clouds(spark):
    """Clouds that meet in a group of their own give what dealt ones give: ties, copies, places outside, nulls and clouds without partner."""
    rnd = np.random.default_rng(4)
    rows = [(k, i, *map(float, np.round(p, 1)), 3 * i) for k in range(5) for i, p in enumerate(rnd.normal(size=(200, 3)))]
    rows += [(1, 900, None, 0.0, 0.0, 1), (None, 1, 0.0, 0.0, 0.0, 1)]
    points = spark.createDataFrame(rows, "cloud_id long, idx long, x double, y double, z double, r int")
    asked = [(k, i, *map(float, np.round(p, 1))) for k in range(7) for i, p in enumerate(rnd.normal(size=(60, 3)) * (1 + 50 * (k == 2)))]
    vertices = spark.createDataFrame([*asked, (1, 99, 0.0, None, 0.0), (None, 5, 0.0, 0.0, 0.0)], "cloud_id long, v_idx long, x double, y double, z double")
    dealt = nearest_attribute(vertices, points, ["r"])
    whole = nearest_attribute(vertices, points, ["r"], shape=measure(points, ["cloud_id"]))
    assert whole.schema.simpleString() == dealt.schema.simpleString() and "CoGroups" in whole._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, whole.collect()))
    assert len(got) == 300 and got == sorted(map(tuple, dealt.collect()))


@pytest.mark.parametrize("query", ["nearest_attribute", "paint_face_groups"])
def test_points_are_shuffled_once_and_not_stored(spark, query):
    df = QUERIES[query](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ExistingRDD" not in final
    assert len(set(re.findall(r"Exchange hashpartitioning\(.*?plan_id=(\d+)", final))) == 1 and "ReusedExchange" in final


def test_corners_met_by_mesh_or_by_corner(spark, monkeypatch):
    rows = [(cloud, i, float(i), float(i * i), float(-i)) for cloud in (1, 2, 3) for i in range(12)]
    vertices = spark.createDataFrame([*rows, (None, 0, 0.0, 0.0, 0.0), (4, 0, 1.0, 1.0, 1.0)], "cloud_id int, v_idx bigint, x double, y double, z double")
    faces = spark.createDataFrame(
        [(cloud, i, 0, i + 1, i + 2) for cloud in (1, 2) for i in range(10)] + [(2, 90, 5, 6, 77), (3, 91, 70, 71, 72), (None, 92, 0, 1, 2), (4, 93, 0, 0, None)],
        "cloud_id int, f_idx bigint, a bigint, b bigint, c bigint")
    palette = spark.createDataFrame([(1, 0, 1, 2, 3), (1, 4, 4, 5, 6), (2, 1, 7, 8, 9)], "cloud_id int, slot bigint, r int, g int, b int")

    def results():
        return [sorted(map(str, df.collect())) for df in (
            M.with_corners(faces, vertices), M.paint_face_groups(M.face_groups(faces, vertices), palette))]

    met = results()
    monkeypatch.setattr(M, "TASK_ROWS", 6)
    assert met == results() and len(met[0]) == 22
