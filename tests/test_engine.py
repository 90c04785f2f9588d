import math

import numpy as np
import pytest

from gridloom.functions.params import MapParams
from gridloom.operators import clouds, fold, heightmap, maps, ndt, spatial
from gridloom.operators.walk import walk
from gridloom.sources import files, generators
from gridloom.sources import rays as sources

RAY = "seq long, ox double, oy double, oz double, sx double, sy double, sz double"


def rays(spark, rows, extra="", values=()):
    return spark.createDataFrame([(i, *map(float, r), *values) for i, r in enumerate(rows)], RAY + extra)


def at(df, *g):
    return df.where(f"gx = {g[0]} and gy = {g[1]} and gz = {g[2]}").collect()


def test_one_hit_and_one_miss(spark):
    p = MapParams()
    got = fold.occupancy(walk(rays(spark, [(0.05, 0.05, 0.05, 0.25, 0.05, 0.05)])), p)
    first, last = (at(got, g, 16, 16)[0]["occupancy"] for g in (16, 18))
    assert last == pytest.approx(p.hit) and first == pytest.approx(p.miss)


def test_clamps_and_order(spark):
    p = MapParams()
    one = (0.05, 0.05, 0.05, 0.05, 0.05, 0.05)
    through = (0.05, 0.05, 0.05, 0.15, 0.05, 0.05)
    got = fold.occupancy(walk(rays(spark, [one] * 5 + [through] * 2)), p)
    value = np.float32(0)
    for h in [True] * 5 + [False] * 2:
        value = min(np.float32(value + np.float32(p.hit)), np.float32(p.high)) if h else max(np.float32(value + np.float32(p.miss)), np.float32(p.low))
    assert np.float32(at(got, 16, 16, 16)[0]["occupancy"]) == value
    chunks = fold.occupancy_by_chunks(walk(rays(spark, [one] * 5 + [through] * 2)), p, chunk=2)
    assert at(chunks, 16, 16, 16)[0]["occupancy"] == pytest.approx(float(value), abs=1e-5)


def test_traversal_of_diagonals(spark):
    p = MapParams(origin=(-0.05, -0.05, -0.05))
    for d, want in (((1, 0, 0), 0.1), ((1, 1, 0), 0.1 * math.sqrt(2)), ((1, 1, 1), 0.1 * math.sqrt(3))):
        visits = walk(rays(spark, [(*(-x for x in d), *d)]), p)
        g = walk(rays(spark, [(0, 0, 0, 0, 0, 0)]), p).collect()[0]
        assert at(fold.traversal(visits), g["gx"], g["gy"], g["gz"])[0]["traversal"] == pytest.approx(want, abs=1e-3)


def test_secondary_statistics(spark):
    df = rays(spark, [(0.1 * i, 0, 0, 1, 0, 0) for i in range(10)], ", return_number int", (1,))
    row = fold.secondary(df).collect()[0]
    assert row["n"] == 10 and row["range_mean"] == pytest.approx(0.55, abs=1e-2) and row["range_std"] == pytest.approx(np.std([1 - 0.1 * i for i in range(10)]), abs=1e-2)


def test_rays_query_ranges(spark):
    ends = [(2, 0, 0), (0, 2, 0), (-2, 0, 0)]
    m = fold.occupancy(walk(rays(spark, [(0.05, 0.05, 0.05, *(x + 0.05 for x in e)) for e in ends])))
    got = {r["seq"]: r for r in spatial.rays_query(rays(spark, [(0.05, 0.05, 0.05, *(1.2 * x + 0.05 for x in e)) for e in ends] + [(0.05, 0.05, 0.05, 0.05, 0.05, 1.0)]), m).collect()}
    for i in range(3):
        assert got[i]["terminal_type"] == 1 and got[i]["range"] == pytest.approx(1.95, abs=1e-5) and got[i]["unobserved_volume"] == 0
    assert got[3]["terminal_type"] == -1 and got[3]["unobserved_volume"] > 0.8


def test_line_and_neighbour_queries(spark):
    solid = spark.createDataFrame([(16, 16, 16, 2.0), (20, 16, 16, -1.0)], "gx int, gy int, gz int, occupancy float")
    near = spatial.line_query(rays(spark, [(-2, 0.05, 0.05, 2, 0.05, 0.05)]), solid, radius=2.0, nearest_only=True).collect()
    assert [(r["gx"], r["clearance"]) for r in near] == [(16, 0.0)]
    points = spark.createDataFrame([(1, 0.05, 0.05, 0.35), (2, 5.0, 5.0, 5.0)], "seq long, x double, y double, z double")
    assert [(r["seq"], r["gz"], round(r["range"], 6)) for r in spatial.nearest_neighbours(points, solid, radius=0.5).collect()] == [(1, 16, 0.3)]
    assert {r["gx"]: round(r["clearance"], 6) for r in spatial.clearance(solid, radius=0.5).collect()} == {16: 0.0, 20: 0.4}
    assert spatial.filter_cloud(points, solid).count() == 0


def test_clipping(spark):
    df = rays(spark, [(0, 0, 0, 4, 0, 0), (0, 0, 0, 1, 0, 0), (5, 5, 5, 6, 6, 6)])
    assert [r["sx"] for r in sources.clip_length(df, 2.0).orderBy("seq").collect()] == [2.0, 1.0, pytest.approx(5 + 1)]
    boxed = sources.clip_box(df, ((-1, -1, -1), (2, 1, 1))).orderBy("seq").collect()
    assert [(r["sx"], r["clipped_end"]) for r in boxed] == [(2.0, True), (1.0, False), (6.0, False)]
    assert sources.split_long(df, 1.5).where("seq = 0").count() == 3
    assert sources.filter_good(rays(spark, [(0, 0, 0, float("inf"), 0, 0), (0, 0, 0, 1, 0, 0)])).count() == 1


def test_trajectory_interpolates_over_buckets(spark):
    path = spark.createDataFrame([(float(t), t * 0.5, t * 0.25, 0.5) for t in (0, 10, 200, 210)], "ts double, x double, y double, z double")
    points = spark.createDataFrame([(1, 5.0), (2, 100.0), (3, 205.0), (4, 400.0), (5, 10.0)], "seq long, ts double")
    got = {r["seq"]: r for r in sources.attach_trajectory(points, path, bucket_s=15.0).collect()}
    for seq, ts in ((1, 5), (2, 100), (3, 205), (5, 10)):
        assert got[seq]["sensor_x"] == pytest.approx(ts * 0.5, abs=1e-12) and got[seq]["sensor_y"] == pytest.approx(ts * 0.25, abs=1e-12)
    assert got[4]["sensor_x"] == 0.0 and len(got) == 5


def test_rotation(spark):
    p = spark.createDataFrame([(1.0, 0.0, 0.0)], "x double, y double, z double")
    r = sources.transform_points(p, (math.sqrt(0.5), 0.0, 0.0, math.sqrt(0.5)), 2.0, (0.0, 0.0, 1.0)).collect()[0]
    assert (r["x"], r["y"], r["z"]) == (pytest.approx(0), pytest.approx(2), pytest.approx(1))


def test_merge_submap_compare(spark):
    a = spark.createDataFrame([(0, 0, 0, 1.0), (40, 0, 0, 1.0)], "gx int, gy int, gz int, occupancy float")
    b = spark.createDataFrame([(1, 0, 0, -1.0)], "gx int, gy int, gz int, occupancy float")
    assert sorted(r["gx"] for r in maps.merge(a, b).collect()) == [1, 40]
    assert [r["gx"] for r in maps.submap(a, ((2.0, -1, -1), (3.0, 1, 1))).collect()] == [40]
    assert maps.compare(a, a, 0.0).collect()[0].asDict() == {"same": 2, "different": 0, "missing": 0}
    assert maps.compare(a, b, 0.0).collect()[0]["missing"] == 2
    assert maps.layout_match(a, b) == "exact" and maps.layout_match(a, a.select("gy", "gx", "gz", "occupancy")) == "equivalent" and maps.shared_layers(a, b) == ["occupancy"]
    assert maps.layout_match(a, a.drop("gz")) == "different" and maps.filter_layers(a, []).columns == ["gx", "gy", "gz"]


def test_heightmap_of_a_room(spark):
    room = generators.box_room(spark, (10, 8), 12).selectExpr("*", "CAST(1 AS FLOAT) AS occupancy")
    got = heightmap.planar(room, clearance=0.5).where("abs(gx) < 10 and abs(gy) < 8").collect()
    assert len(got) == 19 * 15 and {r["gz"] for r in got} == {0} and all(r["clearance"] == pytest.approx(1.1) for r in got)
    assert heightmap.layered(room).where("gx = 0 and gy = 0").count() == 2
    flat = heightmap.planar(room, ceiling=0.05 - 1.6)
    assert heightmap.fill(flat, (0, 0), 0.1).count() == flat.count()
    assert heightmap.mesh(flat).count() == 2 * 20 * 16
    assert heightmap.fill(flat, (99, 99), 0.1).count() == 0


def test_generators(spark):
    assert generators.empty_space(spark, (0, 0, 0), (1, 2, 3), -0.2).count() == 24
    assert generators.slope(spark, (2, 1), 0.5).where("gx = 2").select("gz").distinct().collect()[0][0] == 1
    assert generators.wall(spark, 2, 3, 5).count() == 20
    far = generators.cone(spark, 60, 5, 36, 2.0).selectExpr("max(sqrt(x*x+y*y+z*z)) AS m").collect()[0]["m"]
    assert far == pytest.approx(2.0)


def test_distributions(spark):
    rng = np.random.default_rng(1)
    s = np.array([0.5, 0.5, 0.5]) + rng.normal(size=(400, 3)) * [0.1, 0.05, 0.01]
    df = spark.createDataFrame([(i, 0.5, 0.5, 3.0, *map(float, x), 1.0) for i, x in enumerate(s)], RAY + ", intensity double")
    p = MapParams(resolution=2.0, origin=(-1.0, -1.0, -1.0))
    visits = walk(df, p, keep=("ox", "oy", "oz", "sx", "sy", "sz", "intensity"))
    m = ndt.moments(visits)
    row = m.orderBy("n", ascending=False).collect()[0]
    assert row["n"] == 400 and row["cxx"] == pytest.approx(np.cov(s.T, bias=True)[0, 0])
    e = ndt.eigen(m).orderBy("n", ascending=False).collect()[0]
    assert abs(e["nz"]) > 0.99 and e["l0"] < e["l1"] < e["l2"]
    assert ndt.integrate(visits, p).orderBy("n_samples", ascending=False).collect()[0]["n_samples"] == 400
    points = spark.createDataFrame([(0.5, 0.5, 0.5), (0.5, 0.5, 0.9)], "x double, y double, z double")
    assert ndt.inside_ellipsoid(points, m, p).count() == 1


def test_exports(spark, tmp_path):
    m = fold.occupancy(walk(rays(spark, [(0, 0, 0, 1, 1, 1), (0, 0, 0, -1, 0, 0)])))
    assert clouds.positions(m).count() == 2 and clouds.cubes(m).count() == 16
    colours = clouds.coloured_by_height(m, MapParams(), 0.0, 1.0).orderBy("gz").collect()
    assert (colours[0]["r"], colours[-1]["b"]) == (1.0, 1.0)
    at_centres = clouds.positions(m)
    assert files.write_ply(at_centres, str(tmp_path / "cloud")) == 2
    back = files.read_points(spark, str(tmp_path / "cloud/*.ply"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, at_centres.select("x", "y", "z").collect()))
    files.save_map(m, str(tmp_path / "map"), MapParams(), {"note": "x"})
    voxels, params, info = files.load_map(spark, str(tmp_path / "map"))
    assert params == MapParams() and info == {"note": "x"} and sorted(map(tuple, voxels.collect())) == sorted(map(tuple, m.collect()))


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("X Y Z GPS_Time red\n1 2 3 0.5 9\n4 5 6 0.75 9\nbroken line\n")
    assert sorted(map(tuple, files.read_points(spark, str(tmp_path / "a.xyz")).collect())) == [(0.5, 1, 2, 3), (0.75, 4, 5, 6)]
    (tmp_path / "b.txt").write_text("%time x y z qw\n0 1 2 3 1\n1 2 3\n2 1 1 1 0 0 0 1\n")
    assert sorted(r["ts"] for r in files.read_points(spark, str(tmp_path / "b.txt")).collect()) == [0, 2]
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float X\nproperty float y\nproperty float z\nproperty double Timestamp\nend_header\n1 2 3 4\n5 6 7 8\n")
    got = files.read_points(spark, str(tmp_path / "c.ply"))
    assert got.columns == ["x", "y", "z", "ts"] and got.count() == 2
    (tmp_path / "d.xyz").write_text("x y z\n1 2 3\n")
    with pytest.raises(ValueError):
        files.read_xyz(spark, str(tmp_path / "d.xyz"))


def test_poses_and_motion_batches(spark):
    half = math.sqrt(0.5)
    path = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (10.0, 1.0, 0.0, 0.0, half, 0.0, 0.0, half)], "ts double, x double, y double, z double, qw double, qx double, qy double, qz double")
    points = spark.createDataFrame([(1, 5.0, 1.0, 0.0, 0.0), (2, 99.0, 1.0, 0.0, 0.0)], "seq long, ts double, x double, y double, z double")
    got = {r["seq"]: r for r in sources.attach_pose(points, path).collect()}
    assert got[1]["wx"] == pytest.approx(0.5 + half) and got[1]["wy"] == pytest.approx(half) and got[2]["wx"] is None
    moving = rays(spark, [(0.3 * i, 0, 0, 9, 9, 9) for i in range(10)]).selectExpr("*", "seq % 1 AS part")
    by_motion = {r["seq"]: r["batch"] for r in sources.motion_batches(moving, "part", 100, 0.5).collect()}
    assert [by_motion[i] for i in range(10)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    by_size = {r["seq"]: r["batch"] for r in sources.motion_batches(moving, "part", 4).collect()}
    assert [by_size[i] for i in range(10)] == [0] * 4 + [1] * 4 + [2] * 2


def test_lookup_and_stale_regions(spark):
    m = spark.createDataFrame([(0, 0, 0, 1.0)], "gx int, gy int, gz int, occupancy float")
    table = spark.createDataFrame([(0, 0, 0, 5.0, 3), (1, 1, 1, 5.0, 1), (3, 0, 0, 5.0, 1)], "rx int, ry int, rz int, touched double, stamp long")
    keys = spark.createDataFrame([(0, 0, 0), (5, 0, 0), (90, 90, 90)], "gx int, gy int, gz int")
    assert sorted((r["gx"], r["kind"]) for r in maps.lookup(m, table, keys).collect()) == [(0, 1), (5, -1), (90, -2)]
    assert sorted(r["rx"] for r in maps.stale(table, 2).collect()) == [0, 1]
    assert maps.expire(table, 6.0).count() == 0 and maps.dirty(table, 1).count() == 1
