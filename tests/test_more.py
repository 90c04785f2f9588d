"""Functions and operators against plain Python, and against literal expectations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import colours, keys, names
from gridloom.functions.params import MapParams
from gridloom.operators import clouds, distance, fold, graph, heightmap, maps, ndt, runs, spatial
from gridloom.operators.walk import walk
from gridloom.plans import more
from gridloom.sources import files, generators
from gridloom.sources import rays as sources
from tests import test_catalog
from tests.test_catalog import folder  # noqa: F401

RAY = "seq long, ox double, oy double, oz double, sx double, sy double, sz double"
MAP = "gx int, gy int, gz int, occupancy float"
NEW = [n for n, f in more.QUERIES.items() if f.__module__ == more.__name__]


@pytest.mark.parametrize("name", [n for n in NEW if n in more.SQL])
def test_query_matches_its_sql(spark, folder, name):  # noqa: F811
    test_catalog.test_query_matches_its_sql(spark, folder, name)


def rays(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], RAY)


def test_hit_and_miss_of_one_ray(spark):
    m = {(r["gx"], r["gy"], r["gz"]): r["occupancy"] for r in runs.occupancy_map(rays(spark, [(0.05, 0.05, 0.05, 1.05, 0.05, 0.05)]), exclude_origin=True).collect()}
    assert m == {(16 + i, 16, 16): pytest.approx(-0.2006707 if i < 10 else 2.1972246) for i in range(1, 11)}


def test_two_returns_of_a_ray(spark):
    m = {r["gx"]: r["occupancy"] for r in runs.occupancy_map(rays(spark, [(0.05, 0.05, 0.05, 1.05, 0.05, 0.05), (1.05, 0.05, 0.05, 2.05, 0.05, 0.05)]), exclude_origin=True).collect()}
    assert m[26] == m[36] == pytest.approx(2.1972246) and 16 not in m


def test_chords_through_a_voxel(spark):
    directions = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]
    p = MapParams(origin=(-0.05, -0.05, -0.05))
    into = walk(rays(spark, [(*d, 0, 0, 0) for d in directions]), p).where("gx = 16 and gy = 16 and gz = 16").collect()
    assert len(into) == 26
    for r in into:
        assert r["exit"] - r["enter"] == pytest.approx(0.05 * math.sqrt(sum(map(abs, directions[r["seq"]]))), abs=1e-3)
    through = walk(rays(spark, [(*d, *(-x for x in d)) for d in directions]), p).where("gx = 16 and gy = 16 and gz = 16").collect()
    for r in through:
        assert r["exit"] - r["enter"] == pytest.approx(0.1 * math.sqrt(sum(map(abs, directions[r["seq"]]))), abs=1e-3)


def test_signed_distances_of_a_star(spark):
    ends = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]
    p = MapParams(origin=(-0.05, -0.05, -0.05))
    for d in ends[:4]:
        got = fold.tsdf(walk(rays(spark, [(0, 0, 0, *d)]), p, keep=("ox", "oy", "oz", "sx", "sy", "sz")), p, truncation=10.0).collect()
        for r in got:
            centre = (np.array([r["gx"], r["gy"], r["gz"]]) - 16) * 0.1
            length = np.linalg.norm(d)
            assert r["distance"] == pytest.approx(length - centre @ np.array(d) / length, abs=1e-5)


def test_secondary_returns_of_ten_rays(spark):
    rows = spark.createDataFrame([(i, 0.1 * i, 0.0, 0.0, 1.0, 0.0, 0.0, 1) for i in range(10)] + [(20, -99.0, 0.5, 0.5, 1.0, 0.5, 0.5, 1)], RAY + ", return_number int")
    by_count = {r["n"]: r for r in fold.secondary_quantised(rows).collect()}
    assert by_count[10]["mm"] / 1000 == pytest.approx(0.55, abs=1e-2) and math.sqrt(by_count[10]["m2"] / 10) == pytest.approx(0.2872, abs=1e-2)
    assert by_count[1]["mm"] == 65534


# distances


def brute_clearance(voxels, targets, p, radius, scaling=(1, 1, 1), unknown=False):
    solid = {v for v, o in voxels.items() if o >= 0}
    free = {v for v, o in voxels.items() if o < 0}
    reach = math.ceil(radius / p.resolution - 1e-9)
    out = {}
    for t in targets:
        best = math.inf
        for dx in range(-reach, reach + 1):
            for dy in range(-reach, reach + 1):
                for dz in range(-reach, reach + 1):
                    v = t[0] + dx, t[1] + dy, t[2] + dz
                    if (v not in free) if unknown else v in solid:
                        best = min(best, sum((d * p.resolution * s) ** 2 for d, s in zip((dx, dy, dz), scaling, strict=True)))
        out[t] = math.sqrt(best) if best <= radius * radius + 1e-9 else -1.0
    return out


@pytest.mark.parametrize("options", [{}, {"scaling": (1.0, 2.0, 0.5)}, {"unknown_as_occupied": True}])
def test_distances_of_brute_force(spark, options):
    rng, p = random.Random(3), MapParams(dims=8)
    voxels = {tuple(rng.randrange(-10, 10) for _ in range(3)): rng.choice([-1.0, -1.0, 1.0]) for _ in range(500)}
    df = spark.createDataFrame([(*v, o) for v, o in voxels.items()], MAP)
    targets = [*voxels, (50, 50, 50), (-9, 20, 3)]
    t = spark.createDataFrame(targets * 2, "gx int, gy int, gz int")
    want = brute_clearance(voxels, targets, p, 0.3, options.get("scaling", (1, 1, 1)), options.get("unknown_as_occupied", False))
    got = distance.nearest_obstacle(t, df, p, 0.3, **options).collect()
    assert {(r["gx"], r["gy"], r["gz"]): round(r["clearance"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_clearance_of_one_corner(spark):
    p = MapParams(resolution=1.0)
    voxels = generators.empty_space(spark, (0, 0, 0), (31, 31, 31), -1.0).withColumn("occupancy", F.when(F.expr("gx + gy + gz = 0"), 2.0).otherwise(-1.0).cast("float"))
    got = spatial.clearance(voxels, p, 32.0)
    wrong = got.where("abs(clearance - CASE WHEN gx*gx + gy*gy + gz*gz <= 1024 THEN sqrt(gx*gx + gy*gy + gz*gz) ELSE -1 END) > 1e-3")
    assert got.count() == 32**3 and wrong.isEmpty()


def test_nearest_of_a_line(spark):
    voxels = generators.empty_space(spark, (-20, -5, -5), (40, 37, 37), -1.0).withColumn("occupancy", F.when(F.expr("gx = 16 and gy = 16 and gz = 16"), 2.0).otherwise(-1.0).cast("float"))
    (r,) = spatial.line_query(rays(spark, [(-2, 0, 0, 2, 0, 0)]), voxels, MapParams(), 2.0, nearest_only=True).collect()
    assert (r["gx"], r["gy"], r["gz"], r["clearance"]) == (16, 16, 16, 0.0)


def test_stale_regions_are_computed_anew(spark):
    p = MapParams(dims=8)
    rng = random.Random(4)
    old = {tuple(rng.randrange(-16, 16) for _ in range(3)): -1.0 for _ in range(900)}
    new = old | {(3, 3, 3): 1.0}
    frame = lambda v: spark.createDataFrame([(*k, o) for k, o in v.items()], MAP)
    regions = spark.createDataFrame([(x, y, z, 1.0, 2 if x == y == z == 0 else 1) for x in range(-2, 2) for y in range(-2, 2) for z in range(-2, 2)], "rx int, ry int, rz int, touched double, stamp long")
    updated = distance.update_clearance(spatial.clearance(frame(old), p, 0.4), frame(new), maps.stale(regions, 1), p, 0.4)
    assert sorted(updated.collect()) == sorted(spatial.clearance(frame(new), p, 0.4).collect())
    with pytest.raises(ValueError):
        distance.update_clearance(updated, frame(new), regions, p, 5.0)


# keys, names, colours


def test_key_arithmetic(spark):
    g = tuple(F.col(c) for c in "xyz")
    df = spark.createDataFrame([(31, -1, 0), (-33, 5, 64)], "x int, y int, z int")
    to = keys.moved(g, (1, 0, -1))
    rows = df.select(*[keys.region_part(c).alias(f"r{i}") for i, c in enumerate(to)], *[keys.local_part(c).alias(f"l{i}") for i, c in enumerate(to)], keys.is_null(g).alias("null")).collect()
    assert [tuple(r) for r in rows] == [(1, -1, -1, 0, 31, 31, False), (-1, 0, 1, 0, 5, 31, False)]
    n = [r[0] for r in spark.range(0, 18).select(keys.next_power_of_two(F.col("id"))).collect()]
    assert n == [1, 1, 2, 4, 4, 8, 8, 8, 8, 16, 16, 16, 16, 16, 16, 16, 16, 32]


def test_names_and_what_has_none(spark):
    df = spark.createDataFrame([("fill",), ("nonsense",)], "n string")
    assert [r[0] for r in df.select(names.value_or(F.col("n"), names.HEIGHTMAP_MODES)).collect()] == [1, 0]
    assert [r[0] for r in spark.range(4).select(names.flag_name(F.col("id").cast("int"))).collect()] == ["None", "VoxelMean", "Compressed", "VoxelMean"]


def test_hsv_and_back(spark):
    import colorsys

    rng = random.Random(5)
    rows = [tuple(rng.random() for _ in range(3)) for _ in range(50)] + [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (1.0, 0.0, 0.0)]
    h, s, v = colours.to_hsv(("r", "g", "b"))
    for row in spark.createDataFrame(rows, "r double, g double, b double").selectExpr("*", f"{h} AS h", f"{s} AS s", f"{v} AS v").collect():
        want = colorsys.rgb_to_hsv(row["r"], row["g"], row["b"])
        assert (row["h"] / 360, row["s"], row["v"]) == pytest.approx(want, abs=1e-9)


# sources


def test_filters_flag_and_clip(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0, math.nan, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0), (3, -5.0, 0.0, 0.0, 5.0, 0.0, 0.0), (4, None, 0.0, 0.0, 1.0, 0.0, 0.0)], RAY)
    got = {r["seq"]: (r["flags"], r["sx"]) for r in sources.flag_filter(df, max_length=2.0).collect()}
    assert got[0] == (4, 2.0) and got[2] == (0, 0.5) and got[3] == (4, -3.0) and got[1][0] & 1 and got[4][0] & 1
    boxed = {r["seq"]: r["flags"] for r in sources.flag_filter(df, box=((-1.0,) * 3, (1.0,) * 3)).collect()}
    assert boxed[0] == 4 and boxed[3] == 6 and boxed[2] == 0
    masked = {r["seq"]: (r["flags"], r["sx"]) for r in sources.flag_filter(df, mask=((0.0, -1.0, -1.0), (1.0, 1.0, 1.0))).collect()}
    assert masked[2] == (4, 0.5) and masked[0] == (0, 4.0)


def test_late_rays_over_chunks(spark):
    rng = random.Random(6)
    times = [i + (rng.random() < 0.1) * rng.uniform(-30, 30) for i in range(300)]
    df = spark.createDataFrame([(i, float(t)) for i, t in enumerate(times)], "seq long, ts double")
    top, want = -math.inf, set()
    for i, t in enumerate(times):
        want |= {i} if t < top else set()
        top = max(top, t)
    assert {r["seq"] for r in sources.late(df, 16).collect()} == want and want


def test_cloud_modes_and_first_time(spark):
    points = spark.createDataFrame([(0, 5.0, 1.0, 2.0, 3.0, 0.5, 0.0, -1.0), (1, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "seq long, ts double, x double, y double, z double, nx double, ny double, nz double")
    assert sources.first_time(points).collect()[0][0] == 5.0
    r = {x["seq"]: x for x in sources.rays_from_ray_cloud(points).collect()}
    assert (r[0]["ox"], r[0]["oz"], r[0]["sx"]) == (1.5, 2.0, 1.0)
    fixed = sources.rays_from_cloud(points.drop("nx", "ny", "nz"), offset=(0.0, 0.0, 1.0)).collect()
    assert all((x["ox"], x["oy"], x["oz"]) == (0.0, 0.0, 1.0) for x in fixed)


def test_cones_about_any_axis(spark):
    axis, step = (1.0, 2.0, -0.5), math.radians(10)
    got = generators.conical_rays(spark, axis, math.radians(60), 3.0, step, 0.25).collect()
    assert len(got) == 1 + 36 * 3
    n = np.array(axis) / np.linalg.norm(axis)
    for r in got:
        end, start = np.array([r["sx"], r["sy"], r["sz"]]), np.array([r["ox"], r["oy"], r["oz"]])
        assert np.linalg.norm(end) == pytest.approx(3.0) and np.allclose(start, end / 12)
        assert math.degrees(math.acos(min(1.0, end @ n / 3.0))) <= 30.0 + 1e-6
    assert generators.point_list(spark, [(1, 2, 3)]).collect()[0]["sz"] == 3.0


def test_heightmaps_and_statistics_are_stored(spark, tmp_path):
    surface = spark.createDataFrame([(0, 0, 1.0)], "gx int, gy int, height double")
    files.save_heightmap(surface, str(tmp_path / "h"), {"up_axis": "z", "clearance": "0.5"})
    back, info = files.load_heightmap(spark, str(tmp_path / "h"))
    assert back.collect() == surface.collect() and info["clearance"] == "0.5"
    files.save_heightmap(surface, str(tmp_path / "bad"), {"clearance": "0.5"})
    with pytest.raises(ValueError):
        files.load_heightmap(spark, str(tmp_path / "bad"))
    files.write_statistics(spark.createDataFrame([(5, 0.5)], "ray_count long, ray_length_minimum double").coalesce(1), str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("*.csv")
    assert part.read_text().splitlines() == [",".join(files.STATISTICS), ",,,,5,0.5,,,,"]


# shapes


def test_triangles_close_a_cube(spark):
    t = [(r["a"], r["b"], r["c"]) for r in clouds.triangles(spark.createDataFrame([(0, 0, 0)], "gx int, gy int, gz int")).collect()]
    edges = [(x[i], x[(i + 1) % 3]) for x in t for i in range(3)]
    assert len(t) == 12 and sorted(edges) == sorted((b, a) for a, b in edges) and len({*edges}) == 36
    at = lambda c: np.array([c & 1, c >> 1 & 1, c >> 2 & 1]) - 0.5
    assert all(np.cross(at(b) - at(a), at(c) - at(a)) @ (at(a) + at(b) + at(c)) > 0 for a, b, c in t)  # facing out


def test_ellipsoid_axes_are_the_covariance(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(3, 3))
    cov = m @ m.T
    row = (0, 0, 0, *map(float, (cov[0, 0], cov[0, 1], cov[1, 1], cov[0, 2], cov[1, 2], cov[2, 2])))
    axes = clouds.ellipsoids(spark.createDataFrame([row], "gx int, gy int, gz int, cxx double, cxy double, cyy double, cxz double, cyz double, czz double")).orderBy("axis").collect()
    a = np.array([[r["x"], r["y"], r["z"]] for r in axes])
    assert np.allclose(a.T @ a, cov) and np.allclose(a @ a.T, np.diag(np.diag(a @ a.T)))


def test_fill_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(heightmap, "TILE", 64)
    rng = random.Random(7)
    cells = {(x, y): round(rng.random() * 1.2, 1) for x in range(-70, 70) for y in range(-10, 80) if rng.random() < 0.7}
    cells[0, 0] = 0.5
    seen, todo = {(0, 0)}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        for v in ((x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            if v in cells and v not in seen and abs(cells[v] - cells[x, y]) <= 0.35:
                seen.add(v)
                todo.append(v)
    df = spark.createDataFrame([(*v, h) for v, h in cells.items()], "gx int, gy int, height double")
    assert {(r["gx"], r["gy"]) for r in heightmap.fill(df, (0, 0), 0.35).collect()} == seen and len(seen) > 100
    assert heightmap.fill(df, (500, 500), 0.35).count() == 0


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 199)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(edges).collect()} == {i: 0 for i in range(61)} | {199: 199, 200: 199}


def test_normals_decode_what_they_encode():
    rng = np.random.default_rng(8)
    n = rng.normal(size=(200, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    assert np.allclose(fold.decode_normal(*fold.encode_normal(n)), n, atol=0.02)
    assert (fold.decode_normal(*fold.encode_normal(np.zeros((1, 3)))) == 0).all()


def test_room_has_floor_and_walls_along_every_axis(spark):
    room = generators.box_room(spark, (6, 6), 12).withColumn("occupancy", F.lit(1.0).cast("float"))
    for up in ("x", "-x", "y", "-y", "z", "-z"):
        m = heightmap.planar(heightmap.with_up(room, up), MapParams(), 0.3)
        inner = m.groupBy("gz").count().orderBy("count", ascending=False).head()
        floor = {"x": -6, "-x": 25, "y": -6, "-y": 25, "z": 0, "-z": 19}[up]
        assert inner["gz"] == floor and inner["count"] >= 11 * 11


def test_moments_agree_with_running_distributions(spark):
    rng = random.Random(9)
    rows = [(i, 0.05, 0.05, 0.05, *(0.65 + rng.uniform(-0.04, 0.04) for _ in range(3)), 5.0) for i in range(300)]
    w = walk(spark.createDataFrame(rows, RAY + ", intensity double"), MapParams(), keep=("ox", "oy", "oz", "sx", "sy", "sz", "intensity"))
    (a,) = ndt.moments(w).where("n > 100").collect()
    (b,) = ndt.covariance(ndt.integrate(w)).where("n_samples > 100").collect()
    assert a["n"] == b["n_samples"] == 300 and a["cxx"] == pytest.approx(b["cxx"], rel=0.2) and b["intensity_mean"] == pytest.approx(5.0, rel=1e-4)
