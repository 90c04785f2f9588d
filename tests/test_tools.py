"""Whole jobs with options."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.params import MapParams
from gridloom.operators import fold, maps, ndt, runs, spatial
from gridloom.operators.walk import walk
from gridloom.plans import tools

RAY = "seq long, ts double, ox double, oy double, oz double, sx double, sy double, sz double, intensity float, return_number int"


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(1)
    rows = [(i, float(i), 0.05, 0.05, 0.05, *[rng.uniform(-0.8, 0.8) for _ in range(3)], rng.random(), i % 3) for i in range(300)]
    return spark.createDataFrame([*rows, (900, 900.0, 0.0, 0.0, 0.0, math.nan, 0.0, 0.0, 0.0, 0), (901, 901.0, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 0)], RAY).cache()


def test_populate_joins_its_layers(some):
    p, o = MapParams(), tools.PopulateOptions(layers=("occupancy", "mean", "traversal", "touch_time", "normal", "tsdf", "secondary", "ndt"), max_length=3.0)
    m = tools.populate(some, p, o)
    good = some.where("seq < 300")
    assert sorted(m.select("gx", "gy", "gz", "occupancy", "n_ops").collect()) == sorted(runs.occupancy_map(good, p).collect())
    with_mean = m.where("n_samples IS NOT NULL").select("gx", "gy", "gz", "mx", "my", "mz", "n_samples")
    assert sorted(with_mean.collect()) == sorted(fold.mean(walk(good, p, keep=("sx", "sy", "sz")), p).collect())
    (row,) = m.agg(F.sum("ndt_n_samples").alias("n"), F.sum("second_n").alias("second"), F.count_if(F.col("tsdf_weight").isNull()).alias("none")).collect()
    assert (row["n"], row["second"], row["none"]) == (300, 200, 0)


@pytest.mark.parametrize("mode", ["samples", "erode"])
def test_populate_modes(some, mode):
    m = tools.populate(some, options=tools.PopulateOptions(mode=mode, layers=("occupancy", "traversal"), max_length=3.0))
    hits = m.where("occupancy > 0").count()
    assert (hits == m.count()) if mode == "samples" else hits == 0
    assert m.where("traversal IS NULL").isEmpty()


def test_populate_limits_clips_and_filters(some):
    n = lambda **o: tools.populate(some, options=tools.PopulateOptions(layers=("occupancy",), mode="samples", **o)).agg(F.sum("n_ops")).head()[0]
    assert n(max_length=3.0) == 300 and n(max_length=3.0, clip=True) == 301 and n() == 301
    assert n(point_limit=20) == 20 and n(start_time=100.0, time_limit=49.0) == 50
    assert n(max_length=3.0, ray_filter=lambda r: r.where("return_number = 0")) == 100
    near = tools.populate(some, options=tools.PopulateOptions(layers=("occupancy",), mode="samples", box=((-0.3,) * 3, (0.3,) * 3), max_length=3.0))
    assert near.where("abs(gx - 15.5) > 3.6 OR abs(gy - 15.5) > 3.6 OR abs(gz - 15.5) > 3.6").isEmpty()


def test_info_export_and_filters(some):
    p = MapParams()
    good = some.where("seq < 300")
    m = tools.populate(good, p, tools.PopulateOptions(layers=("occupancy", "mean", "traversal", "tsdf"))).cache()
    solid = m.where("occupancy >= 0").count()
    (i,) = tools.info(m, p).collect()
    assert i["occupied"] == solid and i["occupied"] + i["free"] == m.count() and i["max_gx"] >= i["min_gx"]
    counts = {mode: tools.export(m, p, mode, least=1.0).count() for mode in ("occupancy", "free", "mean", "cubes", "triangles")}
    assert counts == {"occupancy": solid, "free": m.count(), "mean": solid, "cubes": 8 * solid, "triangles": 12 * solid}
    assert 0 < tools.export(m, p, "density", least=1.0).count() <= m.count()
    layer = spatial.clearance(m, p, 0.3)
    assert tools.export(layer, p, "clearance").count() == layer.where("clearance >= 0").count()
    tsdf = m.withColumnsRenamed({"tsdf_weight": "weight", "tsdf_distance": "distance"})
    assert 0 < tools.export(tsdf, p, "tsdf").count() < m.count()
    assert tools.export(m, p, colours=("1e0", "z", "0e0")).where("g = z AND r = 1").count() == solid
    none = maps.overlaps(((50.0, 50.0, 50.0), (60.0, 60.0, 60.0)), p)
    assert tools.export(m, p, region_filter=none).isEmpty() and tools.export(m, p, region_filter=~none).count() == solid
    points = good.selectExpr("seq", "sx AS x", "sy AS y", "sz AS z")
    assert tools.filter_points(points, m, p).count() <= 300
    wide = MapParams(resolution=0.8)
    moments = ndt.moments(walk(good, wide, keep=("sx", "sy", "sz", "intensity")))
    assert 0 < tools.filter_points(points, moments, wide, by_distribution=True).count() < 300


def test_heightmaps_compare_and_probabilities(spark, some):
    p = MapParams()
    m = tools.populate(some.where("seq < 300"), p, tools.PopulateOptions(layers=("occupancy",))).select("gx", "gy", "gz", "occupancy").cache()
    planar = tools.build_heightmap(m, p, clearance=0.2)
    assert planar.count() > 20 and tools.build_heightmap(m, p, "layered", clearance=0.2).count() >= planar.count()
    start = planar.select("gx", "gy").head()
    filled = tools.build_heightmap(m, p, "fill", clearance=0.2, start=(start["gx"], start["gy"]), max_step=0.5)
    assert 0 < filled.count() <= planar.count()
    (same,) = tools.compare(m, m, {"occupancy": 0.0, "absent": 1.0}).collect()
    assert (same["layer"], same["same"], same["different"], same["missing"]) == ("occupancy", m.count(), 0, 0)
    v = spark.createDataFrame([(0.0,), (2.1972246,)], "v double")
    assert [r["probability"] for r in tools.probability(v, "v").collect()] == pytest.approx([0.5, 0.9])
    back = tools.probability(spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double"), "p", back=True)
    assert [r["value"] for r in back.collect()] == [-math.inf, 0.0, math.inf]
