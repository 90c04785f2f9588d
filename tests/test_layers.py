"""Layers against plain loops over rays, and against expected numbers of known scenes."""

import math
import random

import numpy as np
import pytest

from gridloom.functions.params import MapParams
from gridloom.operators import fold, ndt, ordered, runs
from gridloom.operators.walk import walk, walk_arrays

RAY = "seq long, ox double, oy double, oz double, sx double, sy double, sz double, intensity float"


def some_rays(n, seed=1, reach=0.6):
    rng = random.Random(seed)
    return [(i, 0.05, 0.05, 0.05, *[rng.uniform(-reach, reach) for _ in range(3)], rng.random() * 100) for i in range(n)]


def visits_in_order(rows, p):
    for r in rows:
        _, voxel, _, _, sample = walk_arrays(np.array([r[1:4]]), np.array([r[4:7]]), p)
        for v, s in zip(voxel.tolist(), sample.tolist(), strict=True):
            yield r, tuple(v), s


def centre_of(v, p):
    """Region 0 is centred on the origin: its voxel 0 begins half a region before it."""
    return (np.array(v) - p.dims / 2 + 0.5) * p.resolution


def clamp(x, lo, hi):
    return np.float32(min(max(x, lo), hi))


@pytest.mark.parametrize("flags", [{}, {"exclude_origin": True}, {"exclude_sample": True}, {"exclude_ray": True}, {"end_as_free": True}, {"rules": runs.Rules(saturate=(-1.5, 3.0))}, {"rules": runs.Rules(exclude_occupied=True)}])
def test_runs_make_the_map_of_a_loop(spark, flags):
    p, rows = MapParams(), some_rays(3000) + [(9000, math.nan, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0), (9001, None, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)]
    want = {}
    hit, miss, low, high = (np.float32(x) for x in (p.hit, p.miss, p.low, p.high))
    last = None
    for r, v, is_sample in visits_in_order(rows[:3000], p):
        first, last = r[0] != last, r[0]
        if (first and flags.get("exclude_origin")) or (is_sample and flags.get("exclude_sample")) or (not is_sample and flags.get("exclude_ray")):
            continue
        value, n = want.get(v, (np.float32(0), 0))
        limits = flags["rules"].saturate if "rules" in flags else None
        stays = v in want and "rules" in flags and flags["rules"].exclude_occupied and value >= 0
        if not stays and (not limits or np.float32(limits[0]) < value < np.float32(limits[1])):
            value = min(value + hit, high) if is_sample and not flags.get("end_as_free") else max(value + miss, low)
        want[v] = np.float32(value), n + 1
    random.Random(2).shuffle(rows)
    got = runs.occupancy_map(spark.createDataFrame(rows, RAY).repartition(5), p, **flags).collect()
    assert {(r["gx"], r["gy"], r["gz"]): (r["occupancy"], r["n_ops"]) for r in got} == {v: (float(x), n) for v, (x, n) in want.items()}


@pytest.mark.parametrize("rules", [runs.Rules(), runs.Rules(exclude_unobserved=True), runs.Rules(exclude_free=True), runs.Rules(exclude_occupied=True), runs.Rules(exclude_unobserved=True, exclude_free=True)])
def test_rules_on_top_of_a_map(spark, rules):
    p = MapParams()
    before = {(x, y, 16): np.float32((x * 7 + y * 3) % 5 - 2) for x in range(10, 22) for y in range(10, 22)}
    want = {v: (x, 0) for v, x in before.items()}
    for _, v, is_sample in visits_in_order(rows := some_rays(400, 8), p):
        value, n = want.get(v, (None, 0))
        if (value is None and rules.exclude_unobserved) or (value is not None and ((value < 0 and rules.exclude_free) or (value >= 0 and rules.exclude_occupied))):
            want |= {v: (value, n + 1)} if value is not None else {}
            continue
        base = np.float32(0) if value is None else value
        want[v] = (min(base + np.float32(p.hit), np.float32(p.high)) if is_sample else max(base + np.float32(p.miss), np.float32(p.low))), n + 1
    into = spark.createDataFrame([(*v, float(x)) for v, x in before.items()], "gx int, gy int, gz int, occupancy float")
    got = runs.occupancy_map(spark.createDataFrame(rows, RAY), p, rules, into).collect()
    assert {(r["gx"], r["gy"], r["gz"]): (r["occupancy"], r["n_ops"]) for r in got} == {v: (float(x), n) for v, (x, n) in want.items()}


def test_single_hits_and_misses(spark):
    p = MapParams()
    none = spark.createDataFrame([], "gx int, gy int, gz int, occupancy float")
    key = spark.createDataFrame([(1, 2, 3)], "gx int, gy int, gz int")
    once = [runs.touch(none, key, hit, p) for hit in (True, False)]
    assert [m.collect()[0]["occupancy"] for m in once] == pytest.approx([p.hit, p.miss])
    assert runs.touch(once[0], key, True, p).collect()[0]["occupancy"] == pytest.approx(p.high)


def test_a_voxel_that_all_rays_pass_is_one_row_a_run(spark):
    rows = some_rays(20_000, 3)
    r = runs.runs_of(spark.createDataFrame(rows, RAY), MapParams())
    beside = r.where("gx = 16 and gy = 16 and gz = 16").collect()  # the voxel from 0 to 0.1
    assert sum(x["n"] for x in beside) == 20_000 and len(beside) <= 40 and all(x["n_bits"] < 100 for x in beside)


def test_late_runs_take_their_place(spark):
    p, rows = MapParams(), some_rays(600, 4)
    first, second = (spark.createDataFrame(part, RAY) for part in (rows[300:], rows[:300]))
    both = runs.put_together(runs.runs_of(first, p).union(runs.runs_of(second, p)), p)
    assert sorted(both.collect()) == sorted(runs.occupancy_map(spark.createDataFrame(rows, RAY), p).collect())


@pytest.mark.parametrize("options", [{}, {"dropoff": 0.02}, {"sparsity": 4.0}, {"max_weight": 3.0}, {"truncation": 0.3, "dropoff": 0.1, "sparsity": 2.0}])
def test_signed_distances_of_a_loop(spark, options):
    p, rows, f = MapParams(), some_rays(300, 5), np.float32
    o = {"truncation": 0.1, "max_weight": 1e4, "dropoff": 0.0, "sparsity": 0.0} | options
    want = {}
    for r, v, _ in visits_in_order(rows, p):
        to, ray = centre_of(v, p) - np.array(r[1:4]), np.array(r[4:7]) - np.array(r[1:4])
        length = np.linalg.norm(ray)
        d = f(length - to @ ray / length)
        w = max(f((f(o["truncation"]) + d) / f(o["truncation"] - o["dropoff"])), f(0)) if o["dropoff"] > 0 else f(1)
        w = w * f(o["sparsity"]) if o["sparsity"] > 0 and abs(d) < f(o["truncation"]) else w
        weight, distance = want.get(v, (f(0), f(0)))
        if abs(weight + w) >= 1e-5:
            weight, distance = min(weight + w, f(o["max_weight"])), clamp((d * w + distance * weight) / (weight + w), -o["truncation"], o["truncation"])
        want[v] = weight, distance
    got = fold.tsdf(walk(spark.createDataFrame(rows, RAY), p, keep=("ox", "oy", "oz", "sx", "sy", "sz")), p, **options).collect()
    assert len(got) == len(want)
    for r in got:
        w, d = want[r["gx"], r["gy"], r["gz"]]
        assert r["weight"] == pytest.approx(float(w), rel=1e-4, abs=1e-5) and r["distance"] == pytest.approx(float(d), abs=1e-4)


def test_batches_do_not_split_a_voxels_history(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 0, i, float(i % 7)) for i in range(25_000)] + [(k, 1, 0, 0, 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "gx int, gy int, gz int, seq long, x double").orderBy(F.rand(1))
    step = lambda s, u, v: {"a": s["a"] * 0.5 + u["x"]}
    got = ordered.ordered_fold(df, ("x",), ("seq",), lambda k: {"a": np.zeros(k)}, step, lambda s: s, "a double").collect()
    want = 0.0
    for r in rows[:25_000]:
        want = want * 0.5 + r[4]
    assert {(r["gx"], r["gy"]): r["a"] for r in got} == {(0, 0): want} | {(k, 1): 1.0 for k in range(5)}


# distributions


def scalar_ndt(updates, p, q):
    """One voxel's updates (is_sample, sensor, sample, intensity), by matrices in double precision."""
    value, n, bits, cov = None, 0, np.zeros(3), np.eye(3) * (0.1 * p.resolution) ** 2
    i_mean = i_var = 0.0
    hits = misses = 0
    rate = ndt.adaptation_rate(p.p_miss) if q.adaptation is None else q.adaptation
    quantum = p.resolution / 1023
    for is_sample, sensor, sample, intensity in updates:
        mean = bits * quantum - 0.5 * p.resolution  # from the voxel's centre
        inverse = np.linalg.inv(cov)
        ray = (sample - sensor) / np.linalg.norm(sample - sensor)
        t = ray @ inverse @ (mean - sensor) / (ray @ inverse @ ray)
        x = sensor + t * ray
        by_voxel, by_sample = math.exp(-0.5 * (x - mean) @ inverse @ (x - mean)), math.exp(-0.5 * (x - sample) @ (x - sample) / q.noise**2)
        if not is_sample:
            change, is_miss = p.miss, True
            if value is not None and n >= q.least_samples:
                chance = 0.5 - 0.5 * rate * by_voxel * (1 - by_sample)
                change, is_miss = math.log(chance / (1 - chance)), by_voxel * (1 - by_sample) < 0.5 * rate
            value, misses = max((value or 0.0) + change, p.low), misses + is_miss
            continue
        reset = n == 0 or (value is not None and value < q.reset_below and n >= q.reset_samples)
        if value is None or reset:
            hits, misses = 1, 0
        else:
            good = by_voxel * by_sample >= 0.5 * rate
            hits += n < q.least_samples or good
            misses += n >= q.least_samples and not good and by_voxel >= 0.5 * rate
        i_mean, i_var = (intensity, q.intensity_var) if reset else ((n * i_mean + intensity) / (n + 1), (n * i_var + (i_mean - intensity) ** 2 / (n + 1)) / (n + 1))
        if reset:
            n, cov = 0, np.eye(3) * (0.1 * p.resolution) ** 2
        else:
            d = sample - mean
            cov = n / (n + 1) * cov + n / (n + 1) ** 2 * np.outer(d, d)
        old = mean if n else np.zeros(3)
        bits = np.clip(np.floor((old + (sample - old) / (n + 1) + 0.5 * p.resolution) / quantum + 0.5), 0, 1023)
        value, n = min((value or 0.0) + p.hit, p.high), n + 1
    return value, n, bits, cov, i_mean, i_var, hits, misses


def test_distributions_of_a_loop(spark):
    p, q = MapParams(resolution=0.4, dims=32, p_hit=0.7, p_miss=0.3), ndt.NdtParams(reset_samples=4)
    rows = some_rays(400, 7)
    by_voxel = {}
    for r, v, is_sample in visits_in_order(rows, p):
        centre = centre_of(v, p)
        by_voxel.setdefault(v, []).append((is_sample, np.array(r[1:4]) - centre, np.array(r[4:7]) - centre, np.float32(r[7])))
    got = ndt.covariance(ndt.integrate(walk(spark.createDataFrame(rows, RAY), p, keep=("ox", "oy", "oz", "sx", "sy", "sz", "intensity")), p, q)).collect()
    assert len(got) == len(by_voxel) and any(r["n_samples"] >= 4 for r in got)
    for r in got:
        value, n, bits, cov, i_mean, i_var, hits, misses = scalar_ndt(by_voxel[r["gx"], r["gy"], r["gz"]], p, q)
        assert r["occupancy"] == pytest.approx(value, abs=2e-3) and (r["n_samples"], r["hits"], r["misses"]) == (n, hits, misses)
        if n:
            assert np.allclose([r["mx"], r["my"], r["mz"]], bits, atol=1) and np.allclose([r["intensity_mean"], r["intensity_var"]], [i_mean, i_var], rtol=1e-3)
            assert np.allclose([r["cxx"], r["cxy"], r["cyy"], r["cxz"], r["cyz"], r["czz"]], cov[[0, 0, 1, 0, 1, 2], [0, 1, 1, 2, 2, 2]], atol=1e-4)


def scene(name, n=10_000):
    rng = np.random.default_rng(1153297050)
    if name == "planar":
        points, origin = np.column_stack([rng.uniform(0.01, 1.99, (n, 2)), np.ones(n)]), 1.0
    else:
        points, origin = rng.uniform(-0.99, 0.99, (n, 3)), 0.0
        width = 2 if name == "cylinder" else 3
        points[:, :width] *= (rng.uniform(0.25, 0.35, n) / np.linalg.norm(points[:, :width], axis=1))[:, None]
    return points, origin


RAYS_OF = {  # from, to, chance of the voxel after the ray alone, tolerance
    "planar": [((1, 1, 5), (1, 1, -5), 0.004, 0.001), ((1, 1, -5), (1, 1, 5), 0.004, 0.001), ((-5, 1, 0.25), (5, 1, 0.25), 0.5, 0.001), ((1, 5, 1.01), (1, -5, 1.01), 0.5, 0.001), ((-5, 1, 2), (5, 1, 1), 0.5, 0.001), ((-5, 1, 2), (5, 1, 0.5), 0.23, 0.02)],
    "cylinder": [((0, 0, 5), (0, 0, -5), 0.004, 0.001), ((0.3, 0.3, 5), (0.3, 0.3, -5), 0.425, 0.01), ((0.45, 0.45, -5), (0.6, 0.6, 5), 0.499, 0.001), ((2, -0.3, 0), (-2, -0.3, 0), 0.312, 0.005), ((2, -0.3, 0.85), (-2, -0.3, 0.85), 0.436, 0.003), ((2, 0.6, 0.85), (-2, 0.6, 0.85), 0.497, 0.001)],
    "sphere": [((0, 0, 5), (0, 0, -5), 0.004, 0.001), ((0.3, 0.3, 5), (0.3, 0.3, -5), 0.469, 0.006), ((0.45, 0.45, -5), (0.6, 0.6, 5), 0.5, 0.001)],
}


@pytest.mark.parametrize("name", list(RAYS_OF))
def test_misses_of_known_scenes(spark, name):
    points, centre = scene(name)
    p = MapParams(resolution=2.0, dims=32, p_hit=0.55, p_miss=0.45)
    shift = 1.0 - centre  # the scene's voxel is the one from 0 to 2
    samples = spark.createDataFrame([(16, 16, 16, i, 0, True, 1.0, 1.0, 6.0, *map(float, x + shift), 0.0) for i, x in enumerate(points)], "gx int, gy int, gz int, seq long, step int, sample boolean, ox double, oy double, oz double, sx double, sy double, sz double, intensity double")
    (r,) = ndt.covariance(ndt.integrate(samples, p, ndt.NdtParams(adaptation=1.0))).collect()
    assert r["n_samples"] == len(points)
    cov = np.cov(points.T, bias=True)
    assert np.allclose([r["cxx"], r["cyy"], r["czz"]], np.diag(cov), atol=5e-3)
    root = np.zeros((1, 3, 3))
    for i in range(3):
        for j in range(i + 1):
            root[0, i, j] = r[f"r{i}{j}"]
    # steps below half a quantum don't move the stored mean any more: where it rests is chance, so the table is held with the true one
    mean = points.mean(0)[None, :] + shift
    assert np.allclose(np.array([r[f"m{a}"] for a in "xyz"]) * (2.0 / 1023), mean, atol=0.05)
    for a, b, chance, tolerance in RAYS_OF[name]:
        change, _ = ndt.miss_change(root, mean, np.array([a], float) + shift, np.array([b], float) + shift, 1.0, 0.05)
        change = max(r["occupancy"] + float(change[0]), p.low) - r["occupancy"]  # values are clamped
        assert 1 / (1 + math.exp(-change)) == pytest.approx(chance, abs=tolerance + 0.002)  # the points are drawn by another generator


def test_adaptation_rate_follows_the_chance_of_a_miss():
    assert [ndt.adaptation_rate(x) for x in (0.5, 0.45, 0.25, 0.0, 0.6)] == pytest.approx([0, 0.2, 1, 1, 0])
