import numpy as np

from gridloom.functions.params import MapParams
from gridloom.operators.walk import centres, keys, walk, walk_arrays


def sequential(o, s, p):
    """One ray, a wall at a time."""
    k = [int(keys(np.array([o[a]]), p, a)[0]) for a in range(3)]
    end = [int(keys(np.array([s[a]]), p, a)[0]) for a in range(3)]
    d = np.array(s) - np.array(o)
    length = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    short = length * length <= 1e-6
    out, step = [], [0, 0, 0]
    while k != end:
        best, at = None, None
        for a in range(3):
            if k[a] != end[a]:
                sign = np.sign(end[a] - k[a])
                first_key = k[a] - sign * step[a]
                inverse = 0.0 if short else 1 / (d[a] / length)
                wall = centres(np.array([first_key]), p, a)[0] + sign * p.resolution / 2
                first = (wall - o[a]) * inverse
                t = first + ((wall + sign * p.resolution - o[a]) * inverse - first) * step[a]
                if best is None or t <= best:
                    best, at = t, a
        out.append(tuple(k))
        k[at] += int(np.sign(end[at] - k[at]))
        step[at] += 1
    return out + [tuple(end)]


def test_walk_matches_sequential_steps():
    rng = np.random.default_rng(1153297050)
    for p in (MapParams(), MapParams(resolution=0.25, dims=5, origin=(0.125, 0.0, -0.05))):
        o, s = rng.uniform(-3, 3, (300, 3)), rng.uniform(-3, 3, (300, 3))
        o[:50], s[:50] = np.round(o[:50], 1), np.round(s[:50], 1)
        s[5], s[6] = o[5], o[6] + 1e-5
        ray, voxel, enter, leave, sample = walk_arrays(o, s, p)
        for i in range(300):
            own = ray == i
            assert [tuple(v) for v in voxel[own].tolist()] == sequential(o[i], s[i], p)
            assert sample[own].tolist() == [False] * (own.sum() - 1) + [True]
            assert np.all(np.diff(enter[own]) >= -1e-9)


def test_keys_and_centres_round_trip():
    for p in (MapParams(resolution=0.4), MapParams(resolution=0.25, dims=7)):
        g = np.arange(-100, 100)
        assert (keys(centres(g, p, 0), p, 0) == g).all()
        edge = p.resolution * p.dims / 2
        for e in (-5e-7, -1e-15, 0.0):
            g = keys(np.array([edge + e]), p, 0)[0]  # just below and at the edge between regions 0 and 1
            assert g in (p.dims - 1, p.dims) and abs(centres(np.array([g]), p, 0)[0] - edge) <= p.resolution / 2 + 1e-6


def test_walk_frame_flags_and_bad_rays(spark):
    rows = [(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, float("nan"), 0.0, 0.0), (3, None, 0.0, 0.0, 1.0, 0.0, 0.0), (4, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05)]
    rays = spark.createDataFrame(rows, "seq long, ox double, oy double, oz double, sx double, sy double, sz double")
    whole = walk(rays).collect()
    assert {r["seq"] for r in whole} == {1, 4}
    assert sum(r["seq"] == 1 for r in whole) == 11 and sum(r["seq"] == 4 for r in whole) == 1
    assert sum(r["seq"] == 1 for r in walk(rays, exclude_origin=True, exclude_sample=True).collect()) == 9
    assert walk(rays.limit(0)).collect() == []
