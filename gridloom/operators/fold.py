"""Folds of visits into voxel layers.

Layers whose updates add up (traversal, touch times, secondary ranges) are plain
aggregates, combined before the shuffle. Occupancy is a fold in the order of the rays
(see runs for the form that scales; the one here gathers a voxel's updates, as SQL can
say it). Means, normals and signed distances are ordered folds of arrays (see ordered).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.params import MapParams

VOXEL = ("gx", "gy", "gz")


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def occupancy(visits: DataFrame, p: MapParams = MapParams(), hit: Column | None = None) -> DataFrame:
    """gx, gy, gz, occupancy (float) and n_ops; a visit is a hit where `hit` (default: the sample's voxel)."""
    ops = visits.select(*VOXEL, F.struct("seq", (F.col("sample") if hit is None else hit).alias("hit")).alias("op"))
    grouped = ops.groupBy(*VOXEL).agg(F.array_sort(F.collect_list("op")).alias("ops"))
    fold = F.aggregate(
        "ops",
        F.lit(None).cast("float"),
        lambda v, op: F.when(op["hit"], F.least((F.coalesce(v, _f(0)) + _f(p.hit)).cast("float"), _f(p.high))).otherwise(F.greatest((F.coalesce(v, _f(0)) + _f(p.miss)).cast("float"), _f(p.low))),
    )
    return grouped.select(*VOXEL, fold.alias("occupancy"), F.size("ops").cast("long").alias("n_ops"))


def occupancy_by_chunks(visits: DataFrame, p: MapParams = MapParams(), chunk: int = 4096) -> DataFrame:
    """The same by composition of clamped sums over chunks of seq; differs from the exact fold by rounding only."""
    ops = visits.select(*VOXEL, F.floor(F.col("seq") / chunk).alias("chunk"), F.struct("seq", F.col("sample").alias("hit")).alias("op"))
    grouped = ops.groupBy(*VOXEL, "chunk").agg(F.array_sort(F.collect_list("op")).alias("ops"))
    start = F.struct(F.lit(0.0).alias("add"), F.lit(-1e30).alias("low"), F.lit(1e30).alias("high"))

    def then(f: Column, a: Column, lo: Column, hi: Column) -> Column:
        """f, then x -> min(max(x + a, lo), hi)."""
        clamp = lambda x: F.least(F.greatest(x, lo), hi)
        return F.struct((f["add"] + a).alias("add"), clamp(f["low"] + a).alias("low"), clamp(f["high"] + a).alias("high"))

    part = F.aggregate("ops", start, lambda f, op: then(f, F.when(op["hit"], p.hit).otherwise(p.miss), F.when(op["hit"], -1e30).otherwise(p.low), F.when(op["hit"], p.high).otherwise(1e30)))
    chunks = grouped.select(*VOXEL, F.struct("chunk", part.alias("f")).alias("c"), F.size("ops").alias("n"))
    whole = chunks.groupBy(*VOXEL).agg(F.array_sort(F.collect_list("c")).alias("cs"), F.sum("n").alias("n_ops"))
    value = F.aggregate("cs", F.lit(0.0), lambda v, c: F.least(F.greatest(v + c["f"]["add"], c["f"]["low"]), c["f"]["high"]))
    return whole.select(*VOXEL, value.cast("float").alias("occupancy"), "n_ops")


def traversal(visits: DataFrame) -> DataFrame:
    """Metres travelled in each voxel."""
    return visits.groupBy(*VOXEL).agg(F.sum(F.col("exit") - F.col("enter")).alias("traversal"))


def touch_time(visits: DataFrame) -> DataFrame:
    """Milliseconds since the first ray, of the last sample (by seq) in each voxel. visits carry ts."""
    from gridloom.functions.exprs import touch_millis

    return visits.where("sample").groupBy(*VOXEL).agg(F.max_by("ts", "seq").alias("ts")).select(*VOXEL, F.expr(touch_millis("ts", "0e0")).alias("touch_ms"))


def mean_step(bits: np.ndarray, n: np.ndarray, offset: np.ndarray, resolution: float) -> np.ndarray:
    """Ten-bit means (a row a voxel, a column an axis) after one more sample at an offset from the centre."""
    quantum = resolution / 1023
    old = np.where(n[:, None] == 0, 0.0, bits * quantum - 0.5 * resolution)
    new = old + (offset - old) / (n[:, None] + 1)
    return np.clip(np.floor((new + 0.5 * resolution) / quantum + 0.5), 0, 1023).astype(np.int32)


def mean(visits: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Quantised running mean of the samples in each voxel: ten bits an axis, and the count. visits carry sx, sy, sz."""
    from gridloom.operators.ordered import ordered_fold
    from gridloom.operators.walk import centres

    def step(s: dict, u: dict, voxel: np.ndarray) -> dict:
        offset = np.stack([u[f"s{a}"] - centres(voxel[:, i], p, i) for i, a in enumerate("xyz")], 1)
        return {"bits": mean_step(s["bits"], s["n"], offset, p.resolution), "n": s["n"] + 1}

    init = lambda k: {"bits": np.zeros((k, 3), np.int32), "n": np.zeros(k, np.int64)}
    finish = lambda s: {f"m{a}": np.ascontiguousarray(s["bits"][:, i]) for i, a in enumerate("xyz")} | {"n_samples": s["n"]}
    return ordered_fold(visits.where("sample"), ("sx", "sy", "sz"), ("seq",), init, step, finish, "mx int, my int, mz int, n_samples long")


def secondary(rays: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Count, mean and spread of the ranges of secondary returns, by the sample's voxel."""
    from gridloom.functions.exprs import RAY_LENGTH, key

    second = rays.where("return_number > 0").select(*[F.expr(key(f"s{a}", p, i)).alias(f"g{a}") for i, a in enumerate("xyz")], F.expr(RAY_LENGTH).alias("r"))
    return second.groupBy(*VOXEL).agg(F.count("*").alias("n"), F.avg("r").alias("range_mean"), F.stddev_pop("r").alias("range_std"))


def secondary_quantised(rays: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """The same as a running state in the order of seq, as stored: means in whole millimetres, ranges of at most 65.534 m, sums of squares in single precision."""
    from gridloom.functions.exprs import RAY_LENGTH, key
    from gridloom.operators.ordered import ordered_fold

    second = rays.where("return_number > 0").select("seq", *[F.expr(key(f"s{a}", p, i)).alias(f"g{a}") for i, a in enumerate("xyz")], F.expr(RAY_LENGTH).alias("r"))

    def step(s: dict, u: dict, _: np.ndarray) -> dict:
        r, n = np.minimum(u["r"], 65.534), s["n"] + 1
        old = s["mm"] / 1000
        delta = r - old
        new = old + delta / n
        return {"n": n, "mm": (new * 1000).astype(np.int32), "m2": s["m2"] + (delta * (r - new)).astype(np.float32)}

    init = lambda k: {"n": np.zeros(k, np.int64), "mm": np.zeros(k, np.int32), "m2": np.zeros(k, np.float32)}
    return ordered_fold(second, ("r",), ("seq",), init, step, lambda s: s, "n long, mm int, m2 float")


def normals(visits: DataFrame) -> DataFrame:
    """Running mean of the directions from samples to sensors, as packed after each sample: x and y in 14 bits, the sign of z.

    Each step decodes the packed normal, moves it towards the sample's direction, renormalises and packs again.
    visits carry o and s.
    """
    from gridloom.operators.ordered import ordered_fold

    def step(s: dict, u: dict, _: np.ndarray) -> dict:
        to = np.stack([u[f"o{a}"] - u[f"s{a}"] for a in "xyz"], 1)
        square = to[:, 0] * to[:, 0] + to[:, 1] * to[:, 1] + to[:, 2] * to[:, 2]
        unit = to * np.where(square > 1e-6, 1 / np.sqrt(np.maximum(square, 1e-300)), 0.0)[:, None]
        old = decode_normal(s["ix"], s["iy"], s["below"], s["set"])
        count = np.where(s["set"], s["n"], 0) + 1
        moved = old + (unit - old) / count[:, None]
        ix, iy, below, is_set = encode_normal(moved)
        return {"ix": ix, "iy": iy, "below": below, "set": is_set, "n": s["n"] + 1}

    init = lambda k: {"ix": np.zeros(k, np.int32), "iy": np.zeros(k, np.int32), "below": np.zeros(k, bool), "set": np.zeros(k, bool), "n": np.zeros(k, np.int32)}
    finish = lambda s: {c: s[c] for c in ("ix", "iy", "below", "n")}
    return ordered_fold(visits.where("sample"), ("ox", "oy", "oz", "sx", "sy", "sz"), ("seq",), init, step, finish, "ix int, iy int, below boolean, n int")


def decode_normal(ix: np.ndarray, iy: np.ndarray, below: np.ndarray, is_set: np.ndarray) -> np.ndarray:
    x, y = 2 * (ix / 16383.0) - 1, 2 * (iy / 16383.0) - 1
    z = np.sqrt(np.maximum(0.0, 1 - (x * x + y * y))) * np.where(below, -1.0, 1.0)
    return np.stack([x, y, z], 1) * is_set[:, None]


def encode_normal(normal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of x and of y, whether z is below zero, and whether there is a direction at all."""
    square = normal[:, 0] * normal[:, 0] + normal[:, 1] * normal[:, 1] + normal[:, 2] * normal[:, 2]
    unit = normal * np.where(square > 1e-6, 1 / np.sqrt(np.maximum(square, 1e-300)), 0.0)[:, None]
    bits = [np.floor(0.5 * (np.clip(unit[:, a], -1, 1) + 1) * 16383).astype(np.int32) for a in range(2)]
    return *bits, unit[:, 2] < 0, square > 1e-6


def tsdf(visits: DataFrame, p: MapParams = MapParams(), truncation: float = 0.1, max_weight: float = 1e4, dropoff: float = 0.0, sparsity: float = 0.0) -> DataFrame:
    """Weight and signed distance of each voxel: a running mean in the order of the rays, clamped to the truncation at each step.

    A ray weighs 1; with a dropoff (> 0) less behind the surface, with a sparsity factor (> 0) so much more within the truncation.
    Steps to a weight near zero change nothing. visits carry o and s. Single precision, as stored.
    """
    from gridloom.operators.ordered import ordered_fold
    from gridloom.operators.walk import centres

    f = np.float32
    reach, most = f(truncation), f(max_weight)

    def step(s: dict, u: dict, voxel: np.ndarray) -> dict:
        ray = [u[f"s{a}"] - u[f"o{a}"] for a in "xyz"]
        far = np.sqrt(ray[0] * ray[0] + ray[1] * ray[1] + ray[2] * ray[2])
        to = [centres(voxel[:, i], p, i) - u[f"o{a}"] for i, a in enumerate("xyz")]
        along = to[0] * ray[0] + to[1] * ray[1] + to[2] * ray[2]
        sdf = np.where(far > 0, far - along / np.where(far > 0, far, 1), 0.0).astype(f)
        weight = np.maximum((reach + sdf) / (reach - f(dropoff)), f(0)) if dropoff > 0 else np.ones(len(sdf), f)
        if sparsity > 0:
            weight = np.where(np.abs(sdf) < reach, weight * f(sparsity), weight)
        total = s["weight"] + weight
        near_zero = np.abs(total) < f(1e-5)
        mean = (sdf * weight + s["distance"] * s["weight"]) / np.where(near_zero, f(1), total)
        return {"weight": np.where(near_zero, s["weight"], np.minimum(total, most)), "distance": np.where(near_zero, s["distance"], np.clip(mean, -reach, reach))}

    init = lambda k: {"weight": np.zeros(k, f), "distance": np.zeros(k, f)}
    return ordered_fold(visits, ("ox", "oy", "oz", "sx", "sy", "sz"), ("seq", "step"), init, step, lambda s: s, "weight float, distance float")
