"""Synthetic maps and ray patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _box(spark: SparkSession, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    nx, ny, nz = (h - low + 1 for low, h in zip(lo, hi, strict=True))
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i % nx + lo[0]).cast("int").alias("gx"), (F.floor(i / nx) % ny + lo[1]).cast("int").alias("gy"), (F.floor(i / (nx * ny)) + lo[2]).cast("int").alias("gz"))


def empty_space(spark: SparkSession, lo: tuple[int, int, int], hi: tuple[int, int, int], miss: float) -> DataFrame:
    """A box of free voxels."""
    return _box(spark, lo, hi).withColumn("occupancy", F.lit(miss).cast("float"))


def box_room(spark: SparkSession, half: tuple[int, int], height: int) -> DataFrame:
    """Voxels of the walls, the floor and the ceiling of a room."""
    return _box(spark, (-half[0], -half[1], 0), (half[0], half[1], height)).where(f"abs(gx) = {half[0]} OR abs(gy) = {half[1]} OR gz = 0 OR gz = {height}")


def slope(spark: SparkSession, half: tuple[int, int], rise: float) -> DataFrame:
    """One voxel a column, rising along x."""
    return _box(spark, (-half[0], -half[1], 0), (half[0], half[1], 0)).withColumn("gz", F.floor(F.col("gx") * rise).cast("int"))


def wall(spark: SparkSession, half_width: int, height: int, gx: int) -> DataFrame:
    return _box(spark, (gx, -half_width, 0), (gx, half_width, height))


def cone(spark: SparkSession, angle_deg: float, step_deg: float, spokes: int, reach: float) -> DataFrame:
    """Ends of rays from the origin about +z, at deflections of up to half the angle."""
    rings = int(angle_deg / 2 / step_deg) + 1
    i = F.col("id")
    grid = spark.range(rings * spokes).select(F.floor(i / spokes).cast("int").alias("ring"), (i % spokes).cast("int").alias("spoke")).where("ring > 0 OR spoke = 0")
    tilt, turn = F.radians(F.col("ring") * step_deg), F.radians(F.col("spoke") * (360.0 / spokes))
    return grid.select("ring", "spoke", (reach * F.sin(tilt) * F.cos(turn)).alias("x"), (reach * F.sin(tilt) * F.sin(turn)).alias("y"), (reach * F.cos(tilt)).alias("z"))


def conical_rays(spark: SparkSession, axis: tuple[float, float, float], angle: float, reach: float, step: float, least: float = 0.0) -> DataFrame:
    """seq, o and s of rays about an axis: the axis itself, then for each turn by step all deflections of up to half the angle (radians).

    Rays go from the distance least to the distance reach.
    """
    size = math.sqrt(sum(a * a for a in axis))
    n = [a / size for a in axis]
    base = (n[2], n[0], n[1])  # not along the axis, but where its three parts are equal
    rings, spokes = math.floor(0.5 * angle / step + 1e-12), math.ceil(2 * math.pi / step - 1e-12)
    i = F.col("id") - 1
    turn, tilt = F.floor(i / max(rings, 1)) * step, (i % max(rings, 1) + 1) * step

    def rotated(v: list[Column], k: list[Column], by: Column) -> list[Column]:
        cross = [k[1] * v[2] - k[2] * v[1], k[2] * v[0] - k[0] * v[2], k[0] * v[1] - k[1] * v[0]]
        dot = k[0] * v[0] + k[1] * v[1] + k[2] * v[2]
        return [v[a] * F.cos(by) + cross[a] * F.sin(by) + k[a] * dot * (1 - F.cos(by)) for a in range(3)]

    lit = lambda v: [F.lit(float(x)) for x in v]
    rows = spark.range(rings * spokes + 1).withColumns({"turn": turn, "tilt": tilt})
    around = rotated(lit(base), lit(n), F.col("turn"))
    rows = rows.withColumns({f"k{a}": c for a, c in zip("xyz", around, strict=True)})
    length = F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky") + F.col("kz") * F.col("kz"))
    to = rotated(lit(n), [F.col(f"k{a}") / length for a in "xyz"], F.col("tilt"))
    rows = rows.withColumns({f"d{a}": F.when(F.col("id") == 0, n[k]).otherwise(to[k]) for k, a in enumerate("xyz")})
    return rows.select(F.col("id").alias("seq"), *[(F.col(f"d{a}") * least).alias(f"o{a}") for a in "xyz"], *[(F.col(f"d{a}") * reach).alias(f"s{a}") for a in "xyz"])


def ray_list(spark: SparkSession, rays: list[tuple[tuple[float, float, float], tuple[float, float, float]]]) -> DataFrame:
    """A pattern of given rays, in their order."""
    return spark.createDataFrame([(i, *map(float, o), *map(float, s)) for i, (o, s) in enumerate(rays)], "seq long, ox double, oy double, oz double, sx double, sy double, sz double")


def point_list(spark: SparkSession, points: list[tuple[float, float, float]]) -> DataFrame:
    """A pattern of rays from the origin to given points."""
    return ray_list(spark, [((0.0, 0.0, 0.0), p) for p in points])
