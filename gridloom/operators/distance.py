"""Distances of voxels to the nearest obstacle, region by region.

Each region meets the obstacles in it and around it, within the reach of the search, and
fills a dense grid of its size and that margin; the distances follow axis by axis, as
the least of so many shifted copies (the squared distance is a sum over axes). The work
of a region does not depend on how many obstacles it has, a task holds one region at a
time, and an obstacle is copied to at most eight regions if the reach is within one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.params import MapParams
from gridloom.operators.fold import VOXEL

_R = ("rx", "ry", "rz")
_RESULT = "gx int, gy int, gz int, clearance double"


def _grid(cells: pa.Table, lo: np.ndarray, size: int) -> np.ndarray:
    """Which cells of a cube are in the table."""
    out = np.zeros((size, size, size), bool)
    if cells.num_rows:
        at = [cells.column(g).to_numpy() - lo[i] for i, g in enumerate(VOXEL)]
        out[tuple(at)] = True
    return out


def least_squares(solid: np.ndarray, reach: int, steps: tuple[float, float, float]) -> np.ndarray:
    """Squared distance of each inner cell (a margin of reach off) to the nearest solid one within reach cells an axis; inf without one."""
    cost = np.where(solid, 0.0, np.inf)
    n = solid.shape[0] - 2 * reach
    for axis, step in enumerate(steps):
        best = np.full([n if a <= axis else solid.shape[0] for a in range(3)], np.inf)
        for d in range(-reach, reach + 1):
            part = [slice(None)] * 3
            part[axis] = slice(reach + d, reach + d + n)
            best = np.minimum(best, cost[tuple(part)] + (d * step) ** 2)
        cost = best
    return cost


def least_unscaled(solid: np.ndarray, reach: int, resolution: float, scaling: tuple[float, float, float], radius: float) -> np.ndarray:
    """Squared unscaled distance to the solid cell of the least scaled distance, of those within the radius as it is."""
    n = solid.shape[0] - 2 * reach
    d = np.arange(-reach, reach + 1)
    offsets = np.stack(np.meshgrid(d, d, d, indexing="ij"), -1).reshape(-1, 3)
    plain = ((offsets * resolution) ** 2).sum(1)
    offsets, plain = offsets[plain <= radius * radius + 1e-9], plain[plain <= radius * radius + 1e-9]
    out = np.full((n, n, n), np.inf)
    weighed = np.round(((offsets * np.array(scaling)) ** 2).sum(1), 9)
    for k in np.lexsort((plain, weighed)):  # of equals the plainly nearer one
        x, y, z = offsets[k] + reach
        out[solid[x : x + n, y : y + n, z : z + n] & np.isinf(out)] = plain[k]
    return out


def _regions(cells: DataFrame, spread: Column, target: Column, p: MapParams, reach: int) -> DataFrame:
    """Rows of cells for each region that needs them: their own, and, where spread, those within reach."""
    for r, g in zip(_R, VOXEL, strict=True):
        at = lambda d, g=g: F.floor((F.col(g) + F.when(spread, d).otherwise(0)) / F.lit(p.dims)).cast("int")
        cells = cells.withColumn(r, F.explode(F.sequence(at(-reach), at(reach))))
    own = F.lit(True)
    for r, g in zip(_R, VOXEL, strict=True):
        own &= F.floor(F.col(g) / F.lit(p.dims)).cast("int") == F.col(r)
    return cells.select(*_R, *VOXEL, spread.alias("met"), (target & own).alias("target"))


def nearest_obstacle(targets: DataFrame | None, voxels: DataFrame, p: MapParams = MapParams(), radius: float = 0.3, scaling: tuple[float, float, float] = (1.0, 1.0, 1.0), unknown_as_occupied: bool = False, unscaled: bool = False) -> DataFrame:
    """gx, gy, gz (each target once; None: the map's voxels) and its distance to the nearest obstacle within radius; -1 where there is none.

    Obstacles are occupied voxels and, if asked, all that the map doesn't know as free. Distances are scaled by axis, or as
    they are of the obstacle that is nearest when scaled.
    """
    reach = max(1, math.ceil(radius / p.resolution - 1e-9))
    size = p.dims + 2 * reach
    occupied = F.col("occupancy") >= p.threshold
    spread = ~occupied if unknown_as_occupied else occupied
    if targets is None:  # the map is read once
        rows = _regions(voxels.select(*VOXEL, "occupancy"), spread, F.lit(True), p, reach)
    else:
        rows = _regions(voxels.where(spread).select(*VOXEL), F.lit(True), F.lit(False), p, reach)
        rows = rows.unionByName(_regions(targets.select(*VOXEL).distinct(), F.lit(False), F.lit(True), p, reach))
    steps = tuple(p.resolution * s for s in scaling)

    def solve(cells: pa.Table) -> pa.Table:
        asked = cells.filter(cells.column("target"))
        corner = np.array([cells.column(r)[0].as_py() for r in _R]) * p.dims
        if not asked.num_rows:
            return pa.table({g: pa.array([], pa.int32()) for g in VOXEL} | {"clearance": pa.array([], pa.float64())})
        there = _grid(cells.filter(cells.column("met")), corner - reach, size)
        solid = ~there if unknown_as_occupied else there
        square = least_unscaled(solid, reach, p.resolution, scaling, radius) if unscaled else least_squares(solid, reach, steps)
        found = square[tuple(asked.column(g).to_numpy() - corner[i] for i, g in enumerate(VOXEL))]
        near = found <= radius * radius + 1e-9
        return pa.table({g: asked.column(g) for g in VOXEL} | {"clearance": pa.array(np.where(near, np.sqrt(np.where(near, found, 0.0)), -1.0))})

    return rows.groupBy(*_R).applyInArrow(solve, _RESULT)


def update_clearance(layer: DataFrame, voxels: DataFrame, stale: DataFrame, p: MapParams = MapParams(), radius: float = 0.3, **options) -> DataFrame:
    """A clearance layer with the voxels of stale regions (see maps.stale) computed anew. The radius is within a region's edge."""
    from gridloom.operators.maps import REGION, with_region

    if radius > p.resolution * p.dims:
        raise ValueError("a radius beyond a region reaches regions that are not marked as stale")
    keys = stale.select(*REGION)
    kept = with_region(layer, p).join(keys, list(REGION), "left_anti").select(*layer.columns)
    anew = with_region(voxels, p).join(keys, list(REGION), "left_semi")
    return kept.unionByName(nearest_obstacle(anew, voxels, p, radius, **options).select(*layer.columns))
