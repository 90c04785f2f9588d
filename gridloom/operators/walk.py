"""Voxels along rays, as a set: the wall crossings of the three axes, ordered by distance.

A ray crosses |difference of keys| walls on each axis, at distances that are linear in
the number of the wall. Sorting all crossings of a ray (ties: the higher axis first)
and counting those of each axis before a place gives the voxel there. The work is a
few array operations on a batch of rays: no shuffle and no row-wise code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.functions.params import MapParams

#: Rays of a batch are walked in slices of about so many crossings.
SLICE = 400_000
VISITS = "seq long, step int, gx int, gy int, gz int, enter double, exit double, sample boolean"
_RAY = ("seq", "ox", "oy", "oz", "sx", "sy", "sz")


def keys(c: np.ndarray, p: MapParams, axis: int) -> np.ndarray:
    d = p.resolution * p.dims
    c = c - p.origin[axis]
    region = np.floor(c / d + 0.5)
    q = c - (region * d - d / 2)
    q = np.where((q < 0) & (q >= -1e-6), 0.0, np.where((q >= d) & (q - 1e-6 < d), q - 1e-6, q))
    return (region * p.dims + np.floor(q / p.resolution)).astype(np.int64)


def centres(g: np.ndarray, p: MapParams, axis: int) -> np.ndarray:
    d = p.resolution * p.dims
    region = np.floor(g / p.dims)
    return region * d - d / 2 + p.origin[axis] + (g - region * p.dims) * p.resolution + p.resolution / 2


def walk_arrays(o: np.ndarray, s: np.ndarray, p: MapParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ray, voxel (n x 3), enter, exit and whether it is the sample's voxel, of every visit, in order."""
    n = len(o)
    k0 = np.stack([keys(o[:, a], p, a) for a in range(3)], 1)
    k1 = np.stack([keys(s[:, a], p, a) for a in range(3)], 1)
    delta = s - o
    length = np.sqrt(delta[:, 0] * delta[:, 0] + delta[:, 1] * delta[:, 1] + delta[:, 2] * delta[:, 2])
    short = length * length <= 1e-6
    length = np.where(short, 0.0, length)
    ray, axis, t, step = [], [], [], []
    for a in range(3):
        count = np.abs(k1[:, a] - k0[:, a])
        own = np.repeat(np.arange(n), count)
        k = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        sign = np.sign(k1[:, a] - k0[:, a]).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            inverse = np.where(short, 0.0, 1.0 / (delta[:, a] / length))
            wall = centres(k0[:, a], p, a) + sign * p.resolution / 2
            first = (wall - o[:, a]) * inverse
            second = (wall + sign * p.resolution - o[:, a]) * inverse
            apart = second - first
        ray.append(own)
        axis.append(np.full(len(own), a))
        t.append(first[own] + apart[own] * k)
        step.append(sign[own].astype(np.int64))
    ray, axis, t, step = (np.concatenate(x) for x in (ray, axis, t, step))
    order = np.lexsort((-axis, t, ray))
    ray, axis, t, step = ray[order], axis[order], t[order], step[order]
    count = np.bincount(ray, minlength=n)
    start = np.cumsum(count) - count
    voxel = np.empty((len(ray), 3), np.int64)
    for a in range(3):
        moved = np.where(axis == a, step, 0)
        before = np.cumsum(moved) - moved
        voxel[:, a] = k0[ray, a] + before - (before[np.minimum(start, max(len(before) - 1, 0))][ray] if len(before) else 0)
    enter = np.zeros(len(ray))
    enter[1:] = t[:-1]
    enter[start[count > 0]] = 0.0
    last = np.where(count > 0, t[np.maximum(start + count - 1, 0)] if len(t) else 0.0, 0.0)
    all_ray = np.concatenate([ray, np.arange(n)])
    put = np.lexsort((np.concatenate([np.zeros(len(ray)), np.ones(n)]), all_ray))
    sample = np.concatenate([np.zeros(len(ray), bool), np.ones(n, bool)])[put]
    return all_ray[put], np.concatenate([voxel, k1])[put], np.concatenate([enter, last])[put], np.concatenate([t, length])[put], sample


def walk(rays: DataFrame, params: MapParams = MapParams(), keep: tuple[str, ...] = (), exclude_origin: bool = False, exclude_sample: bool = False) -> DataFrame:
    """Visits of each ray, with the columns in keep carried along. Rays with null or non-finite ends have none."""
    kept = [rays.schema[c] for c in keep]
    schema = VISITS + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:7]], 1)
            fine = np.flatnonzero(np.isfinite(ends).all(1))
            size = np.abs(ends[fine, 3:] - ends[fine, :3]).sum(1) / params.resolution + 4
            cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + SLICE, SLICE))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own = fine[i:j]
                ray, voxel, enter, leave, sample = walk_arrays(ends[own, :3], ends[own, 3:], params)
                head = np.concatenate([[True], ray[1:] != ray[:-1]]) if len(ray) else np.zeros(0, bool)
                step = np.arange(len(ray)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                use = np.ones(len(ray), bool)
                if exclude_origin:
                    use[head] = False
                if exclude_sample:
                    use &= ~sample
                at = pa.array(own[ray[use]])
                columns = [batch.column(0).take(at), pa.array(step[use].astype(np.int32)), *(pa.array(voxel[use, a].astype(np.int32)) for a in range(3)), pa.array(enter[use]), pa.array(leave[use]), pa.array(sample[use])]
                yield pa.RecordBatch.from_arrays(columns + [c.take(at) for c in batch.columns[7:]], names=["seq", "step", "gx", "gy", "gz", "enter", "exit", "sample", *keep])

    return rays.select(*_RAY, *keep).mapInArrow(run, schema)
