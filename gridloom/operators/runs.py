"""Occupancy from rays, by runs of their order.

Rays are dealt to tasks by ranges of seq, so a task holds contiguous runs. In a run each
voxel's updates become one row, whatever their number: the map x -> x after the run. It
is kept exactly, in single precision, as the value that it always ends with, where the
lowest and the highest value that a voxel can have come together (as the clamps make
them do beside a sensor), and the hits and misses after that as bits. Rows of a voxel
are put together in the order of their runs; what lies before a known value does not
matter. So the shuffle has one row a voxel and run, and a voxel that every ray passes
costs a task a row a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.params import MapParams
from gridloom.operators.fold import VOXEL
from gridloom.operators.walk import SLICE, walk_arrays

_ENDS = ("ox", "oy", "oz", "sx", "sy", "sz")
_RUNS = "gx int, gy int, gz int, run long, part int, n long, value float, ops binary, n_bits int"
Step = Callable[[np.ndarray, np.ndarray], np.ndarray]


def segments(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows."""
    n = len(keys[0])
    fresh = np.ones(n, bool)
    if n:
        fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], 0)
    return np.append(np.flatnonzero(fresh), n)


def side_by_side(ptr: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For t = 0, 1, ...: the segments longer than t, and their row t."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    for t, k in enumerate(active.tolist()):
        own = order[:k]
        yield own, ptr[own] + t


@dataclass(frozen=True)
class Rules:
    """How values change. Values at or beyond the limits in saturate stay; voxels that are unobserved, free or occupied at the time stay if excluded."""

    saturate: tuple[float, float] | None = None
    exclude_unobserved: bool = False
    exclude_free: bool = False
    exclude_occupied: bool = False

    @property
    def clamp_only(self) -> bool:
        return not (self.saturate or self.exclude_unobserved or self.exclude_free or self.exclude_occupied)


def step_of(p: MapParams, rules: Rules = Rules()) -> Step:
    """The update of values (nan: unobserved) by hits (true) and misses."""
    hit, miss, low, high = (np.float32(x) for x in (p.hit, p.miss, p.low, p.high))

    def step(v: np.ndarray, is_hit: np.ndarray) -> np.ndarray:
        unobserved = np.isnan(v)
        base = np.where(unobserved, np.float32(0), v)
        new = np.where(is_hit, np.minimum(base + hit, high), np.maximum(base + miss, low))
        if rules.clamp_only:
            return new
        stays = unobserved & rules.exclude_unobserved
        if rules.saturate is not None:
            stays |= ~unobserved & ((v <= np.float32(rules.saturate[0])) | (v >= np.float32(rules.saturate[1])))
        stays |= ~unobserved & (((v < p.threshold) & rules.exclude_free) | ((v >= p.threshold) & rules.exclude_occupied))
        return np.where(stays, v, new)

    return step


def reduce_run(voxel: np.ndarray, hit: np.ndarray, step: Step, p: MapParams, clamp_only: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Voxels of a run (updates in order), updates, known values (nan: none), and the updates after those as bits and their number."""
    order = np.lexsort((voxel[:, 2], voxel[:, 1], voxel[:, 0]))
    voxel, hit = voxel[order], hit[order]
    ptr = segments(voxel[:, 0], voxel[:, 1], voxel[:, 2])
    n = np.diff(ptr)
    low, high = (np.full(len(n), x, np.float32) for x in (p.low, p.high))
    known, since = np.full(len(n), np.nan, np.float32), np.zeros(len(n), np.int64)
    for t, (own, rows) in enumerate(side_by_side(ptr) if clamp_only else ()):
        low[own], high[own] = step(low[own], hit[rows]), step(high[own], hit[rows])
        met = own[low[own] == high[own]]
        known[met], since[met] = low[met], t + 1
    bits = n - since
    ops = [np.packbits(hit[a:b]).tobytes() if a < b else b"" for a, b in zip((ptr[:-1] + since).tolist(), ptr[1:].tolist(), strict=True)]
    return voxel[ptr[:-1]], n, known, ops, bits


def _reduce(p: MapParams, rules: Rules, exclude_origin: bool, exclude_sample: bool, exclude_ray: bool, end_as_free: bool):
    step = step_of(p, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            seq = batch.column(0).to_numpy()
            ends = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:7]], 1)
            fine = np.flatnonzero(np.isfinite(ends).all(1))
            size = np.cumsum(np.abs(ends[fine, 3:] - ends[fine, :3]).sum(1) / p.resolution + 4)
            cuts = np.searchsorted(size, np.arange(0, (size[-1] if len(size) else 0) + 4 * SLICE, 4 * SLICE))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own = fine[i:j]
                ray, voxel, _, _, sample = walk_arrays(ends[own, :3], ends[own, 3:], p)
                use = np.ones(len(ray), bool)
                if exclude_origin:
                    use[1:] = ray[1:] == ray[:-1]
                    use[:1] = False
                use &= ~sample if exclude_sample else sample if exclude_ray else True
                if not use.any():
                    continue
                hit = np.zeros(int(use.sum()), bool) if end_as_free else sample[use]
                at, n, known, ops, bits = reduce_run(voxel[use], hit, step, p, rules.clamp_only)
                m, part = len(n), part + 1
                columns = [*(pa.array(at[:, a].astype(np.int32)) for a in range(3)), pa.array(np.full(m, seq[own[0]], np.int64)), pa.array(np.full(m, part, np.int32)), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(known, pa.float32(), mask=np.isnan(known)), pa.array(ops, pa.binary()), pa.array(bits.astype(np.int32))], names=[c.split()[0] for c in _RUNS.split(", ")])

    return run


def _put_together(step: Step):
    """Rows in the order of voxels and runs; the state of the last voxel goes on into the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value, count = None, np.float32(np.nan), 0

        def out(keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            seen = ~np.isnan(values)  # excluded updates leave a voxel unobserved
            return pa.RecordBatch.from_arrays([*(pa.array(keys[seen, a].astype(np.int32)) for a in range(3)), pa.array(values[seen]), pa.array(counts[seen])], names=[*VOXEL, "occupancy", "n_ops"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            n, known, bits = batch.column(5).to_numpy(), batch.column(6).to_numpy(zero_copy_only=False), batch.column(8).to_numpy()
            ptr = segments(at[:, 0], at[:, 1], at[:, 2])
            start = np.full(len(ptr) - 1, np.nan, np.float32)
            counts = np.add.reduceat(n, ptr[:-1])
            if key is not None and tuple(at[0]) == key:
                start[0], counts[0] = value, counts[0] + count
            elif key is not None:
                yield out(np.array([key]), np.array([value], np.float32), np.array([count]))
            # from the last known value on
            segment = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
            rows = np.flatnonzero(~np.isnan(known))
            last = np.full(len(ptr) - 1, -1)
            last[segment[rows]] = rows
            start[last >= 0] = known[last[last >= 0]]
            use = np.flatnonzero((np.arange(len(at)) >= last[segment]) & (bits > 0))
            ops = [np.unpackbits(np.frombuffer(b, np.uint8), count=k) for b, k in zip(batch.column(7).take(pa.array(use)).to_pylist(), bits[use].tolist(), strict=True)]
            hit = np.concatenate([np.empty(0, np.uint8), *ops]).astype(bool)
            size = np.zeros(len(ptr) - 1, np.int64)
            np.add.at(size, segment[use], bits[use])
            for own, updates in side_by_side(np.concatenate([[0], np.cumsum(size)])):
                start[own] = step(start[own], hit[updates])
            key, value, count = tuple(at[-1]), start[-1], int(counts[-1])
            if len(start) > 1:
                yield out(at[ptr[:-2]], start[:-1], counts[:-1])
        if key is not None:
            yield out(np.array([key]), np.array([value], np.float32), np.array([count]))

    return run


def runs_of(rays: DataFrame, p: MapParams = MapParams(), rules: Rules = Rules(), *, exclude_origin: bool = False, exclude_sample: bool = False, exclude_ray: bool = False, end_as_free: bool = False) -> DataFrame:
    """A row a voxel and run: what the run's updates make of the voxel's value."""
    ranged = rays.select("seq", *_ENDS).repartitionByRange("seq").sortWithinPartitions("seq")
    return ranged.mapInArrow(_reduce(p, rules, exclude_origin, exclude_sample, exclude_ray, end_as_free), _RUNS)


def put_together(runs: DataFrame, p: MapParams = MapParams(), rules: Rules = Rules(), into: DataFrame | None = None) -> DataFrame:
    """gx, gy, gz, occupancy (float) and n_ops of runs_of(), of one set of rays or of several, on top of a map if there is one."""
    names = [c.split()[0] for c in _RUNS.split(", ")]
    runs = runs.select(*names)
    if into is not None:
        before = [F.lit(-(1 << 63)).cast("long").alias("run"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.col("occupancy").cast("float").alias("value"), F.lit(b"").alias("ops"), F.lit(0).alias("n_bits")]
        runs = into.select(*VOXEL, *before).unionByName(runs)
    dealt = runs.repartition(*VOXEL).sortWithinPartitions(*VOXEL, "run", "part")
    return dealt.mapInArrow(_put_together(step_of(p, rules)), "gx int, gy int, gz int, occupancy float, n_ops long")


def occupancy_map(rays: DataFrame, p: MapParams = MapParams(), rules: Rules = Rules(), into: DataFrame | None = None, **flags: bool) -> DataFrame:
    """gx, gy, gz, occupancy (float) and n_ops (updates by these rays), of all rays in the order of seq.

    Flags leave out the visits of the origin's voxel (exclude_origin), of the sample's (exclude_sample) or of all but the sample's
    (exclude_ray), or let samples clear (end_as_free). Rays with null or non-finite ends have no visits. into: the map that
    they change, if there is one.
    """
    return put_together(runs_of(rays, p, rules, **flags), p, rules, into)


def touch(voxels: DataFrame, keys: DataFrame, hit: bool, p: MapParams = MapParams()) -> DataFrame:
    """The map after one hit or miss on each of the given voxels."""
    value = p.hit if hit else p.miss
    both = voxels.select(*VOXEL, "occupancy").join(keys.select(*VOXEL, F.lit(True).alias("touched")), list(VOXEL), "full")
    new = (F.coalesce("occupancy", F.lit(0.0).cast("float")) + F.lit(value).cast("float")).cast("float")
    new = F.least(new, F.lit(p.high).cast("float")) if hit else F.greatest(new, F.lit(p.low).cast("float"))
    return both.select(*VOXEL, F.when(F.col("touched"), new).otherwise(F.col("occupancy")).alias("occupancy"))
