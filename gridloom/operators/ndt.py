"""Normal-distribution voxels: mean, covariance and intensity of the samples in each voxel.

moments() has them as plain aggregates of all samples; integrate() as the running state that
rays leave, where misses are weighed by the distribution and a voxel that empties starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.params import MapParams, log_odds
from gridloom.operators.fold import VOXEL, mean_step
from gridloom.operators.ordered import ordered_fold
from gridloom.operators.runs import segments
from gridloom.operators.walk import SLICE, centres, walk_arrays

_PAIRS = ((0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2))


def moments(visits: DataFrame) -> DataFrame:
    """Count, mean, population covariance (six entries) and intensity of the samples in each voxel. visits carry s and intensity.

    Sums of products merge by addition, so this aggregates on the map side and bears any skew of voxels.
    """
    samples = visits.where("sample")
    pairs = [("x", "x"), ("x", "y"), ("y", "y"), ("x", "z"), ("y", "z"), ("z", "z")]
    named = [F.covar_pop(f"s{a}", f"s{b}").alias(f"c{a}{b}") for a, b in pairs]
    return samples.groupBy(*VOXEL).agg(F.count("*").alias("n"), *[F.avg(f"s{a}").alias(f"m{a}") for a in "xyz"], *named, F.avg("intensity").alias("intensity_mean"), F.var_pop("intensity").alias("intensity_var"))


def ordered_moments(samples: DataFrame) -> DataFrame:
    """Count, mean and covariance of moments(), of samples with their voxel (gx, gy, gz), seq and s, added one by one in the order of seq.

    moments() merges parts in any order, so its last bits, and what lies at a limit, change from run to run; these do not.
    """

    def step(s: dict, u: dict, _: np.ndarray) -> dict:
        at = np.stack([u[f"s{a}"] for a in "xyz"], 1)
        n = s["n"] + 1
        gap = at - s["centre"]
        centre = s["centre"] + gap / n[:, None]
        rest = at - centre
        return {"n": n, "total": s["total"] + at, "centre": centre, "co": s["co"] + np.stack([gap[:, j] * rest[:, i] for i, j in _PAIRS], 1)}

    def finish(s: dict) -> dict:
        n = s["n"][:, None]
        mean, co = s["total"] / n, s["co"] / n
        return {"n": s["n"]} | {f"m{a}": np.ascontiguousarray(mean[:, i]) for i, a in enumerate("xyz")} | {f"c{'xyz'[i]}{'xyz'[j]}": np.ascontiguousarray(co[:, k]) for k, (i, j) in enumerate(_PAIRS)}

    init = lambda k: {"n": np.zeros(k, np.int64), "total": np.zeros((k, 3)), "centre": np.zeros((k, 3)), "co": np.zeros((k, 6))}
    schema = "n long, " + ", ".join(f"m{a} double" for a in "xyz") + ", " + ", ".join(f"c{'xyz'[i]}{'xyz'[j]} double" for i, j in _PAIRS)
    return ordered_fold(samples, ("sx", "sy", "sz"), ("seq",), init, step, finish, schema)


def hit_miss(visits: DataFrame) -> DataFrame:
    """How many rays ended in, and passed through, each voxel."""
    return visits.groupBy(*VOXEL).agg(F.count_if("sample").alias("hits"), F.count_if(~F.col("sample")).alias("misses"))


def eigen(voxels: DataFrame) -> DataFrame:
    """Principal axis lengths and the normal (least axis) of each voxel's covariance; Arrow batches of 3x3 matrices."""
    schema = "gx int, gy int, gz int, n long, l0 double, l1 double, l2 double, nx double, ny double, nz double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(k).to_numpy() for k in range(4, 10)]
            m = np.stack([c[0], c[1], c[3], c[1], c[2], c[4], c[3], c[4], c[5]], 1).reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(m) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            lead = vectors[:, :, 0]
            lead = lead * np.where(lead[np.arange(len(lead)), np.abs(lead).argmax(1)] < 0, -1.0, 1.0)[:, None] if len(lead) else lead
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(np.sqrt(np.maximum(values[:, i], 0))) for i in range(3)), *(pa.array(np.ascontiguousarray(lead[:, i])) for i in range(3))], names=[f.split()[0] for f in schema.split(", ")])

    return voxels.select(*VOXEL, "n", "cxx", "cxy", "cyy", "cxz", "cyz", "czz").mapInArrow(run, schema)


@dataclass(frozen=True)
class NdtParams:
    """adaptation: how strongly misses wear a distribution, from 0 to 1; None takes it from the chance of a miss."""

    least_samples: int = 3
    adaptation: float | None = None
    noise: float = 0.05
    reset_below: float = log_odds(0.2)
    reset_samples: int = 100
    intensity_var: float = 1.0


def adaptation_rate(p_miss: float) -> float:
    """The rate that makes a full miss as strong as an occupancy miss of this chance."""
    return min(max(2 * (1 - 2 * p_miss), 0.0), 1.0)


def _solve(root: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Solutions of L x = v for lower triangular matrices L, a row each."""
    x = v[:, 0] / root[:, 0, 0]
    y = (v[:, 1] - root[:, 1, 0] * x) / root[:, 1, 1]
    return np.stack([x, y, (v[:, 2] - root[:, 2, 0] * x - root[:, 2, 1] * y) / root[:, 2, 2]], 1)


def likelihoods(root: np.ndarray, mean: np.ndarray, sensor: np.ndarray, sample: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """At the likeliest point of each ray under the voxel's distribution: its likelihood given the voxel, and given the sample."""
    ray = sample - sensor
    ray = ray / np.maximum(np.linalg.norm(ray, axis=1), 1e-300)[:, None]
    a, b = _solve(root, ray), _solve(root, sensor - mean)
    likeliest = sensor - ray * ((a * b).sum(1) / (a * a).sum(1))[:, None]
    by_voxel = np.exp(-0.5 * (_solve(root, likeliest - mean) ** 2).sum(1))
    return by_voxel, np.exp(-0.5 * ((likeliest - sample) ** 2).sum(1) / noise**2)


def covariance_step(root: np.ndarray, n: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The triangular roots after one more sample: P' = n / (n + 1) P + n / (n + 1)**2 d d'; P itself where n is 0."""
    old, share = root.astype(float), n / (n + 1.0)
    new = np.where(n > 0, share, 1.0)[:, None, None] * (old @ old.transpose(0, 2, 1)) + (share / (n + 1.0))[:, None, None] * (delta[:, :, None] * delta[:, None, :])
    return np.linalg.cholesky(new).astype(np.float32)


def miss_change(root: np.ndarray, mean: np.ndarray, sensor: np.ndarray, sample: np.ndarray, rate: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds that a passing ray adds to a voxel with a distribution, and whether it counts as a miss."""
    by_voxel, by_sample = likelihoods(root, mean, sensor, sample, noise)
    product = by_voxel * (1 - by_sample)
    q = 0.5 - 0.5 * rate * product
    with np.errstate(divide="ignore"):
        return np.log(q / (1 - q)).astype(np.float32), product < 0.5 * rate


#: Voxels along the edge of a block: the unit in which rays are dealt to tasks.
BLOCK = 8
_PACKED = "bx int, by int, bz int, seq long, step int, ox double, oy double, oz double, sx double, sy double, sz double, intensity float, cells binary"
_ENDS = ("ox", "oy", "oz", "sx", "sy", "sz")


def _pack(seq: pa.Array, ends: np.ndarray, intensity: np.ndarray, ray: np.ndarray, step: np.ndarray, voxel: np.ndarray, sample: np.ndarray) -> pa.RecordBatch:
    """A row for each stay of a ray in a block: the ray, and the cells that it visits there, in order, with the sample's marked.

    seq, ends and intensity have a row a ray (the number in `ray`), step, voxel and sample one a visit.
    """
    block = voxel // BLOCK
    local = voxel - block * BLOCK
    cells = ((local[:, 0] * BLOCK + local[:, 1]) * BLOCK + local[:, 2] + np.where(sample, BLOCK**3, 0)).astype("<u2")
    ptr = segments(ray, block[:, 0], block[:, 1], block[:, 2])
    head, own = ptr[:-1], ray[ptr[:-1]]
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((2 * ptr).astype(np.int32).tobytes()), pa.py_buffer(cells.tobytes())])
    columns = [*(pa.array(block[head, a].astype(np.int32)) for a in range(3)), seq.take(pa.array(own)).cast(pa.int64()), pa.array(step[head].astype(np.int32))]
    columns += [*(pa.array(ends[own, a]) for a in range(6)), pa.array(intensity[own].astype(np.float32)), packed]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PACKED.split(", ")])


def _arrays(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[first : first + 6]], 1)
    return ends, batch.column(first + 6).to_numpy(zero_copy_only=False).astype(np.float32)


def integrate(visits: DataFrame, p: MapParams = MapParams(), ndt: NdtParams = NdtParams()) -> DataFrame:
    """Occupancy, quantised mean, covariance root (six entries by rows), intensity and hit and miss counts of each voxel.

    A passing ray lowers a voxel with enough samples by how likely it would have met the voxel's distribution; a sample
    raises it and moves the distribution, which starts anew once the voxel has become unlikely. All in the order of the
    rays. visits carry o, s and intensity; intensity and counts are those of the traversability mode.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, intensity = _arrays(batch, 6)
            voxel = np.stack([batch.column(k).to_numpy() for k in (2, 3, 4)], 1).astype(np.int64)
            ray = np.concatenate([[0], np.cumsum(segment_heads(batch.column(0).to_numpy(), *ends.T, intensity)[1:])]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
            lead = np.flatnonzero(np.diff(ray, prepend=-1))
            yield _pack(batch.column(0).take(pa.array(lead)), ends[lead], intensity[lead], ray, batch.column(1).to_numpy(), voxel, batch.column(5).to_numpy(zero_copy_only=False))

    return _fold(visits.select("seq", "step", *VOXEL, "sample", *_ENDS, "intensity").mapInArrow(run, _PACKED), p, ndt)


def segment_heads(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the one before."""
    heads = np.zeros(len(columns[0]), bool)
    heads[segments(*columns)[:-1]] = True
    return heads


def integrate_rays(rays: DataFrame, p: MapParams = MapParams(), ndt: NdtParams = NdtParams()) -> DataFrame:
    """integrate() of all visits of rays (with intensity), packed as they are walked. Rays with null or non-finite ends have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, intensity = _arrays(batch, 1)
            fine = np.flatnonzero(np.isfinite(ends).all(1))
            size = np.abs(ends[fine, 3:] - ends[fine, :3]).sum(1) / p.resolution + 4
            cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + SLICE, SLICE))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own = fine[i:j]
                if not len(own):
                    continue
                ray, voxel, _, _, sample = walk_arrays(ends[own, :3], ends[own, 3:], p)
                ptr = segments(ray)
                step = np.arange(len(ray)) - np.repeat(ptr[:-1], np.diff(ptr))
                yield _pack(batch.column(0).take(pa.array(own)), ends[own], intensity[own], ray, step, voxel, sample)

    return _fold(rays.select("seq", *_ENDS, "intensity").repartition("seq").mapInArrow(run, _PACKED), p, ndt)


def _fold(packed: DataFrame, p: MapParams, ndt: NdtParams) -> DataFrame:
    """The states that packed rays leave, block by block.

    A task has a block's rays in order and takes a batch of them at a time, with the states of the block's voxels carried
    on. Between two samples in a voxel its distribution stays and misses only lower it, so all those misses are one step:
    there are as many steps as a voxel has samples in a batch, each for all voxels side by side.
    """
    hit, miss, low, high = (np.float32(x) for x in (p.hit, p.miss, p.low, p.high))
    rate = adaptation_rate(p.p_miss) if ndt.adaptation is None else ndt.adaptation
    start = np.float32(0.1) * np.float32(p.resolution)
    size = BLOCK**3

    def init(k: int) -> dict:
        state = {"value": np.full(k, np.nan, np.float32), "n": np.zeros(k, np.int64), "bits": np.zeros((k, 3), np.int32), "root": np.tile(np.eye(3, dtype=np.float32) * start, (k, 1, 1))}
        return state | {"i_mean": np.zeros(k, np.float32), "i_var": np.zeros(k, np.float32), "hits": np.zeros(k, np.int64), "misses": np.zeros(k, np.int64)}

    def mean_of(s: dict, centre: np.ndarray, at: np.ndarray) -> np.ndarray:
        return s["bits"][at] * (p.resolution / 1023) - 0.5 * p.resolution + centre[at]

    def pass_through(s: dict, centre: np.ndarray, at: np.ndarray, sensor: np.ndarray, sample: np.ndarray) -> None:
        """Misses of voxels `at`, in order; a voxel may occur again and again."""
        fresh = np.isnan(s["value"][at])
        first = fresh & np.append(True, at[1:] != at[:-1])
        change, is_miss = np.full(len(at), miss), np.ones(len(at), bool)
        dense = np.flatnonzero(~first & (s["n"][at] >= ndt.least_samples))
        if len(dense):
            k = at[dense]
            change[dense], is_miss[dense] = miss_change(s["root"][k].astype(float), mean_of(s, centre, k), sensor[dense], sample[dense], rate, ndt.noise)
        s["value"][at[first]] = 0
        np.add.at(s["value"], at, change)  # one after the other, in single precision
        s["value"][at] = np.maximum(s["value"][at], low)
        np.add.at(s["misses"], at, is_miss.astype(np.int64))

    def end_in(s: dict, centre: np.ndarray, at: np.ndarray, sensor: np.ndarray, sample: np.ndarray, intensity: np.ndarray) -> None:
        """A sample in each of the voxels `at`, each once."""
        value, count, old, mean = s["value"][at], s["n"][at], s["root"][at], mean_of(s, centre, at)
        fresh = np.isnan(value)
        base = np.where(fresh, np.float32(np.inf), value)
        reset = (count == 0) | ((base < np.float32(ndt.reset_below)) & (count >= ndt.reset_samples))
        # counts: those of before the hit, with the distribution of before
        clear = fresh | reset
        with np.errstate(divide="ignore", invalid="ignore"):
            by_voxel, by_sample = likelihoods(old.astype(float), mean, sensor, sample, ndt.noise)
        product, eta = by_voxel * by_sample, 0.5 * rate
        enough = count >= ndt.least_samples
        s["hits"][at] = np.where(clear, 0, s["hits"][at]) + (clear | ~enough | (product >= eta))
        s["misses"][at] = np.where(clear, 0, s["misses"][at]) + (~clear & enough & (product < eta) & (by_voxel >= eta))
        # intensity
        c, i_mean = count.astype(np.float32), s["i_mean"][at]
        share, gap = np.float32(1) / (c + np.float32(1)), i_mean - intensity
        s["i_mean"][at] = np.where(reset, intensity, share * (c * i_mean + intensity))
        s["i_var"][at] = np.where(reset, np.float32(ndt.intensity_var), share * (c * s["i_var"][at] + share * gap * gap))
        # distribution, value and mean
        root = np.where(reset[:, None, None], np.eye(3, dtype=np.float32) * start, old)
        count = np.where(reset, 0, count)
        s["root"][at] = covariance_step(root, count, np.where(reset[:, None], 0.0, sample - mean))
        s["value"][at] = np.minimum(np.where(fresh, np.float32(0), value) + hit, high)
        s["bits"][at] = mean_step(s["bits"][at], count, sample - centre[at], p.resolution)
        s["n"][at] = count + 1

    def update(s: dict, centre: np.ndarray, voxel: np.ndarray, is_hit: np.ndarray, sensor: np.ndarray, sample: np.ndarray, intensity: np.ndarray) -> None:
        """Visits in order, of numbered voxels; sensor, sample and intensity have a row a visit."""
        order = np.argsort(voxel.astype(np.uint16) if len(centre) <= 1 << 16 else voxel, kind="stable")
        voxel, is_hit = voxel[order], is_hit[order]
        ptr = segments(voxel)
        turn = np.cumsum(is_hit) - is_hit if miss <= 0 else np.arange(len(voxel))
        turn = turn - np.repeat(turn[ptr[:-1]], np.diff(ptr))
        by_turn = np.argsort(2 * turn + is_hit, kind="stable")  # in a turn the misses, then the sample after them
        cuts = np.searchsorted((2 * turn + is_hit)[by_turn], np.arange(2 * int(turn.max(initial=-1)) + 4))
        for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if i < j:
                at, rows = voxel[by_turn[i:j]], order[by_turn[i:j]]
                if k % 2:
                    end_in(s, centre, at, sensor[rows], sample[rows], intensity[rows])
                else:
                    pass_through(s, centre, at, sensor[rows], sample[rows])

    def out(voxel: np.ndarray, s: dict) -> pa.RecordBatch:
        root = {f"r{i}{j}": np.ascontiguousarray(s["root"][:, i, j]) for i in range(3) for j in range(i + 1)}
        made = {"occupancy": s["value"], "n_samples": s["n"]} | {f"m{a}": np.ascontiguousarray(s["bits"][:, i]) for i, a in enumerate("xyz")} | root
        made |= {"intensity_mean": s["i_mean"], "intensity_var": s["i_var"], "hits": s["hits"], "misses": s["misses"]}
        return pa.RecordBatch.from_arrays([*(pa.array(voxel[:, a].astype(np.int32)) for a in range(3)), *(pa.array(x) for x in made.values())], names=[*VOXEL, *made])

    def voxels_of(block: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return block * BLOCK + np.stack([cell // BLOCK**2, cell // BLOCK % BLOCK, cell % BLOCK], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, None, None  # the last block, and the states of its voxels

        def rest() -> pa.RecordBatch:
            cell = np.flatnonzero(seen)
            return out(voxels_of(np.array([key]), cell), {f: v[cell] for f, v in held.items()})

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy() for k in range(3)], 1).astype(np.int64)
            ends, intensity = _arrays(batch, 5)
            packed = batch.column(12).cast(pa.binary())
            offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
            cells = np.frombuffer(packed.buffers()[2], "<u2", count=(offsets[-1] - offsets[0]) // 2, offset=int(offsets[0])).astype(np.int64)
            row = np.repeat(np.arange(len(at)), np.diff(offsets) // 2)
            ptr = segments(at[:, 0], at[:, 1], at[:, 2])
            blocks = at[ptr[:-1]]
            code = np.repeat(np.arange(len(blocks)), np.diff(ptr))[row] * size + cells % size
            met = np.zeros(len(blocks) * size, bool)
            met[code] = True
            codes, number = np.flatnonzero(met), np.cumsum(met) - 1
            block, cell = codes // size, codes % size
            voxel = voxels_of(blocks[block], cell)
            state = init(len(codes))
            goes_on = key is not None and tuple(at[0]) == key
            if goes_on:
                first = block == 0
                for f in state:
                    state[f][first] = held[f][cell[first]]
            elif key is not None:
                yield rest()
            update(state, np.stack([centres(voxel[:, a], p, a) for a in range(3)], 1), number[code], cells >= size, ends[row, :3], ends[row, 3:], intensity[row])
            last = len(blocks) - 1
            done = np.flatnonzero((block < last) & ((block > 0) | (not goes_on)))
            for b in range(last + 1) if last < 1 else (0, last):
                if b == 0 and not goes_on and last > 0:
                    continue
                if b > 0 and goes_on:
                    yield rest()
                if b > 0 or not goes_on:
                    held, seen = init(size), np.zeros(size, bool)
                own = block == b
                for f in state:
                    held[f][cell[own]] = state[f][own]
                seen[cell[own]] = True
                key = tuple(blocks[b])
            if len(done):
                yield out(voxel[done], {f: v[done] for f, v in state.items()})
        if key is not None:
            yield rest()

    roots = ", ".join(f"r{i}{j} float" for i in range(3) for j in range(i + 1))
    schema = f"gx int, gy int, gz int, occupancy float, n_samples long, mx int, my int, mz int, {roots}, intensity_mean float, intensity_var float, hits long, misses long"
    dealt = packed.repartition("bx", "by", "bz").sortWithinPartitions("bx", "by", "bz", "seq", "step")
    return dealt.mapInArrow(run, schema)


def covariance(voxels: DataFrame) -> DataFrame:
    """cxx to czz of voxels with covariance roots: root times its transpose."""
    pairs = [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]
    entry = lambda i, j: sum((F.col(f"r{max(i, k)}{min(i, k)}") * F.col(f"r{max(j, k)}{min(j, k)}") for k in range(min(i, j) + 1)), F.lit(0.0))
    return voxels.withColumns({f"c{'xyz'[i]}{'xyz'[j]}": entry(i, j) for i, j in pairs})


def inside_ellipsoid(points: DataFrame, voxels: DataFrame, p: MapParams = MapParams(), limit: float = 3.0) -> DataFrame:
    """Points whose squared Mahalanobis distance to their voxel's distribution is under the limit; the 3x3 inverse in closed form."""
    from gridloom.functions.exprs import key

    keyed = points.withColumns({g: F.expr(key(a, p, i)) for i, (g, a) in enumerate(zip(VOXEL, "xyz", strict=True))})
    met = keyed.join(voxels.where("n >= 4"), list(VOXEL))
    eps = (p.resolution / 10) ** 2  # 1e-4 at 0.1 m to the last bit
    a, b, c, d, e, f = F.col("cxx") + eps, F.col("cxy"), F.col("cxz"), F.col("cyy") + eps, F.col("cyz"), F.col("czz") + eps
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    x, y, z = (F.col(v) - F.col(f"m{v}") for v in "xyz")
    q = (x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * (x * y * (c * e - b * f) + x * z * (b * e - c * d) + y * z * (b * c - a * e))) / det
    return met.where(q < limit).select(*points.columns)
