"""Ray sets from tables: each row an origin, a sample, a time and an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The mapping of the events table to rays, by arithmetic on its columns.
RAY_COLUMNS = {
    "seq": "event_id",
    "ox": "(user_id % 7) * 0.31e0 - 0.93e0",
    "oy": "(user_id % 5) * 0.27e0 - 0.54e0",
    "oz": "0.5e0 + (user_id % 3) * 0.1e0",
    "sx": "((user_id % 7) * 0.31e0 - 0.93e0) + ((event_id * 37) % 101 - 50) * 0.05e0",
    "sy": "((user_id % 5) * 0.27e0 - 0.54e0) + ((event_id * 53) % 97 - 48) * 0.05e0",
    "sz": "(0.5e0 + (user_id % 3) * 0.1e0) + ((event_id * 71) % 41 - 20) * 0.05e0",
    "intensity": "CAST(value AS FLOAT)",
    "return_number": "CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END",
}


def event_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ox..oz, sx..sz, intensity, return_number and ts (seconds since the first event)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = events.agg(F.min("ts").alias("t0"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    return events.crossJoin(F.broadcast(first)).select(*[F.expr(e).alias(n) for n, e in RAY_COLUMNS.items()], (micros / 1e6).alias("ts"))


def trajectory(rays: DataFrame) -> DataFrame:
    """One knot of a sensor path for each 50th event; equal times keep the first."""
    knots = rays.where("seq % 50 = 0").select("ts", "seq")
    one = knots.groupBy("ts").agg(F.min("seq").alias("seq"))
    return one.select("ts", (F.lit(0.01) * F.col("seq") / 50).alias("x"), (F.expr("(seq DIV 50) % 20") * F.lit(0.05)).alias("y"), F.lit(0.5).alias("z"))


def brackets(points: DataFrame, path: DataFrame, columns: tuple[str, ...], bucket_s: float) -> DataFrame:
    """points, each with the knots before (k_*) and after (n_*) its time; null outside the path.

    A bracket is a pair of neighbouring knots; points and brackets meet on buckets of time, so the join is an
    equi-join that shuffles by bucket, and no pair outside a bracket's own buckets is formed.
    """
    every = ("ts", *columns)
    knots = path.select(*every).withColumn("b", F.floor(F.col("ts") / bucket_s))
    inner = Window.partitionBy("b").orderBy("ts")
    knots = knots.withColumns({f"n_{c}": F.lead(c).over(inner) for c in every})
    # a bucket's last knot is followed by the first of a later bucket; one row a bucket meets in the second window
    heads = knots.groupBy("b").agg(F.min_by(F.struct(*every), "ts").alias("head"))
    ahead = heads.select(F.col("b"), F.lead("head").over(Window.orderBy("b")).alias("then"))
    full = knots.join(ahead, "b").select(*every, *[F.coalesce(f"n_{c}", f"then.{c}").alias(f"n_{c}") for c in every])
    spans = full.where("n_ts IS NOT NULL").withColumn("b", F.explode(F.sequence(F.floor(F.col("ts") / bucket_s), F.floor(F.col("n_ts") / bucket_s))))
    spans = spans.select("b", *[F.col(c).alias(f"k_{c}") for c in every], *[f"n_{c}" for c in every])
    p = points.withColumn("b", F.floor(F.col("ts") / bucket_s))
    return p.join(spans, (p["b"] == spans["b"]) & (p["ts"] >= spans["k_ts"]) & (p["ts"] < spans["n_ts"]), "left").drop("b")


_SHARE = "(ts - k_ts) / (n_ts - k_ts)"


def attach_trajectory(points: DataFrame, path: DataFrame, bucket_s: float = 3600.0) -> DataFrame:
    """Sensor positions at the points' times, linear between the two knots around each; zero outside the path."""
    met = brackets(points, path, ("x", "y", "z"), bucket_s)
    return met.select(*points.columns, *[F.coalesce(F.expr(f"k_{c} + {_SHARE} * (n_{c} - k_{c})"), F.lit(0.0)).alias(f"sensor_{c}") for c in ("x", "y", "z")])


def attach_pose(points: DataFrame, path: DataFrame, bucket_s: float = 3600.0) -> DataFrame:
    """Local points x, y, z moved by the sensor's pose at their time; path has x, y, z and a unit quaternion qw, qx, qy, qz.

    Positions are linear and rotations spherical between knots (the shorter way round); points outside the path
    have null results.
    """
    q = ("qw", "qx", "qy", "qz")
    met = brackets(points, path, ("x", "y", "z", *q), bucket_s).withColumn("u", F.expr(_SHARE))
    met = met.withColumn("dot", F.expr(" + ".join(f"k_{c} * n_{c}" for c in q)))
    met = met.withColumn("angle", F.acos(F.least(F.lit(1.0), F.abs("dot"))))
    near = F.col("angle") < 1e-6
    w0 = F.when(near, 1 - F.col("u")).otherwise(F.sin((1 - F.col("u")) * F.col("angle")) / F.sin("angle"))
    w1 = F.when(near, F.col("u")).otherwise(F.sin(F.col("u") * F.col("angle")) / F.sin("angle")) * F.when(F.col("dot") < 0, -1.0).otherwise(1.0)
    met = met.withColumns({"w0": w0, "w1": w1}).withColumns({f"r_{c}": F.expr(f"w0 * k_{c} + w1 * n_{c}") for c in q})
    # v + 2 w (q x v) + 2 q x (q x v)
    met = met.withColumns({"cx": F.expr("r_qy * z - r_qz * y"), "cy": F.expr("r_qz * x - r_qx * z"), "cz": F.expr("r_qx * y - r_qy * x")})
    turned = {"x": "x + 2 * (r_qw * cx + r_qy * cz - r_qz * cy)", "y": "y + 2 * (r_qw * cy + r_qz * cx - r_qx * cz)", "z": "z + 2 * (r_qw * cz + r_qx * cy - r_qy * cx)"}
    return met.select(*points.columns, *[F.expr(f"k_{a} + u * (n_{a} - k_{a}) + {turned[a]}").alias(f"w{a}") for a in "xyz"])


def motion_batches(rays: DataFrame, part: str, size: int = 4096, delta: float = 0.0) -> DataFrame:
    """A batch number for each ray: a new batch after `size` rays, or where the sensor moved more than delta from the batch's first origin.

    Rays of a part are streamed in the order of seq; a task holds the state of one batch.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, filled, start = object(), 0, 0, (0.0, 0.0, 0.0)
        for batch in batches:
            out = []
            for p, x, y, z in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                moved = (x - start[0]) ** 2 + (y - start[1]) ** 2 + (z - start[2]) ** 2
                if p != own:
                    own, number, filled, start = p, 0, 0, (x, y, z)
                elif filled >= size or (delta > 0 and moved > delta * delta):
                    number, filled, start = number + 1, 0, (x, y, z)
                filled += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.int64())], names=[part, "seq", "batch"])

    rows = rays.select(part, "seq", "ox", "oy", "oz").repartition(part).sortWithinPartitions(part, "seq")
    return rows.mapInArrow(run, f"{part} {rays.schema[part].dataType.simpleString()}, seq long, batch long")


def infer_returns(rays: DataFrame, part: str = "user_id_part") -> DataFrame:
    """return_number 1 where the sample before (by seq, within part) has the same time, and that sample as the origin."""
    w = Window.partitionBy(part).orderBy("seq")
    same = F.coalesce(F.lag("ts").over(w) == F.col("ts"), F.lit(False))
    back = [F.when(same, F.lag(f"s{a}").over(w)).otherwise(F.col(f"o{a}")).alias(f"o{a}") for a in "xyz"]
    return rays.select("seq", part, "ts", *back, "sx", "sy", "sz", same.cast("int").alias("inferred_return"))


def transform_points(points: DataFrame, rotation: tuple[float, float, float, float], scale: float, shift: tuple[float, float, float]) -> DataFrame:
    """Rotation (unit quaternion w, x, y, z) of scaled x, y, z, then a shift."""
    w, qx, qy, qz = rotation
    m = [
        [1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - w * qz), 2 * (qx * qz + w * qy)],
        [2 * (qx * qy + w * qz), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - w * qx)],
        [2 * (qx * qz - w * qy), 2 * (qy * qz + w * qx), 1 - 2 * (qx * qx + qy * qy)],
    ]
    p = [F.col(a) * scale for a in "xyz"]
    return points.withColumns({a: m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + shift[i] for i, a in enumerate("xyz")})


def filter_good(rays: DataFrame, max_length: float = 0.0) -> DataFrame:
    """Rays without NaN or infinite coordinates, and at most max_length long (0: any length)."""
    from gridloom.functions.exprs import RAY_LENGTH

    finite = F.lit(True)
    for c in ("ox", "oy", "oz", "sx", "sy", "sz"):
        finite &= ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = rays.where(finite)
    return kept.where(F.expr(RAY_LENGTH) <= max_length) if max_length else kept


def clip_length(rays: DataFrame, max_length: float) -> DataFrame:
    """Samples farther than max_length are pulled in; clipped_end marks them."""
    from gridloom.functions.exprs import RAY_LENGTH, num

    share = F.expr(f"CASE WHEN {RAY_LENGTH} > {num(max_length)} THEN {num(max_length)} / {RAY_LENGTH} ELSE 1e0 END")
    out = rays.withColumn("share", share)
    return out.withColumns({f"s{a}": F.when(F.col("share") < 1, F.col(f"o{a}") + (F.col(f"s{a}") - F.col(f"o{a}")) * F.col("share")).otherwise(F.col(f"s{a}")) for a in "xyz"} | {"clipped_end": F.col("share") < 1}).drop("share")


def clip_box(rays: DataFrame, box: tuple[tuple[float, ...], tuple[float, ...]]) -> DataFrame:
    """Parts of rays inside a box; rays that miss it stay as they are."""
    from gridloom.functions.exprs import slab

    near, far = slab(box)
    out = rays.withColumns({"t_in": F.expr(near), "t_out": F.expr(far)})
    met = F.col("t_in") <= F.col("t_out")
    cut = {f"o{a}": F.when(met & (F.col("t_in") > 0), F.col(f"o{a}") + (F.col(f"s{a}") - F.col(f"o{a}")) * F.col("t_in")).otherwise(F.col(f"o{a}")) for a in "xyz"}
    cut |= {f"s{a}": F.when(met & (F.col("t_out") < 1), F.col(f"o{a}") + (F.col(f"s{a}") - F.col(f"o{a}")) * F.col("t_out")).otherwise(F.col(f"s{a}")) for a in "xyz"}
    return out.withColumns(cut | {"clipped_start": met & (F.col("t_in") > 0), "clipped_end": met & (F.col("t_out") < 1)}).drop("t_in", "t_out")


def split_long(rays: DataFrame, max_length: float) -> DataFrame:
    """Rays in equal parts of at most max_length, numbered; all parts but the last are clipped at the end."""
    from gridloom.functions.exprs import RAY_LENGTH, num

    parts = rays.withColumn("parts", F.expr(f"greatest(1, CAST(ceil({RAY_LENGTH} / {num(max_length)}) AS INT))")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    at = lambda a, k: F.col(f"o{a}") + (F.col(f"s{a}") - F.col(f"o{a}")) * k / F.col("parts")
    ends = {f"o{a}": at(a, F.col("part")) for a in "xyz"} | {f"s{a}": F.when(F.col("part") + 1 == F.col("parts"), F.col(f"s{a}")).otherwise(at(a, F.col("part") + 1)) for a in "xyz"}
    return parts.withColumns(ends | {"clipped_end": F.col("part") + 1 < F.col("parts")}).drop("parts")


# Flags of filtered rays.
INVALID, CLIPPED_START, CLIPPED_END = 1, 2, 4


def flag_filter(rays: DataFrame, max_length: float = 0.0, box: tuple[tuple[float, ...], tuple[float, ...]] | None = None, mask: tuple[tuple[float, ...], tuple[float, ...]] | None = None) -> DataFrame:
    """Rays with a `flags` column instead of being left out: bad ones INVALID, those clipped to a length or a box at that end.

    A sample inside the mask is flagged as clipped and not moved, so that it does not fill a voxel.
    """
    finite = F.lit(True)
    for c in ("ox", "oy", "oz", "sx", "sy", "sz"):
        finite &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = rays.withColumn("flags", F.when(finite, 0).otherwise(INVALID))
    for clip in ((clip_length, max_length) if max_length else None, (clip_box, box) if box else None):
        if clip is not None:
            out = clip[0](out, clip[1])
            start = F.when(F.col("clipped_start"), CLIPPED_START).otherwise(0) if "clipped_start" in out.columns else F.lit(0)
            out = out.withColumn("flags", F.col("flags").bitwiseOR(start).bitwiseOR(F.when(F.col("clipped_end"), CLIPPED_END).otherwise(0))).drop("clipped_start", "clipped_end")
    if mask is not None:
        inside = F.lit(True)
        for a, low, high in zip("xyz", *mask, strict=True):
            inside &= F.col(f"s{a}").between(low, high)
        out = out.withColumn("flags", F.col("flags").bitwiseOR(F.when(inside, CLIPPED_END).otherwise(0)))
    return out


def limited(rays: DataFrame, start_time: float = 0.0, time_limit: float = 0.0, point_limit: int = 0) -> DataFrame:
    """Rays from a time on, for so long, and the first so many of those by seq (0: no limit)."""
    out = rays.where(F.col("ts") >= start_time) if start_time else rays
    out = out.where(F.col("ts") - start_time <= time_limit) if time_limit else out
    return out.orderBy("seq").limit(point_limit) if point_limit else out


def first_time(rays: DataFrame) -> DataFrame:
    """The time of the first ray by seq, which is the base of touch times (not the earliest time)."""
    return rays.agg(F.min_by("ts", "seq").alias("first_time"))


def late(rays: DataFrame, chunk: int = 65_536) -> DataFrame:
    """seq of the rays whose time lies before that of an earlier ray: a source that only moves forward can't place them.

    The highest time so far is carried from chunk to chunk of seq, one row a chunk.
    """
    own = rays.select("seq", "ts", F.floor(F.col("seq") / chunk).alias("chunk"))
    tops = own.groupBy("chunk").agg(F.max("ts").alias("top"))
    before = tops.select("chunk", F.max("top").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.max("ts").over(Window.partitionBy("chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return own.join(before, "chunk").withColumn("top", F.greatest("before", inside)).where("ts < top").select("seq")


def rays_from_cloud(points: DataFrame, path: DataFrame | None = None, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Rays of a point cloud (seq, ts, x, y, z): from the sensor's path where there is one, from the fixed offset where not.

    Points outside the path's time have their origin at zero.
    """
    if path is None:
        return points.withColumnsRenamed({a: f"s{a}" for a in "xyz"}).withColumns({f"o{a}": F.lit(float(d)) for a, d in zip("xyz", offset, strict=True)})
    met = attach_trajectory(points, path)
    moved = {f"o{a}": F.col(f"sensor_{a}") + d for a, d in zip("xyz", offset, strict=True)}
    return met.withColumns(moved).withColumnsRenamed({a: f"s{a}" for a in "xyz"}).drop("sensor_x", "sensor_y", "sensor_z")


def rays_from_ray_cloud(points: DataFrame) -> DataFrame:
    """Rays of a cloud whose normals point from the sample back to the sensor (nx, ny, nz, at full length)."""
    return points.withColumns({f"o{a}": F.col(a) + F.col(f"n{a}") for a in "xyz"}).withColumnsRenamed({a: f"s{a}" for a in "xyz"}).drop("nx", "ny", "nz")
