"""Further named queries; their SQL writes out the map's numbers (0.1 m voxels, 3.2 m regions) instead of sharing expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import boxes, colours, exprs, keys, names
from gridloom.functions.params import MapParams
from gridloom.operators import clouds, fold, heightmap, maps, ndt, runs, spatial
from gridloom.operators.walk import walk
from gridloom.plans import catalog, oracles
from gridloom.plans.catalog import BOX, QUERIES, SQL, P, as_double, points_of, query, rays_of, rounded, voxels_of
from gridloom.sources import generators
from gridloom.sources import rays as sources

__all__ = ["QUERIES", "SQL"]
_RAYS, _BASE, _VISITS, _TWO = catalog._RAYS, catalog._BASE, catalog._VISITS, catalog._TWO
_SAMPLE_KEYS = ", ".join(f"{e} AS {n}" for n, e in catalog._KEYS.items())
_ORIGIN_KEYS = ", ".join(f"{exprs.key(f'o{a}', P, i)} AS h{a}" for i, a in enumerate("xyz"))
_K = f"{_RAYS}, k AS (SELECT *, {_SAMPLE_KEYS}, {_ORIGIN_KEYS} FROM rays)"
_XYZ = ", ".join(f"round((g{a} - 15.5e0) * 0.1e0, 6) AS {a}" for a in "xyz")
G = ("gx", "gy", "gz")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays with the keys of their sample (g) and origin (h)."""
    r = rays_of(spark, sf_dir)
    return r.withColumns({n: F.expr(e) for n, e in catalog._KEYS.items()} | {f"h{a}": F.expr(exprs.key(f"o{a}", P, i)) for i, a in enumerate("xyz")})


def _three(prefix: str) -> keys.Key:
    return tuple(F.col(f"{prefix}{a}") for a in "xyz")  # type: ignore[return-value]


# keys


@query(f"{_K} SELECT seq, (gx + 40)::INT AS mx, (gy - 3)::INT AS my, (gz + 1)::INT AS mz, floor((gx + 40) / 32e0)::INT AS rx, (gx + 40 - 32 * floor((gx + 40) / 32e0))::INT AS lx, gx - hx AS dx, gy - hy AS dy, gz - hz AS dz FROM k")
def key_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys moved over regions, and the range from each ray's origin to its sample."""
    k = _keyed(spark, sf_dir)
    to, between = keys.moved(keys.stepped(_three("g"), 2), (40, -3, 0)), keys.range_between(_three("h"), _three("g"))
    return k.select("seq", *[c.alias(f"m{a}") for c, a in zip(to, "xyz", strict=True)], keys.region_part(to[0]).alias("rx"), keys.local_part(to[0]).alias("lx"), *[c.alias(f"d{a}") for c, a in zip(between, "xyz", strict=True)])


@query(f"{_K} SELECT seq, gx BETWEEN 8 AND 24 AND gy BETWEEN 8 AND 24 AND gz BETWEEN 12 AND 28 AS inside, gz BETWEEN 12 AND 28 AS inside_z, greatest(8, least(24, gx)) AS cx, greatest(8, least(24, gy)) AS cy, gz AS cz, gx = hx AS same_x FROM k")
def key_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi, g = (8, 8, 12), (24, 24, 28), _three("g")
    c = keys.clamped(g, lo, hi, axes=(0, 1))
    return _keyed(spark, sf_dir).select("seq", keys.bounded(g, lo, hi).alias("inside"), keys.bounded(g, lo, hi, (2,)).alias("inside_z"), *[x.alias(f"c{a}") for x, a in zip(c, "xyz", strict=True)], keys.equal_on(g, _three("h"), 0).alias("same_x"))


@query(f"{_K}, e AS (SELECT min(gx) AS x0, max(gx) AS x1, min(gy) AS y0, max(gy) AS y1, min(gz) AS z0, max(gz) AS z1 FROM k) SELECT row_number() OVER (ORDER BY z, y, x) - 1 AS index, x::INT AS gx, y::INT AS gy, z::INT AS gz FROM (SELECT unnest(range(x0, x1 + 1)) AS x FROM e), (SELECT unnest(range(y0, y1 + 1)) AS y FROM e), (SELECT unnest(range(z0, z1 + 1)) AS z FROM e)")
def key_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of the box of all samples' voxels, by its place in it."""
    k = _keyed(spark, sf_dir)
    box = k.agg(*[f(g).alias(f"{n}{g}") for g in G for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    lo, size = tuple(F.col(f"lo_{g}") for g in G), tuple(F.col(f"hi_{g}") - F.col(f"lo_{g}") + 1 for g in G)
    every = box.select("*", F.explode(F.sequence(F.lit(0).cast("long"), keys.volume_of(size) - 1)).alias("index"))
    return every.select("index", *[c.alias(g) for c, g in zip(keys.from_index(F.col("index"), lo, size), G, strict=True)])


@query(f"{_K} SELECT seq, (gx - 32 * floor(gx / 32e0))::INT + 32 * (gy - 32 * floor(gy / 32e0))::INT + 1024 * (gz - 32 * floor(gz / 32e0))::INT AS place, power(2, ceil(log2(greatest(1, abs(gx - hx) + abs(gy - hy) + abs(gz - hz)))))::BIGINT AS room FROM k")
def voxel_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each sample's voxel in its region, and the power of two that holds the ray's steps."""
    steps = sum((F.abs(d) for d in keys.range_between(_three("h"), _three("g"))), F.lit(0))
    return _keyed(spark, sf_dir).select("seq", keys.voxel_index(_three("g")).alias("place"), keys.next_power_of_two(steps).alias("room"))


@query("SELECT value::INT AS value, CASE value WHEN -2 THEN 'null' WHEN -1 THEN 'uncertain' WHEN 0 THEN 'free' WHEN 1 THEN 'occupied' ELSE '<unknown>' END AS occupancy, CASE value WHEN 0 THEN 'none' WHEN 1 THEN 'occupancy' WHEN 2 THEN 'traversability' ELSE '<unknown>' END AS ndt_mode, CASE value WHEN 0 THEN 'planar' WHEN 1 THEN 'fill' WHEN 2 THEN 'layered-unordered' WHEN 3 THEN 'layered' ELSE '<unknown>' END AS heightmap_mode, CASE WHEN value < 0 THEN 'None' WHEN value & 1 = 1 THEN 'VoxelMean' WHEN value & 2 = 2 THEN 'Compressed' WHEN value & 4 = 4 THEN 'Traversal' ELSE 'None' END AS flag FROM range(-3, 17) t(value)")
def enum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return spark.range(-3, 17).select(F.col("id").cast("int").alias("value")).select("value", names.name_of(v, names.OCCUPANCY_TYPES).alias("occupancy"), names.name_of(v, names.NDT_MODES).alias("ndt_mode"), names.name_of(v, names.HEIGHTMAP_MODES).alias("heightmap_mode"), F.when(v < 0, names.NO_FLAG).otherwise(names.flag_name(v)).alias("flag"))


@query("SELECT * FROM (VALUES ('dims', 'int64', '32', 32e0), ('frame', 'string', 'odom', NULL), ('has_mean', 'bool', 'true', 1e0), ('resolution', 'float64', '0.1', 0.1e0)) t(name, type, value, number)")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.as_number(maps.info_rows(spark, {"resolution": 0.1, "frame": "odom", "has_mean": True, "dims": 32}))


@query(f"{_RAYS} SELECT seq, round(least(ox, sx) * 2 + 1, 6) AS lx, round(greatest(oz, sz) * 2 - 1, 6) AS hz, abs(ox - sx) <= 0.5e0 AND abs(oy - sy) <= 0.5e0 AND abs(oz - sz) <= 0.5e0 AS small FROM rays")
def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of rays, scaled and moved, and whether their corners are equal up to half a metre."""
    box = (tuple(f"least(o{a}, s{a})" for a in "xyz"), tuple(f"greatest(o{a}, s{a})" for a in "xyz"))
    made = boxes.moved(boxes.scaled(box, "2e0"), ("1e0", "0e0", "-1e0"))
    return rounded(rays_of(spark, sf_dir).selectExpr("seq", f"{made[0][0]} AS lx", f"{made[1][2]} AS hz", f"{boxes.equal((box[0], box[0]), (box[1], box[1]), '0.5e0')} AS small"), "lx", "hz")


# rays


_LEN = "sqrt((sx - ox) * (sx - ox) + (sy - oy) * (sy - oy) + (sz - oz) * (sz - oz))"


@query(f"{_RAYS}, c AS (SELECT seq, ox, oy, oz, {_LEN} AS len, CASE WHEN {_LEN} > 2e0 THEN ox + (sx - ox) * 2 / {_LEN} ELSE sx END AS sx, CASE WHEN {_LEN} > 2e0 THEN oy + (sy - oy) * 2 / {_LEN} ELSE sy END AS sy, CASE WHEN {_LEN} > 2e0 THEN oz + (sz - oz) * 2 / {_LEN} ELSE sz END AS sz FROM rays) SELECT seq, CASE WHEN len > 2e0 OR (sx BETWEEN -0.5e0 AND 0.5e0 AND sy BETWEEN -0.5e0 AND 0.5e0 AND sz BETWEEN 0e0 AND 0.5e0) THEN 4 ELSE 0 END AS flags, round(sx, 6) AS sx FROM c")
def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays clipped to 2 m, with samples in a masked box flagged, all kept."""
    return rounded(sources.flag_filter(rays_of(spark, sf_dir), 2.0, mask=((-0.5, -0.5, 0.0), (0.5, 0.5, 0.5))).select("seq", "flags", "sx"), "sx")


@query(f"{_RAYS} SELECT seq FROM rays WHERE ts >= 1000e0 AND ts - 1000e0 <= 2e6 ORDER BY seq LIMIT 2000")
def input_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a time on, for so long, and the first 2000 of those: the limits are the feature."""
    return sources.limited(rays_of(spark, sf_dir), 1000.0, 2e6, 2000).select("seq")


@query(f"{_RAYS} SELECT round(min_by(ts, seq), 6) AS first_time FROM rays")
def event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sources.first_time(rays_of(spark, sf_dir)), "first_time")


@query(f"{_RAYS} SELECT seq FROM rays QUALIFY ts < max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def late_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.late(rays_of(spark, sf_dir), 512)


@query(f"{_K} SELECT seq, {_LEN} > 2e0 AS clipped, gz, gy, gx, hz, hy, hx FROM k")
def ray_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays in the order that keeps voxels together: whole ones first, by sample and origin key; ranges of it a task."""
    k = _keyed(spark, sf_dir).withColumn("clipped", F.expr(f"{exprs.RAY_LENGTH} > 2e0"))
    order = ("clipped", "gz", "gy", "gx", "hz", "hy", "hx")
    return k.repartitionByRange(*order, "seq").sortWithinPartitions(*order, "seq").select("seq", *order)


@query(f"{_K} SELECT t.seq, round(t.sx, 6) AS sx, round(CASE WHEN k.ts IS NULL THEN 0e0 ELSE x + (t.ts - k.ts) / (nts - k.ts) * (nx - x) END + 0.25e0, 6) AS ox FROM k t LEFT JOIN (SELECT *, lead(ts) OVER (ORDER BY ts) AS nts, lead(x) OVER (ORDER BY ts) AS nx FROM (SELECT ts, 0.01e0 * min(seq) / 50 AS x FROM rays WHERE seq % 50 = 0 GROUP BY ts)) k ON t.ts >= k.ts AND t.ts < k.nts")
def rays_of_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays of a point cloud with the sensor's path and its offset."""
    rays = rays_of(spark, sf_dir)
    points = rays.selectExpr("seq", "ts", "sx AS x", "sy AS y", "sz AS z")
    return rounded(sources.rays_from_cloud(points, sources.trajectory(rays), (0.25, 0.0, 0.0)).select("seq", "sx", "ox"), "sx", "ox")


@query("SELECT (CASE WHEN ring = 0 THEN 0 ELSE 1 + spoke * 6 + ring - 1 END)::BIGINT AS seq, round(0.5e0 * cos(ring * pi() / 36), 6) AS oz, round(2e0 * cos(ring * pi() / 36), 6) AS sz, round(2e0 * sin(ring * pi() / 36), 6) AS away FROM range(0, 7) a(ring), range(0, 72) b(spoke) WHERE ring > 0 OR spoke = 0")
def conical_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays about an axis with a least distance: how far each end is along the axis and from it."""
    import math

    c = generators.conical_rays(spark, (0.0, 0.0, 3.0), math.radians(60), 2.0, math.radians(5), 0.5)
    return rounded(c.select("seq", "oz", "sz", F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")).alias("away")), "oz", "sz", "away")


# layers


_STEP = f"CASE WHEN x.v <= -1.5e0::FLOAT OR x.v >= 3e0::FLOAT THEN x.v WHEN y.b THEN least((x.v + {exprs.num(P.hit)}::FLOAT)::FLOAT, {exprs.num(P.high)}::FLOAT) ELSE greatest((x.v + {exprs.num(P.miss)}::FLOAT)::FLOAT, {exprs.num(P.low)}::FLOAT) END"


@query(f"{_VISITS} SELECT gx, gy, gz, list_reduce(list_prepend({{'v': 0::FLOAT, 'b': false}}, list({{'v': 0::FLOAT, 'b': sample}} ORDER BY seq, sample)), lambda x, y: {{'v': ({_STEP})::FLOAT, 'b': y.b}}).v::DOUBLE AS occupancy FROM visits GROUP BY gx, gy, gz")
def occupancy_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at or beyond two limits stay as they are."""
    return as_double(runs.occupancy_map(rays_of(spark, sf_dir), P, runs.Rules(saturate=(-1.5, 3.0)))).drop("n_ops")


_RULE = f"CASE WHEN y.b IS NULL OR x.v >= 0 THEN x.v WHEN y.b THEN least((x.v + {exprs.num(P.hit)}::FLOAT)::FLOAT, {exprs.num(P.high)}::FLOAT) ELSE greatest((x.v + {exprs.num(P.miss)}::FLOAT)::FLOAT, {exprs.num(P.low)}::FLOAT) END"


@query(f"{_VISITS},\n{oracles.voxels_cte(where='NOT sample', voxels='other')}, u AS (SELECT gx, gy, gz, list({{'v': 0::FLOAT, 'b': sample}} ORDER BY seq, sample) AS l FROM visits GROUP BY gx, gy, gz) SELECT gx, gy, gz, list_reduce(list_prepend({{'v': occupancy, 'b': false}}, l), lambda x, y: {{'v': ({_RULE})::FLOAT, 'b': y.b}}).v::DOUBLE AS occupancy FROM other JOIN u USING (gx, gy, gz)")
def update_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rays again on top of a map of misses, leaving alone what is unobserved or occupied at the time."""
    into = voxels_of(spark, sf_dir, exclude_sample=True)
    return as_double(runs.occupancy_map(rays_of(spark, sf_dir), P, runs.Rules(exclude_unobserved=True, exclude_occupied=True), into)).drop("n_ops")


@query(f"{_TWO}, k AS (SELECT DISTINCT true AS t, {_SAMPLE_KEYS} FROM rays) SELECT gx, gy, gz, CASE WHEN k.t IS NULL THEN o.occupancy ELSE greatest((coalesce(o.occupancy, 0::FLOAT) + {exprs.num(P.miss)}::FLOAT)::FLOAT, -2e0::FLOAT) END::DOUBLE AS occupancy FROM other o FULL JOIN k USING (gx, gy, gz)")
def single_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One miss on the voxel of every sample."""
    k = _keyed(spark, sf_dir).select(*G).distinct()
    return as_double(runs.touch(voxels_of(spark, sf_dir, exclude_ray=True), k, False, P))


_MEANS = catalog._mean_sql()


@query(f"SELECT gx, gy, gz, {', '.join(f'round((g{a} - 15.5e0) * 0.1e0 + m{a} * (0.1e0 / 1023) - 0.05e0, 6) AS {a}' for a in 'xyz')} FROM ({_MEANS})")
def mean_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = fold.mean(walk(rays_of(spark, sf_dir), P, keep=("sx", "sy", "sz")), P)
    return rounded(clouds.mean_positions(means, P), "x", "y", "z")


@query(f"{_VISITS} SELECT gx, gy, gz, round(floor(max_by(ts, seq) / 0.001e0) * 0.001e0, 4) AS touched FROM visits JOIN rays USING (seq) WHERE sample GROUP BY gx, gy, gz")
def touch_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fold.touch_time(walk(rays_of(spark, sf_dir), P, keep=("ts",)))
    return t.select(*G, F.round(F.expr(exprs.touch_seconds("touch_ms", "0e0")), 4).alias("touched"))


_TRAVEL = f"{_VISITS}, t AS (SELECT gx, gy, gz, round(sum(exit - enter), 6) AS traversal, count(*) FILTER (sample) AS n FROM visits GROUP BY ALL)"


def _travelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = walk(rays_of(spark, sf_dir), P)
    return w.groupBy(*G).agg(F.round(F.sum(F.col("exit") - F.col("enter")), 6).alias("traversal"), F.count_if("sample").alias("n"))


@query(f"{_TRAVEL} SELECT gx, gy, gz, CASE WHEN n = 0 THEN 0e0 WHEN traversal > 0 THEN round(n / traversal, 4) ELSE 'Infinity'::DOUBLE END AS density FROM t")
def density_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples a metre of every voxel: infinite where samples came without any way travelled."""
    t = _travelled(spark, sf_dir)
    d = F.expr(exprs.density("n", "traversal"))
    return t.select(*G, F.when(d == float("inf"), d).otherwise(F.round(d, 4)).alias("density"))


@query(f"{_TRAVEL} SELECT gx, gy, gz, {_XYZ} FROM t WHERE traversal > 0 AND n / traversal >= 5e0")
def density_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    thick = clouds.dense(_travelled(spark, sf_dir).withColumnRenamed("n", "n_samples"), 5.0)
    return rounded(clouds.at_centres(thick.select(*G), P), "x", "y", "z")


_SECOND = "list_reduce(list_prepend({'mm': 0, 'n': 0, 's': 0::FLOAT, 'r': 0e0}, list({'mm': 0, 'n': 0, 's': 0::FLOAT, 'r': least(len, 65.534e0)} ORDER BY seq)), lambda s, v: {'mm': floor((s.mm / 1e3 + (v.r - s.mm / 1e3) / (s.n + 1)) * 1e3)::INT, 'n': s.n + 1, 's': (s.s + ((v.r - s.mm / 1e3) * (v.r - (s.mm / 1e3 + (v.r - s.mm / 1e3) / (s.n + 1))))::FLOAT)::FLOAT, 'r': 0e0})"


@query(f"{_K}, f AS (SELECT gx, gy, gz, {_SECOND} AS f FROM (SELECT *, {_LEN} AS len FROM k WHERE return_number > 0) GROUP BY gx, gy, gz) SELECT gx, gy, gz, f.n::BIGINT AS n, f.mm::INT AS mm, round(f.s::DOUBLE, 5) AS m2 FROM f")
def secondary_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.secondary_quantised(rays_of(spark, sf_dir), P).withColumn("m2", F.round(F.col("m2").cast("double"), 5))


@query(f"{_VISITS}, m AS (SELECT gx, gy, gz, count(*) AS n, avg(intensity) AS i FROM visits JOIN rays USING (seq) WHERE sample GROUP BY ALL) SELECT sum(n)::BIGINT AS samples, max(n) AS most_samples, round(min(i), 4) AS least_intensity, round(max(i), 4) AS most_intensity FROM m")
def map_detail_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = maps.detail_stats(ndt.moments(walk(rays_of(spark, sf_dir), P, keep=("sx", "sy", "sz", "intensity"))))
    return d.withColumns({c: F.round(c, 4) for c in ("least_intensity", "most_intensity")})


_QUAD = "(x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * (x * y * (c * e - b * f) + x * z * (b * e - c * d) + y * z * (b * c - a * e))) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"


@query(f"{_K}, m AS (SELECT gx, gy, gz, count(*) AS n, avg(sx) AS mx, avg(sy) AS my, avg(sz) AS mz, var_pop(sx) + 1e-4 AS a, covar_pop(sx, sy) AS b, covar_pop(sx, sz) AS c, var_pop(sy) + 1e-4 AS d, covar_pop(sy, sz) AS e, var_pop(sz) + 1e-4 AS f FROM k GROUP BY ALL HAVING count(*) >= 4), q AS (SELECT seq, sx - mx AS x, sy - my AS y, sz - mz AS z, m.* FROM k JOIN m USING (gx, gy, gz)) SELECT seq FROM q WHERE {_QUAD} < 3e0")
def ellipsoid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples within their voxel's distribution; samples at the limit itself are common on a lattice, so the order of the sums is fixed."""
    m = ndt.ordered_moments(_keyed(spark, sf_dir).dropna(subset=["sx", "sy", "sz"]))
    return ndt.inside_ellipsoid(rays_of(spark, sf_dir).selectExpr("seq", "sx AS x", "sy AS y", "sz AS z"), m, P).select("seq")


# regions and whole maps


_REGIONS = catalog._REGIONS
_BOXED = " AND ".join(f"r{a} * 3.2e0 - 1.6e0 <= {h} AND r{a} * 3.2e0 + 1.6e0 >= {lo}" for a, lo, h in zip("xyz", *BOX, strict=True))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.regions(walk(rays_of(spark, sf_dir), P, keep=("ts",)), P)


@query(f"{_REGIONS} SELECT rx, ry, rz FROM regions WHERE {_BOXED}")
def cull_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.cull_outside(_regions(spark, sf_dir), BOX, P).select(*maps.REGION)


@query(f"{_REGIONS} SELECT rx, ry, rz, ({_BOXED}) AND stamp > 1 AS a, ({_BOXED}) OR stamp > 1 AS b, NOT ({_BOXED}) AS c FROM regions")
def copy_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by extents and by stamp, joined and negated."""
    near, new = maps.overlaps(BOX, P), maps.touched_since(1)
    return _regions(spark, sf_dir).select(*maps.REGION, maps.all_of(near, new).alias("a"), maps.any_of(near, new).alias("b"), (~near).alias("c"))


@query(f"{_REGIONS} SELECT min(rx) AS min_rx, max(rx) AS max_rx, min(ry) AS min_ry, max(ry) AS max_ry, min(rz) AS min_rz, max(rz) AS max_rz FROM regions WHERE stamp > 1")
def dirty_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.dirty_extents(_regions(spark, sf_dir), 1)


_REG = ", ".join(f"floor(g{a} / 32e0)::INT AS r{a}" for a in "xyz")


@query(f"{_BASE} SELECT rx, ry, rz, count(*) AS observed, 32768 - count(*) AS unobserved FROM (SELECT *, {_REG} FROM voxels) GROUP BY ALL")
def dense_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every voxel of every region that is there, counted by whether it is observed."""
    v = voxels_of(spark, sf_dir).select(*G, "occupancy")
    d = maps.with_region(maps.dense(v, maps.with_region(v, P).select(*maps.REGION).distinct(), P), P)
    return d.groupBy(*maps.REGION).agg(F.count("occupancy").alias("observed"), F.count_if(F.col("occupancy").isNull()).alias("unobserved"))


@query(f"{_TWO}, a AS (SELECT v.*, t.traversal FROM voxels v JOIN (SELECT gx, gy, gz, round(sum(exit - enter), 6) AS traversal FROM visits GROUP BY ALL) t USING (gx, gy, gz)), b AS (SELECT o.*, t.traversal FROM other o JOIN (SELECT gx, gy, gz, round(sum(exit - enter), 6) AS traversal FROM visits WHERE sample GROUP BY ALL) t USING (gx, gy, gz)), j AS (SELECT a.occupancy AS ao, b.occupancy AS bo, a.traversal AS at_, b.traversal AS bt FROM a LEFT JOIN b USING (gx, gy, gz)) SELECT 'occupancy' AS layer, count(*) FILTER (abs(ao - bo) <= 0.5e0) AS same, count(*) FILTER (abs(ao - bo) > 0.5e0) AS different, count(*) FILTER (bo IS NULL) AS missing FROM j UNION ALL SELECT 'traversal', count(*) FILTER (abs(at_ - bt) <= 1e-3), count(*) FILTER (abs(at_ - bt) > 1e-3), count(*) FILTER (bt IS NULL) FROM j")
def compare_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of the map of rays and of that of samples, each with its tolerance."""
    w = walk(rays_of(spark, sf_dir), P)
    travelled = lambda v: v.groupBy(*G).agg(F.round(F.sum(F.col("exit") - F.col("enter")), 6).alias("traversal"))
    a = voxels_of(spark, sf_dir).join(travelled(w), list(G))
    b = voxels_of(spark, sf_dir, exclude_ray=True).join(travelled(w.where("sample")), list(G))
    return maps.compare_layers(a, b, {"occupancy": 0.5, "traversal": 1e-3})


# queries


@query(catalog.SQL["rays_query"].replace("occupancy > 0", "occupancy >= 0"))
def rays_query_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels at the threshold stop rays as well."""
    return rounded(spatial.rays_query(rays_of(spark, sf_dir), voxels_of(spark, sf_dir), P, at_threshold=True), "range", "unobserved_volume")


@query(catalog.SQL["rays_query"].replace("0e0 + round(sum(", "0e0 + round((pi() / 180) ** 2 * sum("))
def lookup_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.lookup_rays(rays_of(spark, sf_dir), voxels_of(spark, sf_dir), P), "range", "unobserved_volume")


_LAYER = catalog.SQL["clearance"].replace("0e0 + round(", "round(")


@query(f"WITH layer AS ({_LAYER}), {catalog._VISITS.removeprefix('WITH ')} SELECT seq, step AS place, gx, gy, gz, CASE WHEN clearance >= 0 THEN clearance ELSE 9e0 END AS clearance FROM visits LEFT JOIN layer USING (gx, gy, gz)")
def line_query_on_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearances along rays from the clearance layer, 9 where there is none."""
    layer = rounded(spatial.clearance(voxels_of(spark, sf_dir), P, 0.3), "clearance")
    return spatial.line_query_on_layer(rays_of(spark, sf_dir), layer, P, 9.0)


_CUBE = "(SELECT x, y, z FROM range(-3, 4) a(x), range(-3, 4) b(y), range(-3, 4) c(z) WHERE x * x + y * y + z * z <= 9)"


@query(f"{_BASE}, s AS (SELECT v.gx, v.gy, v.gz, d.x, d.y, d.z FROM voxels v, {_CUBE} d), n AS (SELECT s.gx, s.gy, s.gz, min(s.x * s.x + s.y * s.y + s.z * s.z) AS d2 FROM s LEFT JOIN voxels o ON o.gx = s.gx + s.x AND o.gy = s.gy + s.y AND o.gz = s.gz + s.z WHERE o.gx IS NULL OR o.occupancy >= 0 GROUP BY ALL) SELECT gx, gy, gz, round(coalesce(sqrt(d2) * 0.1e0, -1e0), 6) AS clearance FROM voxels LEFT JOIN n USING (gx, gy, gz)")
def clearance_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearance where all that is not known as free is an obstacle."""
    return rounded(spatial.clearance(voxels_of(spark, sf_dir), P, 0.3, unknown_as_occupied=True), "clearance")


_SCALED = "SELECT gx, gy, gz, round(coalesce(sqrt(least_)  * 0.1e0, -1e0), 6) AS clearance FROM voxels LEFT JOIN n USING (gx, gy, gz)"
_NEAR3 = "o.gx BETWEEN t.gx - 3 AND t.gx + 3 AND o.gy BETWEEN t.gy - 3 AND t.gy + 3 AND o.gz BETWEEN t.gz - 3 AND t.gz + 3"
_OFF = "o.gx - t.gx AS x, o.gy - t.gy AS y, o.gz - t.gz AS z"
_PAIRS = f"{_BASE}, t AS (SELECT *, gx // 8 AS c FROM voxels), o AS (SELECT gx, gy, gz, gx // 8 + unnest([-1, 0, 1]) AS c FROM voxels WHERE occupancy >= 0), pairs AS (SELECT t.gx, t.gy, t.gz, {_OFF} FROM t JOIN o ON o.c = t.c AND {_NEAR3})"


@query(f"{_PAIRS}, n AS (SELECT gx, gy, gz, min(x * x + y * y + 4 * z * z) AS least_ FROM pairs WHERE x * x + y * y + 4 * z * z <= 9 GROUP BY ALL) {_SCALED}")
def clearance_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights count twice."""
    return rounded(spatial.clearance(voxels_of(spark, sf_dir), P, 0.3, scaling=(1.0, 1.0, 2.0)), "clearance")


@query(f"{_PAIRS}, n AS (SELECT gx, gy, gz, min_by(x * x + y * y + z * z, (x * x + y * y + 4 * z * z) * 1000 + x * x + y * y + z * z) AS least_ FROM pairs WHERE x * x + y * y + z * z <= 9 GROUP BY ALL) {_SCALED}")
def clearance_unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest when heights count twice, at its plain distance (of equals the plainly nearer one)."""
    return rounded(spatial.clearance(voxels_of(spark, sf_dir), P, 0.3, scaling=(1.0, 1.0, 2.0), unscaled=True), "clearance")


_FAR = MapParams(resolution=0.25)


@query(f"WITH {oracles.rays_cte()},\n{oracles.visits_cte(_FAR)},\n{oracles.voxels_cte(_FAR)}, n AS (SELECT t.gx, t.gy, t.gz, min((o.gx - t.gx) ** 2 + (o.gy - t.gy) ** 2 + (o.gz - t.gz) ** 2) AS d2 FROM voxels t JOIN voxels o ON o.occupancy >= 0 WHERE (o.gx - t.gx) ** 2 + (o.gy - t.gy) ** 2 + (o.gz - t.gz) ** 2 <= 400 GROUP BY ALL) SELECT gx, gy, gz, round(coalesce(sqrt(d2) * 0.25e0, -1e0), 6) AS clearance FROM voxels LEFT JOIN n USING (gx, gy, gz)")
def clearance_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearance up to 5 m in a map of 0.25 m voxels."""
    voxels = runs.occupancy_map(rays_of(spark, sf_dir), _FAR)
    return rounded(spatial.clearance(voxels, _FAR, 5.0), "clearance")


_P3 = " + ".join(f"((g{a} - 15.5e0) * 0.1e0 - {a}) ** 2" for a in "xyz")


@query(f"{_BASE}, {catalog._POINTS}, c AS (SELECT seq, x, y, z, floor(x * 10)::INT + 16 + dx AS gx, floor(y * 10)::INT + 16 + dy AS gy, floor(z * 10)::INT + 16 + dz AS gz FROM points, range(-4, 5) a(dx), range(-4, 5) b(dy), range(-4, 5) c(dz)) SELECT seq, gx::INT AS gx, gy::INT AS gy, gz::INT AS gz, round(sqrt({_P3}), 6) AS range FROM c LEFT JOIN voxels USING (gx, gy, gz) WHERE sqrt({_P3}) <= 0.2e0 AND (occupancy IS NULL OR occupancy >= 0)")
def nearest_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels near points that are occupied or not known."""
    return rounded(spatial.nearest_neighbours(points_of(spark, sf_dir), voxels_of(spark, sf_dir), P, 0.2, unknown_as_occupied=True), "range")


@query(f"WITH layer AS ({_LAYER}) SELECT gx, gy, gz, {_XYZ}, round(1e0 - least(1e0, clearance / 0.3e0), 6) AS r, 0e0 AS g, round(least(1e0, clearance / 0.3e0), 6) AS b FROM layer WHERE clearance >= 0")
def clearance_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clearance layer as points, coloured by it."""
    layer = rounded(spatial.clearance(voxels_of(spark, sf_dir), P, 0.3), "clearance")
    return rounded(clouds.ranges_coloured(layer, P, "clearance", 0.3).drop("clearance"), "x", "y", "z", "r", "g", "b")


@query(f"{_BASE}, {catalog._POINTS}, n AS (SELECT p.seq, v.gx, v.gy, v.gz, sqrt({_P3}) AS range FROM points p JOIN voxels v ON v.occupancy >= 0 AND sqrt({_P3}) <= 0.5e0) SELECT seq, gx, gy, gz, {_XYZ}, round(1e0 - range / 0.5e0, 6) AS r, 0e0 AS g, round(range / 0.5e0, 6) AS b FROM n")
def query_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a neighbour query as points, coloured by range."""
    found = spatial.nearest_neighbours(points_of(spark, sf_dir), voxels_of(spark, sf_dir), P, 0.5)
    return rounded(clouds.ranges_coloured(found, P, "range", 0.5).drop("range"), "x", "y", "z", "r", "g", "b")


# colours and shapes


_WHITE, _RED, _BLUE = colours.rgb((255, 255, 255)), colours.rgb((255, 0, 0)), colours.rgb((0, 0, 255))


def _coloured(df: DataFrame, rgb: colours.Rgb, *columns: str) -> DataFrame:
    return rounded(df.select(*columns, *[F.expr(e).alias(n) for n, e in zip("rgb", rgb, strict=True)]), "r", "g", "b")


@query(f"{_BASE} SELECT gx, gy, gz, CASE WHEN occupancy >= 0 THEN 1e0 ELSE 0e0 END AS r, 0e0 AS g, CASE WHEN occupancy >= 0 THEN 0e0 ELSE 1e0 END AS b FROM voxels")
def colour_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coloured(voxels_of(spark, sf_dir), colours.by_type("occupancy", 0.0, _BLUE, _RED), *G)


@query(f"{_BASE}, p AS (SELECT gx, gy, gz, greatest(0e0, (1 / (1 + exp(-occupancy::DOUBLE)) - 0.5e0) / 0.5e0) AS s FROM voxels) SELECT gx, gy, gz, round(s, 6) AS r, 0e0 AS g, round(1 - s, 6) AS b FROM p")
def colour_by_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coloured(as_double(voxels_of(spark, sf_dir)), colours.by_occupancy("occupancy", _BLUE, _RED, 0.5), *G)


@query(f"{_VISITS}, m AS (SELECT gx, gy, gz, least(avg(intensity), 300e0) / 300e0 AS s FROM visits JOIN rays USING (seq) WHERE sample GROUP BY ALL) SELECT gx, gy, gz, round((154 + 101 * s) / 255e0, 6) AS r, round((52 + 203 * s) / 255e0, 6) AS g, round((3 + 209 * s) / 255e0, 6) AS b FROM m")
def colour_by_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ndt.moments(walk(rays_of(spark, sf_dir), P, keep=("sx", "sy", "sz", "intensity")))
    return _coloured(m, colours.by_intensity("intensity_mean", 300.0), *G)


_GROUND, _SURFACE = catalog._GROUND, catalog._SURFACE
_LAYERS = f"{_GROUND}, l AS (SELECT gx, gy, gz, (row_number() OVER (PARTITION BY gx, gy ORDER BY gz) - 1)::INT AS layer, coalesce(gap, -1e0) AS clearance FROM c WHERE gap IS NULL OR gap >= 0.5e0)"


@query(f"{_LAYERS} SELECT gx, gy, gz, CASE layer % 10 WHEN 0 THEN round(219 / 255e0, 6) WHEN 1 THEN round(178 / 255e0, 6) WHEN 2 THEN 1e0 WHEN 3 THEN 1e0 WHEN 4 THEN round(245 / 255e0, 6) WHEN 5 THEN round(127 / 255e0, 6) WHEN 6 THEN round(64 / 255e0, 6) WHEN 7 THEN round(135 / 255e0, 6) WHEN 8 THEN round(221 / 255e0, 6) ELSE 0e0 END AS r FROM l")
def colour_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coloured(heightmap.layered(voxels_of(spark, sf_dir), P), colours.by_layer("layer"), *G).select(*G, "r")


@query(f"{_LAYERS} SELECT gx, gy, gz, 1e0 AS r, round((128 - 128 * (clearance - 0.5e0) / 1.5e0) / 255e0, 6) AS g FROM l")
def colour_by_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces from orange to red by the height above them."""
    return _coloured(heightmap.layered(voxels_of(spark, sf_dir), P), colours.by_clearance("clearance", 0.5, 2.0), *G).select(*G, "r", "g")


@query(f"{_LAYERS} SELECT gx, gy, gz, 0e0 AS r, CASE WHEN layer = 0 THEN 1e0 ELSE 0.4e0 END AS g, 0e0 AS b FROM l")
def colour_by_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = heightmap.layered(voxels_of(spark, sf_dir), P).withColumn("value", F.lit(1))
    return _coloured(layers, colours.by_surface("value", "layer = 0", colours.rgb((0, 255, 0)), _BLUE), *G)


@query(f"{_BASE} SELECT gx, gy, gz, CASE WHEN occupancy >= 0 THEN 0e0 ELSE 240e0 END AS hue, 1e0 AS saturation FROM voxels")
def colour_hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hue and saturation of the colours by type."""
    h, s, _ = colours.to_hsv(("r", "g", "b"))
    return rounded(colour_by_type(spark, sf_dir).selectExpr(*G, f"{h} AS hue", f"{s} AS saturation"), "hue", "saturation")


@query(f"{_BASE}, t AS (SELECT * FROM (VALUES (0, 0, 2, 1), (1, 1, 2, 3), (2, 4, 5, 6), (3, 5, 7, 6), (4, 0, 1, 4), (5, 1, 5, 4), (6, 2, 6, 3), (7, 3, 6, 7), (8, 0, 4, 2), (9, 2, 4, 6), (10, 1, 3, 5), (11, 3, 7, 5)) t(triangle, a, b, c)) SELECT gx, gy, gz, triangle, a, b, c FROM voxels, t WHERE occupancy >= 0")
def voxel_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.triangles(voxels_of(spark, sf_dir).where("occupancy >= 0"))


@query()
def ndt_ellipsoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of the running distributions; no SQL: a test holds them against their covariance."""
    voxels = ndt.integrate_rays(rays_of(spark, sf_dir), P).where("n_samples > 0")
    return clouds.ellipsoids(ndt.covariance(voxels))


# heightmaps


@query(f"{_SURFACE} SELECT gx, gy, round((gx - 15.5e0) * 0.1e0, 6) AS x, round((gy - 15.5e0) * 0.1e0, 6) AS y, round(height, 6) AS z FROM s")
def heightmap_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clouds.heightmap_points(heightmap.planar(voxels_of(spark, sf_dir), P), P), "x", "y", "z")


_AXES = {"x": ("gy", "gz", "gx"), "-x": ("gy", "gz", "31 - gx"), "y": ("gx", "gz", "gy"), "-y": ("gx", "gz", "31 - gy"), "z": ("gx", "gy", "gz"), "-z": ("gx", "gy", "31 - gz")}
_TURNED = " UNION ALL ".join(f"SELECT '{up}' AS up, {a} AS c1, {b} AS c2, {h} AS h FROM voxels WHERE occupancy >= 0" for up, (a, b, h) in _AXES.items())


@query(f"{_BASE}, t AS ({_TURNED}), c AS (SELECT *, (lead(h) OVER (PARTITION BY up, c1, c2 ORDER BY h) - h - 1) * 0.1e0 AS gap FROM t) SELECT up, c1 AS gx, c2 AS gy, min(h)::INT AS gz FROM c WHERE gap IS NULL OR gap >= 0.5e0 GROUP BY ALL")
def heightmap_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heightmaps along all six axes."""
    v = voxels_of(spark, sf_dir)
    parts = [heightmap.planar(heightmap.with_up(v, up, P), P).select(F.lit(up).alias("up"), "gx", "gy", "gz") for up in _AXES]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query(f"{_SURFACE}, v AS (SELECT a.gx, a.gy FROM (SELECT gx, gy, max((occupancy >= 0)::INT) AS solid FROM voxels GROUP BY ALL) a JOIN (SELECT gx, gy, max((occupancy >= 0)::INT) AS solid FROM voxels GROUP BY ALL) b ON b.solid = 1 AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 WHERE a.solid = 0 GROUP BY ALL HAVING count(*) >= 2), e AS (SELECT min(gx) AS x0, max(gx) AS x1, min(gy) AS y0, max(gy) AS y1 FROM voxels) SELECT x::INT AS gx, y::INT AS gy, CASE WHEN s.gx IS NOT NULL THEN 1 WHEN v.gx IS NOT NULL THEN -1 ELSE 0 END AS value FROM (SELECT unnest(range(x0, x1 + 1)) AS x FROM e), (SELECT unnest(range(y0, y1 + 1)) AS y FROM e) LEFT JOIN s ON s.gx = x AND s.gy = y LEFT JOIN v ON v.gx = x AND v.gy = y")
def heightmap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heightmap.classify(voxels_of(spark, sf_dir), P)


@query(f"{_LAYERS}, h AS (SELECT *, (gz - 15.5e0) * 0.1e0 + 0.05e0 AS height FROM l) SELECT gx, gy, gz, layer, CASE WHEN row_number() OVER (PARTITION BY gx, gy ORDER BY round(abs(height), 6), gz) = 1 THEN 'base' ELSE 'extended' END AS label FROM h")
def heightmap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers; the one nearest to height 0 is the base."""
    return heightmap.labelled(voxels_of(spark, sf_dir), P).select(*G, "layer", "label")


_MESH = catalog.SQL["heightmap_mesh"].replace("0e0 + round(", "round(")


@query(f"WITH m AS ({_MESH}), v AS (SELECT gx, gy, half, unnest(CASE WHEN half = 0 THEN [[gx, gy, gx + 1, gy], [gx + 1, gy, gx + 1, gy + 1], [gx, gy, gx + 1, gy + 1]] ELSE [[gx, gy, gx + 1, gy + 1], [gx, gy + 1, gx + 1, gy + 1], [gx, gy, gx, gy + 1]] END) AS edge FROM m), n AS (SELECT edge, count(*) AS n FROM v GROUP BY edge) SELECT gx, gy, half, (sum(n) - 3)::BIGINT AS neighbours FROM v JOIN n USING (edge) GROUP BY ALL")
def mesh_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heightmap.adjacency(heightmap.mesh(heightmap.planar(voxels_of(spark, sf_dir), P)))
