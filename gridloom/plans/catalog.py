"""Named queries over the tables of a data folder, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes, exprs, names
from gridloom.functions.params import MapParams
from gridloom.operators import clouds, fold, heightmap, maps, ndt, runs, spatial
from gridloom.operators.walk import walk
from gridloom.plans import oracles
from gridloom.sources import generators
from gridloom.sources import rays as sources
from gridloom.streaming import occupancy as streaming

Query = Callable[[SparkSession, str], DataFrame]
P = MapParams()
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BOX = ((-1.5, -1.0, 0.0), (1.5, 1.0, 1.2))
EDGE_BOX = ((0.0, 0.0, 0.0), (1.5, 1.5, 1.5))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("round(", "0e0 + round(")  # no negative zero
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def rays_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.event_rays(spark, sf_dir)


def voxels_of(spark: SparkSession, sf_dir: str, **flags: bool) -> DataFrame:
    return runs.occupancy_map(rays_of(spark, sf_dir), P, **flags)


def as_double(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("occupancy", F.col("occupancy").cast("double"))


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq"), *[(F.get("embedding", F.lit(i)).cast("double") * 5).alias(a) for i, a in enumerate("xyz")])


_POINTS = "points AS (SELECT vec_id AS seq, embedding[1]::DOUBLE * 5 AS x, embedding[2]::DOUBLE * 5 AS y, embedding[3]::DOUBLE * 5 AS z FROM embeddings)"
_KEYS = {f"g{a}": exprs.key(f"s{a}", P, i) for i, a in enumerate("xyz")}
_RAYS = f"WITH {oracles.rays_cte()}"
_BASE = oracles.base()
_VISITS = f"WITH {oracles.rays_cte()},\n{oracles.visits_cte()}"


# scalar functions


@query(f"{_RAYS} SELECT seq, {', '.join(f'{e} AS {n}' for n, e in _KEYS.items())}, {', '.join(f'{exprs.region(f"s{a}", P, i)} AS r{a}' for i, a in enumerate('xyz'))} FROM rays")
def voxel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rays_of(spark, sf_dir).select("seq", *[F.expr(e).alias(n) for n, e in _KEYS.items()], *[F.expr(exprs.region(f"s{a}", P, i)).alias(f"r{a}") for i, a in enumerate("xyz")])


@query(f"{_RAYS}, k AS (SELECT seq, {', '.join(f'{e} AS {n}' for n, e in _KEYS.items())} FROM rays) SELECT seq, {', '.join(f'round({exprs.centre(f"g{a}", P, i)}, 6) AS c{a}, {exprs.local_of(f"g{a}", P)} AS l{a}' for i, a in enumerate('xyz'))} FROM k")
def voxel_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = voxel_keys(spark, sf_dir)
    return keyed.select("seq", *[c for i, a in enumerate("xyz") for c in (F.round(F.expr(exprs.centre(f"g{a}", P, i)), 6).alias(f"c{a}"), F.expr(exprs.local_of(f"g{a}", P)).alias(f"l{a}"))])


@query(f"{_RAYS}, k AS (SELECT seq, {', '.join(f'{e} AS {n}' for n, e in _KEYS.items())} FROM rays), e AS (SELECT min(gx) AS ax, max(gx) AS bx, min(gy) AS ay, max(gy) AS by_, min(gz) AS az, max(gz) AS bz FROM k) SELECT seq, ((gx - ax) + (gy - ay) * (bx - ax + 1) + (gz - az) * (bx - ax + 1) * (by_ - ay + 1))::BIGINT AS index, ((bx - ax + 1) * (by_ - ay + 1) * (bz - az + 1))::BIGINT AS volume FROM k, e")
def key_range_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each sample's voxel in the box of all, x fastest."""
    keyed = voxel_keys(spark, sf_dir)
    box = F.broadcast(keyed.agg(*[f(f"g{a}").cast("long").alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "a"), (F.max, "b"))]))
    size = {a: F.col(f"b{a}") - F.col(f"a{a}") + 1 for a in "xyz"}
    index = (F.col("gx") - F.col("ax")) + (F.col("gy") - F.col("ay")) * size["x"] + (F.col("gz") - F.col("az")) * size["x"] * size["y"]
    return keyed.crossJoin(box).select("seq", index.alias("index"), (size["x"] * size["y"] * size["z"]).alias("volume"))


@query(f"SELECT event_id, round({exprs.probability('v')}, 6) AS p, round({exprs.value(exprs.probability('v'))}, 6) AS v FROM (SELECT event_id, (event_id % 41 - 20) / 10e0 AS v FROM events)")
def log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "(event_id % 41 - 20) / 10e0 AS v")
    return v.selectExpr("event_id", f"round({exprs.probability('v')}, 6) AS p", f"round({exprs.value(exprs.probability('v'))}, 6) AS v")


# filters


@query(f"{_RAYS} SELECT seq, round({exprs.RAY_LENGTH}, 6) AS len FROM rays WHERE {exprs.RAY_LENGTH} <= 2.5e0")
def filter_good_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.filter_good(rays_of(spark, sf_dir), 2.5).selectExpr("seq", f"round({exprs.RAY_LENGTH}, 6) AS len")


@query(f"{_RAYS}, c AS (SELECT *, CASE WHEN {exprs.RAY_LENGTH} > 1.5e0 THEN 1.5e0 / {exprs.RAY_LENGTH} ELSE 1e0 END AS t FROM rays) SELECT seq, {', '.join(f'round(CASE WHEN t < 1 THEN o{a} + (s{a} - o{a}) * t ELSE s{a} END, 6) AS s{a}' for a in 'xyz')}, t < 1 AS clipped_end FROM c")
def filter_clip_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sources.clip_length(rays_of(spark, sf_dir), 1.5).select("seq", "sx", "sy", "sz", "clipped_end"), "sx", "sy", "sz")


_NEAR, _FAR = exprs.slab(BOX)


@query(f"{_RAYS}, c AS (SELECT *, {_NEAR} AS a, {_FAR} AS b FROM rays) SELECT seq, {', '.join(f'round(CASE WHEN a <= b AND a > 0 THEN o{x} + (s{x} - o{x}) * a ELSE o{x} END, 6) AS o{x}, round(CASE WHEN a <= b AND b < 1 THEN o{x} + (s{x} - o{x}) * b ELSE s{x} END, 6) AS s{x}' for x in 'xyz')}, a <= b AND a > 0 AS clipped_start, a <= b AND b < 1 AS clipped_end FROM c")
def filter_clip_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sources.clip_box(rays_of(spark, sf_dir), BOX).select("seq", "ox", "oy", "oz", "sx", "sy", "sz", "clipped_start", "clipped_end"), "ox", "oy", "oz", "sx", "sy", "sz")


@query(f"{_RAYS}, c AS (SELECT *, greatest(1, ceil({exprs.RAY_LENGTH} / 1e0)::INT) AS n FROM rays) SELECT seq, part, {', '.join(f'round(o{a} + (s{a} - o{a}) * part / n, 6) AS o{a}' for a in 'xyz')}, part + 1 < n AS clipped_end FROM (SELECT *, unnest(range(n))::INT AS part FROM c)")
def split_long_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sources.split_long(rays_of(spark, sf_dir), 1.0).select("seq", "part", "ox", "oy", "oz", "clipped_end"), "ox", "oy", "oz")


# walk


@query(f"{_VISITS} SELECT seq, step AS place, gx, gy, gz FROM visits")
def segment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.segment_keys(rays_of(spark, sf_dir), P)


@query(f"{_VISITS} SELECT seq, count(*) AS n_keys FROM visits GROUP BY seq")
def line_keys_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.line_keys_counts(rays_of(spark, sf_dir), P)


@query(f"{_VISITS} SELECT seq, step, gx, gy, gz, round(enter, 6) AS enter, round(exit, 6) AS exit, sample FROM visits")
def walk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(walk(rays_of(spark, sf_dir), P), "enter", "exit")


@query(f"{_VISITS} SELECT DISTINCT {', '.join(f'{exprs.region_of(f"g{a}", P)} AS r{a}' for a in 'xyz')} FROM visits")
def region_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.with_region(walk(rays_of(spark, sf_dir), P), P).select(*maps.REGION).distinct()


# layers


@query(f"{_BASE} SELECT gx, gy, gz, occupancy::DOUBLE AS occupancy, n_ops FROM voxels")
def occupancy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(voxels_of(spark, sf_dir))


@query(f"{_BASE} SELECT gx, gy, gz, round(occupancy::DOUBLE, 4) AS occupancy, n_ops FROM voxels")
def occupancy_by_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.occupancy_by_chunks(walk(rays_of(spark, sf_dir), P), P).withColumns({"occupancy": F.round(F.col("occupancy").cast("double"), 4), "n_ops": F.col("n_ops").cast("long")})


@query(f"{_BASE} SELECT {exprs.occupancy_type('occupancy', P)} AS kind, count(*) AS n FROM voxels GROUP BY 1")
def occupancy_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels_of(spark, sf_dir).groupBy(F.expr(exprs.occupancy_type("occupancy", P)).alias("kind")).agg(F.count("*").alias("n"))


@query(f"{_VISITS} SELECT gx, gy, gz, round(sum(exit - enter), 6) AS traversal FROM visits GROUP BY ALL")
def traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fold.traversal(walk(rays_of(spark, sf_dir), P)), "traversal")


@query(f"{_VISITS} SELECT gx, gy, gz, {exprs.touch_millis('max_by(ts, seq)', '0e0')} AS touch_ms FROM visits JOIN rays USING (seq) WHERE sample GROUP BY gx, gy, gz")
def touch_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.touch_time(walk(rays_of(spark, sf_dir), P, keep=("ts",)))


@query(f"{_VISITS}, {oracles.voxels_cte(where='sample')} SELECT gx, gy, gz, occupancy::DOUBLE AS occupancy, n_ops FROM voxels")
def mode_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples only: rays do not clear."""
    return as_double(voxels_of(spark, sf_dir, exclude_ray=True))


@query(f"{_VISITS}, {oracles.voxels_cte(where='NOT sample')} SELECT gx, gy, gz, occupancy::DOUBLE AS occupancy, n_ops FROM voxels")
def mode_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays only: samples do not fill."""
    return as_double(voxels_of(spark, sf_dir, exclude_sample=True))


@query(f"{_VISITS}, first AS (SELECT *, step + 1 AS rn FROM visits), {oracles.voxels_cte(visits='first', where='rn > 1')} SELECT gx, gy, gz, occupancy::DOUBLE AS occupancy, n_ops FROM voxels")
def exclude_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(voxels_of(spark, sf_dir, exclude_origin=True))


@query(f"{_VISITS}, {oracles.voxels_cte(hit='false')} SELECT gx, gy, gz, occupancy::DOUBLE AS occupancy, n_ops FROM voxels")
def end_point_as_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(voxels_of(spark, sf_dir, end_as_free=True))


_CLEAR = f"""{_BASE}, batch AS (SELECT v.* FROM visits v JOIN voxels USING (gx, gy, gz) WHERE occupancy >= 0),
f AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY seq ORDER BY step) = 1), n AS (SELECT gx, gy, gz, count(*) AS n FROM f GROUP BY ALL)
SELECT gx, gy, gz, round(CASE WHEN n IS NULL THEN occupancy ELSE greatest(occupancy + n * {exprs.num(P.miss)}, {exprs.num(P.low)}) END::DOUBLE, 4) AS occupancy FROM voxels LEFT JOIN n USING (gx, gy, gz)"""


@query(_CLEAR)
def clearing_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of rays that clears the first occupied voxel it meets in the map as it was."""
    return spatial.clearing(rays_of(spark, sf_dir), voxels_of(spark, sf_dir), P).withColumn("occupancy", F.round(F.col("occupancy").cast("double"), 4))


def _mean_sql() -> str:
    """The quantised mean as a reduction over structs."""
    q, half = "(0.1e0 / 1023)", "0.05e0"
    step = []
    for a in "xyz":
        old = f"(CASE WHEN s.n = 0 THEN 0e0 ELSE s.m{a} * {q} - {half} END)"
        step.append(f"'m{a}': least(1023, greatest(0, CAST(floor(({old} + (v.d{a} - {old}) / (s.n + 1) + {half}) / {q} + 0.5e0) AS INT)))")
    zero = "{'mx': 0, 'my': 0, 'mz': 0, 'n': 0, 'dx': 0e0, 'dy': 0e0, 'dz': 0e0}"
    op = "{'mx': 0, 'my': 0, 'mz': 0, 'n': 0, " + ", ".join(f"'d{a}': s{a} - {exprs.centre(f'g{a}', P, i)}" for i, a in enumerate("xyz")) + "}"
    fold = f"list_reduce(list_prepend({zero}, list({op} ORDER BY seq)), lambda s, v: {{{', '.join(step)}, 'n': s.n + 1, 'dx': 0e0, 'dy': 0e0, 'dz': 0e0}})"
    return f"{_VISITS}, f AS (SELECT gx, gy, gz, {fold} AS m FROM visits JOIN rays USING (seq) WHERE sample GROUP BY gx, gy, gz) SELECT gx, gy, gz, m.mx AS mx, m.my AS my, m.mz AS mz, m.n::BIGINT AS n_samples FROM f"


@query(_mean_sql())
def voxel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.mean(walk(rays_of(spark, sf_dir), P, keep=("sx", "sy", "sz")), P)


@query(f"{_VISITS}, t AS (SELECT gx, gy, gz, sum(exit - enter) AS traversal, count(*) FILTER (sample) AS n FROM visits GROUP BY ALL) SELECT gx, gy, gz, round({exprs.density('n', 'traversal')}, 4) AS density FROM t WHERE traversal > 1e-6")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = walk(rays_of(spark, sf_dir), P).groupBy(*fold.VOXEL).agg(F.sum(F.col("exit") - F.col("enter")).alias("traversal"), F.count_if("sample").alias("n")).where("traversal > 1e-6")
    return t.select(*fold.VOXEL, F.round(F.expr(exprs.density("n", "traversal")), 4).alias("density"))


@query(f"{_RAYS} SELECT {', '.join(f'{e} AS {n}' for n, e in _KEYS.items())}, count(*) AS n, round(avg({exprs.RAY_LENGTH}), 6) AS range_mean, round(stddev_pop({exprs.RAY_LENGTH}), 4) AS range_std FROM rays WHERE return_number > 0 GROUP BY 1, 2, 3")
def secondary_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fold.secondary(rays_of(spark, sf_dir), P)
    return s.withColumns({"range_mean": F.round("range_mean", 6), "range_std": F.round("range_std", 4)})


def _normal_sql() -> str:
    dec = {a: f"(CASE WHEN s.set THEN 2 * (s.i{a} / 16383e0) - 1 ELSE 0e0 END)" for a in "xy"}
    raw = {a: f"(2 * (s.i{a} / 16383e0) - 1)" for a in "xy"}
    dec["z"] = f"(CASE WHEN s.set THEN sqrt(greatest(0e0, 1 - ({raw['x']} * {raw['x']} + {raw['y']} * {raw['y']}))) * (CASE WHEN s.below THEN -1e0 ELSE 1e0 END) ELSE 0e0 END)"
    count = "((CASE WHEN s.set THEN s.n ELSE 0 END) + 1)"
    m = {a: f"({dec[a]} + (v.u{a} - {dec[a]}) / {count})" for a in "xyz"}
    size = f"({m['x']} * {m['x']} + {m['y']} * {m['y']} + {m['z']} * {m['z']})"
    by = f"(CASE WHEN {size} > 1e-6 THEN 1 / sqrt({size}) ELSE 0e0 END)"
    bits = {a: f"CAST(floor(0.5e0 * (least(1e0, greatest(-1e0, {m[a]} * {by})) + 1) * 16383) AS INT)" for a in "xy"}
    square = "((ox - sx) * (ox - sx) + (oy - sy) * (oy - sy) + (oz - sz) * (oz - sz))"
    unit = ", ".join(f"'u{a}': (o{a} - s{a}) * (CASE WHEN {square} > 1e-6 THEN 1 / sqrt({square}) ELSE 0e0 END)" for a in "xyz")
    state = "'ix': 0, 'iy': 0, 'below': false, 'set': false, 'n': 0"
    fold = f"list_reduce(list_prepend({{{state}, 'ux': 0e0, 'uy': 0e0, 'uz': 0e0}}, list({{{state}, {unit}}} ORDER BY seq)), lambda s, v: {{'ix': {bits['x']}, 'iy': {bits['y']}, 'below': {m['z']} * {by} < 0, 'set': {size} > 1e-6, 'n': s.n + 1, 'ux': 0e0, 'uy': 0e0, 'uz': 0e0}})"
    return f"{_VISITS}, f AS (SELECT gx, gy, gz, {fold} AS f FROM visits JOIN rays USING (seq) WHERE sample GROUP BY gx, gy, gz) SELECT gx, gy, gz, f.ix AS ix, f.iy AS iy, f.below AS below, f.n AS n FROM f"


@query(_normal_sql())
def incident_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.normals(walk(rays_of(spark, sf_dir), P, keep=("ox", "oy", "oz", "sx", "sy", "sz")))


_ALONG = " + ".join(f"({exprs.centre(f'g{a}', P, i)} - o{a}) * (s{a} - o{a})" for i, a in enumerate("xyz"))
_TSDF_FOLD = """list_reduce(list_prepend({'w': 0::FLOAT, 'd': 0::FLOAT}, list({'w': 0::FLOAT, 'd': sdf} ORDER BY seq)), lambda s, v: {'w': least((s.w + 1::FLOAT)::FLOAT, 1e4::FLOAT),
  'd': least(greatest(((v.d + s.d * s.w)::FLOAT / (s.w + 1::FLOAT))::FLOAT, -0.1e0::FLOAT), 0.1e0::FLOAT)})"""


@query(f"{_VISITS}, d AS (SELECT gx, gy, gz, seq, (CASE WHEN {exprs.RAY_LENGTH} > 0 THEN {exprs.RAY_LENGTH} - ({_ALONG}) / {exprs.RAY_LENGTH} ELSE 0e0 END)::FLOAT AS sdf FROM visits JOIN rays USING (seq)), f AS (SELECT gx, gy, gz, {_TSDF_FOLD} AS f FROM d GROUP BY gx, gy, gz) SELECT gx, gy, gz, f.w::DOUBLE AS weight, round(f.d::DOUBLE, 5) AS distance FROM f")
def tsdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fold.tsdf(walk(rays_of(spark, sf_dir), P, keep=("ox", "oy", "oz", "sx", "sy", "sz")), P)
    return t.select(*fold.VOXEL, F.col("weight").cast("double").alias("weight"), F.round(F.col("distance").cast("double"), 5).alias("distance"))


@query(f"{_VISITS}, d AS (SELECT gx, gy, gz, seq, (CASE WHEN {exprs.RAY_LENGTH} > 0 THEN {exprs.RAY_LENGTH} - ({_ALONG}) / {exprs.RAY_LENGTH} ELSE 0e0 END)::FLOAT AS sdf FROM visits JOIN rays USING (seq)), f AS (SELECT gx, gy, gz, {_TSDF_FOLD} AS f FROM d GROUP BY gx, gy, gz) SELECT gx, gy, gz FROM f WHERE f.w > 0 AND abs(round(f.d::DOUBLE, 5)) < 0.05e0")
def tsdf_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.surface(tsdf(spark, sf_dir), P, 0.05).select(*fold.VOXEL)


# sensor paths and batches


@query(f"""{_RAYS}, knots AS (SELECT ts, 0.01e0 * min(seq) / 50 AS x, ((min(seq) // 50) % 20) * 0.05e0 AS y, 0.5e0 AS z FROM rays WHERE seq % 50 = 0 GROUP BY ts),
spans AS (SELECT *, lead(ts) OVER w AS nts, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM knots WINDOW w AS (ORDER BY ts))
SELECT r.seq, {', '.join(f'round(coalesce(k.{a} + (r.ts - k.ts) / (nts - k.ts) * (n{a} - k.{a}), 0e0), 6) AS sensor_{a}' for a in 'xyz')} FROM rays r LEFT JOIN spans k ON r.ts >= k.ts AND r.ts < k.nts WHERE r.seq % 50 <> 0""")
def trajectory_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays = rays_of(spark, sf_dir)
    met = sources.attach_trajectory(rays.where("seq % 50 <> 0").select("seq", "ts"), sources.trajectory(rays))
    return rounded(met.select("seq", "sensor_x", "sensor_y", "sensor_z"), "sensor_x", "sensor_y", "sensor_z")


@query(f"{_RAYS}, p AS (SELECT *, seq % 16 AS part, floor(ts / 60) AS m FROM rays) SELECT seq, part, coalesce(m = lag(m) OVER w, false)::INT AS inferred_return, round(CASE WHEN coalesce(m = lag(m) OVER w, false) THEN lag(sx) OVER w ELSE ox END, 6) AS ox FROM p WINDOW w AS (PARTITION BY part ORDER BY seq)")
def return_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays = rays_of(spark, sf_dir).withColumns({"part": F.col("seq") % 16, "ts": F.floor(F.col("ts") / 60)})
    return rounded(sources.infer_returns(rays, "part").select("seq", "part", "inferred_return", "ox"), "ox")


_BATCH = f"{_RAYS}, b AS (SELECT (seq // 500)::BIGINT AS batch, count(*) AS rays, round(min({exprs.RAY_LENGTH}), 6) AS shortest, round(max({exprs.RAY_LENGTH}), 6) AS longest, round(avg({exprs.RAY_LENGTH}), 6) AS mean, sum({exprs.RAY_LENGTH}) AS total FROM rays GROUP BY 1)"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr(exprs.RAY_LENGTH)
    return rays_of(spark, sf_dir).groupBy(F.expr("seq DIV 500").alias("batch")).agg(F.count("*").alias("rays"), F.round(F.min(n), 6).alias("shortest"), F.round(F.max(n), 6).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.sum(n).alias("total"))


@query(f"{_BATCH} SELECT batch, rays, shortest, longest, mean FROM b")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).drop("total")


@query(f"{_BATCH} SELECT batch, (sum(rays) OVER w)::BIGINT AS rays, round(sum(total) OVER w / sum(rays) OVER w, 6) AS mean FROM b WINDOW w AS (ORDER BY batch ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def windowed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over each batch and the 19 before it, by chunks of batches; a chunk gets the last 19 batches of the one before as well."""
    size, ahead = 1000, 19
    own = F.floor(F.col("batch") / size)
    spread = F.when(F.col("batch") % size >= size - ahead, F.array(own, own + 1)).otherwise(F.array(own))
    rows = _batches(spark, sf_dir).withColumn("chunk", F.explode(spread))
    w = Window.partitionBy("chunk").orderBy("batch").rowsBetween(-ahead, 0)
    out = rows.select("batch", "chunk", F.sum("rays").over(w).alias("rays"), F.round(F.sum("total").over(w) / F.sum("rays").over(w), 6).alias("mean"))
    return out.where(F.col("chunk") == own).drop("chunk")


@query()
def motion_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of each of seven sensors by size and motion."""
    rays = rays_of(spark, sf_dir).withColumn("sensor", F.expr("CAST(round((ox + 0.93e0) / 0.31e0) AS INT)"))
    return sources.motion_batches(rays, "sensor", 64, 0.4)


@query(f"""{_RAYS}, knots AS (SELECT ts, 0.01e0 * min(seq) / 50 AS x, cos(0.05e0 * min(seq) / 50) AS qw, sin(0.05e0 * min(seq) / 50) AS qz FROM rays WHERE seq % 50 = 0 GROUP BY ts),
spans AS (SELECT *, lead(ts) OVER w AS nts, lead(x) OVER w AS nx FROM knots WINDOW w AS (ORDER BY ts)), lin AS (SELECT k.ts, k.nts, k.x, k.nx, atan2(k.qz, k.qw) AS a, 0.05e0 * (k.nx - k.x) / 0.01e0 AS da FROM spans k)
SELECT r.seq, round(l.x + u * (l.nx - l.x) + cos(2 * (l.a + u * l.da)) * sx - sin(2 * (l.a + u * l.da)) * sy, 4) AS wx, round(sin(2 * (l.a + u * l.da)) * sx + cos(2 * (l.a + u * l.da)) * sy, 4) AS wy
FROM (SELECT r.*, l.*, (r.ts - l.ts) / (l.nts - l.ts) AS u FROM rays r LEFT JOIN lin l ON r.ts >= l.ts AND r.ts < l.nts WHERE r.seq % 50 <> 0) r, LATERAL (SELECT r.x, r.nx, r.a, r.da) l""")
def pose_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved by a turning sensor's pose."""
    rays = rays_of(spark, sf_dir)
    knots = rays.where("seq % 50 = 0").groupBy("ts").agg((F.lit(0.01) * F.min("seq") / 50).alias("x"), (F.lit(0.05) * F.min("seq") / 50).alias("h"))
    path = knots.select("ts", "x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.cos("h").alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin("h").alias("qz"))
    points = rays.where("seq % 50 <> 0").selectExpr("seq", "ts", "sx AS x", "sy AS y", "sz AS z")
    return sources.attach_pose(points, path).select("seq", F.round("wx", 4).alias("wx"), F.round("wy", 4).alias("wy"))


# spatial queries


@query(f"""{_BASE}, j AS (SELECT v.*, occupancy, coalesce(occupancy > 0, false) AS stop, row_number() OVER (PARTITION BY seq ORDER BY step) AS rn FROM visits v LEFT JOIN voxels USING (gx, gy, gz)),
f AS (SELECT *, min(CASE WHEN stop THEN rn END) OVER (PARTITION BY seq) AS first FROM j), u AS (SELECT * FROM f WHERE first IS NULL OR rn <= first)
SELECT seq, round(coalesce(max(exit) FILTER (NOT stop), 0e0), 6) AS range, round(sum(CASE WHEN occupancy IS NULL THEN exit ** 3 - enter ** 3 ELSE 0e0 END), 6) AS unobserved_volume,
CASE WHEN max_by(coalesce(occupancy, 1e30), rn) = 1e30 THEN -1 WHEN max_by(occupancy, rn) > 0 THEN 1 ELSE 0 END AS terminal_type, max_by(gx, rn) AS t_gx, max_by(gy, rn) AS t_gy, max_by(gz, rn) AS t_gz FROM u GROUP BY seq""")
def rays_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.rays_query(rays_of(spark, sf_dir), voxels_of(spark, sf_dir), P), "range", "unobserved_volume")


_D2 = "((o.gx - t.gx) * 0.1e0) ** 2 + ((o.gy - t.gy) * 0.1e0) ** 2 + ((o.gz - t.gz) * 0.1e0) ** 2"
_NEAR_CELL = "o.gx BETWEEN t.gx - 3 AND t.gx + 3 AND o.gy BETWEEN t.gy - 3 AND t.gy + 3 AND o.gz BETWEEN t.gz - 3 AND t.gz + 3"


@query(f"""{_BASE}, t AS (SELECT DISTINCT gx, gy, gz, gx // 8 AS c FROM visits), o AS (SELECT gx, gy, gz, gx // 8 + unnest([-1, 0, 1]) AS c FROM voxels WHERE occupancy >= 0),
n AS (SELECT t.gx, t.gy, t.gz, min({_D2}) AS d2 FROM t JOIN o ON o.c = t.c AND {_NEAR_CELL} WHERE {_D2} <= 0.09e0 + 1e-9 GROUP BY ALL)
SELECT seq, step AS place, gx, gy, gz, round(coalesce(sqrt(d2), -1e0), 6) AS clearance FROM visits LEFT JOIN n USING (gx, gy, gz)""")
def line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.line_query(rays_of(spark, sf_dir), voxels_of(spark, sf_dir), P, 0.3), "clearance")


@query(f"""{_BASE}, t AS (SELECT *, gx // 8 AS c FROM voxels), o AS (SELECT gx, gy, gz, gx // 8 + unnest([-1, 0, 1]) AS c FROM voxels WHERE occupancy >= 0),
n AS (SELECT t.gx, t.gy, t.gz, min({_D2}) AS d2 FROM t JOIN o ON o.c = t.c AND {_NEAR_CELL} WHERE {_D2} <= 0.09e0 + 1e-9 GROUP BY ALL) SELECT gx, gy, gz, round(coalesce(sqrt(d2), -1e0), 6) AS clearance FROM voxels LEFT JOIN n USING (gx, gy, gz)""")
def clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.clearance(voxels_of(spark, sf_dir), P, 0.3), "clearance")


_CENTRE = " + ".join(f"({exprs.centre(f'v.g{a}', P, i)} - p.{a}) ** 2" for i, a in enumerate("xyz"))


@query(f"{_BASE}, {_POINTS} SELECT p.seq, v.gx, v.gy, v.gz, round(sqrt({_CENTRE}), 6) AS range FROM points p JOIN voxels v ON v.occupancy >= 0 AND sqrt({_CENTRE}) <= 0.5e0")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.nearest_neighbours(points_of(spark, sf_dir), voxels_of(spark, sf_dir), P, 0.5), "range")


@query(f"{_BASE}, k AS (SELECT seq, {', '.join(f'{e} AS {n}' for n, e in _KEYS.items())} FROM rays) SELECT seq FROM k SEMI JOIN (SELECT * FROM voxels WHERE occupancy >= 0) USING (gx, gy, gz)")
def cloud_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = rays_of(spark, sf_dir).selectExpr("seq", "sx AS x", "sy AS y", "sz AS z")
    return spatial.filter_cloud(points, voxels_of(spark, sf_dir), P).select("seq")


# whole maps


_REG = ", ".join(f"{exprs.region_of(f'g{a}', P)} AS r{a}" for a in "xyz")
#: A second map, where two are needed: of the samples of all rays.
_TWO = f"{_BASE},\n{oracles.voxels_cte(where='sample', voxels='other')}"


@query(f"{_TWO}, o AS (SELECT DISTINCT {_REG} FROM other), m AS (SELECT *, {_REG} FROM voxels) SELECT gx, gy, gz, occupancy::DOUBLE AS occupancy FROM m ANTI JOIN o USING (rx, ry, rz) UNION ALL SELECT gx, gy, gz, occupancy::DOUBLE FROM other")
def merge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = maps.merge(voxels_of(spark, sf_dir), voxels_of(spark, sf_dir, exclude_ray=True), P)
    return merged.select(*fold.VOXEL, F.col("occupancy").cast("double").alias("occupancy"))


_LO, _HI = maps.region_box(P)
_MEETS = " AND ".join(f"{a} <= {exprs.num(h)} AND {b} >= {exprs.num(l)}" for a, b, l, h in zip(_LO, _HI, *EDGE_BOX, strict=True))  # noqa: E741


@query(f"{_BASE} SELECT gx, gy, gz, occupancy::DOUBLE AS occupancy FROM (SELECT *, {_REG} FROM voxels) WHERE {_MEETS}")
def submap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.submap(voxels_of(spark, sf_dir), EDGE_BOX, P).select(*fold.VOXEL, F.col("occupancy").cast("double").alias("occupancy"))


_REGIONS = f"{_VISITS}, regions AS (SELECT {_REG}, max(ts) AS touched, (max(seq // 4096) + 1)::BIGINT AS stamp FROM visits JOIN rays USING (seq) GROUP BY 1, 2, 3)"


@query(f"{_REGIONS} SELECT rx, ry, rz, round(touched, 3) AS touched FROM regions WHERE touched >= (SELECT avg(touched) FROM regions)")
def expire_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = maps.regions(walk(rays_of(spark, sf_dir), P, keep=("ts",)), P)
    return r.crossJoin(F.broadcast(r.agg(F.avg("touched").alias("limit")))).where("touched >= limit").select(*maps.REGION, F.round("touched", 3).alias("touched"))


@query(f"{_REGIONS} SELECT rx, ry, rz FROM regions WHERE (rx * 3.2e0) ** 2 + (ry * 3.2e0) ** 2 + (rz * 3.2e0) ** 2 < 9e0")
def cull_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = maps.regions(walk(rays_of(spark, sf_dir), P, keep=("ts",)), P)
    return maps.within_distance(r, (0.0, 0.0, 0.0), 3.0, P).select(*maps.REGION)


@query(f"{_REGIONS} SELECT rx, ry, rz, stamp FROM regions WHERE stamp > 1")
def dirty_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.dirty(maps.regions(walk(rays_of(spark, sf_dir), P, keep=("ts",)), P), 1).select(*maps.REGION, "stamp")


@query(f"{_BASE} SELECT count(*) FILTER (occupancy >= 0) AS occupied, count(*) FILTER (NOT occupancy >= 0) AS free, min(occupancy)::DOUBLE AS least, max(occupancy)::DOUBLE AS most, (SELECT count(*) FROM (SELECT DISTINCT {_REG} FROM voxels)) AS regions FROM voxels")
def map_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.stats(voxels_of(spark, sf_dir), P)


@query(f"{_BASE} SELECT min(gx) AS min_gx, max(gx) AS max_gx, min(gy) AS min_gy, max(gy) AS max_gy, min(gz) AS min_gz, max(gz) AS max_gz FROM voxels")
def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.extents(voxels_of(spark, sf_dir))


@query(f"{_TWO} SELECT count(*) FILTER (abs(a.occupancy - b.occupancy) <= 0.5e0) AS same, count(*) FILTER (abs(a.occupancy - b.occupancy) > 0.5e0) AS different, count(*) FILTER (b.occupancy IS NULL) AS missing FROM voxels a LEFT JOIN other b USING (gx, gy, gz)")
def compare_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.compare(voxels_of(spark, sf_dir), voxels_of(spark, sf_dir, exclude_ray=True), 0.5)


@query(f"{_REGIONS} SELECT DISTINCT a.rx, a.ry, a.rz FROM regions a JOIN regions b ON b.stamp > 1 AND abs(a.rx - b.rx) <= 1 AND abs(a.ry - b.ry) <= 1 AND abs(a.rz - b.rz) <= 1")
def stale_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose clearance must be computed anew."""
    return maps.stale(maps.regions(walk(rays_of(spark, sf_dir), P, keep=("ts",)), P), 1)


@query(f"{_BASE}, q AS (SELECT seq, {', '.join(f'{e} + 1 AS {n}' for n, e in _KEYS.items())} FROM rays), r AS (SELECT DISTINCT {_REG} FROM voxels) SELECT seq, gx, gy, gz, round(occupancy::DOUBLE, 6) AS occupancy, CASE WHEN occupancy IS NOT NULL THEN (occupancy >= 0)::INT WHEN r.rx IS NOT NULL THEN -1 ELSE -2 END AS kind FROM (SELECT *, {_REG} FROM q) q LEFT JOIN voxels USING (gx, gy, gz) LEFT JOIN r ON q.rx = r.rx AND q.ry = r.ry AND q.rz = r.rz")
def voxel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = voxels_of(spark, sf_dir)
    keys = rays_of(spark, sf_dir).selectExpr("seq", *[f"{e} + 1 AS {n}" for n, e in _KEYS.items()])
    return rounded(maps.lookup(m, maps.with_region(m, P).select(*maps.REGION).distinct(), keys, P), "occupancy")


@query(f"{_REGIONS} SELECT count(*) AS regions, count(*) * {32**3 * 12} AS bytes FROM regions")
def map_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.memory(maps.regions(walk(rays_of(spark, sf_dir), P, keep=("ts",)), P), 12, P)


_RAY_BOX = (tuple(f"least(o{a}, s{a})" for a in "xyz"), tuple(f"greatest(o{a}, s{a})" for a in "xyz"))
_FIXED_BOX = tuple(tuple(exprs.num(x) for x in side) for side in BOX)


@query(f"{_RAYS} SELECT seq, {boxes.overlaps(_RAY_BOX, _FIXED_BOX)} AS overlaps, {boxes.contains(_FIXED_BOX, ('sx', 'sy', 'sz'))} AS inside, round({boxes.diagonal(_RAY_BOX)}, 6) AS diagonal, round({boxes.volume(_RAY_BOX)}, 6) AS volume, round({boxes.centre(_RAY_BOX)[0]}, 6) AS cx FROM rays")
def ray_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of rays against a box."""
    r = rays_of(spark, sf_dir)
    out = r.selectExpr("seq", f"{boxes.overlaps(_RAY_BOX, _FIXED_BOX)} AS overlaps", f"{boxes.contains(_FIXED_BOX, ('sx', 'sy', 'sz'))} AS inside", f"{boxes.diagonal(_RAY_BOX)} AS diagonal", f"{boxes.volume(_RAY_BOX)} AS volume", f"{boxes.centre(_RAY_BOX)[0]} AS cx")
    return rounded(out, "diagonal", "volume", "cx")


@query(f"{_BASE} SELECT CASE WHEN occupancy >= 0 THEN 'occupied' ELSE 'free' END AS name, count(*) AS n FROM voxels GROUP BY 1")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr(exprs.occupancy_type("occupancy", P))
    return voxels_of(spark, sf_dir).groupBy(names.name_of(kind, names.OCCUPANCY_TYPES).alias("name")).agg(F.count("*").alias("n"))


# heightmaps


_GROUND = f"{_BASE}, c AS (SELECT gx, gy, gz, (lead(gz) OVER (PARTITION BY gx, gy ORDER BY gz) - gz - 1) * 0.1e0 AS gap FROM voxels WHERE occupancy >= 0)"


@query(f"{_GROUND}, n AS (SELECT gx, gy, count(*) AS n_occupied FROM c GROUP BY ALL), g AS (SELECT * FROM c WHERE gap IS NULL OR gap >= 0.5e0 QUALIFY row_number() OVER (PARTITION BY gx, gy ORDER BY gz) = 1) SELECT gx, gy, gz, round({exprs.centre('gz', P, 2)} + 0.05e0, 6) AS height, round(coalesce(gap, -1e0), 6) AS clearance, n_occupied FROM g JOIN n USING (gx, gy)")
def heightmap_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(heightmap.planar(voxels_of(spark, sf_dir), P), "height", "clearance")


@query(f"{_GROUND} SELECT gx, gy, gz, (row_number() OVER (PARTITION BY gx, gy ORDER BY gz) - 1)::INT AS layer, round(coalesce(gap, -1e0), 6) AS clearance FROM c WHERE gap IS NULL OR gap >= 0.5e0")
def heightmap_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(heightmap.layered(voxels_of(spark, sf_dir), P), "clearance")


@query(f"""{_BASE}, c AS (SELECT gx, gy, max((occupancy >= 0)::INT) AS solid, min(gz) AS gz FROM voxels GROUP BY ALL)
SELECT a.gx, a.gy, a.gz, count(*) AS neighbours FROM c a JOIN c b ON b.solid = 1 AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 WHERE a.solid = 0 GROUP BY ALL HAVING count(*) >= 2""")
def heightmap_virtual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heightmap.virtual_surfaces(voxels_of(spark, sf_dir), P)


_SURFACE = f"{_GROUND}, s AS (SELECT gx, gy, {exprs.centre('gz', P, 2)} + 0.05e0 AS height FROM c WHERE gap IS NULL OR gap >= 0.5e0 QUALIFY row_number() OVER (PARTITION BY gx, gy ORDER BY gz) = 1)"


@query(f"{_SURFACE}, q AS (SELECT a.gx, a.gy, a.height AS h00, b.height AS h10, c2.height AS h01, d.height AS h11 FROM s a JOIN s b ON b.gx = a.gx + 1 AND b.gy = a.gy JOIN s c2 ON c2.gx = a.gx AND c2.gy = a.gy + 1 JOIN s d ON d.gx = a.gx + 1 AND d.gy = a.gy + 1) SELECT gx, gy, 0 AS half, round(h00, 6) AS a, round(h10, 6) AS b, round(h11, 6) AS c FROM q UNION ALL SELECT gx, gy, 1, round(h00, 6), round(h11, 6), round(h01, 6) FROM q")
def heightmap_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(heightmap.mesh(heightmap.planar(voxels_of(spark, sf_dir), P)), "a", "b", "c")


@query(f"{_SURFACE}, e AS (SELECT min(gx) AS x0, max(gy) AS y1 FROM s) SELECT y1 - gy AS row, gx - x0 AS col, CAST(floor(least(1e0, greatest(0e0, (height - -2e0) / 4e0)) * 65535) AS INT) AS shade FROM s, e")
def heightmap_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heightmap.pixels(heightmap.planar(voxels_of(spark, sf_dir), P), -2.0, 2.0)


@query(f"{_SURFACE} SELECT a.gx, a.gy, round(degrees(atan(max(abs(a.height - b.height) / (sqrt((a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2) * 0.1e0)))), 4) AS slope FROM s a JOIN s b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND (a.gx <> b.gx OR a.gy <> b.gy) GROUP BY ALL")
def heightmap_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heightmap.slopes(heightmap.planar(voxels_of(spark, sf_dir), P), P).withColumn("slope", F.round("slope", 4))


@query(f"{_SURFACE.replace('WITH ', 'WITH RECURSIVE ', 1)}, r AS (SELECT gx, gy, height FROM s WHERE gx = 16 AND gy = 16 UNION SELECT s.gx, s.gy, s.height FROM r JOIN s ON abs(s.gx - r.gx) <= 1 AND abs(s.gy - r.gy) <= 1 AND abs(s.height - r.height) <= 0.35e0) SELECT gx, gy, round(height, 6) AS height FROM r")
def heightmap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns reached from the middle of the heightmap by steps of 0.35 m at most."""
    surface = heightmap.planar(voxels_of(spark, sf_dir), P)
    return rounded(heightmap.fill(surface, (16, 16), 0.35, P), "height")


# distributions and exports


@query(f"{_VISITS} SELECT gx, gy, gz, count(*) AS n, {', '.join(f'round(avg(s{a}), 6) AS m{a}' for a in 'xyz')}, round(covar_pop(sx, sx), 6) AS cxx, round(covar_pop(sx, sy), 6) AS cxy, round(avg(intensity), 4) AS intensity_mean FROM visits JOIN rays USING (seq) WHERE sample GROUP BY ALL")
def ndt_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ndt.moments(walk(rays_of(spark, sf_dir), P, keep=("sx", "sy", "sz", "intensity")))
    return rounded(m, "mx", "my", "mz", "cxx", "cxy").select(*fold.VOXEL, "n", "mx", "my", "mz", "cxx", "cxy", F.round("intensity_mean", 4).alias("intensity_mean"))


@query(f"{_VISITS} SELECT gx, gy, gz, count(*) FILTER (sample) AS hits, count(*) FILTER (NOT sample) AS misses FROM visits GROUP BY ALL")
def ndt_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndt.hit_miss(walk(rays_of(spark, sf_dir), P))


@query()
def ndt_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running distributions of all voxels; no SQL: tests hold them against plain loops."""
    return ndt.integrate_rays(rays_of(spark, sf_dir), P)


@query()
def ndt_eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndt.eigen(ndt.moments(walk(rays_of(spark, sf_dir), P, keep=("sx", "sy", "sz", "intensity"))).where("n >= 4"))


_SHARE = f"least(1e0, greatest(0e0, ({exprs.centre('gz', P, 2)} - -1e0) / 2.5e0))"


@query(f"{_BASE} SELECT gx, gy, gz, {', '.join(f'round({e}, 6) AS {n}' for n, e in zip('rgb', exprs.hsv_to_rgb(f'({_SHARE} * 240e0)', '1e0', '1e0'), strict=True))} FROM voxels WHERE occupancy >= 0")
def colour_by_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clouds.coloured_by_height(voxels_of(spark, sf_dir), P, -1.0, 1.5), "r", "g", "b")


@query(f"{_BASE}, c AS (SELECT *, unnest(range(8))::INT AS corner FROM voxels WHERE occupancy >= 0) SELECT gx, gy, gz, corner, {', '.join(f'round({exprs.centre(f"g{a}", P, i)} + CASE WHEN (corner // {1 << i}) % 2 = 1 THEN 0.05e0 ELSE -0.05e0 END, 6) AS {a}' for i, a in enumerate('xyz'))} FROM c")
def voxel_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clouds.cubes(voxels_of(spark, sf_dir), P), "x", "y", "z")


@query("SELECT x::INT AS gx, y::INT AS gy, z::INT AS gz FROM range(-10, 11) a(x), range(-8, 9) b(y), range(0, 13) c(z) WHERE abs(x) = 10 OR abs(y) = 8 OR z = 0 OR z = 12")
def box_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.box_room(spark, (10, 8), 12)


@query("SELECT ring::INT AS ring, spoke::INT AS spoke, round(2e0 * sin(ring * pi() / 36) * cos(spoke * pi() / 18), 6) AS x, round(2e0 * sin(ring * pi() / 36) * sin(spoke * pi() / 18), 6) AS y, round(2e0 * cos(ring * pi() / 36), 6) AS z FROM range(0, 7) a(ring), range(0, 36) b(spoke) WHERE ring > 0 OR spoke = 0")
def cone_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generators.cone(spark, angle_deg=60.0, step_deg=5.0, spokes=36, reach=2.0), "x", "y", "z")


@query(f"{_BASE} SELECT gx, gy, gz, occupancy::DOUBLE AS occupancy, n_ops FROM voxels")
def stream_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occupancy_map, from a stream in micro-batches."""
    return streaming.replay(spark, sf_dir, P).withColumn("occupancy", F.col("occupancy").cast("double"))
