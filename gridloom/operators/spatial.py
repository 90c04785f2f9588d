"""Spatial queries on a voxel table (gx, gy, gz, occupancy): all of them joins on voxel keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import RAY_LENGTH, centre, key, num
from gridloom.functions.params import MapParams
from gridloom.operators.distance import nearest_obstacle
from gridloom.operators.fold import VOXEL
from gridloom.operators.walk import walk


def occupied(p: MapParams) -> Column:
    return F.col("occupancy") >= p.threshold


def rays_query(rays: DataFrame, voxels: DataFrame, p: MapParams = MapParams(), coefficient: float = 1.0, at_threshold: bool = False) -> DataFrame:
    """Range to the first occupied voxel, unobserved volume ahead of it, and the terminal voxel, of each ray.

    A voxel at the threshold itself stops a ray only if asked. The map is joined to the visits by key; the first
    occupied visit of a ray is an aggregate, so rays are shuffled once after the join and never sorted whole.
    """
    seen = walk(rays, p).join(voxels.select(*VOXEL, "occupancy"), list(VOXEL), "left")
    above = lambda c: F.col(c) >= p.threshold if at_threshold else F.col(c) > p.threshold
    stops = F.coalesce(above("occupancy"), F.lit(False))
    order = F.col("step")
    w = Window.partitionBy("seq")
    first = F.min(F.when(stops, order)).over(w)
    used = seen.withColumns({"order": order, "stops": stops, "first": first}).where(F.col("first").isNull() | (F.col("order") <= F.col("first")))
    volume = F.when(F.col("occupancy").isNull(), F.pow("exit", F.lit(3)) - F.pow("enter", F.lit(3))).otherwise(0.0)
    last = F.max_by(F.struct(*VOXEL, "occupancy"), "order")
    out = used.groupBy("seq").agg(F.coalesce(F.max(F.when(~F.col("stops"), F.col("exit"))), F.lit(0.0)).alias("range"), (coefficient * F.sum(volume)).alias("unobserved_volume"), last.alias("t"))
    kind = F.when(F.col("t.occupancy").isNull(), -1).when(above("t.occupancy"), 1).otherwise(0)
    return out.select("seq", "range", "unobserved_volume", kind.alias("terminal_type"), *[F.col(f"t.{g}").alias(f"t_{g}") for g in VOXEL])


def lookup_rays(rays: DataFrame, voxels: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """rays_query() for rays a degree apart."""
    return rays_query(rays, voxels, p, (math.pi / 180) ** 2)


def segment_keys(rays: DataFrame, p: MapParams = MapParams(), include_end: bool = True) -> DataFrame:
    """Voxels of each segment with their place."""
    visits = walk(rays, p, exclude_sample=not include_end)
    return visits.select("seq", F.col("step").alias("place"), *VOXEL)


def line_keys_counts(rays: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Number of voxels of each segment: one more than the key difference, so no walk is needed."""
    steps = " + ".join(f"abs({key(f's{a}', p, i)} - {key(f'o{a}', p, i)})" for i, a in enumerate("xyz"))
    return rays.select("seq", F.expr(f"CAST({steps} + 1 AS BIGINT)").alias("n_keys"))


def _offsets(reach: int) -> Column:
    return F.explode(F.expr(f"sequence(-{reach}, {reach})"))


def line_query(rays: DataFrame, voxels: DataFrame, p: MapParams = MapParams(), radius: float = 0.3, nearest_only: bool = False, **options) -> DataFrame:
    """Clearance of each voxel along each segment, or the nearest of each segment. options: as in distance.nearest_obstacle."""
    keys = segment_keys(rays, p)
    return _along(keys, nearest_obstacle(keys, voxels, p, radius, **options), nearest_only)


def line_query_on_layer(rays: DataFrame, layer: DataFrame, p: MapParams = MapParams(), default: float = -1.0, nearest_only: bool = False) -> DataFrame:
    """The same from a clearance layer: `default` where it has no voxel, or no obstacle near it."""
    keys = segment_keys(rays, p)
    met = keys.join(layer.select(*VOXEL, "clearance"), list(VOXEL), "left")
    return _along(keys, met.withColumn("clearance", F.when(F.col("clearance") >= 0, F.col("clearance")).otherwise(default)), nearest_only, met=True)


def _along(keys: DataFrame, found: DataFrame, nearest_only: bool, met: bool = False) -> DataFrame:
    # the visits of small tables of rays are taken for small as well, and would be broadcast: both sides are sorted instead
    rows = found if met else keys.join(found.hint("merge"), list(VOXEL))
    if not nearest_only:
        return rows.select("seq", "place", *VOXEL, "clearance")
    best = F.min_by(F.struct("place", *VOXEL, "clearance"), F.struct(F.when(F.col("clearance") < 0, 1e30).otherwise(F.col("clearance")), F.col("place")))
    return rows.groupBy("seq").agg(best.alias("b")).select("seq", "b.*")


def nearest_neighbours(points: DataFrame, voxels: DataFrame, p: MapParams = MapParams(), radius: float = 0.3, nearest_only: bool = False, unknown_as_occupied: bool = False) -> DataFrame:
    """Occupied voxels (and, if asked, those that the map doesn't know) with their centre within radius of each point (seq, x, y, z).

    Unknown voxels are results themselves, so each point then asks for every voxel around it.
    """
    if unknown_as_occupied:
        reach = math.ceil(radius / p.resolution) + 1
        at = points.select("seq", "x", "y", "z", *[F.expr(key(a, p, i)).alias(g) for i, (g, a) in enumerate(zip(VOXEL, "xyz", strict=True))])
        for g in VOXEL:
            at = at.withColumn(g, F.explode(F.sequence(F.col(g) - reach, F.col(g) + reach)))
        centred = at.withColumns({f"v{i}": F.expr(centre(g, p, i)) for i, g in enumerate(VOXEL)})
    else:
        reach = max(1, math.ceil(radius / p.resolution) + 1)
        at = points.select("seq", "x", "y", "z", *[F.expr(f"CAST(floor({key(a, p, i)} / {num(reach)}) AS INT)").alias(f"c{i}") for i, a in enumerate("xyz")])
        o = voxels.where(occupied(p)).select(*VOXEL, *[F.expr(centre(g, p, i)).alias(f"v{i}") for i, g in enumerate(VOXEL)])
        for i, g in enumerate(VOXEL):
            o = o.withColumn(f"n{i}", F.explode(F.expr("sequence(-1, 1)"))).withColumn(f"c{i}", F.floor(F.col(g) / reach).cast("int") + F.col(f"n{i}"))
        centred = at.join(o.drop("n0", "n1", "n2"), ["c0", "c1", "c2"])
    d = [F.col(f"v{i}") - F.col(a) for i, a in enumerate("xyz")]
    found = centred.withColumn("range", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("range") <= radius)
    if unknown_as_occupied:
        found = found.join(voxels.where(~occupied(p)).select(*VOXEL), list(VOXEL), "left_anti")
    if nearest_only:
        return found.groupBy("seq").agg(F.min_by(F.struct(*VOXEL, "range"), F.struct("range", *VOXEL)).alias("b")).select("seq", "b.*")
    return found.select("seq", *VOXEL, "range")


def clearance(voxels: DataFrame, p: MapParams = MapParams(), radius: float = 0.3, **options) -> DataFrame:
    """Distance of every observed voxel to the nearest obstacle. options: as in distance.nearest_obstacle."""
    return nearest_obstacle(None, voxels, p, radius, **options)


def filter_cloud(points: DataFrame, voxels: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Points that lie in an occupied voxel."""
    keyed = points.withColumns({g: F.expr(key(a, p, i)) for i, (g, a) in enumerate(zip(VOXEL, "xyz", strict=True))})
    return keyed.join(voxels.where(occupied(p)).select(*VOXEL), list(VOXEL), "left_semi").select(*points.columns)


def long_rays(rays: DataFrame, least: float) -> DataFrame:
    return rays.where(F.expr(RAY_LENGTH) >= least)


def clearing(rays: DataFrame, voxels: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """The voxels with one miss for each ray whose first occupied voxel (in the map before the batch) they are."""
    seen = walk(rays, p).join(voxels.where(occupied(p)).select(*VOXEL), list(VOXEL), "left_semi")
    first = seen.groupBy("seq").agg(F.min_by(F.struct(*VOXEL), F.col("step")).alias("v"))
    misses = first.groupBy("v").agg(F.count("*").alias("n")).select("v.*", "n")
    fold = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.col("occupancy"), lambda v, _: F.greatest((v + F.lit(p.miss).cast("float")).cast("float"), F.lit(p.low).cast("float")))
    joined = voxels.join(misses, list(VOXEL), "left")
    return joined.select(*VOXEL, F.when(F.col("n") > 0, fold).otherwise(F.col("occupancy")).alias("occupancy"))
