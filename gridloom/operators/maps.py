"""Operations on whole maps: voxel tables (gx, gy, gz, layers) and region tables (rx, ry, rz, touched, stamp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exprs import num, region_of
from gridloom.functions.params import MapParams
from gridloom.operators.fold import VOXEL

REGION = ("rx", "ry", "rz")


def with_region(voxels: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    return voxels.withColumns({r: F.expr(region_of(g, p)) for r, g in zip(REGION, VOXEL, strict=True)})


def regions(visits: DataFrame, p: MapParams = MapParams(), batch: int = 4096) -> DataFrame:
    """Regions of visits (with ts): last time touched, and the stamp of the last batch that touched it."""
    seen = with_region(visits, p)
    return seen.groupBy(*REGION).agg(F.max("ts").alias("touched"), (F.max(F.floor(F.col("seq") / batch)) + 1).cast("long").alias("stamp"))


def merge(into: DataFrame, source: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """into, with every region that source has replaced by source's."""
    keys = with_region(source, p).select(*REGION).distinct()
    kept = with_region(into, p).join(keys, list(REGION), "left_anti").drop(*REGION)
    return kept.unionByName(source)


def region_box(p: MapParams) -> tuple[list[str], list[str]]:
    d = num(p.resolution * p.dims)
    lo = [f"({r} * {d} - {d} / 2 + {num(o)})" for r, o in zip(REGION, p.origin, strict=True)]
    return lo, [f"({x} + {d})" for x in lo]


def overlaps(box: tuple[tuple[float, ...], tuple[float, ...]], p: MapParams = MapParams()) -> Column:
    """Whether a region (rx, ry, rz) meets a box."""
    lo, hi = region_box(p)
    return F.expr(" AND ".join(f"{a} <= {num(h)} AND {b} >= {num(l)}" for a, b, l, h in zip(lo, hi, *box, strict=True)))  # noqa: E741


def submap(voxels: DataFrame, box: tuple[tuple[float, ...], tuple[float, ...]], p: MapParams = MapParams()) -> DataFrame:
    """Whole regions that meet a box."""
    return with_region(voxels, p).where(overlaps(box, p)).drop(*REGION)


def expire(region_table: DataFrame, time: float) -> DataFrame:
    """Regions touched at `time` or later."""
    return region_table.where(F.col("touched") >= time)


def within_distance(region_table: DataFrame, at: tuple[float, float, float], distance: float, p: MapParams = MapParams()) -> DataFrame:
    """Regions whose centre is nearer than distance."""
    d = num(p.resolution * p.dims)
    squares = " + ".join(f"({r} * {d} + {num(o)} - {num(c)}) * ({r} * {d} + {num(o)} - {num(c)})" for r, o, c in zip(REGION, p.origin, at, strict=True))
    return region_table.where(F.expr(f"{squares} < {num(distance * distance)}"))


def keep_regions(voxels: DataFrame, region_table: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Voxels of the given regions."""
    return with_region(voxels, p).join(region_table.select(*REGION), list(REGION), "left_semi").drop(*REGION)


def dirty(region_table: DataFrame, since: int) -> DataFrame:
    """Regions touched after a stamp, in the order of their stamps."""
    return region_table.where(F.col("stamp") > since).orderBy("stamp", *REGION)


def extents(voxels: DataFrame) -> DataFrame:
    return voxels.agg(*[f(g).alias(f"{n}_{g}") for g in VOXEL for f, n in ((F.min, "min"), (F.max, "max"))])


def stats(voxels: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Counts of occupied and free voxels, regions and the range of values."""
    is_occupied = F.col("occupancy") >= p.threshold
    r = with_region(voxels, p)
    return r.agg(F.count_if(is_occupied).alias("occupied"), F.count_if(~is_occupied).alias("free"), F.min("occupancy").cast("double").alias("least"), F.max("occupancy").cast("double").alias("most"), F.count_distinct(*REGION).alias("regions"))


def compare(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Voxels of a that b has within the tolerance, has otherwise, or lacks."""
    both = a.select(*VOXEL, F.col("occupancy").alias("va")).join(b.select(*VOXEL, F.col("occupancy").alias("vb")), list(VOXEL), "left")
    near = F.abs(F.col("va") - F.col("vb")) <= tolerance
    return both.agg(F.count_if(near).alias("same"), F.count_if(~near).alias("different"), F.count_if(F.col("vb").isNull()).alias("missing"))


def layout_match(a: DataFrame, b: DataFrame) -> str:
    """exact (equal columns in order), equivalent (equal but for order) or different."""
    one, two = [(f.name, f.dataType) for f in a.schema], [(f.name, f.dataType) for f in b.schema]
    return "exact" if one == two else "equivalent" if sorted(one, key=str) == sorted(two, key=str) else "different"


def shared_layers(a: DataFrame, b: DataFrame) -> list[str]:
    """Layers that two maps have in common, by name and type."""
    return [f.name for f in a.schema if f.name not in VOXEL and any(f.name == g.name and f.dataType == g.dataType for g in b.schema)]


def filter_layers(voxels: DataFrame, layers: list[str]) -> DataFrame:
    return voxels.select(*VOXEL, *[c for c in layers if c in voxels.columns])


def clear_layer(voxels: DataFrame, layer: str, value: float | None) -> DataFrame:
    """The map with one layer set to its clear value."""
    return voxels.withColumn(layer, F.lit(value).cast(voxels.schema[layer].dataType))


def memory(region_table: DataFrame, bytes_a_voxel: int, p: MapParams = MapParams()) -> DataFrame:
    """Regions, and the bytes that a dense store of them would take."""
    return region_table.agg(F.count("*").alias("regions"), (F.count("*") * (p.dims**3 * bytes_a_voxel)).alias("bytes"))


def stale(region_table: DataFrame, since: int) -> DataFrame:
    """Regions to compute anew after a stamp: those touched since, and their 26 neighbours that exist."""
    near = region_table.where(F.col("stamp") > since).select(*REGION)
    for r in REGION:
        near = near.withColumn(f"d{r}", F.explode(F.expr("sequence(-1, 1)"))).withColumn(r, F.col(r) + F.col(f"d{r}"))
    return region_table.select(*REGION).join(near.select(*REGION).distinct(), list(REGION), "left_semi")


def lookup(voxels: DataFrame, region_table: DataFrame, keys: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Occupancy and type of single voxels: null (-2) where the region isn't there, unobserved (-1) where it is but the voxel isn't."""
    there = region_table.select(*REGION, F.lit(True).alias("there"))
    met = with_region(keys, p).join(voxels.select(*VOXEL, "occupancy"), list(VOXEL), "left").join(there, list(REGION), "left")
    kind = F.when(F.col("occupancy").isNotNull(), F.when(F.col("occupancy") >= p.threshold, 1).otherwise(0)).when(F.col("there"), -1).otherwise(-2)
    return met.select(*keys.columns, "occupancy", kind.alias("kind"))


def cull_outside(region_table: DataFrame, box: tuple[tuple[float, ...], tuple[float, ...]], p: MapParams = MapParams()) -> DataFrame:
    """Regions that meet a box; the others go."""
    return region_table.where(overlaps(box, p))


def touched_since(stamp: int) -> Column:
    return F.col("stamp") > stamp


def all_of(*filters: Column) -> Column:
    out = F.lit(True)
    for f in filters:
        out &= f
    return out


def any_of(*filters: Column) -> Column:
    out = F.lit(False)
    for f in filters:
        out |= f
    return out


def dense(voxels: DataFrame, region_table: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Every voxel of the regions, with the layers of those that are observed (null where not)."""
    cells = region_table.select(*REGION)
    for r, g in zip(REGION, VOXEL, strict=True):
        cells = cells.withColumn(g, F.explode(F.sequence(F.col(r) * p.dims, F.col(r) * p.dims + (p.dims - 1))))
    return cells.select(*VOXEL).join(voxels, list(VOXEL), "left")


def dirty_extents(region_table: DataFrame, since: int) -> DataFrame:
    """Box of the regions touched after a stamp."""
    return region_table.where(F.col("stamp") > since).agg(*[f(r).alias(f"{n}_{r}") for r in REGION for f, n in ((F.min, "min"), (F.max, "max"))])


def detail_stats(voxels: DataFrame) -> DataFrame:
    """Samples and intensities of a map with n (samples a voxel) and intensity_mean."""
    return voxels.agg(F.sum("n").alias("samples"), F.max("n").alias("most_samples"), F.min("intensity_mean").alias("least_intensity"), F.max("intensity_mean").alias("most_intensity"))


def compare_layers(a: DataFrame, b: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """For each layer: voxels of a that b has within the layer's tolerance, has otherwise, or lacks."""
    one = a.select(*VOXEL, *[F.col(c).alias(f"a_{c}") for c in tolerances])
    two = b.select(*VOXEL, F.lit(True).alias("there"), *[F.col(c).alias(f"b_{c}") for c in tolerances])
    near = lambda c: F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerances[c], F.lit(False))
    there = F.col("there").isNotNull()
    counts = [F.struct(F.lit(c).alias("layer"), F.count_if(there & near(c)).alias("same"), F.count_if(there & ~near(c)).alias("different"), F.count_if(~there).alias("missing")) for c in tolerances]
    return one.join(two, list(VOXEL), "left").agg(F.array(*counts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def info_rows(spark, values: dict[str, object]) -> DataFrame:
    """Named values of a map as name, type and value, by name."""
    kinds = {bool: "bool", int: "int64", float: "float64", str: "string"}
    return spark.createDataFrame(sorted((k, kinds[type(v)], str(v).lower() if isinstance(v, bool) else str(v)) for k, v in values.items()), "name string, type string, value string")


def as_number(info: DataFrame) -> DataFrame:
    """Values as numbers where they are, booleans as 0 and 1; null for other strings."""
    return info.withColumn("number", F.when(F.col("type") == "bool", (F.col("value") == "true").cast("double")).otherwise(F.expr("try_cast(value AS DOUBLE)")))
