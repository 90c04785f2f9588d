"""Heightmaps: the ground voxel of each column, by windows over columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import centre
from gridloom.functions.params import MapParams
from gridloom.functions.shared import cut
from gridloom.operators.graph import components


def planar(voxels: DataFrame, p: MapParams = MapParams(), clearance: float = 0.5, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """Lowest occupied voxel of each column with clear height above: gx, gy, height (upper wall), clearance, n_occupied.

    A column's occupied voxels are ordered by height; the gap to the next one is its clearance, -1 if nothing is above.
    """
    cells = voxels.where(F.col("occupancy") >= p.threshold).select("gx", "gy", "gz")
    z = F.expr(centre("gz", p, 2))
    if floor is not None:
        cells = cells.where(z >= floor)
    if ceiling is not None:
        cells = cells.where(z <= ceiling)
    column = Window.partitionBy("gx", "gy").orderBy("gz")
    gap = (F.lead("gz").over(column) - F.col("gz") - 1) * p.resolution
    open_cells = cells.withColumn("gap", gap).withColumn("ok", F.col("gap").isNull() | (F.col("gap") >= clearance))
    ground = F.min_by(F.struct("gz", "gap"), F.when(F.col("ok"), F.col("gz")))
    out = open_cells.groupBy("gx", "gy").agg(ground.alias("g"), F.count("*").alias("n_occupied")).where("g is not null")
    return out.select("gx", "gy", F.col("g.gz").alias("gz"), (F.expr(centre("g.gz", p, 2)) + p.resolution / 2).alias("height"), F.coalesce("g.gap", F.lit(-1.0)).alias("clearance"), "n_occupied")


def layered(voxels: DataFrame, p: MapParams = MapParams(), clearance: float = 0.5) -> DataFrame:
    """Every surface of each column with enough clearance, numbered from below; the lowest is the base layer."""
    cells = voxels.where(F.col("occupancy") >= p.threshold).select("gx", "gy", "gz")
    column = Window.partitionBy("gx", "gy").orderBy("gz")
    gap = (F.lead("gz").over(column) - F.col("gz") - 1) * p.resolution
    surfaces = cells.withColumn("gap", gap).where("gap is null or gap >= " + repr(clearance))
    return surfaces.withColumn("layer", F.row_number().over(column) - 1).select("gx", "gy", "gz", "layer", F.coalesce("gap", F.lit(-1.0)).alias("clearance"))


def virtual_surfaces(voxels: DataFrame, p: MapParams = MapParams(), least_neighbours: int = 2) -> DataFrame:
    """Lowest free voxel of columns without an occupied one, kept if enough of the 8 columns around have a surface."""
    kind = F.col("occupancy") >= p.threshold
    columns = voxels.groupBy("gx", "gy").agg(F.max(kind.cast("int")).alias("solid"), F.min("gz").alias("gz"))
    around = columns.where("solid = 1").select("gx", "gy").withColumn("dx", F.explode(F.expr("sequence(-1, 1)"))).withColumn("dy", F.explode(F.expr("sequence(-1, 1)"))).where("dx <> 0 or dy <> 0")
    votes = around.groupBy((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy")).agg(F.count("*").alias("neighbours"))
    return columns.where("solid = 0").join(votes, ["gx", "gy"]).where(F.col("neighbours") >= least_neighbours).select("gx", "gy", "gz", "neighbours")


#: Columns a side of the tiles in which a fill is done at once.
TILE = 64


def _labels(heights: np.ndarray, max_step: float) -> np.ndarray:
    """Least cell of each cell's component in a grid (nan: no column), by steps between the 8 neighbours."""
    n, m = heights.shape
    label = np.where(np.isnan(heights), -1, np.arange(n * m).reshape(n, m))
    pairs = []
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        one = (slice(0, n - dx), slice(max(0, -dy), m - max(0, dy)))
        two = (slice(dx, n), slice(max(0, dy), m - max(0, -dy)))
        pairs.append((one, two, np.abs(heights[one] - heights[two]) <= max_step))
    while True:
        before = label.copy()
        for one, two, joined in pairs:
            least = np.minimum(label[one], label[two])
            label[one] = np.where(joined, least, label[one])
            label[two] = np.where(joined, np.minimum(least, label[two]), label[two])  # the first line may have changed it
        flat = label.ravel()
        there = flat >= 0
        flat[there] = flat[flat[there]]
        if (label == before).all():
            return label


def fill(surface: DataFrame, start: tuple[int, int], max_step: float, p: MapParams = MapParams()) -> DataFrame:
    """Columns of a planar heightmap reached from a start by steps of at most max_step between the 8 neighbours.

    Columns are labelled by component within tiles; the labels that meet over the tiles' borders are joined, and the
    columns of the start's component stay. Nothing grows with the length of a path but the rounds over labels, by its logarithm.
    """

    def label(cells: pa.Table) -> pa.Table:
        x0, y0 = cells.column("tx")[0].as_py() * TILE, cells.column("ty")[0].as_py() * TILE
        x, y = cells.column("gx").to_numpy() - x0, cells.column("gy").to_numpy() - y0
        grid = np.full((TILE, TILE), np.nan)
        grid[x, y] = cells.column("height").to_numpy()
        own = _labels(grid, max_step)[x, y]
        root = ((own // TILE + x0) << 32) + (own % TILE + y0 + (1 << 31))
        return pa.table({"gx": cells.column("gx"), "gy": cells.column("gy"), "height": cells.column("height"), "label": pa.array(root)})

    tiled = surface.select("gx", "gy", "height", F.floor(F.col("gx") / TILE).cast("int").alias("tx"), F.floor(F.col("gy") / TILE).cast("int").alias("ty"))
    cells = cut(tiled.groupBy("tx", "ty").applyInArrow(label, "gx int, gy int, height double, label long"))
    edge = lambda g: F.pmod(F.col(g), F.lit(TILE)).isin(0, TILE - 1)
    border = cells.where(edge("gx") | edge("gy"))
    around = border.select("gx", "gy", F.col("height").alias("h"), F.col("label").alias("a")).withColumn("dx", F.explode(F.expr("sequence(-1, 1)"))).withColumn("dy", F.explode(F.expr("sequence(-1, 1)")))
    moved = around.select((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), "h", "a")
    edges = border.join(moved, ["gx", "gy"]).where((F.abs(F.col("height") - F.col("h")) <= max_step) & (F.col("label") != F.col("a"))).select("a", F.col("label").alias("b"))
    rooted = cells.join(components(edges).select(F.col("node").alias("label"), "root"), "label", "left").select("gx", "gy", "height", F.coalesce("root", "label").alias("root"))
    first = rooted.where((F.col("gx") == start[0]) & (F.col("gy") == start[1])).select("root").distinct()
    return rooted.join(F.broadcast(first), "root", "left_semi").select("gx", "gy", "height")


def with_up(voxels: DataFrame, up: str, p: MapParams = MapParams()) -> DataFrame:
    """The map turned so that its axis `up` (x, y, z, -x, -y or -z) is z: heightmaps of it go along that axis.

    Downward axes are mirrored about the middle of region 0.
    """
    order = {"x": ("gy", "gz", "gx"), "y": ("gx", "gz", "gy"), "z": ("gx", "gy", "gz")}[up[-1]]
    height = F.col(order[2])
    turned = [F.col(order[0]).alias("gx"), F.col(order[1]).alias("gy"), (F.lit(p.dims - 1) - height if up[0] == "-" else height).alias("gz")]
    return voxels.select(*turned, *[c for c in voxels.columns if c not in ("gx", "gy", "gz")])


def classify(voxels: DataFrame, p: MapParams = MapParams(), clearance: float = 0.5) -> DataFrame:
    """Every column of the map's extents: 1 with a surface, -1 with a virtual one (free, near surfaces), 0 with neither."""
    found = planar(voxels, p, clearance).select("gx", "gy", F.lit(1).alias("value"))
    virtual = virtual_surfaces(voxels, p).select("gx", "gy", F.lit(-1).alias("other"))
    box = voxels.agg(*[f(g).alias(f"{n}{g}") for g in ("gx", "gy") for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    grid = box.select(F.explode(F.sequence("lo_gx", "hi_gx")).alias("gx"), "lo_gy", "hi_gy").select("gx", F.explode(F.sequence("lo_gy", "hi_gy")).alias("gy"))
    return grid.join(found, ["gx", "gy"], "left").join(virtual, ["gx", "gy"], "left").select("gx", "gy", F.coalesce("value", "other", F.lit(0)).alias("value"))


def labelled(voxels: DataFrame, p: MapParams = MapParams(), clearance: float = 0.5, reference: float = 0.0) -> DataFrame:
    """Layers of each column with a label: the one nearest to the reference height is the base, the others extend it."""
    layers = layered(voxels, p, clearance).withColumn("height", F.expr(centre("gz", p, 2)) + p.resolution / 2)
    off = F.abs(F.col("height") - reference)
    best = F.row_number().over(Window.partitionBy("gx", "gy").orderBy(off, "gz"))
    return layers.withColumn("label", F.when(best == 1, "base").otherwise("extended"))


def adjacency(triangles: DataFrame) -> DataFrame:
    """Number of triangles that share an edge with each triangle of mesh(): a join on edges with their ends in order."""
    corner = lambda dx, dy: F.struct((F.col("gx") + dx).alias("x"), (F.col("gy") + dy).alias("y"))
    ends = F.when(F.col("half") == 0, F.array(corner(0, 0), corner(1, 0), corner(1, 1))).otherwise(F.array(corner(0, 0), corner(1, 1), corner(0, 1)))
    edges = triangles.select("gx", "gy", "half", ends.alias("v")).select("gx", "gy", "half", F.explode(F.array(*[F.array_sort(F.array(F.col("v")[i], F.col("v")[(i + 1) % 3])) for i in range(3)])).alias("edge"))
    met = edges.groupBy("edge").agg(F.count("*").alias("n"))
    return edges.join(met, "edge").groupBy("gx", "gy", "half").agg(F.sum(F.col("n") - 1).alias("neighbours"))


def mesh(surface: DataFrame) -> DataFrame:
    """Triangles of a planar heightmap: two for each square of four neighbouring columns, facing up."""
    corner = lambda n, dx, dy: surface.select((F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.col("height").alias(n))
    squares = surface.select("gx", "gy", F.col("height").alias("h00"))
    for n, dx, dy in (("h10", 1, 0), ("h01", 0, 1), ("h11", 1, 1)):
        squares = squares.join(corner(n, dx, dy), ["gx", "gy"])
    two = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("h00").alias("a"), F.col("h10").alias("b"), F.col("h11").alias("c")), F.struct(F.lit(1).alias("half"), F.col("h00").alias("a"), F.col("h11").alias("b"), F.col("h01").alias("c"))))
    return squares.select("gx", "gy", two.alias("t")).select("gx", "gy", "t.*")


def pixels(surface: DataFrame, low: float, high: float) -> DataFrame:
    """Rows and columns of an image of a heightmap, north up, with heights as 16-bit shades; columns without ground have none."""
    box = surface.agg(F.min("gx").alias("x0"), F.max("gy").alias("y1"))
    shade = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("height") - low) / (high - low))) * 65535).cast("int")
    return surface.crossJoin(F.broadcast(box)).select((F.col("y1") - F.col("gy")).alias("row"), (F.col("gx") - F.col("x0")).alias("col"), shade.alias("shade"))


def slopes(surface: DataFrame, p: MapParams = MapParams()) -> DataFrame:
    """Steepest rise to the 8 neighbours of each column, in degrees; a mask of what can be driven is a filter on it."""
    around = surface.select("gx", "gy", F.col("height").alias("h")).withColumn("dx", F.explode(F.expr("sequence(-1, 1)"))).withColumn("dy", F.explode(F.expr("sequence(-1, 1)"))).where("dx <> 0 or dy <> 0")
    near = around.select((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), "h", (F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * p.resolution).alias("run"))
    rise = surface.join(near, ["gx", "gy"]).withColumn("rise", F.abs(F.col("height") - F.col("h")) / F.col("run"))
    return rise.groupBy("gx", "gy").agg(F.degrees(F.atan(F.max("rise"))).alias("slope"))
