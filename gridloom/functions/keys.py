"""Arithmetic on voxel keys. A key is one whole number an axis; region and local parts follow from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.params import MapParams

Key = tuple[Column, Column, Column]


def region_part(g: Column, p: MapParams = MapParams()) -> Column:
    return F.floor(g / F.lit(p.dims)).cast("int")


def local_part(g: Column, p: MapParams = MapParams()) -> Column:
    return F.pmod(g, F.lit(p.dims)).cast("int")


def joined(region: Column, local: Column, p: MapParams = MapParams()) -> Column:
    return (region * p.dims + local).cast("int")


def moved(key: Key, by: tuple[int, int, int]) -> Key:
    """A key so many voxels away; regions follow."""
    return tuple((g + d).cast("int") for g, d in zip(key, by, strict=True))  # type: ignore[return-value]


def stepped(key: Key, axis: int, by: int = 1) -> Key:
    """A key moved along one axis."""
    return moved(key, tuple(by if a == axis else 0 for a in range(3)))  # type: ignore[arg-type]


def range_between(a: Key, b: Key) -> Key:
    """Voxels from a to b, an axis each."""
    return tuple(y - x for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def is_null(key: Key) -> Column:
    return key[0].isNull() | key[1].isNull() | key[2].isNull()


def bounded(key: Key, lo: tuple[int, int, int], hi: tuple[int, int, int], axes: tuple[int, ...] = (0, 1, 2)) -> Column:
    """Whether a key lies in a closed box, on the axes given."""
    out = F.lit(True)
    for a in axes:
        out &= key[a].between(lo[a], hi[a])
    return out


def clamped(key: Key, lo: tuple[int, int, int], hi: tuple[int, int, int], axes: tuple[int, ...] = (0, 1, 2)) -> Key:
    """A key moved into a closed box, on the axes given."""
    return tuple(F.greatest(F.least(g, F.lit(hi[a])), F.lit(lo[a])) if a in axes else g for a, g in enumerate(key))  # type: ignore[return-value]


def equal_on(a: Key, b: Key, axis: int) -> Column:
    return a[axis] == b[axis]


def volume_of(size: Key) -> Column:
    return size[0].cast("long") * size[1] * size[2]


def index_of(key: Key, lo: Key, size: Key) -> Column:
    """Place of a key in a box, x fastest."""
    x, y, z = (g.cast("long") - low for g, low in zip(key, lo, strict=True))
    return x + y * size[0] + z * size[0] * size[1]


def from_index(index: Column, lo: Key, size: Key) -> Key:
    """The key at a place of a box."""
    x, rest = F.pmod(index, size[0]), F.floor(index / size[0])
    return tuple((low + d).cast("int") for low, d in zip(lo, (x, F.pmod(rest, size[1]), F.floor(rest / size[1])), strict=True))  # type: ignore[return-value]


def voxel_index(key: Key, p: MapParams = MapParams()) -> Column:
    """Place of a voxel in its region, x fastest."""
    x, y, z = (local_part(g, p) for g in key)
    return x + y * p.dims + z * p.dims * p.dims


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is not below n (1 for n up to 1)."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin((n - 1).cast("long")))))
