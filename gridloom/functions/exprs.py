"""Scalar expressions as SQL text: on columns for Catalyst, and readable by any SQL engine.

Doubles are written with an exponent, so that no engine takes them for decimals.
"""

from __future__ import annotations

from gridloom.functions.params import MapParams

AXES = ("x", "y", "z")


def num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def region(c: str, p: MapParams, axis: int = 0) -> str:
    """Region coordinate: regions are centred on multiples of their edge."""
    return f"CAST(floor(({c} - {num(p.origin[axis])}) / {num(p.resolution * p.dims)} + 0.5e0) AS INT)"


def key(c: str, p: MapParams, axis: int = 0) -> str:
    """Global voxel index of a coordinate: region, then the place in it, with the walls' tolerance."""
    d, r = num(p.resolution * p.dims), num(p.resolution)
    reg = region(c, p, axis)
    q = f"(({c} - {num(p.origin[axis])}) - ({reg} * {d} - {d} / 2))"
    safe = f"(CASE WHEN {q} < 0 AND {q} >= -1e-6 THEN 0e0 WHEN {q} >= {d} AND {q} - 1e-6 < {d} THEN {q} - 1e-6 ELSE {q} END)"
    return f"({reg} * {p.dims} + CAST(floor({safe} / {r}) AS INT))"


def centre(g: str, p: MapParams, axis: int = 0) -> str:
    """Centre of a voxel."""
    d, r = num(p.resolution * p.dims), num(p.resolution)
    reg = region_of(g, p)
    return f"({reg} * {d} - {d} / 2 + {num(p.origin[axis])} + ({g} - {reg} * {p.dims}) * {r} + {r} / 2)"


def region_of(g: str, p: MapParams) -> str:
    return f"CAST(floor({g} / {num(p.dims)}) AS INT)"


def local_of(g: str, p: MapParams) -> str:
    return f"({g} - {region_of(g, p)} * {p.dims})"


def probability(v: str) -> str:
    return f"(1e0 - 1e0 / (1e0 + exp({v})))"


def value(p: str) -> str:
    return f"ln({p} / (1e0 - {p}))"


def length(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    x, y, z = (f"({q} - {o})" for o, q in zip(a, b, strict=True))
    return f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"


RAY_LENGTH = length(("ox", "oy", "oz"), ("sx", "sy", "sz"))


def sub_voxel(offset: str, p: MapParams) -> str:
    """A coordinate within its voxel (from the centre) as ten bits."""
    r = num(p.resolution)
    return f"least(1023, greatest(0, CAST(floor(({offset} + 0.5e0 * {r}) / ({r} / 1023e0)) AS INT)))"


def sub_voxel_offset(bits: str, p: MapParams) -> str:
    r = num(p.resolution)
    return f"({bits} * ({r} / 1023e0) - 0.5e0 * {r})"


def touch_millis(t: str, base: str) -> str:
    return f"CAST(floor(({t} - {base}) / 0.001e0) AS BIGINT)"


def density(count: str, traversal: str) -> str:
    """Samples a metre; infinite where samples came without any traversal."""
    return f"(CASE WHEN {count} = 0 THEN 0e0 WHEN {traversal} > 0 THEN {count} / {traversal} ELSE CAST('Infinity' AS DOUBLE) END)"


def touch_seconds(millis: str, base: str) -> str:
    return f"({millis} * 0.001e0 + {base})"


def occupancy_type(v: str, p: MapParams) -> str:
    return f"(CASE WHEN {v} IS NULL THEN -1 WHEN {v} < {num(p.threshold)} THEN 0 ELSE 1 END)"


def slab(box: tuple[tuple[float, ...], tuple[float, ...]]) -> tuple[str, str]:
    """Entry and exit fractions of the segment o -> s in a box; it meets the box if entry <= exit."""
    lo, hi = box
    near, far = [], []
    for a, l, h in zip(AXES, lo, hi, strict=True):  # noqa: E741
        d, o = f"(s{a} - o{a})", f"o{a}"
        inside = f"{o} >= {num(l)} AND {o} <= {num(h)}"
        t0, t1 = f"(({num(l)} - {o}) / nullif({d}, 0e0))", f"(({num(h)} - {o}) / nullif({d}, 0e0))"
        near.append(f"(CASE WHEN {d} = 0 THEN (CASE WHEN {inside} THEN -1e300 ELSE 1e300 END) ELSE least({t0}, {t1}) END)")
        far.append(f"(CASE WHEN {d} = 0 THEN 1e300 ELSE greatest({t0}, {t1}) END)")
    return f"greatest(0e0, {', '.join(near)})", f"least(1e0, {', '.join(far)})"


def hsv_to_rgb(h: str, s: str, v: str) -> tuple[str, str, str]:
    """Components of a hue in degrees, by distance from the component's own hue."""
    out = []
    for n in (5, 3, 1):
        k = f"(({n} + {h} / 60e0) - 6e0 * floor(({n} + {h} / 60e0) / 6e0))"
        out.append(f"({v} - {v} * {s} * greatest(0e0, least({k}, 4e0 - {k}, 1e0)))")
    return out[0], out[1], out[2]
