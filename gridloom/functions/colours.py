"""Colours as SQL text: three expressions of 0 to 1 each."""

from __future__ import annotations

from gridloom.functions.exprs import num, probability

Rgb = tuple[str, str, str]
# The colours of heightmap layers, in turn, and of the intensity and clearance ramps.
LAYER_CYCLE = ((219, 112, 147), (178, 34, 34), (255, 165, 0), (255, 255, 224), (245, 222, 179), (127, 255, 0), (64, 224, 208), (135, 206, 235), (221, 160, 221), (0, 0, 205))
INTENSITY = ((154, 52, 3), (255, 255, 212))
CLEARANCE = ((255, 128, 0), (255, 0, 0))


def rgb(bytes_: tuple[int, int, int]) -> Rgb:
    return tuple(num(b / 255) for b in bytes_)  # type: ignore[return-value]


def lerp(a: Rgb, b: Rgb, share: str) -> Rgb:
    return tuple(f"({x} + ({y} - {x}) * {share})" for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def adjusted(c: Rgb, factor: str) -> Rgb:
    """Lighter or darker, within 0 to 1."""
    return tuple(f"greatest(0e0, least(1e0, {x} * {factor}))" for x in c)  # type: ignore[return-value]


def to_hsv(c: Rgb) -> tuple[str, str, str]:
    """Hue in degrees, saturation and value of a colour."""
    r, g, b = c
    most, least = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    d = f"nullif({most} - {least}, 0e0)"
    hue = f"coalesce(60e0 * CASE WHEN {most} = {r} THEN ({g} - {b}) / {d} WHEN {most} = {g} THEN 2e0 + ({b} - {r}) / {d} ELSE 4e0 + ({r} - {g}) / {d} END, 0e0)"
    return f"({hue} + CASE WHEN {hue} < 0 THEN 360e0 ELSE 0e0 END)", f"coalesce(({most} - {least}) / nullif({most}, 0e0), 0e0)", most


def share(value: str, low: float, high: float) -> str:
    return f"least(1e0, greatest(0e0, ({value} - {num(low)}) / {num(high - low)}))"


def by_type(value: str, threshold: float, free: Rgb, occupied: Rgb) -> Rgb:
    """Black for what isn't observed."""
    return tuple(f"(CASE WHEN {value} IS NULL THEN 0e0 WHEN {value} >= {num(threshold)} THEN {o} ELSE {f} END)" for f, o in zip(free, occupied, strict=True))  # type: ignore[return-value]


def by_occupancy(value: str, low: Rgb, high: Rgb, above: float | None = None) -> Rgb:
    """By probability; from the probability `above` on if given, which is then the start of the ramp."""
    p = f"(CASE WHEN {value} IS NULL THEN 0e0 ELSE {probability(value)} END)"
    return lerp(low, high, share(p, above or 0.0, 1.0))


def by_intensity(value: str, most: float, low: Rgb = rgb(INTENSITY[0]), high: Rgb = rgb(INTENSITY[1])) -> Rgb:
    return tuple(f"coalesce({x}, {y})" for x, y in zip(lerp(low, high, share(value, 0.0, most)), high, strict=True))  # type: ignore[return-value]


def by_layer(layer: str) -> Rgb:
    return tuple(f"(CASE {layer} % 10 " + " ".join(f"WHEN {i} THEN {rgb(c)[k]}" for i, c in enumerate(LAYER_CYCLE)) + " END)" for k in range(3))  # type: ignore[return-value]


def by_surface(value: str, base: str, surface: Rgb, virtual: Rgb) -> Rgb:
    """By kind (1: surface, -1: virtual), darker off the base layer."""
    factor = f"(CASE WHEN {base} THEN 1e0 ELSE 0.4e0 END)"
    return tuple(f"(CASE {value} WHEN 1 THEN {s} WHEN -1 THEN {v} ELSE 0e0 END)" for s, v in zip(adjusted(surface, factor), adjusted(virtual, factor), strict=True))  # type: ignore[return-value]


def by_clearance(value: str, least: float, most: float, low: Rgb = rgb(CLEARANCE[0]), high: Rgb = rgb(CLEARANCE[1])) -> Rgb:
    return lerp(low, high, f"(({value} - {num(least)}) / {num(most - least)})" if most > least else "1e0")
