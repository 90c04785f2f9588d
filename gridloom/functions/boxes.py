"""Axis-aligned boxes as SQL text: a box is (lo, hi), three expressions each."""

from __future__ import annotations

Box = tuple[tuple[str, str, str], tuple[str, str, str]]


def box(prefix: str) -> Box:
    """Columns <prefix>_lx .. <prefix>_hz."""
    return tuple(f"{prefix}_l{a}" for a in "xyz"), tuple(f"{prefix}_h{a}" for a in "xyz")  # type: ignore[return-value]


def overlaps(a: Box, b: Box) -> str:
    return "(" + " AND ".join(f"{al} <= {bh} AND {ah} >= {bl}" for al, ah, bl, bh in zip(*a, *b, strict=True)) + ")"


def contains(b: Box, point: tuple[str, str, str], eps: str = "0e0") -> str:
    return "(" + " AND ".join(f"{p} + {eps} >= {low} AND {p} - {eps} <= {h}" for low, h, p in zip(*b, point, strict=True)) + ")"


def is_valid(b: Box) -> str:
    return "(" + " AND ".join(f"{low} <= {h}" for low, h in zip(*b, strict=True)) + ")"


def centre(b: Box) -> tuple[str, str, str]:
    return tuple(f"(0.5e0 * ({low} + {h}))" for low, h in zip(*b, strict=True))  # type: ignore[return-value]


def half_extents(b: Box) -> tuple[str, str, str]:
    return tuple(f"(0.5e0 * ({h} - {low}))" for low, h in zip(*b, strict=True))  # type: ignore[return-value]


def diagonal(b: Box) -> str:
    return "sqrt(" + " + ".join(f"({h} - {low}) * ({h} - {low})" for low, h in zip(*b, strict=True)) + ")"


def volume(b: Box) -> str:
    return "(" + " * ".join(f"({h} - {low})" for low, h in zip(*b, strict=True)) + ")"


def expand(b: Box, by: str) -> Box:
    return tuple(f"({x} - {by})" for x in b[0]), tuple(f"({x} + {by})" for x in b[1])  # type: ignore[return-value]


def moved(b: Box, by: tuple[str, str, str]) -> Box:
    return tuple(tuple(f"({x} + {d})" for x, d in zip(side, by, strict=True)) for side in b)  # type: ignore[return-value]


def scaled(b: Box, by: str) -> Box:
    return tuple(tuple(f"({x} * {by})" for x in side) for side in b)  # type: ignore[return-value]


def equal(a: Box, b: Box, eps: str = "1e-9") -> str:
    return "(" + " AND ".join(f"abs({x} - {y}) <= {eps}" for s, t in zip(a, b, strict=True) for x, y in zip(s, t, strict=True)) + ")"


def corner(b: Box, i: int) -> tuple[str, str, str]:
    """Corner i of eight: bit a chooses the upper side on axis a."""
    return tuple(b[(i >> a) & 1][a] for a in range(3))  # type: ignore[return-value]
