"""Geometry: vectors, projection, boxes, rays, directions.  All lengths in metres, Z up."""

from __future__ import annotations

from ..plans.dialect import Spark

ASPECT = 16 / 9
DIRECTIONS = ("front", "front-right", "right", "rear-right", "rear", "rear-left", "left", "front-left")
CARDINALS = ("North", "Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest")


def norm(*xs: str) -> str:
    return "sqrt(" + " + ".join(f"({x}) * ({x})" for x in xs) + ")"


def dot(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b)) + ")"


def vector(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """From a to b."""
    return tuple(f"({y} - {x})" for x, y in zip(a, b))


def half_tangent(fov: str) -> str:
    """tan(fov / 2), by sine and cosine, which engines agree on to the last bit."""
    return f"(sin(radians({fov}) / 2) / cos(radians({fov}) / 2))"


def axis_range(low: str, high: str, origin: str, direction: str) -> tuple[str, str]:
    """Where a ray enters and leaves a slab; a parallel ray outside of it never does."""
    flat, out = f"abs({direction}) < 1e-12", f"({origin} < {low} or {origin} > {high})"
    a, b = f"({low} - {origin}) / nullif({direction}, 0)", f"({high} - {origin}) / nullif({direction}, 0)"
    enter = f"case when {flat} then case when {out} then 1e300 else -1e300 end else least({a}, {b}) end"
    leave = f"case when {flat} then case when {out} then -1e300 else 1e300 end else greatest({a}, {b}) end"
    return enter, leave


def named(d: Spark, index: str, names: tuple[str, ...]) -> str:
    return f"case {index} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


def octant(d: Spark, right: str, forward: str) -> str:
    """0..7: the nearest of eight directions, clockwise from straight ahead; halves go to even."""
    return f"cast({d.pmod(d.rint(f'degrees(atan2({right}, {forward})) / 45'), '8')} as int)"


def off_octant(right: str, forward: str, index: str) -> str:
    """Degrees between a direction and its octant's, at most 180."""
    return f"abs(degrees(atan2(sin(atan2({right}, {forward}) - radians(45 * {index})), cos(atan2({right}, {forward}) - radians(45 * {index})))))"


def side(x: str, above: str, below: str, threshold: float) -> str:
    """A word for a signed distance: above the threshold, below its negative, or none."""
    return f"case when {x} > {threshold} then '{above}' when {x} < -{threshold} then '{below}' else '' end"
