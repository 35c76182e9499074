"""Planar predicates as Column expressions. A point is a pair of Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
TOLERANCE = 1e-9
EARTH = 6_371_000.0


def point(prefix: str) -> Point:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y")


def cross(a: Point, b: Point, c: Point) -> Column:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def distance2(a: Point, b: Point) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    return dx * dx + dy * dy


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(distance2(a, b))


def orientation(a: Point, b: Point, c: Point) -> Column:
    """-1 right turn, 0 straight within the tolerance, 1 left turn."""
    slack = F.lit(TOLERANCE) * F.greatest(F.lit(1.0), distance(a, b) * distance(a, c))
    value = cross(a, b, c)
    return F.when(value > slack, 1).when(value < -slack, -1).otherwise(0)


def on_segment(p: Point, a: Point, b: Point) -> Column:
    slack = F.lit(TOLERANCE) * F.greatest(F.lit(1.0), distance(a, b))
    within = [(p[k] >= F.least(a[k], b[k]) - slack) & (p[k] <= F.greatest(a[k], b[k]) + slack) for k in (0, 1)]
    return (orientation(a, b, p) == 0) & within[0] & within[1]


def segments_meet(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Proper crossing, touch or overlap."""
    proper = (orientation(a, b, c) * orientation(a, b, d) < 0) & (orientation(c, d, a) * orientation(c, d, b) < 0)
    return proper | on_segment(a, c, d) | on_segment(b, c, d) | on_segment(c, a, b) | on_segment(d, a, b)


def ray_crosses(p: Point, a: Point, b: Point) -> Column:
    """Whether the ray from p to the right crosses the edge; half-open in y, so a shared vertex counts once."""
    spans = (a[1] > p[1]) != (b[1] > p[1])
    at = (b[0] - a[0]) * (p[1] - a[1]) / F.when(a[1] != b[1], b[1] - a[1]) + a[0]
    return F.when(spans, p[0] < at).otherwise(False)


def box_distance2(p: Point, low: Point, high: Point) -> Column:
    """Squared distance to a box, 0 inside."""
    d = [F.greatest(low[k] - p[k], F.lit(0.0), p[k] - high[k]) for k in (0, 1)]
    return d[0] * d[0] + d[1] * d[1]


def point_segment_distance(p: Point, a: Point, b: Point) -> Column:
    length = distance2(a, b)
    t = ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / F.when(length > 0, length)
    t = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return distance(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def same_cost(a: Column, b: Column) -> Column:
    """Equal, or both finite, non-zero and within 32 units in the last place of the larger."""
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & (a != 0) & (b != 0)
    return (a == b) | (finite & (F.abs(a - b) <= 32 * 2.220446049250313e-16 * F.greatest(F.abs(a), F.abs(b))))


def project(lat: Column, lon: Column, lat0: float, lon0: float) -> Point:
    """Local equirectangular metres around the origin."""
    return (
        F.lit(EARTH) * (lon - F.lit(lon0)) * F.lit(math.pi / 180) * F.lit(math.cos(lat0 * math.pi / 180)),
        F.lit(EARTH) * (lat - F.lit(lat0)) * F.lit(math.pi / 180),
    )


def unproject(p: Point, lat0: float, lon0: float) -> tuple[Column, Column]:
    degrees = 180 / math.pi
    return F.lit(lat0) + p[1] / F.lit(EARTH) * F.lit(degrees), F.lit(lon0) + p[0] / F.lit(EARTH * math.cos(lat0 * math.pi / 180)) * F.lit(degrees)


def micro(value: Column) -> Column:
    """Millionths as a whole number, the same in every engine."""
    return F.floor(value * F.lit(1e6) + F.lit(0.5)).cast("long")
