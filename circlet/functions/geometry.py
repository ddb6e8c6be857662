"""Predicates and formulas on points, circles and boxes, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0


def squared_distance(x: Column, y: Column, qx, qy) -> Column:
    dx, dy = x - qx, y - qy
    return dx * dx + dy * dy


def within(x: Column, y: Column, qx, qy, rad, inclusive: bool = False) -> Column:
    """Distance less than rad, or also equal; planar."""
    d, r = squared_distance(x, y, qx, qy), F.lit(rad * rad) if isinstance(rad, (int, float)) else rad * rad
    return d <= r if inclusive else d < r


def in_circle_box(x: Column, y: Column, qx: float, qy: float, rad: float) -> Column:
    return x.between(qx - rad, qx + rad) & y.between(qy - rad, qy + rad)


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def box_in_box(small: list[Column], large: list[Column]) -> Column:
    return (small[0] >= large[0]) & (small[1] >= large[1]) & (small[2] <= large[2]) & (small[3] <= large[3])


def box_overlap(a: list[Column], b: list[Column]) -> tuple[Column, list[Column]]:
    """Whether two boxes meet (edges count), and the common box."""
    box = [F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])]
    return (box[0] <= box[2]) & (box[1] <= box[3]), box


def circle_meets_box(qx, qy, rad, box: list[Column]) -> Column:
    x, y = F.greatest(box[0], F.least(qx, box[2])), F.greatest(box[1], F.least(qy, box[3]))
    return squared_distance(x, y, qx, qy) < rad * rad


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres of the web's Mercator projection."""
    return F.radians(lon) * EARTH_RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS
