"""Curve ranges that cover a box: quadrant decomposition, cell enumeration, merging."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.curves import NEXT, TRAVERSAL, decode, encode_cell

Box = tuple[float, float, float, float]
Range = tuple[int, int]


def unit_box(box: Box, world: Box) -> Box | None:
    """The part of a world box inside the world, in the unit square; None if there is none."""
    lo = [max(box[i], world[i]) for i in (0, 1)]
    hi = [min(box[i], world[i]) for i in (2, 3)]
    if lo[0] > hi[0] or lo[1] > hi[1]:
        return None
    size = [world[2] - world[0] or 1.0, world[3] - world[1] or 1.0]
    low, high = ([(v[i] - world[i]) / size[i] for i in (0, 1)] for v in (lo, hi))
    return (low[0], low[1], high[0], high[1])


def world_box(box: Box, world: Box) -> Box:
    """A box of the unit square, in the world."""
    size = [world[2] - world[0], world[3] - world[1]]
    return tuple(world[i % 2] + v * size[i % 2] for i, v in enumerate(box))


def sides(box: Box) -> tuple[float, float]:
    return box[2] - box[0], box[3] - box[1]


def lattice(depth: int) -> tuple[int, int, int, int]:
    """All of the fine lattice: 4**depth places a side."""
    return 0, 0, 4**depth - 1, 4**depth - 1


def lattice_box(box: Box, depth: int) -> tuple[int, int, int, int]:
    """The places of the fine lattice that a box of the unit square meets; the edge at 1 belongs to the last one."""
    return tuple(max(0, min(int(math.floor(v * 4**depth)), 4**depth - 1)) for v in box)


def discontinuities(spark: SparkSession, depth: int, curve: str = "hilbert") -> int:
    """Steps of a curve that don't lead to one of the eight cells around: each cell beside the one of the next index, by a join."""
    cells = spark.range(4**depth).select("id", decode(F.col("id"), depth, curve).alias("c")).select("id", "c.gx", "c.gy")
    after = cells.select((F.col("id") - 1).alias("id"), F.col("gx").alias("nx"), F.col("gy").alias("ny"))
    far = F.greatest(F.abs(F.col("gx") - F.col("nx")), F.abs(F.col("gy") - F.col("ny"))) > 1
    return cells.join(after, "id").where(far).count()


def merge(ranges: list[Range], tolerance: int = 1) -> list[Range]:
    """Sorted ranges whose gap is within the tolerance become one: 1 joins neighbours only, 0 joins none."""
    out: list[Range] = []
    for lo, hi in sorted(ranges):
        if out and out[-1][1] + tolerance >= lo:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def decompose(box: Box, depth: int, curve: str = "hilbert", tolerance: int = 1, max_ranges: int | None = 64) -> list[Range]:
    """Ranges of all cells that the box meets.  Whole quadrants are given at once, so that the cost follows the box's edge.

    With more than max_ranges, those with the smallest gaps between them are joined: a superset.
    """
    side = 2**depth
    lo_x, lo_y = (max(0, min(int(math.floor(v * side)), side - 1)) for v in box[:2])
    hi_x, hi_y = (max(0, min(int(math.floor(v * side)), side - 1)) for v in box[2:])
    out: list[Range] = []

    def walk(x: int, y: int, size: int, state: int, start: int) -> None:
        if x > hi_x or y > hi_y or x + size - 1 < lo_x or y + size - 1 < lo_y:
            return
        if size == 1 or (x >= lo_x and y >= lo_y and x + size - 1 <= hi_x and y + size - 1 <= hi_y):
            end = start + size * size - 1
            if out and out[-1][1] + tolerance >= start:
                out[-1] = out[-1][0], end
            else:
                out.append((start, end))
            return
        half = size // 2
        for i, k in enumerate(TRAVERSAL[curve][state]):
            walk(x + half * (k >> 1), y + half * (1 - (k & 1)), half, NEXT[curve][state][k], start + i * half * half)

    walk(0, 0, side, 0, 0)
    return limit(out, max_ranges)


def limit(ranges: list[Range], most: int | None) -> list[Range]:
    if most is None or len(ranges) <= most:
        return ranges
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1])
    joined = set(gaps[: len(ranges) - most])
    out = [ranges[0]]
    for i in range(1, len(ranges)):
        if i in joined:
            out[-1] = out[-1][0], ranges[i][1]
        else:
            out.append(ranges[i])
    return out


def collect(indices: list[int], tolerance: int = 0) -> list[Range]:
    """Ranges of single indices; a new one begins after a gap of more than the tolerance."""
    return merge([(i, i) for i in set(indices)], tolerance + 1)


def enumerate_cells(box: Box, depth: int, curve: str = "hilbert", tolerance: int | None = None) -> list[Range]:
    """The same cover by listing every cell of the box."""
    side = 2**depth
    spans = []
    for lo, hi in ((box[0], box[2]), (box[1], box[3])):
        first = max(0, min(math.floor(lo * side), side - 1))
        spans.append(range(first, max(first, min(math.ceil(hi * side), side) - 1) + 1))
    cells = [encode_cell(x, y, depth, curve) for x in spans[0] for y in spans[1]]
    return collect(cells, 2 ** max(0, depth - 1) if tolerance is None else tolerance)


def overlap(parts: list[Range], ranges: list[Range]) -> list[tuple[int, int, int]]:
    """part, first and last index that the ranges cover in it; both lists are sorted and disjoint."""
    out, i = [], 0
    for p, (lo, hi) in enumerate(parts):
        while i < len(ranges) and ranges[i][1] < lo:
            i += 1
        j = i
        while j < len(ranges) and ranges[j][0] <= hi:
            j += 1
        if j > i:
            out.append((p, max(lo, ranges[i][0]), min(hi, ranges[j - 1][1])))
    return out


def clip(part: Range, ranges: list[Range]) -> list[Range]:
    return [(max(lo, part[0]), min(hi, part[1])) for lo, hi in ranges if lo <= part[1] and hi >= part[0]]


def greedy_partitions(histogram: list[int], parts: int, depth: int, grouping: int = 1) -> list[Range]:
    """Ranges of about equal population; none is empty, the last one ends with the curve."""
    quota = int((sum(histogram) // parts) * 1.1)
    out, start, held = [], 0, 0
    for i, n in enumerate(histogram):
        if held and held + n > quota and len(out) < parts - 1:
            out.append((start * grouping, i * grouping - 1))
            start, held = i, n
        else:
            held += n
    return [*out, (start * grouping, 4**depth - 1)]
