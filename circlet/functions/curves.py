"""Hilbert and Z-order curves: as Column expressions, and in plain Python for the driver.

A point of the unit square lies in a cell of a 2**depth x 2**depth grid.  The
quadrant of a cell at a level is k = 2 * xbit + (1 - ybit).  A curve is a state
machine: TRAVERSAL[state] lists the quadrants in the order of the curve.
"""

from __future__ import annotations

import functools
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: order of quadrants and next state by quadrant, for each state
TRAVERSAL = {"hilbert": [[1, 0, 2, 3], [2, 0, 1, 3], [2, 3, 1, 0], [1, 3, 2, 0]], "zorder": [[0, 2, 1, 3]]}
NEXT = {"hilbert": [[0, 3, 0, 1], [1, 1, 2, 0], [3, 2, 1, 2], [2, 0, 3, 3]], "zorder": [[0, 0, 0, 0]]}


@lru_cache
def position(curve: str) -> list[list[int]]:
    """Where each quadrant comes in the order of a state."""
    return [[order.index(k) for k in range(4)] for order in TRAVERSAL[curve]]


def encode_cell(gx: int, gy: int, depth: int, curve: str = "hilbert") -> int:
    index, state, pos = 0, 0, position(curve)
    for b in range(depth - 1, -1, -1):
        k = ((gx >> b) & 1) * 2 + 1 - ((gy >> b) & 1)
        index, state = index * 4 + pos[state][k], NEXT[curve][state][k]
    return index


def decode_cell(index: int, depth: int, curve: str = "hilbert") -> tuple[int, int]:
    gx = gy = state = 0
    for b in range(depth - 1, -1, -1):
        k = TRAVERSAL[curve][state][(index >> (2 * b)) & 3]
        gx, gy, state = gx * 2 + (k >> 1), gy * 2 + 1 - (k & 1), NEXT[curve][state][k]
    return gx, gy


def unit_cell(u: float, depth: int) -> int:
    """Clamped: the edge at 1 belongs to the last cell."""
    return max(0, min(int(u * 2**depth // 1), 2**depth - 1))


def encode_unit(x: float, y: float, depth: int, curve: str = "hilbert") -> int:
    return encode_cell(unit_cell(x, depth), unit_cell(y, depth), depth, curve)


def unit(value: Column, low: float, high: float) -> Column:
    """Of a world coordinate; 0 where the world has no extent."""
    return F.lit(0.0) if high == low else (value - F.lit(float(low))) / F.lit(float(high - low))


def cell(u: Column, depth: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(u * F.lit(float(2**depth))), F.lit(2**depth - 1))).cast("long")


def _packed(answer: list[list[int]], following: list[list[int]]) -> Column:
    """A number with four bits for each state and input: the answer, then the next state."""
    out = 0
    for state, row in enumerate(answer):
        for k, value in enumerate(row):
            out |= (value << 2 | following[state][k]) << (4 * (4 * state + k))
    return F.lit(out - (1 << 64) if out >> 63 else out).cast("long")


def _steps(inputs: list[Column], packed: Column) -> list[Column]:
    """What the state machine gives for each input, the answer in bits 2 and 3.

    The number of levels is known here, so that this is a chain of shifts that becomes generated code; a step
    stands once in the next one.
    """
    out: list[Column] = []
    for k in inputs:
        at = k * 4 if not out else (out[-1].bitwiseAND(F.lit(3)) * 4 + k) * 4
        out.append(F.call_function("shiftrightunsigned", packed, at.cast("int")).bitwiseAND(F.lit(15).cast("long")))
    return out


def _sum(terms: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, terms, F.lit(0).cast("long"))


def encode(gx: Column, gy: Column, depth: int, curve: str = "hilbert") -> Column:
    """Index of a cell."""
    levels = range(depth - 1, -1, -1)
    bit = lambda g, b: F.shiftright(g.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
    steps = _steps([bit(gx, b) * 2 + F.lit(1) - bit(gy, b) for b in levels], _packed(position(curve), NEXT[curve]))
    return _sum([F.shiftleft(F.shiftright(s, 2), 2 * b) for s, b in zip(steps, levels, strict=True)])


def decode(index: Column, depth: int, curve: str = "hilbert") -> Column:
    """struct<gx, gy> of a cell."""
    levels = range(depth - 1, -1, -1)
    # the next state by the place in the order
    following = [[NEXT[curve][state][k] for k in order] for state, order in enumerate(TRAVERSAL[curve])]
    steps = _steps([F.shiftright(index.cast("long"), 2 * b).bitwiseAND(F.lit(3).cast("long")) for b in levels], _packed(TRAVERSAL[curve], following))
    gx = [F.shiftleft(F.shiftright(s, 3), b) for s, b in zip(steps, levels, strict=True)]
    gy = [F.shiftleft(F.lit(1) - F.shiftright(s, 2).bitwiseAND(F.lit(1).cast("long")), b) for s, b in zip(steps, levels, strict=True)]
    return F.struct(_sum(gx).alias("gx"), _sum(gy).alias("gy"))


def cell_box(gx: Column, gy: Column, depth: int) -> list[Column]:
    """min_x, min_y, max_x, max_y of a cell, in the unit square."""
    n = F.lit(float(2**depth))
    return [(gx / n).alias("min_x"), (gy / n).alias("min_y"), ((gx + 1) / n).alias("max_x"), ((gy + 1) / n).alias("max_y")]
