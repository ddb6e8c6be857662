"""Median quadtrees over a bounded sample, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranges import Box


@dataclass
class Node:
    box: Box
    depth: int
    pnum: int
    leaf: int | None = None
    x_med: float = 0.0
    ly_med: float = 0.0
    ry_med: float = 0.0
    #: TL, BL, TR, BR
    children: list["Node"] = field(default_factory=list)

    def leaves(self) -> list["Node"]:
        return [self] if self.leaf is not None else [x for c in self.children for x in c.leaves()]

    def walk(self) -> list["Node"]:
        return [self, *(x for c in self.children for x in c.walk())]


def build(points: list[tuple[int, float, float]], box: Box, min_leaf: int = 256) -> Node:
    """points: (id, x, y).  Halves by x, then each half by y; ties by id."""
    if min_leaf < 3:
        raise ValueError("a leaf holds three points or more")
    count = iter(range(1 << 60))

    def make(own: list, box: Box, depth: int) -> Node:
        if len(own) <= min_leaf:
            return Node(box, depth, len(own), next(count))
        own = sorted(own, key=lambda p: (p[1], p[0]))
        sides = own[: len(own) // 2], own[len(own) // 2 :]
        x_med = sides[0][-1][1]
        halves, meds = [], []
        for side in sides:
            side = sorted(side, key=lambda p: (p[2], p[0]))
            halves.append((side[: len(side) // 2], side[len(side) // 2 :]))
            meds.append(halves[-1][0][-1][2])
        node = Node(box, depth, len(own), None, x_med, meds[0], meds[1])
        for k, (bottom, top) in enumerate(halves):
            lo, hi = (box[0], x_med) if k == 0 else (x_med, box[2])
            node.children.append(make(top, (lo, meds[k], hi, box[3]), depth + 1))
            node.children.append(make(bottom, (lo, box[1], hi, meds[k]), depth + 1))
        return node

    return make(points, box, 0)


def route(node: Node, x: Column, y: Column) -> Column:
    """The leaf of a point."""
    if node.leaf is not None:
        return F.lit(node.leaf)
    tl, bl, tr, br = (route(c, x, y) for c in node.children)
    left = F.when(y <= node.ly_med, bl).otherwise(tl)
    right = F.when(y <= node.ry_med, br).otherwise(tr)
    return F.when(x <= node.x_med, left).otherwise(right)


def dump(node: Node) -> list[str]:
    """A line for each node, parents first."""
    return [f"{n.depth}," + ",".join(f"{v:.0f}" for v in n.box) for n in node.walk()]


def dump_all(found: dict[int, Node]) -> list[str]:
    """The lines of several trees: the base, then each other one after a line with its number."""
    out = []
    for t, n in found.items():
        out += [*([str(t)] if t else []), *dump(n)]
    return out


def to_rows(node: Node, tree: int = 0) -> list[tuple]:
    """tree, node, parent, depth, box, medians, leaf and population of all nodes: all that is needed to load it again."""
    rows: list[tuple] = []

    def visit(n: Node, parent: int) -> None:
        own = len(rows)
        rows.append((tree, own, parent, n.depth, *n.box, n.x_med, n.ly_med, n.ry_med, -1 if n.leaf is None else n.leaf, n.pnum))
        for c in n.children:
            visit(c, own)

    visit(node, -1)
    return rows


NODE_SCHEMA = "tree int, node int, parent int, depth int, min_x double, min_y double, max_x double, max_y double, x_med double, ly_med double, ry_med double, leaf int, pnum long"


def from_rows(rows: list[tuple]) -> Node:
    nodes: dict[int, Node] = {}
    root = None
    for _, own, parent, depth, a, b, c, d, x_med, ly, ry, leaf, pnum in sorted(rows, key=lambda r: r[1]):
        nodes[own] = node = Node((a, b, c, d), depth, pnum, None if leaf < 0 else leaf, x_med, ly, ry)
        if parent < 0:
            root = node
        else:
            nodes[parent].children.append(node)
    return root
