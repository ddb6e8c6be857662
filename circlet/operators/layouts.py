"""Access methods.  Each is a layout: how a point table is written, and the predicate that a circle becomes.

Every method gives the same rows.  A layout derives, on the driver, which
partitions and curve ranges a circle can meet; as Column predicates these prune
partitions and reach the Parquet scan, and the exact distance refines them.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves
from ..functions.geometry import circle_meets_box, in_circle_box, within
from ..plans import tree as trees
from ..plans.ranges import Box, Range, clip, decompose, enumerate_cells, greedy_partitions, overlap, unit_box
from ..sources.store import remove, scratch, usage

SAMPLE = 4096


def extent(points: DataFrame) -> Box:
    row = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return tuple(float(v) if v is not None else 0.0 for v in row)


def hashed_sample(points: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The n rows with the least digests of their id: the same ones at every run."""
    return points.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(n)


def _any(terms: list[str]) -> str:
    return " or ".join(f"({t})" for t in terms) if terms else "false"


def _between(column: str, ranges: list[Range]) -> str:
    """As SQL text: a predicate of many ranges is one call to the JVM so, not several for each of them."""
    return _any([f"{column} between {lo} and {hi}" for lo, hi in ranges])


def _among(column: str, values: list[int]) -> str:
    return f"{column} in ({', '.join(map(str, values))})" if values else "false"


def _circle_box(x: float, y: float, rad: float) -> Box:
    return (x - rad, y - rad, x + rad, y + rad)


@dataclass
class Layout:
    """A full scan: no columns of its own, no candidates ruled out."""

    world: Box
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()

    def assign(self, points: DataFrame) -> DataFrame:
        return points

    def candidates(self, x: float, y: float, rad: float) -> Column:
        return F.lit(True)


@dataclass
class CurveLayout(Layout):
    """A curve index; the table is sorted by it."""

    depth: int = 8
    curve: str = "hilbert"
    tolerance: int = 1
    max_ranges: int | None = 64

    def assign(self, points: DataFrame) -> DataFrame:
        # cells are columns of their own first: the index takes each of them once a level
        w = self.world
        cells = {f"_{c}": curves.cell(curves.unit(F.col(c), w[i], w[i + 2]), self.depth) for i, c in enumerate("xy")}
        return points.withColumns(cells).withColumn("sfc", curves.encode(F.col("_x"), F.col("_y"), self.depth, self.curve)).drop(*cells)

    def ranges(self, x: float, y: float, rad: float) -> list[Range]:
        box = unit_box(_circle_box(x, y, rad), self.world)
        return decompose(box, self.depth, self.curve, self.tolerance, self.max_ranges) if box else []

    def candidates(self, x: float, y: float, rad: float) -> Column:
        return F.expr(_between("sfc", self.ranges(x, y, rad)))


@dataclass
class MbrLayout(CurveLayout):
    """Sorted along a curve, so that what lies together has narrow limits in x and y; the circle's bounding box is pushed to the scan."""

    def candidates(self, x: float, y: float, rad: float) -> Column:
        return in_circle_box(F.col("x"), F.col("y"), x, y, rad)


@dataclass
class RangePartitions(CurveLayout):
    """Partitions of about equal population along the curve.

    form: ``multi`` reads the ranges of each partition; ``span`` from the first to the last covered index
    of each, of cells that are enumerated; ``whole`` all of each that is met; ``envelope`` one range from
    the circle's first index to its last.
    """

    parts: list[Range] = field(default_factory=list)
    form: str = "multi"

    def assign(self, points: DataFrame) -> DataFrame:
        part = functools.reduce(lambda acc, p: acc.when(F.col("sfc") <= p[1][1], F.lit(p[0])), list(enumerate(self.parts))[1:], F.when(F.col("sfc") <= self.parts[0][1], F.lit(0)))
        return super().assign(points).withColumn("part_id", part.otherwise(F.lit(len(self.parts) - 1)))

    def candidates(self, x: float, y: float, rad: float) -> Column:
        box = unit_box(_circle_box(x, y, rad), self.world)
        if box is None:
            return F.lit(False)
        ranges = enumerate_cells(box, self.depth, self.curve) if self.form == "span" else decompose(box, self.depth, self.curve, self.tolerance, self.max_ranges)
        if self.form == "envelope":
            ranges = [(ranges[0][0], ranges[-1][1])]
        met = overlap(self.parts, ranges)
        wanted = _among("part_id", [p for p, _, _ in met])
        if self.form == "whole":
            return F.expr(wanted)
        own = {p: [(lo, hi)] if self.form in ("span", "envelope") else clip(self.parts[p], ranges) for p, lo, hi in met}
        return F.expr(f"{wanted} and ({_any([f'part_id = {p} and ({_between('sfc', r)})' for p, r in own.items()])})")


@dataclass
class TreePartitions(Layout):
    """Leaves of median quadtrees, with a curve index local to each leaf.

    trees: 0 is the base; others stand in boxes (of clusters), and a point belongs to the first box that holds it.
    """

    trees: dict[int, trees.Node] = field(default_factory=dict)
    boxes: list[Box] = field(default_factory=list)
    depths: dict[int, int] = field(default_factory=dict)
    curve: str = "hilbert"

    def assign(self, points: DataFrame) -> DataFrame:
        x, y = F.col("x"), F.col("y")
        tree = F.coalesce(*[F.when(x.between(b[0], b[2]) & y.between(b[1], b[3]), F.lit(i + 1)) for i, b in enumerate(self.boxes)], F.lit(0))
        leaf = F.coalesce(*[F.when(F.col("tree") == t, trees.route(n, x, y)) for t, n in self.trees.items()])
        points = points.withColumn("tree", tree).withColumn("leaf", leaf)
        # one fold over the cell of the point's own leaf, whose box is looked up
        leaves = [(t, n.leaf, n.box) for t, root in self.trees.items() for n in root.leaves()]
        boxes = F.map_from_arrays(F.array(*[F.lit(t * 1_000_000 + k) for t, k, _ in leaves]), F.array(*[F.array(*[F.lit(float(v)) for v in b]) for _, _, b in leaves]))
        points = points.withColumn("_box", F.element_at(boxes, F.col("tree") * 1_000_000 + F.col("leaf")))
        out, drop = None, ["_box"]
        for depth in sorted(set(self.depths.values())):
            cells = {}
            for i, c in enumerate("xy"):
                low, high = F.get("_box", F.lit(i)), F.get("_box", F.lit(i + 2))
                cells[f"_{c}{depth}"] = curves.cell(F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0)), depth)
            points = points.withColumns(cells)
            index = curves.encode(*[F.col(c) for c in cells], depth, self.curve)
            own = F.col("tree").isin([t for t, d in self.depths.items() if d == depth])
            out = F.when(own, index) if out is None else out.when(own, index)
            drop += cells
        return points.withColumn("sfc", out).drop(*drop)

    def candidates(self, x: float, y: float, rad: float) -> Column:
        box = _circle_box(x, y, rad)
        whole: dict[int, list[int]] = {}
        terms = []
        for t, root in self.trees.items():
            for n in root.leaves():
                common = (max(box[0], n.box[0]), max(box[1], n.box[1]), min(box[2], n.box[2]), min(box[3], n.box[3]))
                if common[0] > common[2] or common[1] > common[3]:
                    continue
                if t == 0 and any(b[0] <= common[0] and b[1] <= common[1] and b[2] >= common[2] and b[3] >= common[3] for b in self.boxes):
                    continue
                if common == n.box:
                    whole.setdefault(t, []).append(n.leaf)
                else:
                    ranges = decompose(unit_box(box, n.box), self.depths[t], self.curve)
                    terms.append(f"tree = {t} and leaf = {n.leaf} and ({_between('sfc', ranges)})")
        terms += [f"tree = {t} and {_among('leaf', own)}" for t, own in whole.items()]
        return F.expr(_any(terms))


#: groups of curve indices whose counts are collected at most
GROUPS = 1 << 16


def histogram(points: DataFrame, depth: int, grouping: int = 1) -> list[int]:
    """Rows by groups of curve indices; 4**depth / grouping numbers."""
    found = {r["g"]: r["n"] for r in points.groupBy(F.floor(F.col("sfc") / grouping).alias("g")).agg(F.count("*").alias("n")).collect()}
    return [found.get(g, 0) for g in range(-(-(4**depth) // grouping))]


def naive(points: DataFrame) -> Layout:
    return Layout(extent(points))


def mbr(points: DataFrame) -> MbrLayout:
    return MbrLayout(extent(points), sort_by=("sfc",))


def sfc(points: DataFrame, depth: int = 8, curve: str = "hilbert", tolerance: int = 1, max_ranges: int | None = 64) -> CurveLayout:
    return CurveLayout(extent(points), sort_by=("sfc",), depth=depth, curve=curve, tolerance=tolerance, max_ranges=max_ranges)


def m1(points: DataFrame, depth: int = 6, parts: int = 16, form: str = "multi", curve: str = "hilbert", sample: int | None = None) -> RangePartitions:
    base = CurveLayout(extent(points), depth=depth, curve=curve)
    rows = points if sample is None else hashed_sample(points, sample)
    grouping = max(1, 4**depth // GROUPS)
    cut = greedy_partitions(histogram(base.assign(rows), depth, grouping), parts, depth, grouping)
    return RangePartitions(base.world, ("part_id",), ("sfc",), depth=depth, curve=curve, parts=cut, form=form)


def _sampled(points: DataFrame, sample: int) -> list[tuple[int, float, float]]:
    return [(r["id"], r["x"], r["y"]) for r in hashed_sample(points, sample).collect()]


def m2(points: DataFrame, depth: int = 4, min_leaf: int = 256, sample: int = SAMPLE) -> TreePartitions:
    world = extent(points)
    return TreePartitions(world, ("leaf",), ("tree", "leaf", "sfc"), {0: trees.build(_sampled(points, sample), world, min_leaf)}, [], {0: depth})


def m3(points: DataFrame, boxes: list[Box], base_leaf: int = 256, base_depth: int = 4, cluster_leaf: int = 64, cluster_depth: int = 4, sample: int = SAMPLE) -> TreePartitions:
    world = extent(points)
    own: dict[int, list] = {t: [] for t in range(len(boxes) + 1)}
    for p in _sampled(points, sample):
        own[next((i + 1 for i, b in enumerate(boxes) if b[0] <= p[1] <= b[2] and b[1] <= p[2] <= b[3]), 0)].append(p)
    made = {t: trees.build(rows, boxes[t - 1] if t else world, cluster_leaf if t else base_leaf) for t, rows in own.items()}
    return TreePartitions(world, ("tree", "leaf"), ("tree", "leaf", "sfc"), made, boxes, {t: cluster_depth if t else base_depth for t in made})


KINDS = {c.__name__: c for c in (Layout, CurveLayout, MbrLayout, RangePartitions, TreePartitions)}


def describe(layout: Layout) -> str:
    """All that a layout is, as JSON: the catalog of a written table."""
    out = {f.name: getattr(layout, f.name) for f in fields(layout)}
    if isinstance(layout, TreePartitions):
        out["trees"] = [row for t, n in layout.trees.items() for row in trees.to_rows(n, t)]
        out["depths"] = list(layout.depths.items())
    return json.dumps({"kind": type(layout).__name__, **out})


def restore(text: str) -> Layout:
    out = json.loads(text)
    kind = KINDS[out.pop("kind")]
    tuples = lambda rows: [tuple(r) for r in rows]
    out |= {k: tuple(out[k]) for k in ("world", "partition_by", "sort_by")} | {k: tuples(out[k]) for k in ("parts", "boxes") if k in out}
    if kind is TreePartitions:
        rows = tuples(out["trees"])
        out["trees"] = {t: trees.from_rows([r for r in rows if r[0] == t]) for t in dict.fromkeys(r[0] for r in rows)}
        out["depths"] = dict(out["depths"])
    return kind(**out)


@dataclass
class PointTable:
    """A written layout.  It is dealt and sorted when written, so that queries read little of it.

    A folder holds the points (``data``) and the catalog (``layout``); ``open`` needs nothing else.
    """

    df: DataFrame
    layout: Layout
    path: str | None = None

    @classmethod
    def write(cls, points: DataFrame, layout: Layout, label: str = "points", path: str | None = None) -> "PointTable":
        spark = points.sparkSession
        path = path or scratch(spark, label)
        placed = layout.assign(points.where("x is not null and y is not null"))
        if layout.sort_by:
            placed = placed.repartitionByRange(*[F.col(c) for c in layout.sort_by]).sortWithinPartitions(*dict.fromkeys((*layout.partition_by, *layout.sort_by)))
        writer = placed.write.partitionBy(*layout.partition_by) if layout.partition_by else placed.write
        writer.parquet(f"{path}/data")
        # the catalog comes last: a table whose writing broke off can't be opened
        spark.createDataFrame([(describe(layout),)], "value string").coalesce(1).write.text(f"{path}/layout")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "PointTable":
        """A table that was written before, by whatever session."""
        layout = restore(spark.read.text(f"{path}/layout").first()[0])
        return cls(spark.read.parquet(f"{path}/data"), layout, path)

    def drop(self) -> None:
        """Deletes the table."""
        remove(self.df.sparkSession, self.path)

    def compact(self, path: str | None = None) -> "PointTable":
        """The table written anew, with a file for each partition or stretch of the curve; the old one stays."""
        keep = [c for c in self.df.columns if c not in ("sfc", *self.layout.partition_by, "tree", "leaf")]
        return PointTable.write(self.df.select(*keep), self.layout, "compact", path)

    def storage(self) -> dict[str, int]:
        """bytes, files and partitions."""
        found = usage(self.df.sparkSession, f"{self.path}/data")
        n = self.df.select(*self.layout.partition_by).distinct().count() if self.layout.partition_by else 1
        return {**found, "partitions": n}

    def candidates(self, x: float, y: float, rad: float) -> DataFrame:
        return self.df.where(self.layout.candidates(x, y, rad))

    def range_query(self, x: float, y: float, rad: float, inclusive: bool = False, limit: int | None = None) -> DataFrame:
        """id, x, y of the points nearer than rad (or as near, if inclusive)."""
        found = self.candidates(x, y, rad).where(within(F.col("x"), F.col("y"), x, y, float(rad), inclusive)).select("id", "x", "y")
        return found if limit is None else found.limit(limit)

    def hit_rate(self, x: float, y: float, rad: float) -> DataFrame:
        """found, checked and hit (null if nothing is checked)."""
        ok = within(F.col("x"), F.col("y"), x, y, float(rad))
        found, checked = F.coalesce(F.sum(ok.cast("long")), F.lit(0)), F.count("*")
        return self.candidates(x, y, rad).agg(found.alias("found"), checked.alias("checked"), F.when(checked > 0, found / checked).alias("hit"))

    def batch(self, queries: list[tuple[int, float, float, float]], inclusive: bool = False) -> DataFrame:
        """qid, id, x, y for many circles (qid, x, y, rad) over a curve's layout: its points are joined with the circles' ranges."""
        depth = self.layout.depth
        rows = [(q, x, y, rad, lo, hi) for q, x, y, rad in queries for lo, hi in self.layout.ranges(x, y, rad)]
        ranges = self.df.sparkSession.createDataFrame(rows, "qid long, qx double, qy double, qr double, start long, end long")
        met = in_ranges(self.df, "sfc", ranges, max(0, 2 * depth - 12))
        return met.where(within(F.col("x"), F.col("y"), F.col("qx"), F.col("qy"), F.col("qr"), inclusive)).select("qid", "id", "x", "y")


def in_ranges(rows: DataFrame, column: str, ranges: DataFrame, bits: int) -> DataFrame:
    """rows joined with the ranges (start, end and more) that hold their value, by stretches of 2**bits values: no nested loop."""
    dealt = ranges.select("*", F.explode(F.sequence(F.shiftright("start", bits), F.shiftright("end", bits))).alias("_stretch"))
    return rows.withColumn("_stretch", F.shiftright(F.col(column).cast("long"), bits)).join(dealt, "_stretch").where(F.col(column).between(F.col("start"), F.col("end"))).drop("_stretch")


def overlap_join(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """left (l, l_start, l_end) and right (r, r_start, r_end): l, r, first and last of what intervals have in common.

    Both are dealt over the stretches that they meet; a pair is found in the first stretch that both meet.
    """
    dealt = lambda rows, s: rows.select("*", F.explode(F.sequence(F.shiftright(f"{s}_start", bits), F.shiftright(f"{s}_end", bits))).alias("_stretch"))
    first, last = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    both = dealt(left, "l").join(dealt(right, "r"), "_stretch").where((first <= last) & (F.shiftright(first, bits) == F.col("_stretch")))
    return both.select("l", "r", first.alias("first"), last.alias("last"))


def batch_range(points: DataFrame, queries: DataFrame, cell_size: float, inclusive: bool = False) -> DataFrame:
    """qid, id, x, y for all queries (qid, x, y, rad) at once.

    Points get a cell of the given size, queries are exploded over the cells
    that they meet, and both are joined by the cell: no nested loop over all
    pairs, and a shuffle or a broadcast as sizes ask for.
    """
    of = lambda v: F.floor(v / F.lit(float(cell_size))).cast("long")
    q = queries.select("qid", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("rad").alias("qr"))
    q = q.withColumn("cx", F.explode(F.sequence(of(F.col("qx") - F.col("qr")), of(F.col("qx") + F.col("qr")))))
    q = q.withColumn("cy", F.explode(F.sequence(of(F.col("qy") - F.col("qr")), of(F.col("qy") + F.col("qr")))))
    cell = [F.col("cx") * cell_size, F.col("cy") * cell_size, (F.col("cx") + 1) * cell_size, (F.col("cy") + 1) * cell_size]
    q = q.where(circle_meets_box(F.col("qx"), F.col("qy"), F.col("qr") * (1 + 1e-9) + 1e-9, cell))
    p = points.withColumn("cx", of(F.col("x"))).withColumn("cy", of(F.col("y")))
    return p.join(q, ["cx", "cy"]).where(within(F.col("x"), F.col("y"), F.col("qx"), F.col("qy"), F.col("qr"), inclusive)).select("qid", "id", "x", "y")
