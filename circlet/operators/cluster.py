"""Density-based clusters, cluster boxes, k-means steps and cluster scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranges import Box
from ..sources.store import written


def standardise(points: DataFrame) -> DataFrame:
    """x and y less their mean, over their population deviation."""
    row = points.agg(F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y")).first()
    if row[0] is None:
        return points
    return points.withColumn("x", (F.col("x") - row[0]) / (row[2] or 1.0)).withColumn("y", (F.col("y") - row[1]) / (row[3] or 1.0))


def neighbours(points: DataFrame, eps: float) -> DataFrame:
    """a, b: ids of points no further apart than eps, each one with itself too; by a grid of cells of that size."""
    of = lambda c: F.floor(F.col(c) / F.lit(eps)).cast("long")
    left = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), of("x").alias("cx"), of("y").alias("cy"))
    right = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), of("x").alias("cx"), of("y").alias("cy"))
    around = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    right = right.withColumn("cx", F.explode(F.transform(around, lambda d: F.col("cx") + d))).withColumn("cy", F.explode(F.transform(around, lambda d: F.col("cy") + d)))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return left.join(right, ["cx", "cy"]).where(dx * dx + dy * dy <= F.lit(eps * eps)).select("a", "b")


def core_points(pairs: DataFrame, min_samples: int) -> DataFrame:
    return pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("id")


#: links of cells that the driver joins (16 bytes each); more are joined by rounds of Spark
DRIVER_LINKS = 500_000
#: cells around a cell in which a point can be near: of side eps / sqrt(2), two away at most, but not in the corners
_AROUND = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) != (0, 0) and abs(dx) + abs(dy) < 4]


def _near(left: DataFrame, right: DataFrame, eps: float, offsets: list[tuple[int, int]]) -> DataFrame:
    """left (cx, cy, x, y and more) joined with the right's points (ox, oy and more) no further than eps in the cells around."""
    to = F.explode(F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in offsets])).alias("to")
    moved = left.select("*", to).withColumns({"tx": F.col("cx") + F.col("to.dx"), "ty": F.col("cy") + F.col("to.dy")}).drop("to")
    other = right.withColumnsRenamed({"cx": "tx", "cy": "ty", "x": "ox", "y": "oy"})
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return moved.join(other, ["tx", "ty"]).where(dx * dx + dy * dy <= F.lit(eps * eps))


def _joined(links: DataFrame) -> DataFrame:
    """node and root, the least node that links lead to, of all nodes in links (u, v)."""
    spark = links.sparkSession
    if links.limit(DRIVER_LINKS + 1).count() <= DRIVER_LINKS:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for u, v in links.collect():
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
        return spark.createDataFrame([(x, find(x)) for x in root], "node long, root long")
    both = written(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    roots = both.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    while True:  # each round takes the least root around, and then that one's own
        least = both.join(roots, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("around"))
        least = roots.join(least, "node").select("node", F.least("root", "around").alias("root"))
        jump = least.join(least.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", F.least("root", "further").alias("root"))
        nxt = written(jump, "roots")
        if not nxt.join(roots.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count():
            return nxt
        roots = nxt


def dbscan(points: DataFrame, eps: float = 0.18, min_samples: int = 24) -> DataFrame:
    """id and label: the least core id of the point's cluster; a border point takes the least one of its core neighbours; -1 is noise.

    Points of a cell of side eps / sqrt(2) are all near each other.  So all points of a cell with min_samples are
    core, only those of other cells are counted around, and clusters are made of cells: two of them are linked by
    any pair of core points, which the extreme points of eight directions mostly show.
    """
    side = F.lit(eps / math.sqrt(2) * (1 - 1e-9))
    cells = points.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    counts = cells.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    cells = written(cells.join(counts, ["cx", "cy"]).withColumn("cell", F.shiftleft("cx", 32) + F.pmod(F.col("cy"), F.lit(1 << 32))), "cells")
    thin = cells.where(F.col("n") < min_samples)
    around = _near(thin, cells.select("cx", "cy", "x", "y"), eps, _AROUND).groupBy("id").agg(F.count("*").alias("more"))
    thin = thin.join(around, "id", "left").withColumn("core", F.col("n") + F.coalesce("more", F.lit(0)) >= min_samples).drop("more")
    placed = written(cells.where(F.col("n") >= min_samples).withColumn("core", F.lit(True)).unionByName(thin), "placed")
    core = placed.where("core").select("id", "x", "y", "cx", "cy", "cell")
    # links of cells: by their extreme points, else by any pair
    ways = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    ends = F.array(*[f(F.struct("x", "y"), w) for w in ways for f in (F.min_by, F.max_by)])
    box = core.groupBy("cx", "cy", "cell").agg(ends.alias("ends"), F.min("id").alias("least"))
    ahead = [o for o in _AROUND if o > (0, 0)]
    to = F.explode(F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in ahead])).alias("to")
    pairs = box.select("cell", "ends", "cx", "cy", to)
    pairs = pairs.select(F.col("cell").alias("u"), F.col("ends").alias("mine"), (F.col("cx") + F.col("to.dx")).alias("cx"), (F.col("cy") + F.col("to.dy")).alias("cy")).join(box.select(F.col("cell").alias("v"), F.col("ends").alias("theirs"), "cx", "cy"), ["cx", "cy"])
    close = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) <= F.lit(eps * eps)
    pairs = written(pairs.select("u", "v", F.exists("mine", lambda a: F.exists("theirs", lambda b: close(a, b))).alias("sure")), "cell-pairs")
    unsure = pairs.where("not sure").select("u", "v")
    mine, theirs = (core.select(F.col("cell").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in "uv")
    dx, dy = F.col("xu") - F.col("xv"), F.col("yu") - F.col("yv")
    shown = unsure.join(mine, "u").join(theirs, "v").where(dx * dx + dy * dy <= F.lit(eps * eps)).select("u", "v").distinct()
    roots = _joined(pairs.where("sure").select("u", "v").unionByName(shown))
    of = box.select("cell", "least").join(roots.withColumnRenamed("node", "cell"), "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    of = of.join(of.groupBy("root").agg(F.min("least").alias("label")), "root").select("cell", "label")
    labels = core.join(of, "cell").select("id", "label", "x", "y", "cx", "cy")
    others = placed.where("not core").select("id", "x", "y", "cx", "cy")
    border = _near(others, labels.select("label", "x", "y", "cx", "cy"), eps, [(0, 0), *_AROUND]).groupBy("id").agg(F.min("label").alias("near"))
    out = others.select("id").join(border, "id", "left").select("id", F.coalesce("near", F.lit(-1)).alias("label"))
    return labels.select("id", "label").unionByName(out)


def boxes(labelled: DataFrame) -> DataFrame:
    """label, n, min_x, min_y, max_x, max_y of each cluster (x, y, label); noise has none."""
    return labelled.where("label <> -1").groupBy("label").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def overlapping(found: list[Box]) -> list[tuple[int, int]]:
    """Pairs that have a point in common, edges included."""
    return [(i, j) for i in range(len(found)) for j in range(i) if all(found[i][k] <= found[j][k + 2] and found[j][k] <= found[i][k + 2] for k in (0, 1))]


def union(a: Box, b: Box) -> Box:
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def fix_overlaps(found: list[Box], gap: float = 100.0) -> list[Box]:
    """Boxes that don't meet: while two do, the one with the shorter diagonal loses the least that leaves a gap between them; what is left of no size goes."""
    out = list(found)
    while met := overlapping(out):
        i, j = sorted(met[0], key=lambda k: math.dist(out[k][:2], out[k][2:]))
        small, large = out[i], out[j]
        cuts = []
        for k in (0, 1):
            below, above = list(small), list(small)
            below[k + 2], above[k] = large[k] - gap, large[k + 2] + gap
            cuts += [(small[k + 2] - below[k + 2], below), (above[k] - small[k], above)]
        out[i] = tuple(min(cuts)[1])
        out = [b for b in out if b[0] <= b[2] and b[1] <= b[3]]
    return out


def find_boxes(sample: DataFrame, eps: float = 0.18, min_samples: int = 24, part: float = 1 / 9001, gap: float = 100.0) -> list[Box]:
    """Boxes of the clusters of a bounded sample (id, x, y): points are standardised for the search, boxes are in their own units.

    Clusters with no more than ``part`` of the sample are left out.
    """
    labels = dbscan(standardise(sample), eps, min_samples)
    rows = boxes(sample.join(labels, "id")).where(F.col("n") > F.lit(sample.count() * part)).orderBy("label").collect()
    return fix_overlaps([(r["min_x"], r["min_y"], r["max_x"], r["max_y"]) for r in rows], gap)


def kmeans_step(points: DataFrame, centres: list[tuple[int, float, float]]) -> DataFrame:
    """k, n, x, y: the new centres.  The nearest centre of each point is found in the row, by k comparisons."""
    distance = [F.struct(((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)).alias("d"), F.lit(k).alias("k")) for k, cx, cy in centres]
    near = F.array_min(F.array(*distance))["k"]
    return points.withColumn("k", near).groupBy("k").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def kmeans(points: DataFrame, k: int, max_rounds: int = 50, shift: float = 1.0) -> list[tuple[int, float, float]]:
    """From the k points with the least ids, until the centres move by less than ``shift`` in all."""
    centres = [(i, r["x"], r["y"]) for i, r in enumerate(points.orderBy("id").limit(k).collect())]
    for _ in range(max_rounds):
        new = {r["k"]: (r["x"], r["y"]) for r in kmeans_step(points, centres).collect()}
        moved = [(i, *new.get(i, (x, y))) for i, x, y in centres]
        total = sum(math.dist(a[1:], b[1:]) for a, b in zip(centres, moved, strict=True))
        centres = moved
        if total < shift:
            break
    return centres


def silhouette(labelled: DataFrame) -> DataFrame:
    """score: the mean of (b - a) / max(a, b) over points (id, x, y, label).

    The score is defined on all pairs; give a sample (the callers' is bounded), as its cost is that of its square.
    """
    a = labelled.select(F.col("id").alias("i"), F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("label").alias("il"))
    b = labelled.select(F.col("id").alias("j"), F.col("x").alias("jx"), F.col("y").alias("jy"), F.col("label").alias("jl"))
    dx, dy = F.col("ix") - F.col("jx"), F.col("iy") - F.col("jy")
    pairs = a.join(b, F.col("i") != F.col("j")).groupBy("i", "il", "jl").agg(F.avg(F.sqrt(dx * dx + dy * dy)).alias("d"))
    own = F.min(F.when(F.col("il") == F.col("jl"), F.col("d")))
    other = F.min(F.when(F.col("il") != F.col("jl"), F.col("d")))
    per = pairs.groupBy("i").agg(own.alias("a"), other.alias("b"))
    return per.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("score"))


def davies_bouldin(labelled: DataFrame) -> DataFrame:
    """score: the mean over clusters of the largest (s_i + s_j) / d_ij; s is the root of the mean squared distance."""
    centre = labelled.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    spread = labelled.join(centre, "label").groupBy("label", "cx", "cy").agg(F.sqrt(F.avg(dx * dx + dy * dy)).alias("s"))
    i = spread.select(F.col("label").alias("i"), F.col("cx").alias("ix"), F.col("cy").alias("iy"), F.col("s").alias("si"))
    j = spread.select(F.col("label").alias("j"), F.col("cx").alias("jx"), F.col("cy").alias("jy"), F.col("s").alias("sj"))
    dx, dy = F.col("ix") - F.col("jx"), F.col("iy") - F.col("jy")
    worst = i.join(j, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.sqrt(dx * dx + dy * dy)).alias("r"))
    return worst.agg(F.avg("r").alias("score"))
