"""Seeded generators of points and of queries."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ranges import Box


def uniform(spark: SparkSession, n: int, box: Box = (-1e5, -1e5, 1e5, 1e5), seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", (F.rand(seed) * (box[2] - box[0]) + box[0]).alias("x"), (F.rand(seed + 1) * (box[3] - box[1]) + box[1]).alias("y"))


def gaussian(spark: SparkSession, n: int, box: Box = (-1e5, -1e5, 1e5, 1e5), sigma: float = 0.2, seed: int = 1) -> DataFrame:
    """Normal around the middle on each axis, cut to the open box: of eight draws an axis the first that fits, else the middle."""
    rows = spark.range(n)
    axis = {}
    for k, c in enumerate("xy"):
        draws = [F.randn(seed + 100 * k + i) * sigma + 0.5 for i in range(8)]
        rows = rows.withColumn(f"_{c}", F.array(*draws))
        axis[c] = F.coalesce(F.get(F.filter(f"_{c}", lambda v: (v > 0) & (v < 1)), F.lit(0)), F.lit(0.5)) * (box[k + 2] - box[k]) + box[k]
    return rows.select("id", axis["x"].alias("x"), axis["y"].alias("y"))


def make_datasets(spark: SparkSession, n: int, folder: str, box: Box = (-1e5, -1e5, 1e5, 1e5), seed: int = 1) -> dict[str, str]:
    """Writes n even points (``ran``) and n normal ones (``gau``), and says where."""
    made = {"ran": uniform(spark, n, box, seed), "gau": gaussian(spark, n, box, seed=seed)}
    for name, points in made.items():
        points.write.parquet(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in made}


def poisson(rng: random.Random, mean: float) -> int:
    k, p, stop = 0, 1.0, math.exp(-mean)
    while (p := p * rng.random()) > stop:
        k += 1
    return k


def islands(spark: SparkSession, seed: int = 1, size: int = 20480, noise: float = 0.0) -> DataFrame:
    """Gaussian clusters around random centres; noise: 0, 1 or 2 times their mean size each, spread evenly."""
    rng = random.Random(seed)
    count = max(6, poisson(rng, 5))
    rows = [(c, rng.uniform(-2e5, 2e5), rng.uniform(-2e5, 2e5), max(1, int(rng.gauss(size, size / 4)))) for c in range(count)]
    centres = spark.createDataFrame(rows, "c int, cx double, cy double, n int")
    points = centres.select("cx", "cy", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select((F.col("cx") + F.randn(seed) * 12560).alias("x"), (F.col("cy") + F.randn(seed + 1) * 12560).alias("y"))
    if noise:
        points = points.unionByName(uniform(spark, int(noise * size * count), (-2.4e5, -2.4e5, 2.4e5, 2.4e5), seed + 2).drop("id"))
    return points.select(F.monotonically_increasing_id().alias("id"), "x", "y")


def radius_bounds(width: float, height: float) -> tuple[float, float]:
    d = math.sqrt(width * height)
    return 0.0625 * d**0.625, 0.225 * d**0.875


def cell_cdf(points: DataFrame, box: Box, cells: int = 32) -> DataFrame:
    """gx, gy, n and upto, the share of points in this cell or before it; at most cells**2 rows."""
    of = lambda c, i: F.greatest(F.lit(0), F.least(F.floor((F.col(c) - box[i]) / (box[i + 2] - box[i] or 1.0) * cells), F.lit(cells - 1)))
    counts = points.groupBy(of("x", 0).alias("gx"), of("y", 1).alias("gy")).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("gy", "gx").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(total))


def density_queries(points: DataFrame, box: Box, n: int = 200, cells: int = 32, seed: int = 1) -> list[tuple[float, float, float]]:
    """Circles where the points are: a cell by its share, a place in it and a radius at random."""
    cdf = cell_cdf(points, box, cells).orderBy("upto").collect()
    rng, size = random.Random(seed), ((box[2] - box[0]) / cells, (box[3] - box[1]) / cells)
    low, high = radius_bounds(box[2] - box[0], box[3] - box[1])
    out = []
    for _ in range(n if cdf else 0):
        u = rng.random()
        row = next((r for r in cdf if r["upto"] >= u), cdf[-1])
        out.append((box[0] + (row["gx"] + rng.random()) * size[0], box[1] + (row["gy"] + rng.random()) * size[1], rng.uniform(low, high)))
    return out


def cluster_queries(found: list[Box], n: int = 200, seed: int = 1) -> list[tuple[float, float, float]]:
    """n / k circles in each box; the further from its middle, the larger."""
    rng, out = random.Random(seed), []
    for b in found:
        w, h = b[2] - b[0], b[3] - b[1]
        d = math.sqrt(w * h)
        for _ in range(n // len(found)):
            x, y = b[0] + rng.uniform(0.15, 0.9) * w, b[1] + rng.uniform(0.15, 0.9) * h
            e = math.dist((x, y), (b[0] + w / 2, b[1] + h / 2))
            out.append((x, y, 300 + d * (e / d) ** 2 if d else 300.0))
    return out


def nested_samples(points: DataFrame, parts: int, size: int) -> DataFrame:
    """id and part: sample i holds the rows of parts 0 to i, parts of the same permutation."""
    step = size // (parts + 1)
    ranked = points.select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("m")).orderBy("m", "id").limit(step * parts)
    place = F.row_number().over(Window.orderBy("m", "id")) - 1
    return ranked.select("id", F.floor(place / F.lit(max(1, step))).alias("part"))
