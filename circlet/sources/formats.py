"""Text formats of points, queries, boxes and results, and GeoJSON.

Points and results are read and written by Spark.  Queries and boxes are small
lists by nature (hundreds); they are read through Spark too, so that any store
works, and kept on the driver.
"""

from __future__ import annotations

import json
import math
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import mercator


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``x,y``."""
    return spark.read.schema("x double, y double").csv(path).where("x is not null and y is not null")


def export_lines(points: DataFrame) -> DataFrame:
    """Lines with six decimals."""
    return points.select(F.format_string("%.6f,%.6f", "x", "y").alias("value"))


def write_points(points: DataFrame, path: str) -> None:
    export_lines(points).write.text(path)


def read_groups(spark: SparkSession, path: str, size: int) -> list[tuple[float, ...]]:
    """Numbers, one a line, in groups; an error if the last one isn't whole."""
    values = [float(r.value) for r in spark.read.text(path, wholetext=True).selectExpr("explode(split(trim(value), '\\\\s+')) as value").where("value <> ''").collect()]
    if len(values) % size:
        raise ValueError(f"{path}: {len(values)} lines aren't groups of {size}")
    return [tuple(values[i : i + size]) for i in range(0, len(values), size)]


def read_queries(spark: SparkSession, path: str) -> list[tuple[float, ...]]:
    """x, y, rad."""
    return read_groups(spark, path, 3)


def read_boxes(spark: SparkSession, path: str) -> list[tuple[float, ...]]:
    """min_x, min_y, max_x, max_y; an empty file holds no boxes."""
    return read_groups(spark, path, 4)


def read_query_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("x double, y double, rad double").csv(path)


def write_groups(spark: SparkSession, rows: list[tuple[float, ...]], path: str) -> None:
    """Numbers rounded to integers, one a line, in one file."""
    lines = "\n".join(f"{v:.0f}" for row in rows for v in row)
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(path)


_RING = "array<array<double>>"


def _mean(ring) -> list[F.Column]:
    """Of the points of a line, or of a ring without the last one, which is the first again."""
    open_ring = F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    return [F.aggregate(open_ring, F.lit(0.0), lambda s, v: s + v[i]) / F.size(open_ring) for i in (0, 1)]


def _area_centre(ring) -> list[F.Column]:
    """Centroid of the area of a closed ring, relative to its first point for precision; the mean of its points where it has no area."""
    first = F.get(ring, F.lit(0))
    at = lambda i, k: F.get(ring, i)[k] - first[k]
    cross = lambda i: at(i, 0) * at(i + 1, 1) - at(i + 1, 0) * at(i, 1)
    edges = F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))
    total = lambda f: F.aggregate(edges, F.lit(0.0), lambda s, i: s + f(i))
    area = total(cross)
    mean = _mean(ring)
    return [F.when(area != 0, first[k] + total(lambda i: (at(i, k) + at(i + 1, k)) * cross(i)) / (3 * area)).otherwise(mean[k]) for k in (0, 1)]


def read_geojson(spark: SparkSession, path: str, projected: bool = False, lines: bool = False) -> DataFrame:
    """ogc_fid, x, y, id and properties (JSON) of each feature: of points their place, of lines the mean of their points, of polygons the
    centroid of the outer ring's area; of the parts of a multi-shape the first one.  Degrees are projected.  Features without a place go.

    lines: a feature on each line, so that a large file is read by many tasks; else one collection a file.
    """
    feature = "struct<id:string,properties:string,geometry:struct<type:string,coordinates:string>>"
    if lines:
        rows = spark.read.schema("id string, properties string, geometry struct<type:string,coordinates:string>").json(path)
        rows = rows.select((F.monotonically_increasing_id() + 1).alias("ogc_fid"), F.struct("id", "properties", "geometry").alias("f"))
    else:
        features = spark.read.option("multiLine", True).schema(f"features array<{feature}>").json(path)
        rows = features.select(F.posexplode("features").alias("n", "f")).select((F.col("n") + 1).cast("long").alias("ogc_fid"), "f")
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    depth = F.length(F.regexp_extract(text, r"^[\s\[]*", 0)) - F.length(F.regexp_replace(F.regexp_extract(text, r"^[\s\[]*", 0), r"\[", ""))
    # points have one bracket, lines two, polygons three; a part of a multi-shape is read as the shape itself
    point = F.from_json(F.when(depth == 1, text), "array<double>")
    line = F.coalesce(F.from_json(F.when((depth == 2) & (kind == "LineString"), text), _RING), F.from_json(F.when((depth == 3) & (kind == "MultiLineString"), text), f"array<{_RING}>")[0])
    several = F.from_json(F.when((depth == 2) & (kind == "MultiPoint"), text), _RING)
    ring = F.coalesce(F.from_json(F.when((depth == 3) & (kind == "Polygon"), text), f"array<{_RING}>")[0], F.from_json(F.when(depth == 4, text), f"array<array<{_RING}>>")[0][0])
    rows = rows.select("ogc_fid", "f.id", "f.properties", point.alias("point"), F.coalesce(line, several).alias("line"), ring.alias("ring"))
    lon, lat = (F.coalesce(F.get("point", F.lit(k)), _mean(F.col("line"))[k], _area_centre(F.col("ring"))[k]) for k in (0, 1))
    rows = rows.select("ogc_fid", lon.alias("lon"), lat.alias("lat"), "id", "properties").where("lon is not null and lat is not null")
    x, y = (F.col("lon"), F.col("lat")) if projected else mercator(F.col("lon"), F.col("lat"))
    return rows.select("ogc_fid", x.alias("x"), y.alias("y"), "id", "properties")


def wkb_point(data: F.Column) -> F.Column:
    """struct<x, y>: the first point of a shape in WKB (either byte order, any of the simple and multi shapes, also with z, m and an SRID); null if there is none."""

    @F.pandas_udf("x double, y double")
    def decode(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_first_point(v) or (None, None) for v in values], columns=["x", "y"], dtype="Float64")

    found = decode(data)
    return F.when(found["x"].isNotNull(), found)


def _first_point(data: bytes | None) -> tuple[float, float] | None:
    at = 0
    while data is not None and len(data) >= at + 5 and data[at] in (0, 1):
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5 + (4 if kind & 0x20000000 else 0)
        kind = (kind & 0xFFFF) % 1000
        if kind in (2, 3):  # how many points, or rings and then points
            for _ in range(kind - 1):
                if len(data) < at + 4 or not struct.unpack_from(f"{order}I", data, at)[0]:
                    return None
                at += 4
        if kind in (1, 2, 3):
            if len(data) < at + 16:
                return None
            x, y = struct.unpack_from(f"{order}2d", data, at)
            return None if math.isnan(x) or math.isnan(y) else (x, y)
        if kind not in (4, 5, 6, 7) or len(data) < at + 4 or not struct.unpack_from(f"{order}I", data, at)[0]:
            return None
        at += 4
    return None


def ingest(spark: SparkSession, path: str, points_path: str | None = None, projected: bool = False, lines: bool = False) -> DataFrame:
    """GeoJSON to a point table (id, x, y) without empty shapes; its points are also exported as lines if a path is given."""
    points = clean(read_geojson(spark, path, projected, lines)).select(F.col("ogc_fid").alias("id"), "x", "y")
    if points_path is not None:
        write_points(points, points_path)
    return points


def clean(points: DataFrame) -> DataFrame:
    return points.where("x is not null and y is not null")


def result_lines(results: DataFrame) -> DataFrame:
    """elapsed, hit of each query; hit is -1 where it isn't known."""
    return results.select(F.format_string("%.9f,%.6f", "elapsed", F.coalesce("hit", F.lit(-1.0))).alias("value"))


def results_json(cases: list[dict]) -> str:
    """cases: case, label, times, hit and parameters; means are added: of times the plain one, of hits the geometric one with a floor."""
    out = []
    for c in cases:
        hits = [h if h and h > 0 else 1e-3 for h in c["hit"]]
        data = {"times": c["times"], "hit": c["hit"], "avg_time": sum(c["times"]) / len(c["times"]), "avg_hit": math.exp(sum(map(math.log, hits)) / len(hits)), "label": c["label"], **{k: str(v) for k, v in c.get("params", {}).items()}}
        out.append({"case": c["case"], "data": data})
    return json.dumps(out)


def read_results(text: str) -> list[dict]:
    """The cases of results_json, as it takes them."""
    out = []
    for c in json.loads(text):
        data = dict(c["data"])
        known = {k: data.pop(k) for k in ("times", "hit", "label")}
        data.pop("avg_time", None)
        data.pop("avg_hit", None)
        out.append({"case": c["case"], **known, "params": data})
    return out
