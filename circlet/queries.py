"""The registered queries and, as plain SQL, what they have to give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import curves
from .functions.geometry import box_in_box, box_overlap, circle_meets_box, mercator, squared_distance
from .operators import cluster, generate, layouts
from .plans import ranges as plan
from .plans import tree as trees
from .sources.formats import export_lines

#: the circle of the single queries, on pts_orders
CIRCLE = (100.0, 1500.0, 300.0)
#: the circles of the batch queries: an arithmetic pattern over the plane
BATCH = [(i, float(i * 37 % 150), 250.0 + i * 211 % 4500, 20.0 + i * 13 % 180) for i in range(20)]
BOXES = [(20.0, 500.0, 80.0, 2000.0), (60.0, 1500.0, 130.0, 3200.0), (500.0, 1000.0, 900.0, 2500.0)]
CENTRES = [(k, -0.3 + 0.06 * k, 0.3 - 0.06 * k) for k in range(10)]
DEPTH = 6
EPS, MIN_SAMPLES = 0.18, 8

TOLERANCES = (1, 16, 256)

_READY: dict[tuple, object] = {}


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pts_orders; y is scaled so that a circle makes sense."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 100.0).alias("y"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), "label")


def table(spark: SparkSession, sf_dir: str, name: str) -> layouts.PointTable:
    """The written layout of a method over pts_orders; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _READY:
        points = orders(spark, sf_dir)
        made = {
            "naive": lambda: layouts.naive(points), "rstar": lambda: layouts.mbr(points), "hilbert": lambda: layouts.sfc(points), "zorder": lambda: layouts.sfc(points, curve="zorder"),
            "m1_span": lambda: layouts.m1(points, form="span"), "m1_multi": lambda: layouts.m1(points), "m1_whole": lambda: layouts.m1(points, form="whole"), "m1_envelope": lambda: layouts.m1(points, form="envelope"),
            "m2": lambda: layouts.m2(points), "m3": lambda: layouts.m3(points, BOXES, base_leaf=128, cluster_leaf=64),
        }[name]()
        _READY[key] = layouts.PointTable.write(points, made, name)
    return _READY[key]


def _range(name: str) -> Callable:
    return lambda spark, sf_dir: table(spark, sf_dir, name).range_query(*CIRCLE)


def _batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BATCH, "qid int, x double, y double, rad double")


def batch_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.batch_range(orders(spark, sf_dir), _batch(spark), 100.0)


def batch_layout_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the ranges of a written curve layout."""
    return table(spark, sf_dir, "hilbert").batch(BATCH)


def reopened_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circle on tables of three layouts that are opened by their paths alone."""
    found = None
    for name in ("rstar", "m1_multi", "m3"):
        one = layouts.PointTable.open(spark, table(spark, sf_dir, name).path).range_query(*CIRCLE).select(F.lit(name).alias("layout"), "id", "x", "y")
        found = one if found is None else found.unionByName(one)
    return found


def compacted_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circle on a table that was written anew, and after the first one was dropped."""
    points = orders(spark, sf_dir)
    first = layouts.PointTable.write(points, layouts.m2(points), "dropped")
    second = first.compact()
    first.drop()
    return second.range_query(*CIRCLE)


def _hit(name: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        exact = replace(t.layout, max_ranges=None) if isinstance(t.layout, layouts.CurveLayout) else t.layout
        return layouts.PointTable(t.df, exact).hit_rate(*CIRCLE)

    return run


def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, files and partitions of each written layout."""
    rows = [(name, *(table(spark, sf_dir, name).storage()[k] for k in ("bytes", "files", "partitions"))) for name in METHODS.values()]
    return spark.createDataFrame(rows, "layout string, bytes long, files long, partitions long")


def cluster_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles in the boxes: of 30, ten each, as often as they lie in which box."""
    rows = [(i, *map(float, q)) for i, q in enumerate(generate.cluster_queries(BOXES, 30))]
    circles = spark.createDataFrame(rows, "qid int, x double, y double, rad double")
    box = F.floor(F.col("qid") / 10).cast("int")
    inside = F.coalesce(*[F.when(box == i, F.col("x").between(b[0], b[2]) & F.col("y").between(b[1], b[3])) for i, b in enumerate(BOXES)])
    return circles.groupBy(box.alias("box")).agg(F.count("*").alias("n"), F.sum(inside.cast("long")).alias("inside"), (F.min("rad") >= 300).alias("wide"))


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample that clusters are searched in."""
    return cluster.standardise(layouts.hashed_sample(orders(spark, sf_dir), 2048).select("id", "x", "y"))


def standardised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardised(spark, sf_dir).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DBSCAN at 0.18 and 24 of the standardised sample."""
    return cluster.dbscan(standardised(spark, sf_dir), 0.18, 24)


def m3_own_boxes_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circle over m3 with the boxes that are found in the points."""
    points = orders(spark, sf_dir)
    found = cluster.find_boxes(layouts.hashed_sample(points, 2048).select("id", "x", "y"), gap=1.0)
    return layouts.PointTable.write(points, layouts.m3(points, found), "m3-own").range_query(*CIRCLE)


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen parts of 256 indices against an interval for each order: many ranges against a catalog."""
    start = F.pmod(F.col("o_orderkey") * 37, F.lit(4096))
    left = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l"), start.alias("l_start"), F.least(F.lit(4095), start + F.pmod("o_custkey", F.lit(700))).alias("l_end"))
    right = spark.range(16).select(F.col("id").alias("r"), (F.col("id") * 256).alias("r_start"), (F.col("id") * 256 + 255).alias("r_end"))
    return layouts.overlap_join(left, right, 7)


def batch_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are the points of the circle's bounding box."""
    q = _batch(spark)
    of = lambda v: F.floor(v / F.lit(100.0)).cast("long")
    q = q.select("qid", F.col("x").alias("qx"), F.col("y").alias("qy"), "rad").withColumn("cx", F.explode(F.sequence(of(F.col("qx") - F.col("rad")), of(F.col("qx") + F.col("rad"))))).withColumn("cy", F.explode(F.sequence(of(F.col("qy") - F.col("rad")), of(F.col("qy") + F.col("rad")))))
    p = orders(spark, sf_dir).withColumn("cx", of(F.col("x"))).withColumn("cy", of(F.col("y")))
    near = p.join(q, ["cx", "cy"]).where(F.col("x").between(F.col("qx") - F.col("rad"), F.col("qx") + F.col("rad")) & F.col("y").between(F.col("qy") - F.col("rad"), F.col("qy") + F.col("rad")))
    ok = squared_distance(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")) < F.col("rad") * F.col("rad")
    per = near.groupBy("qid").agg(F.sum(ok.cast("long")).alias("found"), F.count("*").alias("checked"))
    return per.select("qid", "found", "checked", (F.col("found") / F.col("checked")).alias("hit"))


def _indexed(curve: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = orders(spark, sf_dir)
        return layouts.sfc(points, DEPTH, curve).assign(points).select("id", "sfc")

    return run


def _unindexed(curve: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = spark.range(4**DEPTH).select(F.col("id").alias("sfc"), curves.decode(F.col("id"), DEPTH, curve).alias("c"))
        return cells.select("sfc", *curves.cell_box(F.col("c.gx"), F.col("c.gy"), DEPTH))

    return run


def curve_discontinuities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each curve that don't lead to one of the eight cells around."""
    return spark.createDataFrame([(c, plan.discontinuities(spark, DEPTH, c)) for c in ("hilbert", "zorder")], "curve string, n long")


UNIT_BOX = (0.1, 0.4, 0.5, 0.8)


def cell_enumeration_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(plan.enumerate_cells(UNIT_BOX, DEPTH), "start long, end long")


def quadrant_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(plan.decompose(UNIT_BOX, DEPTH, max_ranges=None), "start long, end long")


def collect_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands of the cells that hold points: at most 4**DEPTH rows are left for the one window."""
    used = _indexed("hilbert")(spark, sf_dir).select("sfc").distinct()
    by = Window.orderBy("sfc")
    new = F.when(F.col("sfc") > F.lag("sfc").over(by) + 2, 1).otherwise(0)
    return used.withColumn("new", new).withColumn("g", F.sum("new").over(by)).groupBy("g").agg(F.min("sfc").alias("start"), F.max("sfc").alias("end")).drop("g")


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen even parts of the curve against the ranges of a box: what each part has to read."""
    n = 4**DEPTH // 16
    parts = [(p * n, p * n + n - 1) for p in range(16)]
    return spark.createDataFrame(plan.overlap(parts, plan.decompose(UNIT_BOX, DEPTH, max_ranges=None)), "part long, first long, last long")


def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.agg(F.count("*").alias("n"), F.countDistinct("l_quantity").alias("n_y"))


def normalise_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = orders(spark, sf_dir)
    w = layouts.extent(points)
    return points.select("id", curves.unit(F.col("x"), w[0], w[2]).alias("ux"), curves.unit(F.col("y"), w[1], w[3]).alias("uy"))


def cell_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = orders(spark, sf_dir)
    w = layouts.extent(points)
    gx, gy = (curves.cell(curves.unit(F.col(c), w[i], w[i + 2]), 5) for i, c in enumerate("xy"))
    return points.groupBy(gx.alias("gx"), gy.alias("gy")).agg(F.count("*").alias("n"))


def index_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all buckets of sixteen indices, those without points too."""
    counts = _indexed("hilbert")(spark, sf_dir).groupBy(F.shiftright("sfc", 4).alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(4**DEPTH // 16).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def _cut(spark: SparkSession, sf_dir: str) -> layouts.RangePartitions:
    return layouts.m1(orders(spark, sf_dir), depth=4, parts=16)


def population_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(_cut(spark, sf_dir).parts)], "part_id int, start long, end long")


def assign_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).assign(orders(spark, sf_dir)).select("id", "part_id")


def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_partitions(spark, sf_dir).groupBy("part_id").agg(F.count("*").alias("n"))


def _tree(spark: SparkSession, sf_dir: str, min_leaf: int) -> trees.Node:
    points = orders(spark, sf_dir)
    return trees.build(layouts._sampled(points, layouts.SAMPLE), layouts.extent(points), min_leaf)


def median_tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of three levels: their population in the sample of 4096 and their boxes."""
    rows = [(n.leaf, n.pnum, *map(float, n.box)) for n in _tree(spark, sf_dir, 64).leaves()]
    return spark.createDataFrame(rows, "leaf int, pnum long, min_x double, min_y double, max_x double, max_y double")


def tree_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of the tree over the sample, and the leaf of every point by its medians."""
    return orders(spark, sf_dir).select("id", trees.route(_tree(spark, sf_dir, 256), F.col("x"), F.col("y")).alias("leaf"))


def leaf_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_route(spark, sf_dir).groupBy("leaf").agg(F.count("*").alias("n"))


def tree_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the tree of m2, as the opened table has them: those of a tree that is built anew."""
    opened = layouts.PointTable.open(spark, table(spark, sf_dir, "m2").path).layout
    return spark.createDataFrame(trees.to_rows(opened.trees[0]), trees.NODE_SCHEMA).select("node", "parent", "depth", "leaf", "pnum")


def point_in_box_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of m3's trees a point of the written table belongs to."""
    return table(spark, sf_dir, "m3").df.select("id", "tree")


def box_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = [(i, *b) for i, b in enumerate(BOXES)]
    names = ["min_x", "min_y", "max_x", "max_y"]
    a, b = (spark.createDataFrame(boxes, f"{p} int, " + ", ".join(f"{p}_{n} double" for n in names)) for p in "ab")
    mine, other = [F.col(f"a_{n}") for n in names], [F.col(f"b_{n}") for n in names]
    meet, common = box_overlap(mine, other)
    circle = circle_meets_box(F.lit(CIRCLE[0]), F.lit(CIRCLE[1]), F.lit(CIRCLE[2]), mine)
    return a.join(b, (F.col("a") <= F.col("b")) & meet).select("a", "b", *[c.alias(n) for c, n in zip(common, names, strict=True)], box_in_box(mine, other).alias("inside"), circle.alias("in_circle"))


def cluster_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.boxes(embedded(spark, sf_dir))


def dbscan_core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = embedded(spark, sf_dir).select("id", (F.col("x") * 8.0).alias("x"), (F.col("y") * 8.0).alias("y"))
    return cluster.core_points(cluster.neighbours(points, EPS), MIN_SAMPLES)


def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = embedded(spark, sf_dir).select("id", (F.col("x") * 8.0).alias("x"), (F.col("y") * 8.0).alias("y"))
    return cluster.dbscan(points, EPS, MIN_SAMPLES)


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.kmeans_step(embedded(spark, sf_dir), CENTRES)
    return found.select("k", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.silhouette(embedded(spark, sf_dir)).select(F.round("score", 6).alias("score"))


def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.davies_bouldin(embedded(spark, sf_dir)).select(F.round("score", 6).alias("score"))


def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.hashed_sample(orders(spark, sf_dir), 1000).select("id")


def nested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.nested_samples(orders(spark, sf_dir), 4, 1000)


def query_cell_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = orders(spark, sf_dir)
    return generate.cell_cdf(points, layouts.extent(points), 32)


def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x, y = mercator(F.pmod("c_custkey", F.lit(360)) - F.lit(180.0), F.pmod("c_custkey", F.lit(170)) - F.lit(85.0))
    return rows.select(F.col("c_custkey").alias("id"), F.round(x, 4).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


def export_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return export_lines(rows)


def semi_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounding-box ids first, then the points by a semi-join, edges included."""
    points = orders(spark, sf_dir)
    x, y, r = CIRCLE
    ids = points.where(F.col("x").between(x - r, x + r) & F.col("y").between(y - r, y + r)).select("id")
    return points.join(ids, "id", "left_semi").where(squared_distance(F.col("x"), F.col("y"), x, y) <= r * r).select("id")


def limited_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a limit of seven leaves."""
    return table(spark, sf_dir, "naive").range_query(*CIRCLE, limit=7).agg(F.count("*").alias("n"))


def union_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two circles as one set, joined back to the table by id."""
    t = table(spark, sf_dir, "hilbert")
    x, y, r = CIRCLE
    ids = t.range_query(x, y, r).select("id").unionByName(t.range_query(x, y + r, r).select("id")).dropDuplicates(["id"])
    return orders(spark, sf_dir).join(ids, "id").select("id", "x", "y")


def sweep_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found, what is checked for it and by how many ranges, at some tolerances; found is the same at all."""
    t = table(spark, sf_dir, "hilbert")
    out = None
    for tolerance in TOLERANCES:
        layout = replace(t.layout, tolerance=tolerance, max_ranges=None)
        row = layouts.PointTable(t.df, layout).hit_rate(*CIRCLE)
        row = row.select(F.lit(tolerance).alias("tolerance"), F.lit(len(layout.ranges(*CIRCLE))).alias("ranges"), "found", "checked")
        out = row if out is None else out.unionByName(row)
    return out


METHODS = {"naive_range": "naive", "rstar_range": "rstar", "sfc_range_hilbert": "hilbert", "sfc_range_zorder": "zorder", "m1_range_span": "m1_span", "m1_range_multi": "m1_multi", "m1_range_whole": "m1_whole", "m1_range_envelope": "m1_envelope", "m2_range": "m2", "m3_range": "m3"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _range(method) for name, method in METHODS.items()},
    **{"hit_" + name: _hit(method) for name, method in METHODS.items()},
    "hilbert_index": _indexed("hilbert"), "zorder_index": _indexed("zorder"), "hilbert_unindex": _unindexed("hilbert"), "zorder_unindex": _unindexed("zorder"),
    **{f.__name__: f for f in (
        batch_range, batch_layout_range, reopened_range, compacted_range, storage, cluster_queries, standardised_points, cluster_labels, m3_own_boxes_range, overlap_join, tree_catalog,
        batch_hit_rate, curve_discontinuities, cell_enumeration_ranges, quadrant_ranges, collect_ranges, interval_overlap, extent, row_count, normalise_points, cell_histogram, index_histogram,
        population_partitions, assign_partitions, partition_sizes, median_tree_leaves, tree_route, leaf_sizes, point_in_box_assign, box_intersections, cluster_boxes, dbscan_core_points, dbscan_labels,
        kmeans_step, silhouette, davies_bouldin, deterministic_sample, nested_samples, query_cell_cdf, web_mercator, export_format, semi_join_ids, limited_range, union_of_candidates, sweep_tolerance,
    )},
}

# the oracles: plain predicates, no ranges of ours
_P = "p as (select o_orderkey id, o_custkey::double x, o_totalprice / 100.0::double y from orders)"
_W = "w as (select min(x) x0, min(y) y0, max(x) x1, max(y) y1 from p)"
_E = "e as (select vec_id id, embedding[1]::double x, embedding[2]::double y, label from embeddings)"


def _d2(x: float, y: float) -> str:
    return f"((x - {x}::double) * (x - {x}::double) + (y - {y}::double) * (y - {y}::double))"


_IN = f"{_d2(*CIRCLE[:2])} < {CIRCLE[2] * CIRCLE[2]}::double"


def _cell(c: str, n: int) -> str:
    i = "0" if c == "" else c
    return f"greatest(0, least(floor(({i} - {i}0) / ({i}1 - {i}0) * {n}.0::double), {n - 1}))::bigint"


def _flat(rows: list[list[int]]) -> str:
    return "[" + ",".join(str(v) for row in rows for v in row) + "]::bigint[]"


def _encode(depth: int, curve: str, gx: str = "gx", gy: str = "gy") -> str:
    pos, nxt = _flat(curves.position(curve)), _flat(curves.NEXT[curve])
    k = f"(((a & 3) * 4 + (({gx} >> b) & 1) * 2 + 1 - (({gy} >> b) & 1)) + 1)"
    levels = "[0," + ",".join(str(b) for b in range(depth - 1, -1, -1)) + "]::bigint[]"
    return f"(list_reduce({levels}, lambda a, b: ((a >> 2) * 4 + ({pos})[{k}]) * 4 + ({nxt})[{k}]) >> 2)"


def _index_sql(curve: str, depth: int) -> str:
    n = 2**depth
    return f"g as (select id, {_cell('x', n)} gx, {_cell('y', n)} gy from p, w), s as (select id, {_encode(depth, curve)} sfc from g)"


def _grid_sql(curve: str) -> str:
    n = 2**DEPTH
    return f"c as (select gx::bigint gx, gy::bigint gy from range({n}) a(gx), range({n}) b(gy)), s as (select {_encode(DEPTH, curve)} sfc, gx, gy from c)"


def _islands(source: str, tolerance: int) -> str:
    return f"select min(sfc) as start, max(sfc) as end from (select sfc, sum(n) over (order by sfc) g from (select sfc, case when sfc > lag(sfc) over (order by sfc) + {tolerance + 1} then 1 else 0 end n from ({source}))) group by g"


_BATCH_Q = "q(qid, qx, qy, rad) as (values " + ", ".join(f"({i}, {x}::double, {y}::double, {r}::double)" for i, x, y, r in BATCH) + ")"
_BOX = ", ".join(f"({i}, {b[0]}::double, {b[1]}::double, {b[2]}::double, {b[3]}::double)" for i, b in enumerate(BOXES))
_U = "(select sfc from s where gx between 6 and 31 and gy between 25 and 51)"
_TREE_CASE = "case " + " ".join(f"when x between {b[0]} and {b[2]} and y between {b[1]} and {b[3]} then {i + 1}" for i, b in enumerate(BOXES)) + " else 0 end"
_CUT = f"""with recursive {_P}, {_W}, {_index_sql("hilbert", 4)},
h as (select i::bigint i, (select count(*) from s where sfc = i) n from range(256) r(i)),
quota as (select cast(floor(sum(n) // 16 * 1.1::double) as bigint) q from h),
r(i, cur, part) as (select 0::bigint, n::bigint, 0 from h where i = 0
 union all select h.i, case when cur > 0 and cur + n > q and part < 15 then n else cur + n end, case when cur > 0 and cur + n > q and part < 15 then part + 1 else part end from r join h on h.i = r.i + 1, quota)"""

def _tree_sql(levels: int) -> str:
    """Of the sample, level by level: node, the box so far and the medians of each node."""
    out = [_P, _W, "m0 as (select p.*, 0 node, x0 lx, y0 ly, x1 hx, y1 hy from p, w order by md5(id::varchar), id limit 4096)"]
    for n in range(1, levels + 1):
        out.append(f"l{n} as (select *, (row_number() over (partition by node order by x, id) > count(*) over (partition by node) // 2)::int r from m{n - 1})")
        out.append(f"v{n} as (select *, max(x) filter (where r = 0) over (partition by node) xm, (row_number() over (partition by node, r order by y, id) <= count(*) over (partition by node, r) // 2)::int b from l{n})")
        out.append(f"u{n} as (select *, max(y) filter (where b = 1) over (partition by node, r) ym from v{n})")
        out.append(f"d{n} as (select node, any_value(xm) xm, max(ym) filter (where r = 0) lm, max(ym) filter (where r = 1) rm from u{n} group by 1)")
        out.append(f"m{n} as (select id, x, y, node * 4 + r * 2 + b node, case when r = 1 then xm else lx end lx, case when b = 0 then ym else ly end ly, case when r = 0 then xm else hx end hx, case when b = 1 then ym else hy end hy from u{n})")
    return "with " + ", ".join(out)


def _route_sql() -> str:
    out = ["t0 as (select id, x, y, 0 node from p)"]
    for n in (1, 2):
        out.append(f"t{n} as (select id, x, y, t.node * 4 + case when x <= xm then (y <= lm)::int else 2 + (y <= rm)::int end node from t{n - 1} t join d{n} d on t.node = d.node)")
    return _tree_sql(2) + ", " + ", ".join(out)


def _met(depth: int) -> str:
    """The cells of a grid that the circle's box meets, and each point's."""
    n, (x, y, r) = 2**depth, CIRCLE
    at = lambda v, c: f"greatest(0, least(floor((greatest(least({v}::double, {c}1), {c}0) - {c}0) / ({c}1 - {c}0) * {n}.0::double), {n - 1}))::bigint"
    return f"box as (select {at(x - r, 'x')} ax, {at(x + r, 'x')} zx, {at(y - r, 'y')} ay, {at(y + r, 'y')} zy from w), g as (select p.*, {_cell('x', n)} gx, {_cell('y', n)} gy from p, w)"


_FOUND = f"count(*) filter (where {_IN}) found, count(*) checked, (count(*) filter (where {_IN}))::double / count(*)::double hit"
_RANGES = f"cells as (select a.gx, b.gy from (select unnest(range(ax, zx + 1)) gx from box) a, (select unnest(range(ay, zy + 1)) gy from box) b), i as (select {_encode(8, 'hilbert')} sfc from cells), pts as (select *, {_encode(8, 'hilbert')} sfc from g)"
_STD = "z as (select * from p order by md5(id::varchar), id limit 2048), sd as (select avg(x) ax, avg(y) ay, stddev_pop(x) dx, stddev_pop(y) dy from z), st as (select id, (x - ax) / dx x, (y - ay) / dy y from z, sd)"
_N = f"n as (select a.id a, b.id b from (select id, x * 8.0::double x, y * 8.0::double y from e) a, (select id, x * 8.0::double x, y * 8.0::double y from e) b where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS}::double), k as (select a id from n group by a having count(*) >= {MIN_SAMPLES})"

ORACLES: dict[str, str] = {
    **{name: f"with {_P} select id, x, y from p where {_IN}" for name in METHODS},
    "batch_range": f"with {_P}, {_BATCH_Q} select qid, id, x, y from p, q where (x - qx) * (x - qx) + (y - qy) * (y - qy) < rad * rad",
    "batch_layout_range": f"with {_P}, {_BATCH_Q} select qid::bigint qid, id, x, y from p, q where (x - qx) * (x - qx) + (y - qy) * (y - qy) < rad * rad",
    "reopened_range": f"with {_P} select unnest(['rstar', 'm1_multi', 'm3']) layout, id, x, y from p where {_IN}",
    "compacted_range": f"with {_P} select id, x, y from p where {_IN}",
    "m3_own_boxes_range": f"with {_P} select id, x, y from p where {_IN}",
    "hit_naive_range": f"with {_P} select {_FOUND} from p",
    "hit_rstar_range": f"with {_P} select {_FOUND} from p where x between {CIRCLE[0] - CIRCLE[2]}::double and {CIRCLE[0] + CIRCLE[2]}::double and y between {CIRCLE[1] - CIRCLE[2]}::double and {CIRCLE[1] + CIRCLE[2]}::double",
    **{f"hit_{k}": f"with {_P}, {_W}, {_met(d)} select {_FOUND} from g, box where gx between ax and zx and gy between ay and zy" for k, d in (("sfc_range_hilbert", 8), ("sfc_range_zorder", 8), ("m1_range_multi", 6))},
    "cluster_queries": "select unnest([0, 1, 2])::int box, 10::bigint n, 10::bigint inside, true wide",
    "standardised_points": f"with {_P}, {_STD} select id, round(x, 6) x, round(y, 6) y from st",
    "cluster_labels": f"with recursive {_P}, {_STD}, n as (select a.id a, b.id b from st a, st b where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {0.18 * 0.18}::double), k as (select a id from n group by a having count(*) >= 24), c as (select a, b from n where a in (select id from k) and b in (select id from k)), r(id, root) as (select id, id from k union select c.b, r.root from r join c on c.a = r.id), l as (select id, min(root) label from r group by id), t as (select a id, min(label) near from n join l on l.id = n.b group by a) select st.id, coalesce(l.label, t.near, -1) label from st left join l on l.id = st.id left join t on t.id = st.id",
    "overlap_join": "with l as (select o_orderkey l, o_orderkey * 37 % 4096 a, least(4095, o_orderkey * 37 % 4096 + o_custkey % 700) z from orders), r as (select i::bigint r, i * 256 a, i * 256 + 255 z from range(16) t(i)) select l, r, greatest(l.a, r.a)::bigint as first, least(l.z, r.z)::bigint as last from l join r on l.a <= r.z and r.a <= l.z",
    "tree_catalog": f"{_tree_sql(2)}, a as (select node path, 2 depth, count(*) pnum from m2 group by 1 union all select node, 1, count(*) from m1 group by 1 union all select 0, 0, count(*) from m0), b as (select *, path * 4 ** (2 - depth) first from a), c as (select *, (row_number() over (order by first, depth) - 1)::int node from b) select c.node, coalesce(u.node, -1)::int parent, c.depth::int depth, case when c.depth = 2 then c.path else -1 end::int leaf, c.pnum from c left join c u on u.depth = c.depth - 1 and u.path = c.path // 4",
    "batch_hit_rate": f"with {_P}, {_BATCH_Q}, c as (select qid, ((x - qx) * (x - qx) + (y - qy) * (y - qy) < rad * rad)::bigint ok from p, q where x between qx - rad and qx + rad and y between qy - rad and qy + rad) select qid, sum(ok)::bigint found, count(*) checked, sum(ok)::double / count(*)::double hit from c group by qid",
    "hilbert_index": f"with {_P}, {_W}, {_index_sql('hilbert', DEPTH)} select id, sfc from s",
    "zorder_index": f"with {_P}, {_W}, {_index_sql('zorder', DEPTH)} select id, sfc from s",
    **{f"{c}_unindex": f"with {_grid_sql(c)} select sfc, gx / 64.0::double min_x, gy / 64.0::double min_y, (gx + 1) / 64.0::double max_x, (gy + 1) / 64.0::double max_y from s" for c in ("hilbert", "zorder")},
    "curve_discontinuities": " union all ".join(f"select * from (with {_grid_sql(c)}, t as (select greatest(abs(gx - lag(gx) over (order by sfc)), abs(gy - lag(gy) over (order by sfc))) d from s) select '{c}' curve, count(*) filter (where d > 1) n from t)" for c in ("hilbert", "zorder")),
    "cell_enumeration_ranges": f"with {_grid_sql('hilbert')} {_islands(_U, 2 ** (DEPTH - 1))}",
    "quadrant_ranges": f"with {_grid_sql('hilbert')} {_islands('(select sfc from s where gx between 6 and 32 and gy between 25 and 51)', 0)}",
    "collect_ranges": f"with {_P}, {_W}, {_index_sql('hilbert', DEPTH)} {_islands('select distinct sfc from s', 1)}",
    "interval_overlap": f"with {_grid_sql('hilbert')} select sfc // 256 part, min(sfc) as first, max(sfc) as last from s where gx between 6 and 32 and gy between 25 and 51 group by 1",
    "extent": f"with {_P} select min(x) min_x, min(y) min_y, max(x) max_x, max(y) max_y from p",
    "row_count": "select count(*) n, count(distinct l_quantity) n_y from lineitem",
    "normalise_points": f"with {_P}, {_W} select id, (x - x0) / (x1 - x0) ux, (y - y0) / (y1 - y0) uy from p, w",
    "cell_histogram": f"with {_P}, {_W} select {_cell('x', 32)} gx, {_cell('y', 32)} gy, count(*) n from p, w group by 1, 2",
    "index_histogram": f"with {_P}, {_W}, {_index_sql('hilbert', DEPTH)} select i::bigint bucket, count(sfc) n from range(256) r(i) left join s on sfc >> 4 = i group by 1",
    "population_partitions": f"{_CUT} select part part_id, min(i) as start, case when part = max(part) over () then 255 else max(i) end::bigint as end from r group by part",
    "assign_partitions": f"{_CUT} select id, part part_id from s join r on sfc = i",
    "partition_sizes": f"{_CUT} select part part_id, count(*) n from s join r on sfc = i group by 1",
    "median_tree_leaves": f"{_tree_sql(3)} select node::int leaf, count(*) pnum, any_value(lx) min_x, any_value(ly) min_y, any_value(hx) max_x, any_value(hy) max_y from m3 group by 1",
    "tree_route": f"{_route_sql()} select id, node::int leaf from t2",
    "leaf_sizes": f"{_route_sql()} select node::int leaf, count(*) n from t2 group by 1",
    "point_in_box_assign": f"with {_P} select id, {_TREE_CASE} tree from p",
    "box_intersections": f"with b(i, x0, y0, x1, y1) as (values {_BOX}) select a.i a, b.i b, greatest(a.x0, b.x0) min_x, greatest(a.y0, b.y0) min_y, least(a.x1, b.x1) max_x, least(a.y1, b.y1) max_y, a.x0 >= b.x0 and a.y0 >= b.y0 and a.x1 <= b.x1 and a.y1 <= b.y1 inside, pow(greatest(a.x0, least({CIRCLE[0]}, a.x1)) - {CIRCLE[0]}, 2) + pow(greatest(a.y0, least({CIRCLE[1]}, a.y1)) - {CIRCLE[1]}, 2) < {CIRCLE[2] ** 2} in_circle from b a join b b on a.i <= b.i and greatest(a.x0, b.x0) <= least(a.x1, b.x1) and greatest(a.y0, b.y0) <= least(a.y1, b.y1)",
    "cluster_boxes": f"with {_E} select label, count(*) n, min(x) min_x, min(y) min_y, max(x) max_x, max(y) max_y from e where label <> -1 group by label",
    "dbscan_core_points": f"with {_E}, {_N} select id from k",
    "dbscan_labels": f"with recursive {_E}, {_N}, c as (select a, b from n where a in (select id from k) and b in (select id from k)), r(id, root) as (select id, id from k union select c.b, r.root from r join c on c.a = r.id), l as (select id, min(root) label from r group by id), t as (select a id, min(label) near from n join l on l.id = n.b group by a) select e.id, coalesce(l.label, t.near, -1) label from e left join l on l.id = e.id left join t on t.id = e.id",
    "kmeans_step": f"with {_E}, c(k, cx, cy) as (values {', '.join(f'({k}, {x!r}::double, {y!r}::double)' for k, x, y in CENTRES)}), d as (select e.*, k, row_number() over (partition by id order by (x - cx) * (x - cx) + (y - cy) * (y - cy), k) n from e, c) select k, count(*) n, round(avg(x), 6) x, round(avg(y), 6) y from d where n = 1 group by k",
    "silhouette": f"with {_E}, d as (select a.id i, a.label il, b.label jl, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) d from e a join e b on a.id <> b.id group by 1, 2, 3), s as (select i, min(d) filter (il = jl) a, min(d) filter (il <> jl) b from d group by i) select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) score from s",
    "davies_bouldin": f"with {_E}, c as (select label, avg(x) cx, avg(y) cy from e group by 1), s as (select c.label, cx, cy, sqrt(avg((x - cx) * (x - cx) + (y - cy) * (y - cy))) s from e join c on e.label = c.label group by 1, 2, 3), r as (select a.label, max((a.s + b.s) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) r from s a join s b on a.label <> b.label group by 1) select round(avg(r), 6) score from r",
    "deterministic_sample": f"with {_P} select id from p order by md5(id::varchar), id limit 1000",
    "nested_samples": f"with {_P}, m as (select id, row_number() over (order by md5(id::varchar), id) - 1 n from p) select id, n // 200 part from m where n < 800",
    "query_cell_cdf": f"with {_P}, {_W}, c as (select {_cell('x', 32)} gx, {_cell('y', 32)} gy, count(*) n from p, w group by 1, 2) select gx, gy, n, sum(n) over (order by gy, gx)::double / sum(n) over ()::double upto from c",
    "web_mercator": "select c_custkey id, round(radians(c_custkey % 360 - 180.0::double) * 6378137.0::double, 4) x, round(ln(tan(pi() / 4 + radians(c_custkey % 170 - 85.0::double) / 2)) * 6378137.0::double, 4) + 0.0::double y from customer",
    "export_format": "select printf('%.6f,%.6f', p_partkey::double, p_retailprice) as value from part",
    "semi_join_ids": f"with {_P} select id from p where {_d2(*CIRCLE[:2])} <= {CIRCLE[2] * CIRCLE[2]}::double",
    "limited_range": f"with {_P} select least(7, count(*)) n from p where {_IN}",
    "union_of_candidates": f"with {_P} select id, x, y from p where {_IN} or {_d2(CIRCLE[0], CIRCLE[1] + CIRCLE[2])} < {CIRCLE[2] * CIRCLE[2]}::double",
    "sweep_tolerance": f"with {_P}, {_W}, {_met(8)}, {_RANGES}, t(tolerance) as (values " + ", ".join(f"({t}::int)" for t in TOLERANCES) + f"), n as (select tolerance, sfc, case when sfc <= lag(sfc) over (partition by tolerance order by sfc) + tolerance then 0 else 1 end new from i, t), k as (select tolerance, sfc, sum(new) over (partition by tolerance order by sfc) g from n), q as (select tolerance, g, min(sfc) lo, max(sfc) hi from k group by 1, 2), c as (select tolerance, count(*) filter (where {_IN}) found, count(*) checked from q join pts on sfc between lo and hi group by 1), r as (select tolerance, count(*)::int ranges from q group by 1) select c.tolerance, ranges, found, checked from c join r on c.tolerance = r.tolerance",
}
