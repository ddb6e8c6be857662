import random

import pytest
from pyspark.sql import functions as F

from circlet.operators import cluster, generate, layouts
from circlet.plans import tree as trees

BOXES = [(10.0, 10.0, 40.0, 60.0), (30.0, 30.0, 70.0, 90.0)]


def _points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id long, x double, y double")


def _methods(points):
    yield "naive", layouts.naive(points)
    yield "mbr", layouts.mbr(points)
    yield "hilbert", layouts.sfc(points, 5)
    yield "wide tolerance", layouts.sfc(points, 5, "zorder", tolerance=256)
    for form in ("multi", "span", "whole", "envelope"):
        yield form, layouts.m1(points, depth=4, parts=5, form=form)
    yield "m2", layouts.m2(points, depth=3, min_leaf=20)
    yield "m3", layouts.m3(points, BOXES, 20, 3, 10, 2)


@pytest.mark.parametrize("kind", ["random", "corners", "same", "ties"])
def test_all_methods_agree(spark, kind):
    rng = random.Random(3)
    rows = {"random": [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(300)], "corners": [(0, 0), (0, 100), (100, 0), (100, 100), (50, 50)], "same": [(7, 7)] * 50, "ties": [(rng.randrange(4) * 30, rng.randrange(4) * 30) for _ in range(200)]}[kind]
    points = _points(spark, rows)
    circles = [(50, 50, 30), (0, 0, 1), (100, 100, 0.5), (500, 500, 20), (50, 50, 1000), (50, 50, 0), (7, 7, 3)]
    want = {c: {i for i, (x, y) in enumerate(rows) if (x - c[0]) ** 2 + (y - c[1]) ** 2 < c[2] ** 2} for c in circles}
    for name, layout in _methods(points):
        placed = layout.assign(points).cache()
        table = layouts.PointTable(placed, layout)
        for c in circles:
            assert {r.id for r in table.range_query(*map(float, c)).collect()} == want[c], (name, c)
        placed.unpersist()


def test_edge_of_the_circle(spark):
    table = layouts.PointTable(_points(spark, [(3, 4), (3, 3)]), layouts.naive(_points(spark, [(3, 4), (3, 3)])))
    assert {r.id for r in table.range_query(0.0, 0.0, 5.0).collect()} == {1}
    assert {r.id for r in table.range_query(0.0, 0.0, 5.0, inclusive=True).collect()} == {0, 1}
    assert table.range_query(0.0, 0.0, 50.0, limit=1).count() == 1
    assert table.hit_rate(0.0, 0.0, 5.0).first()["hit"] == 0.5


def test_plans_prune_and_push_down(spark):
    points = generate.uniform(spark, 5000, (0, 0, 100, 100))
    table = layouts.PointTable.write(points, layouts.m1(points, depth=5, parts=8))
    found = table.range_query(20.0, 20.0, 5.0)
    text = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in text and "part_id" in text.split("PartitionFilters: [")[1][:300]
    assert "sfc" in text.split("PushedFilters: [")[1][:600]
    row = table.hit_rate(20.0, 20.0, 5.0).first()
    assert row["checked"] < 500 and row["found"] == found.count()


def test_nulls_and_empty(spark):
    points = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 1.0), (3, 2.0, None)], "id long, x double, y double")
    table = layouts.PointTable.write(points, layouts.sfc(points.where("x is not null and y is not null"), 3))
    assert {r.id for r in table.range_query(1.0, 1.0, 5.0).collect()} == {2}
    none = points.limit(0)
    for _, layout in _methods(none):
        assert layouts.PointTable(layout.assign(none), layout).range_query(0.0, 0.0, 5.0).count() == 0


def test_batch_equals_single(spark):
    points = generate.gaussian(spark, 500, (0, 0, 100, 100)).cache()
    queries = spark.createDataFrame([(0, 50.0, 50.0, 10.0), (1, 0.0, 0.0, 60.0), (2, 900.0, 0.0, 5.0)], "qid int, x double, y double, rad double")
    got = {(r.qid, r.id) for r in layouts.batch_range(points, queries, 7.0).collect()}
    rows = points.collect()
    assert got == {(q.qid, p.id) for q in queries.collect() for p in rows if (p.x - q.x) ** 2 + (p.y - q.y) ** 2 < q.rad**2}


def test_tree_is_saved_whole():
    rng = random.Random(1)
    root = trees.build([(i, rng.random(), rng.random()) for i in range(500)], (0, 0, 1, 1), 30)
    again = trees.from_rows(trees.to_rows(root))
    assert trees.dump(again) == trees.dump(root) and [n.pnum for n in again.leaves()] == [n.pnum for n in root.leaves()]
    assert sum(n.pnum for n in root.leaves()) == 500


def test_clusters(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 0.2), rng.gauss(0, 0.2)) for _ in range(60)] + [(rng.gauss(10, 0.2), rng.gauss(5, 0.2)) for _ in range(60)] + [(5.0, -40.0)]
    points = _points(spark, rows)
    labels = {r.id: r.label for r in cluster.dbscan(points, 0.5, 5).collect()}
    assert labels[120] == -1 and len({labels[i] for i in range(60)} - {-1}) == 1 and labels[0] != labels[60]
    found = cluster.boxes(points.join(cluster.dbscan(points, 0.5, 5), "id"))
    assert found.count() == 2
    labelled = points.where("id < 120").withColumn("label", (F.col("id") >= 60).cast("int"))
    assert cluster.silhouette(labelled).first()[0] > 0.9 and cluster.davies_bouldin(labelled).first()[0] < 0.2
    centres = cluster.kmeans(points.where("id < 120").withColumn("id", F.col("id") % 60 * 2 + F.col("id") / 60), 2)
    assert len(centres) == 2


def test_overlaps_are_fixed():
    boxes = cluster.fix_overlaps([(0, 0, 1000, 1000), (900, 200, 1300, 500)])
    assert not cluster.overlapping(boxes) and len(boxes) == 2


def test_generators(spark):
    assert generate.uniform(spark, 100).collect() == generate.uniform(spark, 100).collect()
    row = generate.gaussian(spark, 300, (0, 0, 1, 1)).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert 0 < row[0] < row[1] < 1 and 0 < row[2] < row[3] < 1
    assert generate.islands(spark, 4, 100, 1.0).count() > 600
    points = generate.uniform(spark, 1000, (0, 0, 100, 100))
    queries = generate.density_queries(points, (0, 0, 100, 100), 20, 8)
    assert len(queries) == 20 and queries == generate.density_queries(points, (0, 0, 100, 100), 20, 8)
    assert len(generate.cluster_queries(BOXES, 10)) == 10
    parts = generate.nested_samples(points, 4, 500).groupBy("part").count().collect()
    assert sorted((r.part, r["count"]) for r in parts) == [(0, 100), (1, 100), (2, 100), (3, 100)]


def test_opened_tables_answer_alike(spark, tmp_path):
    """A table is whole in its folder; without its catalog, which comes last, it can't be opened."""
    rng = random.Random(5)
    points = _points(spark, [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(400)])
    want = {r.id for r in layouts.PointTable(points, layouts.naive(points)).range_query(45.0, 50.0, 25.0).collect()}
    for name, layout in _methods(points):
        path = str(tmp_path / name)
        layouts.PointTable.write(points, layout, path=path)
        opened = layouts.PointTable.open(spark, path)
        assert layouts.describe(opened.layout) == layouts.describe(layout)
        assert {r.id for r in opened.range_query(45.0, 50.0, 25.0).collect()} == want, name
        assert opened.storage()["bytes"] > 0 and opened.storage()["partitions"] >= 1
        again = opened.compact(str(tmp_path / (name + " again")))
        opened.drop()
        assert not (tmp_path / name).exists() and {r.id for r in again.range_query(45.0, 50.0, 25.0).collect()} == want
        assert sorted(again.df.columns) == sorted(layout.assign(points).columns)
    (tmp_path / "broken" / "data").mkdir(parents=True)
    with pytest.raises(Exception, match="broken"):
        layouts.PointTable.open(spark, str(tmp_path / "broken"))


def test_batch_over_a_layout(spark):
    points = generate.gaussian(spark, 600, (0, 0, 100, 100)).cache()
    queries = [(0, 50.0, 50.0, 10.0), (1, 0.0, 0.0, 60.0), (2, 900.0, 0.0, 5.0)]
    rows = points.collect()
    for layout in (layouts.sfc(points, 7), layouts.m1(points, depth=5, parts=4), layouts.sfc(points, 3, "zorder")):
        got = [(r.qid, r.id) for r in layouts.PointTable.write(points, layout).batch(queries).collect()]
        assert sorted(got) == sorted((q, p.id) for q, x, y, r in queries for p in rows if (p.x - x) ** 2 + (p.y - y) ** 2 < r * r)


def test_dbscan_plainly(spark):
    """Dense cells, chains, border points and noise against all pairs; driver and Spark join the cells alike."""
    rng = random.Random(6)
    rows = [(rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for _ in range(250)] + [(3 + 0.35 * i, 0.1 * rng.random()) for i in range(60)] + [(rng.uniform(-9, 30), rng.uniform(-9, 9)) for _ in range(150)] + [(1.0, 1.0)] * 30
    points = _points(spark, rows)
    for eps, least in ((0.5, 4), (0.4, 12), (2.0, 3)):
        near = [{j for j, q in enumerate(rows) if (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) <= eps * eps} for p in rows]
        core = {i for i, n in enumerate(near) if len(n) >= least}
        label = {}
        for i in sorted(core):
            todo = [i] if i not in label else []
            while todo:
                k = todo.pop()
                if label.setdefault(k, i) == i:
                    todo += [j for j in near[k] & core if j not in label]
        want = {i: label[i] if i in core else min((label[j] for j in n & core), default=-1) for i, n in enumerate(near)}
        assert {r.id: r.label for r in cluster.dbscan(points, eps, least).collect()} == want
        links = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (20, 21), *[(100 + i, 101 + i) for i in range(9)]], "u long, v long")
        small = {tuple(r) for r in cluster._joined(links).collect()}
        limit, cluster.DRIVER_LINKS = cluster.DRIVER_LINKS, 0
        try:
            assert {tuple(r) for r in cluster._joined(links).collect()} == small == {(x, min(x, 1) if x < 10 else 20 if x < 30 else 100) for x in (1, 2, 3, 9, 20, 21, *range(100, 110))}
        finally:
            cluster.DRIVER_LINKS = limit
    assert cluster.dbscan(points.limit(0)).count() == 0


def test_overlaps_of_many_boxes_are_fixed():
    rng = random.Random(7)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(1, 12)):
            x, y = rng.randrange(5000), rng.randrange(5000)
            found.append((x, y, x + rng.randrange(1, 3000), y + rng.randrange(1, 3000)))
        out = cluster.fix_overlaps(found)
        assert not cluster.overlapping(out)
        assert all(any(f[0] <= b[0] <= b[2] <= f[2] and f[1] <= b[1] <= b[3] <= f[3] for f in found) for b in out)
    assert cluster.overlapping([(0, 0, 1, 1), (1, 1, 2, 2)]) == [(1, 0)]
    assert cluster.union((0, 5, 1, 6), (-1, 7, 0, 8)) == (-1, 5, 1, 8)
    # cut in y, where less goes
    assert cluster.fix_overlaps([(0, 0, 1000, 1000), (100, 950, 600, 2000)])[1] == (100, 1100, 600, 2000)


def test_boxes_of_clusters(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 50), rng.gauss(0, 50)) for _ in range(300)] + [(rng.gauss(4000, 50), rng.gauss(3000, 50)) for _ in range(300)] + [(rng.uniform(-500, 5000), rng.uniform(-500, 4000)) for _ in range(30)]
    found = cluster.find_boxes(_points(spark, rows))
    assert len(found) == 2 and not cluster.overlapping(found)
    assert all(any(b[0] < x < b[2] and b[1] < y < b[3] for b in found) for x, y in ((0, 0), (4000, 3000)))
