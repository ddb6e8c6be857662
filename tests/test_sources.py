import json

from circlet.operators import generate, layouts
from circlet.plans import tuning
from circlet.sources import formats
from circlet.streaming import append_stream


def test_text_formats(spark, tmp_path):
    formats.write_groups(spark, [(1.4, 2.0, 3.0), (4, 5, 6.6)], str(tmp_path / "q"))
    assert formats.read_queries(spark, str(tmp_path / "q")) == [(1, 2, 3), (4, 5, 7)]
    points = spark.createDataFrame([(1.5, 2.25)], "x double, y double")
    formats.write_points(points, str(tmp_path / "p"))
    assert [tuple(r) for r in formats.read_points(spark, str(tmp_path / "p")).collect()] == [(1.5, 2.25)]
    (tmp_path / "empty").write_text("")
    assert formats.read_boxes(spark, str(tmp_path / "empty")) == []


def test_geojson(spark, tmp_path):
    shapes = [{"type": "Point", "coordinates": [10.0, 0.0]}, {"type": "LineString", "coordinates": [[0, 0], [2, 0]]}, None]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g} for g in shapes]}))
    rows = formats.read_geojson(spark, str(tmp_path / "g.json"), projected=True).collect()
    assert [(r.ogc_fid, r.x, r.y) for r in rows] == [(1, 10.0, 0.0), (2, 1.0, 0.0)]


def test_results_json():
    data = json.loads(formats.results_json([{"case": "c", "label": "l", "times": [1.0, 3.0], "hit": [0.5, 0.0]}]))[0]["data"]
    assert data["avg_time"] == 2.0 and abs(data["avg_hit"] - (0.5 * 1e-3) ** 0.5) < 1e-12


def test_stream_gets_the_same_layout(spark, tmp_path):
    points = generate.uniform(spark, 500, (0, 0, 100, 100))
    points.write.parquet(str(tmp_path / "in"))
    layout = layouts.m1(points, depth=4, parts=4)
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    append_stream(stream, layout, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    table = layouts.PointTable(spark.read.parquet(str(tmp_path / "out")), layout)
    plain = layouts.PointTable(points, layouts.naive(points))
    assert {r.id for r in table.range_query(40.0, 40.0, 20.0).collect()} == {r.id for r in plain.range_query(40.0, 40.0, 20.0).collect()}


def test_tuning(spark):
    points = generate.uniform(spark, 300, (0, 0, 100, 100)).cache()
    build = lambda depth, curve: layouts.PointTable(layouts.sfc(points, depth, curve).assign(points), layouts.sfc(points, depth, curve))
    best, figures = tuning.optimise(build, tuning.grid("sfc")[:2], [(50.0, 50.0, 10.0)])
    assert best["depth"] == 4 and len(figures["times"]) == 1
    swept = tuning.sweep(lambda d, c, t: layouts.sfc(points, d, c, t, None), [(50.0, 50.0, 20.0)], (4,), ("hilbert",), 4)
    assert len(swept) == 4 and swept[0][3] >= swept[-1][3]


def test_geojson_shapes_and_properties(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 2], [0, 2], [0, 0]]
    shapes = [("Polygon", [square, [[1, 1], [2, 1], [2, 2], [1, 1]]]), ("MultiPolygon", [[square], [[[9, 9], [9, 8], [8, 8], [9, 9]]]]), ("MultiPoint", [[1, 1], [3, 5]]), ("MultiLineString", [[[0, 0], [2, 2]], [[7, 7], [8, 8]]]), ("Polygon", [[[1, 1], [3, 3], [1, 1]]]), ("Point", []), ("Point", [7, 8, 9])]
    features = [{"type": "Feature", "id": f"f{i}", "properties": {"name": i, "of": {"deep": True}}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(shapes)]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, features)))
    want = {"f0": (2, 1), "f1": (2, 1), "f2": (2, 3), "f3": (1, 1), "f4": (2, 2), "f6": (7, 8)}
    for name, lines in (("g.json", False), ("g.jsonl", True)):
        rows = formats.read_geojson(spark, str(tmp_path / name), projected=True, lines=lines).collect()
        assert {r.id: (round(r.x, 9), round(r.y, 9)) for r in rows} == want
        assert json.loads(rows[1].properties) == {"name": 1, "of": {"deep": True}}
    assert formats.ingest(spark, str(tmp_path / "g.json"), str(tmp_path / "p"), projected=True).columns == ["id", "x", "y"]
    assert formats.read_points(spark, str(tmp_path / "p")).count() == 6


def test_wkb(spark):
    import struct

    point = lambda o, x, y: struct.pack(f"{o}BI2d", o == "<", 1, x, y) if o == "<" else struct.pack(">BI2d", 0, 1, x, y)
    line = struct.pack("<BII4d", 1, 2, 2, 5, 6, 7, 8)
    polygon = struct.pack("<BIII4d", 1, 3, 1, 2, 3, 4, 5, 6)
    with_srid = struct.pack("<BII2d", 1, 0x20000001, 3857, 1, 2)
    with_z = struct.pack("<BI3d", 1, 1001, 1, 2, 3)
    many = struct.pack("<BII", 1, 4, 1) + point("<", 8, 9)
    empty = struct.pack("<BII", 1, 2, 0)
    nan = point("<", float("nan"), float("nan"))
    rows = [point("<", 1, 2), point(">", 3, 4), line, polygon, with_srid, with_z, many, empty, nan, b"", b"\x07", line[:12], None]
    got = spark.createDataFrame([(i, bytearray(r) if r is not None else None) for i, r in enumerate(rows)], "i int, g binary").select("i", formats.wkb_point("g").alias("p")).orderBy("i").collect()
    assert [tuple(r.p) if r.p else None for r in got] == [(1, 2), (3, 4), (5, 6), (3, 4), (1, 2), (1, 2), (8, 9)] + [None] * 6


def test_results_are_read_back():
    cases = [{"case": "c", "label": "l", "times": [1.0, 3.0], "hit": [0.5, 0.0], "params": {"depth": "4"}}]
    assert formats.read_results(formats.results_json(cases)) == cases


def test_sweep_with_times(spark):
    points = generate.uniform(spark, 300, (0, 0, 100, 100)).cache()
    table = lambda d, c: layouts.PointTable(layouts.sfc(points, d, c).assign(points), layouts.sfc(points, d, c))
    rows = tuning.measured_sweep(table, [(50.0, 50.0, 20.0), (900.0, 900.0, 1.0)], (4,), ("hilbert",), 4)
    assert len(rows) == 4 and rows[0][3] >= rows[-1][3] and rows[0][5] >= rows[-1][5] > 0 and all(r[4] > 0 for r in rows)


def test_lattices_and_curves(spark):
    from circlet.plans import ranges, tree

    world = (10.0, -5.0, 30.0, 15.0)
    assert ranges.world_box(ranges.unit_box((12.0, 0.0, 20.0, 5.0), world), world) == (12.0, 0.0, 20.0, 5.0)
    assert ranges.sides(world) == (20.0, 20.0) and ranges.lattice(3) == (0, 0, 63, 63)
    assert ranges.lattice_box((0.0, 0.5, 1.0, 1.0), 4) == (0, 128, 255, 255) and ranges.lattice_box((0.0, 0.0, 0.1, 1.0), 2) == (0, 0, 1, 15)
    assert [ranges.discontinuities(spark, d, "zorder") for d in (1, 2, 3)] == [0, 1, 7] and ranges.discontinuities(spark, 4, "hilbert") == 0
    node = tree.build([(i, float(i), float(i)) for i in range(8)], (0, 0, 7, 7), 4)
    assert tree.dump_all({0: node, 2: node}) == [*tree.dump(node), "2", *tree.dump(node)]


def test_datasets_and_tuning_on_a_sample(spark, tmp_path):
    made = generate.make_datasets(spark, 200, str(tmp_path / "made"))
    tables = {name: spark.read.parquet(path) for name, path in made.items()}
    assert {name: t.count() for name, t in tables.items()} == {"ran": 200, "gau": 200}
    build = lambda points, depth, curve: layouts.PointTable(layouts.sfc(points, depth, curve).assign(points), layouts.sfc(points, depth, curve))
    best, figures = tuning.tune_on_sample(tables["ran"], layouts.hashed_sample(tables["ran"], 50), build, [{"depth": 3, "curve": "zorder"}, {"depth": 4, "curve": "hilbert"}], [(0.0, 0.0, 4e4)])
    assert best["depth"] in (3, 4) and len(figures["times"]) == len(figures["hit"]) == 1
