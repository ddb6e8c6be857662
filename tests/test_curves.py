import random

import pytest
from pyspark.sql import functions as F

from circlet.functions import curves
from circlet.plans import ranges


@pytest.mark.parametrize("curve", ["hilbert", "zorder"])
def test_round_trip(curve):
    for depth in range(1, 6):
        assert all(curves.encode_cell(*curves.decode_cell(i, depth, curve), depth, curve) == i for i in range(4**depth))


@pytest.mark.parametrize(("point", "hilbert", "zorder"), [((0.3, 0.6), [7, 121, 1937, 31003], [3, 56, 903, 14456]), ((0.5, 0.5), [8, 128, 2048, 32768], [6, 106, 1706, 27306]), ((0.999, 0.001), [15, 255, 4095, 65535], [15, 255, 4095, 65535]), ((0.1, 0.9), [5, 87, 1405, 22487], [0, 3, 60, 963])])
def test_known_indices(point, hilbert, zorder):
    assert [curves.encode_unit(*point, d) for d in (2, 4, 6, 8)] == hilbert
    assert [curves.encode_unit(*point, d, "zorder") for d in (2, 4, 6, 8)] == zorder


def test_edge_of_the_world_is_in_the_last_cell():
    assert curves.unit_cell(1.0, 4) == 15 and curves.unit_cell(-0.1, 4) == 0


@pytest.mark.parametrize("curve", ["hilbert", "zorder"])
def test_columns_equal_plain_python(spark, curve):
    cells = spark.range(256).select(F.col("id"), curves.decode(F.col("id"), 4, curve).alias("c"))
    rows = cells.select("id", "c.gx", "c.gy", curves.encode(F.col("c.gx"), F.col("c.gy"), 4, curve).alias("back")).collect()
    assert all(r.back == r.id and (r.gx, r.gy) == curves.decode_cell(r.id, 4, curve) for r in rows)


def test_known_ranges():
    box = (0.1, 0.4, 0.5, 0.8)
    assert ranges.decompose(box, 4) == [(40, 51), (61, 62), (66, 77), (81, 81), (94, 97), (110, 129), (142, 144), (213, 214)]
    assert ranges.enumerate_cells(box, 4) == [(40, 51), (61, 81), (94, 97), (110, 127)]


def test_ranges_hold_every_cell_of_the_box():
    rng = random.Random(5)
    for _ in range(100):
        x, y = sorted(rng.random() for _ in range(2)), sorted(rng.random() for _ in range(2))
        for most in (None, 3):
            got = ranges.decompose((x[0], y[0], x[1], y[1]), 5, max_ranges=most)
            for _ in range(20):
                i = curves.encode_unit(rng.uniform(*x), rng.uniform(*y), 5)
                assert any(lo <= i <= hi for lo, hi in got)
        assert len(got) <= 3


def test_greedy_partitions_cover_the_curve_and_are_never_empty():
    for histogram in ([1000] + [1] * 15, [0] * 16, [5] * 16, [0] * 15 + [9]):
        parts = ranges.greedy_partitions(histogram, 4, 2)
        assert parts[0][0] == 0 and parts[-1][1] == 15
        assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
        assert all(lo <= hi for lo, hi in parts)


def test_overlap_and_collect():
    assert ranges.overlap([(0, 9), (10, 19), (20, 29)], [(2, 4), (8, 11), (25, 40)]) == [(0, 2, 9), (1, 10, 11), (2, 25, 29)]
    assert ranges.collect([5, 1, 2, 3, 9], 0) == [(1, 3), (5, 5), (9, 9)]
    assert ranges.collect([5, 1, 2, 3, 9], 1) == [(1, 5), (9, 9)]
