"""Parameter search and sweeps over the access methods."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable
from dataclasses import replace

# fixed values: grids of parameters
GRIDS = {
    "sfc": {"depth": [4, 6, 8, 10], "curve": ["hilbert", "zorder"]},
    "m1": {"depth": [6, 8, 10], "parts": [16, 32, 64, 128, 255]},
    "m2": {"depth": [4, 6, 8], "min_leaf": [64, 256]},
    "m3": {"base_leaf": [32, 64, 128, 256], "cluster_leaf": [32, 64, 128, 256], "base_depth": [4, 6], "cluster_depth": [4, 6]},
}


def grid(name: str) -> list[dict]:
    keys = GRIDS[name]
    return [dict(zip(keys, v, strict=True)) for v in itertools.product(*keys.values())]


def measure(table, queries: list[tuple[float, float, float]], warm_up: int = 1) -> dict:
    """times and hit of each query; the first ones are run before, uncounted."""
    for q in queries[:warm_up]:
        table.hit_rate(*q).collect()
    times, hits = [], []
    for q in queries:
        began = time.perf_counter()
        row = table.hit_rate(*q).first()
        times.append(time.perf_counter() - began)
        hits.append(row["hit"] or 0.0)
    return {"times": times, "hit": hits}


def optimise(build: Callable[..., object], settings: list[dict], queries: list[tuple[float, float, float]]) -> tuple[dict, dict]:
    """The setting with the least mean time, and its figures."""
    tried = [(s, measure(build(**s), queries)) for s in settings]
    return min(tried, key=lambda x: sum(x[1]["times"]))


def tune_on_sample(points, sample, build: Callable[..., object], settings: list[dict], queries: list[tuple[float, float, float]]) -> tuple[dict, dict]:
    """The setting that is best on a sample of the points, and its figures on all of them.  build: a table of points and a setting."""
    best, _ = optimise(lambda **s: build(sample, **s), settings, queries)
    return best, measure(build(points, **best), queries)


def tolerances(depth: int, steps: int = 32) -> list[int]:
    return [max(1, i * 2**depth // 16) for i in range(steps)]


def sweep(layout_of: Callable[[int, str, int], object], queries: list[tuple[float, float, float]], depths=(4, 6, 8, 10), curves=("hilbert", "zorder"), steps: int = 32) -> list[tuple]:
    """curve, depth, tolerance and mean number of ranges over the queries that have any."""
    out = []
    for curve, depth in itertools.product(curves, depths):
        for tolerance in tolerances(depth, steps):
            sizes = [len(r) for r in (layout_of(depth, curve, tolerance).ranges(*q) for q in queries) if r]
            out.append((curve, depth, tolerance, sum(sizes) / len(sizes) if sizes else 0.0))
    return out


def measured_sweep(table_of: Callable[[int, str], object], queries: list[tuple[float, float, float]], depths=(4, 6, 8, 10), curves=("hilbert", "zorder"), steps: int = 32) -> list[tuple]:
    """curve, depth, tolerance and the means over the queries with a hit: number of ranges, seconds and hit rate.

    table_of: the written table of a depth and a curve; the tolerance only changes what a circle becomes.
    """
    out = []
    for curve, depth in itertools.product(curves, depths):
        table = table_of(depth, curve)
        for tolerance in tolerances(depth, steps):
            own = replace(table, layout=replace(table.layout, tolerance=tolerance, max_ranges=None))
            found = measure(own, queries)
            rows = [(len(own.layout.ranges(*q)), t, h) for q, t, h in zip(queries, found["times"], found["hit"], strict=True) if h > 0]
            out.append((curve, depth, tolerance, *(sum(x) / len(rows) for x in zip(*rows, strict=True))) if rows else (curve, depth, tolerance, 0.0, 0.0, 0.0))
    return out


def geometric_mean(hits: list[float], floor: float = 1e-3) -> float:
    return math.exp(sum(math.log(h if h > 0 else floor) for h in hits) / len(hits))


def summary(measured: dict) -> dict[str, float]:
    """Mean seconds and the geometric mean of the hit rates."""
    return {"avg_time": sum(measured["times"]) / len(measured["times"]), "avg_hit": geometric_mean(measured["hit"])}
