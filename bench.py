"""Headline figures of the range queries: one JSON line.

Layouts are written first, outside the clock; each query runs once before it is
timed.  ``queries`` holds seconds; ``candidates`` what each method checked for
the rows that it found.  ``experiment`` has circles drawn where the points are
(the first BENCH_QUERIES of 200): mean seconds of a circle, the geometric mean
of the hit rates, bytes and files of the layout.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from circlet import queries as spatial
from circlet.operators import generate, layouts
from circlet.plans import tuning


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds, candidates = {}, {}
    for name, method in spatial.METHODS.items():
        table = spatial.table(spark, sf_dir, method)
        table.range_query(*spatial.CIRCLE).count()
        times = []
        for _ in range(3):
            began = time.perf_counter()
            table.range_query(*spatial.CIRCLE).count()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times), 4)
        row = table.hit_rate(*spatial.CIRCLE).first()
        candidates[name] = {"found": row["found"], "checked": row["checked"]}
    points = spatial.orders(spark, sf_dir)
    circles = generate.density_queries(points, layouts.extent(points), 200)
    experiment = {}
    for name, method in spatial.METHODS.items():
        table = spatial.table(spark, sf_dir, method)
        found = tuning.summary(tuning.measure(table, circles[: int(os.environ.get("BENCH_QUERIES", "8"))]))
        experiment[name] = {"mean_s": round(found["avg_time"], 4), "hit": round(found["avg_hit"], 4), **table.storage()}
    for name in ("batch_range", "batch_hit_rate", "hilbert_index", "collect_ranges", "population_partitions", "median_tree_leaves", "dbscan_labels", "silhouette"):
        spatial.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        spatial.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 4)
    for name in ("naive", "hilbert", "m1_multi"):
        table = spatial.table(spark, sf_dir, name)
        began = time.perf_counter()
        if name == "naive":
            rows = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(circles)], "qid int, x double, y double, rad double")
            layouts.batch_range(points, rows, 100.0).write.format("noop").mode("overwrite").save()
        else:
            table.batch([(i, *map(float, c)) for i, c in enumerate(circles)]).write.format("noop").mode("overwrite").save()
        seconds[f"batch_200_{name}"] = round(time.perf_counter() - began, 4)
    many = spark.createDataFrame([(i, float(i * 37 % 15000), 10 + i * 211 % 4900.0, 20.0 + i % 90) for i in range(2000)], "qid int, x double, y double, rad double")
    began = time.perf_counter()
    layouts.batch_range(points, many, 50.0).write.format("noop").mode("overwrite").save()
    seconds["batch_2000"] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "range_queries_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "candidates": candidates, "experiment": experiment, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
