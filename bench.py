"""Benchmark: runs headline queries and prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores.  Each query
runs once to warm up and then BENCH_RUNS times; the median counts.  With
``--matrix`` the experiments by strategy, schedule and number of stripes are
run over generated points instead, as a table; ``--sizes a,b`` sets the numbers of
points and ``--workers n`` the most stripes.
"""

from __future__ import annotations

import argparse
import json
import os
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import aggregate, join, order
from tessera.plans import fixtures
from tessera.sources import generate


def session(cpus: int) -> SparkSession:
    """A local session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.sql.session.timeZone": "UTC"}
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(make, runs: int) -> float:
    """Median seconds of building and running a query, after one run to warm up."""
    took = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    return round(median(took[1:]), 4)


def headline(spark: SparkSession, sf_dir: str) -> dict:
    """Queries over 10,000 grid cells; name to a function that makes the DataFrame."""
    grid = generate.grid(spark, 100, 100)
    points = {t: fixtures.points(spark, sf_dir, t) for t in ("orders", "events")}
    out = {}
    for table, p in points.items():
        for strategy in ("cells", "strip", "quadtree", "replicated", "sharded"):
            out[f"classify_{table}_{strategy}"] = lambda p=p, s=strategy: aggregate.summary(join.classify(p, grid, strategy=s))
    # As the published numbers have it: "total" with the index, "classify" without.
    index = join.cell_index(grid)
    index.gathered.count()
    for name, maker in (("uniform", generate.uniform), ("clustered", generate.clustered)):
        out[f"total_1m_{name}"] = lambda m=maker: aggregate.summary(join.classify(m(spark, 1_000_000), grid))
        out[f"classify_1m_{name}"] = lambda m=maker: aggregate.summary(join.classify(m(spark, 1_000_000), index))
        out[f"classify_10m_{name}"] = lambda m=maker: aggregate.summary(join.classify(m(spark, 10_000_000), index))
    out["shapes_orders"] = lambda: aggregate.per_polygon(join.classify(points["orders"], fixtures.shapes(spark)))
    out["nations_orders"] = lambda: aggregate.per_polygon(join.classify(points["orders"], fixtures.nations(spark)))
    out["stripes_events"] = lambda: aggregate.per_stripe(join.classify(points["events"], grid), fixtures.DOMAIN, 4)
    out["morton_orders"] = lambda: order.morton_sorted(points["orders"], fixtures.DOMAIN)
    return out


def matrix(spark: SparkSession, sizes: list[int], workers: int, runs: int) -> DataFrame:
    """Throughput, replication against sharding, schedules, strong and weak scaling."""
    grid = generate.grid(spark, 100, 100)
    rows = []

    def add(experiment: str, name: str, n: int, count: int, make) -> None:
        rows.append((experiment, name, n, count, 1000 * timed(make, runs)))

    makers = {"uniform": generate.uniform, "clustered": generate.clustered}
    for n in sizes:
        for name, maker in makers.items():
            add("throughput", name, 1, n, lambda n=n, m=maker: aggregate.summary(join.classify(m(spark, n), grid)))
            for mode in ("replicated", "sharded"):
                add(f"{mode}_{name}", mode, workers, n, lambda n=n, m=maker, s=mode: aggregate.summary(join.classify(m(spark, n), grid, strategy=s, n=workers)))
        for kind in order.SCHEDULES:
            add("schedule", kind, 1, n, lambda n=n, k=kind: aggregate.summary(join.classify(order.scheduled(generate.uniform(spark, n), k), grid)))
        w = 1
        while w <= workers:
            add("strong", "uniform", w, n, lambda n=n, w=w: aggregate.summary(join.classify(generate.uniform(spark, n).coalesce(w), grid)))
            add("weak", "uniform", w, n * w // workers, lambda n=n, w=w: aggregate.summary(join.classify(generate.uniform(spark, n * w // workers).coalesce(w), grid)))
            w *= 2
    metrics = spark.createDataFrame(rows, "experiment string, name string, workers int, points bigint, ms double")
    return aggregate.speedup(metrics).selectExpr("*", "points / (ms / 1000) AS points_per_s")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--matrix", action="store_true")
    parser.add_argument("--quick", action="store_true", help="one run of each query")
    parser.add_argument("--sizes", default="1000000")
    parser.add_argument("--workers", type=int, default=4)
    args, _ = parser.parse_known_args()  # unknown arguments are ignored
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = max(1, int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1)))
    runs = 1 if args.quick else max(1, int(os.environ.get("BENCH_RUNS", "3")))
    spark = session(cpus)
    if args.matrix:
        sizes = [max(1, int(s)) for s in args.sizes.split(",") if s.strip()]
        matrix(spark, sizes, max(1, args.workers), runs).orderBy("experiment", "name", "points", "workers").show(200, truncate=False)
        return
    took = {name: timed(make, runs) for name, make in headline(spark, sf_dir).items()}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
