"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is forced with the ``noop`` sink, so the full result is computed
without collecting it on the driver.  The ``*_sink_*`` and ``cc_*`` rows run
graphs whose state stays large, to the empty workset, and report the rows each
superstep saved.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stepwise.plans import catalog, components, pagerank  # noqa: E402
from stepwise.session import build_session, checkpoint_dir, scratch_dir  # noqa: E402
from stepwise.sources import tables as tb  # noqa: E402

HEADLINE = [
    "pagerank_delta", "pagerank_bulk", "pagerank_staged", "pagerank_threshold_sweep",
    "cc_bulk", "cc_delta_iter", "cc_staged", "cc_delta_shuffled",
    "kmeans_bulk", "kmeans_staged", "kmeans_many_centers", "linreg_bulk", "linreg_staged",
    "gen_points_skewed", "gen_points_many_means", "runtime_report", "execution_summary",
]
STEPS = 30
LOOPS = {
    "pagerank_sink_bulk": lambda s, sf: pagerank.pagerank_bulk(tb.sink_links(s, sf), max_iter=STEPS),
    "pagerank_sink_delta": lambda s, sf: pagerank.pagerank_delta(
        tb.sink_links(s, sf), max_iter=STEPS, threshold=0.0001),
    "pagerank_sink_staged": lambda s, sf: pagerank.pagerank_staged(
        tb.sink_links(s, sf), f"{scratch_dir(s, 'bench')}/{time.time_ns()}", max_iter=STEPS, threshold=0.0001),
    "cc_delta_loop": lambda s, sf: components.components_delta(tb.cc_edges(s, sf), STEPS),
    "cc_bulk_loop": lambda s, sf: components.components_bulk(tb.cc_edges(s, sf), STEPS),
}
SAVED = ("ranks", "pagerank-delta", "components", "components-delta")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app="stepwise-bench", shuffle_partitions=cpus,
                          conf={"spark.driver.memory": "16g"})
    checkpoint_dir(spark)
    # warm-up on the smallest tables: JVM JIT and codegen caches, not the data
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("pagerank_delta", "cc_bulk", "cc_delta_iter", "kmeans_bulk", "runtime_report"):
            catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times, rows = {}, {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    for name, loop in LOOPS.items():
        t0 = time.time()
        res = loop(spark, sf_dir)
        res.df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        rows[name] = [n for op, _, n in res.counts if op in SAVED]
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "saved_rows_per_step": rows, "sf": sf}))


if __name__ == "__main__":
    main()
