"""Job entry points over text files (spark-submit friendly).

    spark-submit stepwise/jobs.py pagerank --links L --out O [--mode delta] ...
    python -m stepwise.jobs components --edges E --out O --mode staged --state S

Inputs and outputs use the text formats of the original jobs: TAB edge
lists with ``%`` comments, blank-separated points / centers / samples, and
blank-separated results.  Parameters are named, never positional.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from stepwise.plans import components as cc
from stepwise.plans import kmeans as kmp
from stepwise.plans import linreg as lrp
from stepwise.plans import pagerank as pr
from stepwise.session import build_session
from stepwise.sources import delimited as dl
from stepwise.sources import generated as gen
from stepwise.sources import text as tx


def _counters(res) -> None:
    """M2 and M5: counters sorted by name, then runtime per iteration."""
    for op, i, n in sorted(res.counts, key=lambda t: (t[0], t[1])):
        print(f"{op}-iter_{i} : {n}")
    for i, ms, par in res.step_ms:
        print(f"iteration {i}: {ms} ms, {par} partitions")


def run_pagerank(spark: SparkSession, a) -> None:
    links = tx.read_edges(spark, a.links)
    if a.mode == "bulk":
        res = pr.pagerank_bulk(links, a.num_pages, a.max_iter)
    elif a.mode == "delta":
        res = pr.pagerank_delta(links, a.num_pages, a.max_iter, a.threshold, counters=True)
    else:
        res = pr.pagerank_staged(links, a.state, a.num_pages, a.max_iter, a.threshold,
                                 adaptive_rows=a.adaptive_rows, resume=a.resume)
    tx.write_rows(res.df.select("id", "rank"), a.out)
    _counters(res)


def run_components(spark: SparkSession, a) -> None:
    edges = tx.read_edges(spark, a.edges)
    if a.mode == "bulk":
        res = cc.components_bulk(edges, a.max_iter)
    elif a.mode == "delta":
        res = cc.components_delta(edges, a.max_iter, counters=True)
    else:
        res = cc.components_staged(edges, a.state, a.max_iter, resume=a.resume)
    tx.write_rows(res.df.select("v", "comp"), a.out)
    _counters(res)


def run_kmeans(spark: SparkSession, a) -> None:
    points = dl.read_points(spark, a.points)
    centers = dl.read_centers(spark, a.centers)
    if a.mode == "bulk":
        res = kmp.kmeans_bulk(points, centers, a.iterations)
    else:
        res = kmp.kmeans_staged(points, centers, a.state, a.iterations, adaptive_rows=a.adaptive_rows,
                                resume=a.resume)
    out = kmp.final_assignment(points, res).select("cluster", "x", "y")
    tx.write_rows(out, a.out, mode="overwrite" if a.overwrite else "errorifexists")


def run_linreg(spark: SparkSession, a) -> None:
    samples = dl.read_samples(spark, a.data)
    start = (a.theta0, a.theta1)
    if a.mode == "bulk":
        res = lrp.linreg_bulk(samples, start, a.iterations, a.rate)
    else:
        res = lrp.linreg_staged(samples, start, a.state, a.iterations, a.rate, resume=a.resume)
    tx.write_params(res.df, a.out)


def run_gen_kmeans(spark: SparkSession, a) -> None:
    skew = [int(x) for x in a.skew.split(",")] if a.skew else None
    pts = gen.kmeans_points(spark, a.points, a.k, skew, a.partitions, a.stddev, a.range, a.seed)
    gen.write_points(pts, f"{a.output}/points")
    gen.write_centers(gen.start_centers(spark, a.k, a.range, a.seed), f"{a.output}/centers")


def run_gen_linreg(spark: SparkSession, a) -> None:
    gen.write_points(gen.regression_samples(spark, a.points, a.partitions, a.seed), f"{a.output}/data")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stepwise.jobs")
    sub = p.add_subparsers(dest="job", required=True)

    s = sub.add_parser("pagerank")
    s.add_argument("--links", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--mode", choices=["bulk", "delta", "staged"], default="delta")
    s.add_argument("--num-pages", type=int, default=None)
    s.add_argument("--max-iter", type=int, default=10)
    s.add_argument("--threshold", type=float, default=0.1)
    s.add_argument("--state")
    s.add_argument("--resume", action="store_true", help="go on from the state of a staged run")
    s.add_argument("--adaptive-rows", type=int, default=None)
    s.set_defaults(fn=run_pagerank)

    s = sub.add_parser("components")
    s.add_argument("--edges", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--mode", choices=["bulk", "delta", "staged"], default="delta")
    s.add_argument("--max-iter", type=int, default=10)
    s.add_argument("--state")
    s.add_argument("--resume", action="store_true", help="go on from the state of a staged run")
    s.set_defaults(fn=run_components)

    s = sub.add_parser("kmeans")
    s.add_argument("--points", required=True)
    s.add_argument("--centers", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--mode", choices=["bulk", "staged"], default="bulk")
    s.add_argument("--iterations", type=int, default=10)
    s.add_argument("--state")
    s.add_argument("--resume", action="store_true", help="go on from the state of a staged run")
    s.add_argument("--adaptive-rows", type=int, default=None)
    s.add_argument("--overwrite", action="store_true")
    s.set_defaults(fn=run_kmeans)

    s = sub.add_parser("linreg")
    s.add_argument("--data", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--theta0", type=float, required=True)
    s.add_argument("--theta1", type=float, required=True)
    s.add_argument("--mode", choices=["bulk", "staged"], default="bulk")
    s.add_argument("--iterations", type=int, default=10)
    s.add_argument("--rate", type=float, default=0.01)
    s.add_argument("--state")
    s.add_argument("--resume", action="store_true", help="go on from the state of a staged run")
    s.set_defaults(fn=run_linreg)

    s = sub.add_parser("gen-kmeans")
    s.add_argument("--points", type=int, required=True)
    s.add_argument("--k", type=int, required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--stddev", type=float, default=gen.RELATIVE_STDDEV)
    s.add_argument("--range", type=float, default=gen.DEFAULT_RANGE)
    s.add_argument("--skew")
    s.add_argument("--partitions", type=int, default=None)
    s.add_argument("--seed", type=int, default=0)
    s.set_defaults(fn=run_gen_kmeans)

    s = sub.add_parser("gen-linreg")
    s.add_argument("--points", type=int, required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--partitions", type=int, default=None)
    s.add_argument("--seed", type=int, default=0)
    s.set_defaults(fn=run_gen_linreg)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.job in ("pagerank", "components", "kmeans", "linreg") and \
            getattr(a, "mode", None) == "staged" and not a.state:
        raise SystemExit("--state is required in staged mode")
    spark = spark or build_session(app=f"stepwise-{a.job}")
    a.fn(spark, a)
    print(json.dumps({"job": a.job, "status": "ok"}))


if __name__ == "__main__":
    main(sys.argv[1:])
