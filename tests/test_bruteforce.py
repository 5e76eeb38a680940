"""Spark jobs against plain-Python loops over the sf0.001 tables."""

import math
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from conftest import SF001, rows
from stepwise.plans import components as cc
from stepwise.plans import kmeans as kmp
from stepwise.plans import linreg as lrp
from stepwise.plans import pagerank as pr
from stepwise.plans.iterate import delta_iterate, upsert
from stepwise.sources import tables as tb
from stepwise.sources.delimited import CENTER_SCHEMA


def _cols(table, *cols):
    t = pq.read_table(f"{SF001}/{table}.parquet", columns=list(cols)).to_pydict()
    return list(zip(*[t[c] for c in cols]))


def _pr_edges():
    return _cols("lineitem", "l_partkey", "l_suppkey")


def _out(edges):
    out = defaultdict(list)
    for s, d in edges:
        out[s].append(d)
    return out


def test_pagerank_delta_bruteforce(spark):
    edges = _pr_edges()
    out = _out(edges)
    n = len({v for e in edges for v in e})
    ranks = {s: 1.0 for s in out}
    work = {s: 1.0 - 1.0 / n for s in out}
    for _ in range(10):
        acc = defaultdict(float)
        for s, dlt in work.items():
            for t in out.get(s, []):
                acc[t] += 0.85 * dlt / len(out[s])
        work = {k: v for k, v in acc.items() if abs(v) > 0.1}
        for k, v in work.items():
            if k in ranks:
                ranks[k] += v
        if not work:
            break
    got = pr.pagerank_delta(tb.pr_links(spark, SF001), max_iter=10).df
    assert rows(got, nd=6) == sorted((k, round(v, 6)) for k, v in ranks.items())


def test_pagerank_bulk_bruteforce(spark):
    edges = _pr_edges()
    out = _out(edges)
    n = len({v for e in edges for v in e})
    ranks = {s: 1.0 for s in out}
    for _ in range(10):
        acc = defaultdict(float)
        for s, r in ranks.items():
            for t in out.get(s, []):
                acc[t] += r / len(out[s])
        new = {k: v * 0.85 + (1 - 0.85) / n for k, v in acc.items()}
        moved = any(abs(new[k] - ranks[k]) > 0.0001 for k in new if k in ranks)
        ranks = new
        if not moved:
            break
    got = pr.pagerank_bulk(tb.pr_links(spark, SF001), max_iter=10).df
    assert rows(got, nd=6) == sorted((k, round(v, 6)) for k, v in ranks.items())


def test_components_bruteforce(spark):
    edges = [(o, 1_000_000 + p) for o, p in _cols("lineitem", "l_orderkey", "l_partkey")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    want = sorted((v, find(v)) for v in {x for e in edges for x in e})
    got = cc.components_delta(tb.cc_edges(spark, SF001), 30)
    assert got.converged and rows(got.df) == want


def test_kmeans_bruteforce(spark):
    pts = [(q, p / 1000.0) for q, p in _cols("lineitem", "l_quantity", "l_extendedprice")]
    centers = [(1, 10.0, 10.0), (2, 30.0, 50.0), (3, 50.0, 90.0)]
    for _ in range(5):
        acc = defaultdict(lambda: [0.0, 0.0, 0])
        for x, y in pts:
            cid = min(centers, key=lambda c: (math.sqrt((x - c[1]) ** 2 + (y - c[2]) ** 2), c[0]))[0]
            a = acc[cid]
            a[0] += x
            a[1] += y
            a[2] += 1
        centers = sorted((k, a[0] / a[2], a[1] / a[2]) for k, a in acc.items())
    res = kmp.kmeans_bulk(tb.points(spark, SF001),
                          spark.createDataFrame([(1, 10.0, 10.0), (2, 30.0, 50.0), (3, 50.0, 90.0)],
                                                CENTER_SCHEMA), 5)
    for (i, x, y), (j, gx, gy) in zip(centers, res.extra["centers"]):
        assert i == j and x == pytest.approx(gx, abs=1e-9) and y == pytest.approx(gy, abs=1e-9)


def test_linreg_bruteforce(spark):
    smp = [(q / 50.0, p / 100000.0) for q, p in _cols("lineitem", "l_quantity", "l_extendedprice")]
    t0 = t1 = 0.0
    for _ in range(10):
        s0 = s1 = 0.0
        for x, y in smp:
            err = (t0 + t1 * x) - y
            s0 += t0 - 0.01 * err
            s1 += t1 - 0.01 * (err * x)
        t0, t1 = s0 / len(smp), s1 / len(smp)
    g0, g1 = lrp.linreg_bulk(tb.samples(spark, SF001), (0.0, 0.0), 10).extra["params"]
    assert g0 == pytest.approx(t0, abs=1e-12) and g1 == pytest.approx(t1, abs=1e-12)


def test_generic_delta_iterate_and_upsert(spark):
    sol = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    d = spark.createDataFrame([(2, 21), (3, 30)], "k long, v long")
    assert rows(upsert(sol, d, "k")) == [(1, 10), (2, 21), (3, 30)]
    # count each key down to zero; the workset holds keys still above zero
    start = spark.createDataFrame([(1, 3), (2, 1)], "k long, v long")

    def step(s, ws, i):
        from pyspark.sql import functions as F
        nxt = ws.select("k", (F.col("v") - 1).alias("v"))
        return nxt, nxt.where(F.col("v") > 0)

    res = delta_iterate(start, start, step, 10, key="k")
    assert rows(res.df) == [(1, 0), (2, 0)] and res.converged and res.iterations == 3
