"""Randomized checks on small graphs (few examples: each runs Spark jobs)."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from stepwise.operators import graph as g
from stepwise.plans import components as cc
from stepwise.plans import pagerank as pr

edge_lists = st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60)
SETTINGS = settings(max_examples=4, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _union_find(edges):
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
    return sorted((v, find(v)) for v in {x for e in edges for x in e})


@SETTINGS
@given(edges=edge_lists, split=st.sampled_from([None, 1, 2]))
def test_components_match_union_find(spark, edges, split):
    df = spark.createDataFrame(edges, "src long, dst long")
    lk = g.Links(g.undirected(df), split_rows=split) if split else None
    res = cc.components_delta(df, 100, prepared=lk)
    assert res.converged and rows(res.df) == _union_find(edges)


@SETTINGS
@given(edges=edge_lists, threshold=st.sampled_from([0.05, 0.2]), split=st.sampled_from([None, 1]))
def test_delta_pagerank_matches_python(spark, edges, threshold, split):
    df = spark.createDataFrame(edges, "src long, dst long")
    out = defaultdict(list)
    for s, d in edges:
        out[s].append(d)
    n = len({v for e in edges for v in e})
    ranks = {s: 1.0 for s in out}
    work = {s: 1.0 - 1.0 / n for s in out}
    for _ in range(8):
        acc = defaultdict(float)
        for s, dlt in work.items():
            for t in out.get(s, []):
                acc[t] += 0.85 * dlt / len(out[s])
        work = {k: v for k, v in acc.items() if abs(v) > threshold}
        for k, v in work.items():
            if k in ranks:
                ranks[k] += v
        if not work:
            break
    lk = g.Links(df, split_rows=split) if split else None
    got = pr.pagerank_delta(df, max_iter=8, threshold=threshold, prepared=lk).df
    assert rows(got, nd=7) == sorted((k, round(v, 7)) for k, v in ranks.items())
