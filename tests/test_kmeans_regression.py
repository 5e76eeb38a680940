import math

import numpy as np
import pytest

from conftest import SF001, rows
from stepwise.operators import clustering as km
from stepwise.operators import regression as lr
from stepwise.plans import kmeans as kmp
from stepwise.plans import linreg as lrp
from stepwise.sources import tables as tb
from stepwise.sources.delimited import CENTER_SCHEMA, POINT_SCHEMA

F7_POINTS = [(1.2, 2.3), (5.3, 7.2)]
F7_CENTERS = [(1, 6.2, 3.2), (2, 2.9, 5.7)]


def test_f7_assign(spark):
    pts = spark.createDataFrame(F7_POINTS, POINT_SCHEMA)
    assert [r.cluster for r in km.assign(pts, F7_CENTERS).collect()] == [2, 2]


def test_f8_one_step(spark):
    pts = spark.createDataFrame(F7_POINTS, POINT_SCHEMA)
    assert rows(km.kmeans_step(pts, F7_CENTERS), nd=9) == [(2, 3.25, 4.75)]


def test_f9_tie_lowest_id(spark):
    pts = spark.createDataFrame([(0.0, 0.0)], POINT_SCHEMA)
    assert km.assign(pts, [(2, -1.0, 0.0), (1, 1.0, 0.0)]).first().cluster == 1


def test_f10_nan(spark):
    pts = spark.createDataFrame([(float("nan"), 0.0)], POINT_SCHEMA)
    assert km.assign(pts, F7_CENTERS).first().cluster == -1


def test_many_centers_path_matches(spark):
    pts = tb.points(spark, SF001)
    centers = [(i, float(i % 50), float(i % 97)) for i in range(150)]
    a = km.assign(pts, centers)
    b = km.assign(pts, centers[:km.MAX_UNROLLED_CENTERS])  # unrolled path, fewer centers
    assert a.count() == b.count()
    # brute force on the driver for the large path
    got = [r.cluster for r in a.limit(200).collect()]
    for (x, y), c in zip([(r.x, r.y) for r in pts.limit(200).collect()], got):
        best = min(centers, key=lambda t: (math.hypot(x - t[1], y - t[2]), t[0]))
        assert best[0] == c


def test_kmeans_bulk_equals_staged(spark, tmp_path):
    pts = tb.points(spark, SF001)
    start = spark.createDataFrame([(1, 10.0, 10.0), (2, 30.0, 50.0), (3, 50.0, 90.0)], CENTER_SCHEMA)
    b = kmp.kmeans_bulk(pts, start, 5)
    s = kmp.kmeans_staged(pts, start, str(tmp_path), 5)
    assert b.extra["centers"] == s.extra["centers"]
    assert rows(kmp.final_assignment(pts, b)) == rows(kmp.final_assignment(pts, s))


def test_empty_cluster_vanishes(spark):
    pts = spark.createDataFrame(F7_POINTS, POINT_SCHEMA)
    res = kmp.kmeans_bulk(pts, spark.createDataFrame(F7_CENTERS, CENTER_SCHEMA), 2)
    assert [c[0] for c in res.extra["centers"]] == [2]


def test_f11_regression(spark):
    s = spark.createDataFrame([(-0.02, -0.04), (5.3, 10.6)], POINT_SCHEMA)
    assert rows(lr.sample_steps(s, 0.0, 0.0), nd=9) == sorted([(-0.0004, 0.000008), (0.106, 0.5618)])
    assert rows(lr.regression_step(s, 0.0, 0.0), nd=9) == [(0.0528, 0.280904)]
    res = lrp.linreg_bulk(s, (0.0, 0.0), 1)
    assert [round(v, 9) for v in res.extra["params"]] == [0.0528, 0.280904]


def test_regression_bulk_equals_staged(spark, tmp_path):
    s = tb.samples(spark, SF001)
    a = lrp.linreg_bulk(s, (0.0, 0.0), 4)
    b = lrp.linreg_staged(s, (0.0, 0.0), str(tmp_path), 4)
    assert a.extra["params"] == b.extra["params"]


def test_regression_needs_start(spark):
    import pytest
    s = spark.createDataFrame(F7_POINTS, POINT_SCHEMA)
    with pytest.raises(ValueError):
        lrp.linreg_bulk(s, None, 1)


def _odd_points_and_centers(seed, n, k):
    """Clusters, far outliers, equal points, equal centers and non-finite values."""
    r = np.random.default_rng(seed)
    pts = np.concatenate((r.normal(0, 1, (n, 2)), r.normal(50, 0.01, (n, 2)), r.integers(-3, 4, (n, 2)),
                          [(1e6, -1e6), (1e6, -1e6), (np.nan, 0.0), (np.inf, 1.0), (0.0, 0.0)]))
    cen = np.concatenate((r.normal(0, 2, (k, 2)), r.normal(50, 0.02, (k, 2)), r.integers(-3, 4, (k, 2)),
                          [(np.nan, 0.0), (-np.inf, 0.0), (9e5, -9e5)]))
    ids = r.permutation(len(cen))
    return pts, sorted((int(i), float(x), float(y)) for i, (x, y) in zip(ids, cen))


def _brute_nearest(pts, centers):
    out = []
    for x, y in pts:
        d = [(math.sqrt((x - cx) ** 2 + (y - cy) ** 2), i) for i, cx, cy in centers
             if all(map(math.isfinite, (x, y, cx, cy)))]
        out.append(min(d)[1] if d else -1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_nearest_in_boxes(seed, monkeypatch):
    monkeypatch.setattr(km, "BOX_CENTERS", 3)
    monkeypatch.setattr(km, "BOX_POINTS", 2)
    pts, centers = _odd_points_and_centers(seed, 150, 60)
    ids, cx, cy = np.array(centers).T
    got = km._nearest_in_boxes(pts[:, 0], pts[:, 1], ids.astype(np.int64), cx, cy)
    assert got.tolist() == _brute_nearest(pts, centers)


@pytest.mark.parametrize("n,k", [(80, 60), (3, 1), (80, 2)])
def test_joined_centers_agree_with_all_pairs(spark, n, k):
    pts, centers = _odd_points_and_centers(n + k, n, k)
    points = spark.createDataFrame([(float(x), float(y), i) for i, (x, y) in enumerate(pts)], "x double, y double, row int")
    frame = spark.createDataFrame(centers, CENTER_SCHEMA)
    want = _brute_nearest(pts, centers)
    got = {r.row: r.cluster for r in km.assign(points, frame).collect()}
    assert [got[i] for i in range(len(pts))] == want
    none = km.assign(points, frame.limit(0)).collect()
    assert {r.cluster for r in none} == {-1} and len(none) == len(pts)
    assert km.assign(points.limit(0), frame).count() == 0


def test_joined_loop_agrees_with_broadcast_loop(spark):
    r = np.random.default_rng(9)
    points = spark.createDataFrame([tuple(map(float, p)) for p in r.normal(0, 10, (2000, 2))], "x double, y double")
    start = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(0, 12, (150, 2)))],
                                  CENTER_SCHEMA)
    a, b = (kmp.kmeans_bulk(points, start, 4, joined=j) for j in (False, True))
    assert rows(a.df, nd=9) == rows(b.df, nd=9)
    assert (rows(kmp.final_assignment(points, a), nd=9) == rows(kmp.final_assignment(points, b), nd=9))


def test_joined_centers_are_never_broadcast(spark):
    pts = spark.range(500).selectExpr("cast(id % 25 as double) as x", "cast(id % 20 as double) as y")
    centers = spark.range(50).selectExpr("cast(id as int) as id", "cast(id % 7 as double) as x", "cast(id % 11 as double) as y")
    out = km.assign_joined(pts, centers, km.Grid.of(pts, centers))
    assert out.count() == 500
    out.collect()       # the adaptive plan is final now
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan


def test_too_many_centers_stay_off_the_driver(spark):
    centers = spark.range(50).selectExpr("cast(id as int) as id", "cast(id as double) as x", "cast(id * 2 as double) as y")
    assert km.collect_centers(centers, 49) is None
    assert km.collect_centers(centers, 50) == [(i, i * 1.0, i * 2.0) for i in range(50)]
