from pyspark.sql import functions as F

from conftest import rows
from stepwise.operators import reports as rp
from stepwise.sources import generated as gen


def _report(spark, times):
    e = spark.createDataFrame([(1, "s", "job")], "id long, suite string, name string")
    r = spark.createDataFrame([(1, t) for t in times], "experiment_id long, time int")
    return rp.runtime_report(e, r, "s").first()


def test_f12_f13_runtime_report(spark):
    r = _report(spark, [5, 9, 7])
    assert (r.min_time, r.max_time, r.median_time, r.p50_time) == (5, 9, 7, 7.0)
    r = _report(spark, [5])
    assert (r.min_time, r.max_time, r.median_time, r.p50_time) == (5, 5, -5, 5.0)


def _proposal(spark, util, cur, slots, minimum):
    df = spark.createDataFrame([(util,)], "u double")
    return df.select(rp.proposed_parallelism("u", cur, slots, 0.70, minimum).alias("p")).first().p


def test_f14_f15_f16_parallelism(spark):
    assert _proposal(spark, 0.35, 32, 320, 8) == 16
    assert _proposal(spark, 1.4, 200, 320, 8) == 320
    assert _proposal(spark, 0.05, 40, 320, 8) == 8
    assert _proposal(spark, None, 32, 320, 8) == -1


def test_f17_average_of_averages(spark):
    s = spark.createDataFrame([("j", 1, "a", 0.2), ("j", 1, "a", 0.4), ("j", 1, "b", 0.9)],
                              "job string, iteration int, worker string, sample double")
    assert round(rp.cpu_averages(s).first().utilization, 9) == 0.6


def test_f18_generator_partition_independent(spark):
    a = rows(gen.kmeans_points(spark, 10, 3, partitions=3))
    b = rows(gen.kmeans_points(spark, 10, 3, partitions=7))
    assert a == b and len(a) == 10
    s3 = rows(gen.regression_samples(spark, 10, 3))
    s7 = rows(gen.regression_samples(spark, 10, 7))
    assert s3 == s7


def test_skew_weights(spark):
    assert gen.mean_weights(3, [1, 2]) == [1 / 3] * 3
    assert gen.mean_weights(2, [1, 3]) == [0.25, 0.75]
    pts = gen.points_for(gen.ids(spark, 4000, 4), [(0, -40.0, -40.0), (1, 40.0, 40.0)], [1, 3])
    n_hi = pts.where(F.col("x") > 0).count()
    assert 2700 < n_hi < 3300


def test_uniform_range_and_gaussian_moments(spark):
    u = gen.uniform_for(gen.ids(spark, 10000, 4))
    lo, hi = u.agg(F.min("u"), F.max("u")).first()
    assert 0.0 <= lo and hi < 1.0
    s = gen.regression_samples(spark, 10000, 4)
    m, v = s.agg(F.avg("x"), F.var_samp("x")).first()
    assert abs(m) < 0.05 and 0.9 < v < 1.1


def test_centers_in_range(spark):
    c = gen.uniform_centers(spark, 50)
    lo, hi = c.agg(F.least(F.min("x"), F.min("y")), F.greatest(F.max("x"), F.max("y"))).first()
    assert -50.0 <= lo and hi < 50.0
    assert rows(gen.start_centers(spark, 5)) != rows(gen.uniform_centers(spark, 5))


def test_median_without_buffer(spark):
    import random
    import statistics
    r = random.Random(3)
    times = [r.choice([5, 70_000, 70_001, 2_000_000_000, -3, 65_535, 65_536]) for _ in range(301)]
    for part in (times, times[:300], times[:2], times[:1]):
        assert _report(spark, part).p50_time == statistics.median(part)


def test_choice_of_many_means(spark):
    k = gen.MAX_MEANS
    pts = gen.points_for(gen.ids(spark, 3000, 4), [(i, float(i), 0.0) for i in range(k)],
                         [1 + i % 7 for i in range(k)], stddev=0.0)
    u = {r.id: r.u for r in gen.uniform_for(gen.ids(spark, 3000, 4), "pointsc").collect()}
    import bisect
    import itertools
    cum = list(itertools.accumulate(gen.mean_weights(k, [1 + i % 7 for i in range(k)])))
    for row in pts.collect():
        assert row.x == min(bisect.bisect_right(cum, u[row.id]), k - 1)


def test_choice_of_a_table_of_means(spark):
    import bisect
    import itertools
    k = 2 * gen.MAX_MEANS
    means = gen.ids(spark, k).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"),
                                     (F.col("id") % 7).alias("weight"))
    got = gen.points_for_table(gen.ids(spark, 3000, 4), means, stddev=0.0).collect()
    u = {r.id: r.u for r in gen.uniform_for(gen.ids(spark, 3000, 4), "pointsc").collect()}
    cum = list(itertools.accumulate(i % 7 for i in range(k)))
    hi = [c / float(cum[-1]) for c in cum]
    assert {r.id: r.x for r in got} == {i: bisect.bisect_right(hi, v) for i, v in u.items()} and len(got) == 3000


def test_seed_gives_other_data(spark):
    a, b = (rows(gen.kmeans_points(spark, 20, 3, seed=s)) for s in (0, 1))
    assert a == rows(gen.kmeans_points(spark, 20, 3)) and a != b


def test_proposal_without_samples(spark):
    s = spark.createDataFrame([("j", 1, "a", 0.35)], "job string, iteration int, worker string, sample double")
    jobs = spark.createDataFrame([("j", 32, 320), ("idle", 32, 320)], "job string, current int, slots int")
    got = {r.job: r.parallelism for r in rp.parallelism_proposal(s, jobs).collect()}
    assert got == {"j": 16, "idle": -1}


def test_job_generator_takes_any_number_of_means(spark, monkeypatch):
    """More means than a list may have: the same points from a joined table, with and without weights."""
    for skew in (None, [1, 0, 5, 2, 1, 1, 9, 1, 1, 1, 1, 3]):
        listed = rows(gen.kmeans_points(spark, 500, 12, skew, 3), nd=9)
        with monkeypatch.context() as m:
            m.setattr(gen, "MAX_MEANS", 4)
            assert rows(gen.kmeans_points(spark, 500, 12, skew, 3), nd=9) == listed
    assert gen.kmeans_points(spark, 300, 200_000).count() == 300
