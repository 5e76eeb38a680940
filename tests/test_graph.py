import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from stepwise.operators import graph as g
from stepwise.plans import catalog
from stepwise.plans import components as cc
from stepwise.plans import pagerank as pr
from stepwise.plans.iterate import ParquetStore, _conf
from stepwise.sources import tables as tb


@pytest.mark.parametrize("mode", ["bulk", "delta", "staged"])
def test_f2_components(spark, edges_t, tmp_path, mode):
    if mode == "bulk":
        res = cc.components_bulk(edges_t)
    elif mode == "delta":
        res = cc.components_delta(edges_t)
    else:
        res = cc.components_staged(edges_t, str(tmp_path))
    assert rows(res.df) == [(1, 1), (2, 1), (12, 1), (42, 42), (63, 42)]
    assert res.converged
    if mode != "bulk":
        assert [n for op, i, n in res.counts if op.endswith("-delta")] == [3, 0]


def test_f3_pagerank_bulk(spark, edges_t):
    lk = g.Links(edges_t)
    r1 = g.bulk_rank_step(g.rank_init(edges_t), lk, 5)
    assert rows(r1, nd=6) == [(2, 0.455), (12, 1.305), (63, 0.88)]
    r2 = g.bulk_rank_step(r1, lk, 5)
    assert rows(r2, nd=6) == [(12, 0.41675)]
    res = pr.pagerank_bulk(edges_t, num_pages=5, max_iter=10)
    assert res.iterations == 3 and res.converged and res.df.count() == 0


def test_f4_pagerank_delta(spark, edges_t, tmp_path):
    res = pr.pagerank_delta(edges_t, num_pages=5, threshold=0.1, max_iter=10)
    assert rows(res.df, nd=6) == [(1, 1.0), (2, 1.34), (42, 1.0)]
    deltas = [n for op, i, n in res.counts if op == "pagerank-delta"]
    assert deltas == [3, 1, 0] and res.converged
    staged = pr.pagerank_staged(edges_t, str(tmp_path), num_pages=5, threshold=0.1)
    assert rows(staged.df, nd=6) == rows(res.df, nd=6)


def test_f4_delta_values(spark, edges_t):
    lk = g.Links(edges_t)
    w0 = g.delta_init(g.rank_init(edges_t), 5)
    w1 = g.sum_and_filter(g.delta_shares(w0, lk), 0.1)
    assert rows(w1, nd=6) == [(2, 0.34), (12, 1.02), (63, 0.68)]
    w2 = g.sum_and_filter(g.delta_shares(w1, lk), 0.1)
    assert rows(w2, nd=6) == [(12, 0.289)]


def test_f5_parallel_edges(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "src long, dst long")
    assert rows(g.adjacency_list(e)) == [(1, 0, [2, 2, 3])]
    assert rows(g.out_degree(e)) == [(1, 3)]
    s = g.sum_shares(g.rank_shares(g.rank_init(e), g.Links(e)), "share", "share")
    assert rows(s, nd=9) == [(2, round(2 / 3, 9)), (3, round(1 / 3, 9))]
    assert g.rank_shares(g.rank_init(e), g.Links(e)).count() == 2       # parallel edges are folded


def test_f6_threshold_strict(spark):
    sh = spark.createDataFrame([(1, 0.05), (1, 0.05), (2, 0.3)], "id long, share double")
    assert rows(g.sum_and_filter(sh, 0.1)) == [(2, 0.3)]
    sh = spark.createDataFrame([(1, 0.5)], "id long, share double")
    assert rows(g.sum_and_filter(sh, 0.5)) == []


@pytest.mark.parametrize("max_hot", [0, 100_000])
def test_salted_links_give_same_ranks(spark, max_hot):
    links = tb.pr_links(spark, SF001)
    plain = g.Links(links)
    salted = g.Links(links, split_rows=3, max_hot=max_hot)
    assert plain.n_hot == 0 and salted.n_hot > 0
    assert (salted.salted, salted.two_way) == (max_hot == 0, max_hot > 0)
    assert salted.count_vertices() == plain.count_vertices()
    a = pr.pagerank_delta(links, max_iter=5, prepared=plain).df
    b = pr.pagerank_delta(links, max_iter=5, prepared=salted).df
    assert rows(a, nd=9) == rows(b, nd=9)
    c1 = cc.components_delta(tb.cc_edges(spark, SF001), 20).df
    und = g.undirected(tb.cc_edges(spark, SF001))
    c2 = cc.components_delta(tb.cc_edges(spark, SF001), 20, prepared=g.Links(und, split_rows=2, max_hot=max_hot)).df
    assert rows(c1) == rows(c2)


def test_component_modes_agree(spark, tmp_path):
    e = tb.cc_edges(spark, SF001)
    b = cc.components_bulk(e, 20)
    d = cc.components_delta(e, 20)
    s = cc.components_staged(e, str(tmp_path), 20)
    assert rows(b.df) == rows(d.df) == rows(s.df)
    assert b.converged and d.converged


def test_pagerank_independent_of_partitions(spark):
    links = tb.pr_links(spark, SF001)
    a = pr.pagerank_delta(links, max_iter=4).df
    b = pr.pagerank_delta(links, max_iter=4, partitions=lambda i: 1 + i).df
    assert rows(a, nd=9) == rows(b, nd=9)


def test_store_writes_per_step(spark, edges_t, tmp_path):
    pr.pagerank_staged(edges_t, str(tmp_path), num_pages=5)
    store = ParquetStore(str(tmp_path))
    back = spark.read.parquet(store.path("pagerank-delta", 1))
    assert back.count() == 3


def test_partition_stats_sum_to_totals(spark):
    links = tb.pr_links(spark, SF001)
    res = pr.pagerank_delta(links, max_iter=3, partition_stats=True)
    per = {}
    for r in res.partition_stats().collect():
        per[(r.operator, r.iteration)] = per.get((r.operator, r.iteration), 0) + r.rows
    totals = {(op, i): n for op, i, n in res.counts if op == "pagerank-delta"}
    assert per == totals


def test_adaptive_staged_equals_delta(spark, tmp_path):
    from stepwise.plans.iterate import by_rows
    links = tb.pr_links(spark, SF001)
    a = pr.pagerank_delta(links, max_iter=4).df
    b = pr.pagerank_staged(links, str(tmp_path), max_iter=4, adaptive_rows=7).df
    assert rows(a, nd=9) == rows(b, nd=9)
    choose = by_rows(100, minimum=2, maximum=8)
    assert choose(1) is None and choose(2, 50) == 2 and choose(3, 550) == 6 and choose(4, 10**6) == 8


def test_adjacency_list_splits_hubs(spark):
    e = spark.createDataFrame([(1, d) for d in range(100)] + [(1, 7)] * 3 + [(2, 5)], "src long, dst long")
    got = g.adjacency_list(e, max_neighbors=20).collect()
    hub = {r.chunk: r.neighbors for r in got if r.src == 1}
    assert set(hub) == set(range(6))
    assert sorted(x for n in hub.values() for x in n) == sorted([*range(100), 7, 7, 7])
    assert all(len(n) <= 40 and n == sorted(n) for n in hub.values())
    assert [(r.chunk, r.neighbors) for r in got if r.src == 2] == [(0, [5])]
    again = g.adjacency_list(e.repartition(7), max_neighbors=20).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_delta_and_bulk_steps_agree(spark):
    from pyspark.sql import functions as F
    und = g.undirected(tb.cc_edges(spark, SF001))
    lk = g.Links(und)
    sol = lk.sources.select(F.col("src").alias("v"), F.col("src").alias("comp"))
    offers = g.cc_candidates(sol, lk)
    a = g.cc_update(sol, g.cc_delta(g.cc_min_candidate(offers), sol))
    assert rows(a) == rows(g.cc_relax_step(sol, offers).drop("changed"))


def _chain(spark, n, extra=0):
    """A path 0 - 1 - ... - n and many settled pairs beside it."""
    e = [(i, i + 1) for i in range(n)] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(extra)]
    return spark.createDataFrame(e, "src long, dst long")


def test_delta_components_save_only_the_workset(spark):
    res = cc.components_delta(_chain(spark, 12, extra=500), 20)
    assert res.converged
    saved = {i: n for op, i, n in res.counts if op == "components-delta"}
    # the path loses one changed vertex a step; the pairs beside it settle in step 1
    assert saved[1] == 512 and [saved[i] for i in range(2, 13)] == list(range(11, 0, -1)) and saved[13] == 0
    solutions = [i for op, i, _ in res.counts if op == "components-solution"]
    assert solutions == [1, 2]
    assert dict((op, n) for op, i, n in res.counts if i == 0)["components-initial"] == 1013
    assert {r.comp for r in res.df.where("v <= 12").collect()} == {0}


def _scanned(df):
    """Rows that the file scans of an executed plan gave out."""
    df.collect()
    seen, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("Scan parquet"):
            seen += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return seen


def test_late_steps_look_up_their_keys(spark):
    """Links and solution in files by bucket: few keys read few pages, and the answer is that of the scans."""
    from stepwise.plans.iterate import BucketStore, step_plan
    chain = _chain(spark, 12, extra=30_000)
    plain = cc.components_delta(chain, 20, lookup=False, counters=True)
    found = cc.components_delta(chain, 20, lookup=True, counters=True)
    drop = lambda res: sorted(c for c in res.counts if not c[0].endswith("-solution"))
    assert rows(plain.df) == rows(found.df) and drop(plain) == drop(found) and found.converged
    found.extra["release"]()
    files = BucketStore(spark, "src", 4)
    lk = g.Links(g.undirected(chain), save=lambda t, k, n: files.save(t, "links", 0))
    ws = spark.createDataFrame([(10_500, 1), (40_000, 2)], "__v long, comp long")
    with step_plan(spark, None, 1, None, lk.layout):
        assert _scanned(lk.of(ws, "__v", [10_500, 40_000])) <= 4 * 512 < _scanned(lk.table)
        sol = BucketStore(spark, "v", lk.layout)
        saved = sol.save(lk.sources.select(g.F.col("src").alias("v"), g.F.col("src").alias("comp")), "s", 1)
        assert _exchanges(saved.join(saved.withColumnRenamed("comp", "c").hint("shuffle_hash"), "v")) == 0
    files.close()
    sol.close()


def _exchanges(df, kind="Exchange"):
    """Exchanges of a plan, not counting those behind a cached table."""
    seen, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        seen += kind in node.nodeName()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return seen


def test_state_keeps_its_partitioning(spark):
    """With layout a step shuffles only what it produces, never the state it reads."""
    from stepwise.plans.iterate import CheckpointStore, step_plan
    lk = g.Links(g.undirected(tb.cc_edges(spark, SF001)), broadcast_state=False)
    assert lk.layout == lk.partitions and lk.n_hot == 0
    F = g.F
    save, step = CheckpointStore().save, lambda ws, sol: g.cc_delta(g.cc_min_candidate(g.cc_candidates(ws, lk)), sol)
    with step_plan(spark, None, 1, None, lk.layout):
        start = lk.sources.select(F.col("src").alias("v"), F.col("src").alias("comp"))
        delta = save(step(start, start), "d", 1)
        sol = save(g.cc_update(start, delta), "s", 1)
        delta = save(step(delta, sol), "d", 2)
        assert _exchanges(step(delta, g.cc_update(sol, delta))) == 1        # candidates to their targets


def test_hot_sources_leave_the_layout(spark):
    """One hub: the other vertices keep their partitioning, and the hub's links are spread."""
    from stepwise.plans.iterate import CheckpointStore, step_plan
    F = g.F
    edges = (spark.range(1, 4000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
             .union(spark.range(1, 3999).selectExpr("id AS src", "id + 1 AS dst")))
    und = g.undirected(edges)
    lk = g.Links(und, split_rows=100, broadcast_state=False)
    assert lk.two_way and lk.n_hot == 1 and lk.layout == lk.partitions
    per_part = lk.hot_table.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_part) == 3999
    assert lk.table.where("src = 0").isEmpty()
    save, step = CheckpointStore().save, lambda ws, sol: g.cc_delta(g.cc_min_candidate(g.cc_candidates(ws, lk)), sol)
    with step_plan(spark, None, 1, None, lk.layout):
        start = lk.sources.select(F.col("src").alias("v"), F.col("src").alias("comp"))
        delta = save(step(start, start), "d", 1)
        sol = save(g.cc_update(start, delta), "s", 1)
        # candidates to their targets; the others are the two small broadcasts of the hot side
        assert _exchanges(step(delta, sol)) - _exchanges(step(delta, sol), "BroadcastExchange") == 1
    assert {r.comp for r in cc.components_delta(und, 9, directed=True, prepared=lk).df.collect()} == {0}


def test_counters_with_hot_sources(spark):
    links = tb.pr_links(spark, SF001)
    drop = lambda res: [c for c in res.counts if c[0] not in ("pagerank-solution", "shares-out")]
    plain = pr.pagerank_delta(links, max_iter=3, counters=True)
    lk = g.Links(links, split_rows=3)
    hot = pr.pagerank_delta(links, max_iter=3, counters=True, prepared=lk)
    lk.unpersist()
    assert drop(plain) == drop(hot)
    shares = lambda res: [c for c in res.counts if c[0] == "shares-out"]
    assert shares(plain) == shares(hot)


def test_links_shuffle_the_edges_once(spark):
    lk = g.Links(tb.pr_links(spark, SF001), persist=False)
    plan = lk.table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1        # the edges
    assert plan.count("ENSURE_REQUIREMENTS") == 1       # the degrees, after partial counts


@pytest.mark.parametrize("parts", ["3", "11"])
def test_results_independent_of_shuffle_partitions(spark, parts):
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    base_pr = rows(pr.pagerank_delta(tb.pr_links(spark, SF001), max_iter=5).df, nd=9)
    base_cc = rows(cc.components_bulk(tb.cc_edges(spark, SF001), 20).df)
    spark.conf.set(key, parts)
    try:
        assert rows(pr.pagerank_delta(tb.pr_links(spark, SF001), max_iter=5).df, nd=9) == base_pr
        assert rows(cc.components_bulk(tb.cc_edges(spark, SF001), 20).df) == base_cc
    finally:
        spark.conf.set(key, old)


def test_summary_has_one_row_per_step(spark, edges_t):
    res = pr.pagerank_delta(edges_t, num_pages=5, threshold=0.1)
    s = res.summary().orderBy("iteration").collect()
    assert [r.iteration for r in s] == [1, 2, 3]
    assert s[0].rows["pagerank-delta"] == 3 and all(r.runtime_ms >= 0 for r in s)


def test_more_hot_sources_than_can_be_broadcast(spark, monkeypatch):
    links = tb.pr_links(spark, SF001)
    lk = g.Links(links, split_rows=3, max_hot=5)
    assert lk.two_way and not lk.salted and lk.n_hot == 5 and lk.layout == lk.partitions
    degrees = {r["src"]: r["deg"] for r in g.out_degree(links).collect()}
    hottest = sorted(degrees, key=lambda s: (-degrees[s], s))[:5]
    assert rows(lk.hot_table.select("src").distinct()) == sorted((s,) for s in hottest)
    every = lk.table.unionByName(lk.hot_table).select("src", "dst", "w", "deg")
    assert rows(every) == rows(g.Links(links).table.select("src", "dst", "w", "deg"))
    lk.unpersist()
    monkeypatch.setattr(g, "MAX_BROADCAST_HOT", 5)      # the queries hand it on
    assert rows(catalog.QUERIES["cc_delta_hot"](spark, SF001)) == rows(catalog.QUERIES["cc_delta_iter"](spark, SF001))
    assert rows(catalog.QUERIES["pagerank_hot"](spark, SF001), nd=5) == rows(
        catalog.QUERIES["pagerank_delta"](spark, SF001), nd=5)


@pytest.mark.parametrize("links", [{}, {"split_rows": 2}, {"split_rows": 2, "max_hot": 0}])
def test_first_candidates_are_the_offers_of_all_vertices(spark, links):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (1, 2), (9, 1), (7, 8)], "src long, dst long")
    lk = g.Links(g.undirected(edges), symmetric=True, **links)
    init = lk.sources.select(F.col("src").alias("v"), F.col("src").alias("comp"))
    assert lk.symmetric and rows(g.cc_first_candidates(lk)) == rows(g.cc_candidates(init, lk))
    lk.unpersist()
    some = g.Links(g.undirected(edges.union(spark.createDataFrame([(None, 5)], "src long, dst long"))), symmetric=True)
    assert not some.symmetric       # a link of a null source is dropped, its counterpart is not
    some.unpersist()


def test_relax_shuffles_candidates_only(spark):
    with _conf(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="4",
               spark__sql__autoBroadcastJoinThreshold="-1"):
        sol = spark.createDataFrame([(v, v) for v in range(20)] + [(None, None)], "v long, comp long")
        sol = sol.repartition(4, "v").checkpoint()
        cand = spark.createDataFrame([(5, 3), (5, 2), (6, 9), (99, 1), (None, 1)], "v long, comp long")
        out = g.cc_relax_step(sol, cand)
        assert rows(out) == sorted((v, 2 if v == 5 else v, v == 5) for v in range(20))
        plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("links", [{}, {"split_rows": 3}, {"split_rows": 3, "max_hot": 0}])
def test_links_in_lists_are_the_same_links(spark, monkeypatch, links):
    """One row per vertex instead of one per link; wide lists are split; offers of like value come together."""
    monkeypatch.setattr(g, "MAX_LIST_NEIGHBORS", 4)
    edges = spark.createDataFrame([(1, d) for d in range(2, 30)] + [(2, 3), (3, 3), (1, 2), (40, 41)],
                                  "src long, dst long")
    und = g.undirected(edges)
    plain, listed = (g.Links(und, symmetric=True, count_vertices=True, lists=x, **links) for x in (False, True))
    assert listed.lists and not plain.lists and "dst" not in listed.table.columns
    assert listed.table.count() < plain.table.count() and listed.vertex_count == g.num_vertices(edges) == 31
    assert rows(listed.rows(), "src", "dst") == rows(plain.rows(), "src", "dst")
    assert listed.table.agg(F.max(F.size("neighbors"))).first()[0] < 28     # those of vertex 1 are in several lists
    sol = plain.sources.select(F.col("src").alias("v"), (F.col("src") % 5).alias("comp"))
    assert rows(g.cc_candidates(sol, listed)) == rows(g.cc_candidates(sol, plain))
    assert rows(g.cc_first_candidates(listed)) == rows(g.cc_first_candidates(plain))
    assert rows(g.cc_min_candidate(g.cc_first_least(listed))) == rows(g.cc_min_candidate(g.cc_first_least(plain)))
    plain.unpersist()
    listed.unpersist()
    some = g.Links(und.union(spark.createDataFrame([(None, 5)], "src long, dst long")), symmetric=True, lists=True)
    assert not some.lists       # a list would lose a null target
    some.unpersist()


def test_lists_join_one_row_per_vertex_sorted_by_offer(spark):
    edges = spark.createDataFrame([(i, 100 + i % 7) for i in range(90)], "src long, dst long")
    lk = g.Links(g.undirected(edges), symmetric=True, lists=True, broadcast_state=False)
    sol = lk.sources.select(F.col("src").alias("v"), F.col("src").alias("comp"))
    assert lk.table.count() == lk.n_sources == 97
    plan = g.cc_min_candidate(g.cc_candidates(sol, lk))._jdf.queryExecution().executedPlan().toString()
    assert "Sort [comp" in plan         # kept below the minima, so that their shuffle packs better
    lk.unpersist()


def test_late_steps_look_up_their_lists(spark):
    from stepwise.plans.iterate import BucketStore
    files = BucketStore(spark, "src", 4)
    chain = _chain(spark, 12, extra=30_000)
    lk = g.Links(g.undirected(chain), save=lambda t, k, n: files.save(t, "links", 0), symmetric=True, lists=True)
    ws = spark.createDataFrame([(10_500, 1), (40_000, 2)], "__v long, comp long")
    got = lk.of(ws, "__v", [10_500, 40_000])
    assert rows(got, "__v", "comp", "dst") == [(10_500, 1, 10_501), (40_000, 2, 40_001)]
    assert _scanned(got) <= 4 * 512 < lk.table.count()
    lk.unpersist()
    files.close()


def test_salted_sources_keep_the_layout(spark):
    """A state is spread over the buckets and the offers go to their targets; nothing else is shuffled."""
    from stepwise.plans.iterate import CheckpointStore, step_plan
    und = g.undirected(tb.cc_edges(spark, SF001))
    lk = g.Links(und, split_rows=3, max_hot=0, broadcast_state=False, symmetric=True, lists=True)
    assert lk.salted and lk.layout == lk.partitions
    with step_plan(spark, None, 1, None, lk.layout), _conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        start = lk.sources.select(F.col("src").alias("v"), F.col("src").alias("comp"))
        sol = CheckpointStore().save(g.cc_relax_step(start, g.cc_first_candidates(lk)).drop("changed"), "s", 1)
        assert _exchanges(g.cc_relax_step(sol, g.cc_candidates(sol, lk))) == 2
    lk.unpersist()


def test_state_files_pack_their_sorted_keys(spark):
    """A table of sorted keys takes far less than the eight bytes a key."""
    from stepwise.plans.iterate import BucketStore
    files = BucketStore(spark, "v", 2)
    saved = files.save(spark.range(0, 400_000, 3, 2).selectExpr("id AS v", "id % 7 AS comp"), "s", 1)
    size = lambda f: spark._jvm.java.io.File(f.removeprefix("file:")).length()
    assert sum(size(f) for f in saved.inputFiles()) < 400_000 // 3 * 3 and saved.count() == 133_334
    files.close()
