"""Registered queries: name -> (Spark callable, reference SQL or None).

Each callable takes ``(spark, sf_dir)``, reads the test tables there and
returns a DataFrame whose column names match its SQL twin.  Doubles are
rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.operators import clustering as km
from stepwise.operators import graph as g
from stepwise.operators import regression as lr
from stepwise.operators import reports as rp
from stepwise.plans import components as cc
from stepwise.plans import kmeans as kmp
from stepwise.plans import linreg as lrp
from stepwise.plans import oracle as sql
from stepwise.plans import pagerank as prp
from stepwise.plans.utilization import Measured
from stepwise.session import scratch_dir
from stepwise.sources import delimited as dl
from stepwise.sources import generated as gen
from stepwise.sources import state as st
from stepwise.sources import tables as tb
from stepwise.sources import text as tx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the registered queries.
PR_STEPS = 10
SWEEP_THRESHOLDS = [50.0, 10.0, 5.0, 0.9, 0.75, 0.5, 0.1, 0.01, 0.001, 0.0001]
SWEEP_STEPS = 20
CC_STEPS = 20
SPLIT_ROWS = 3          # of the salted variants: most test sources count as hot
LIST_ROWS = 4           # of the adjacency lists: most sources span several chunks
KM_STEPS = 10
KM_START = [(1, 10.0, 10.0), (2, 20.0, 30.0), (3, 30.0, 50.0), (4, 40.0, 70.0), (5, 50.0, 90.0)]
RESUME_AFTER = 3            # steps of the first run of a loop that is resumed
LR_STEPS = 10
LR_START = (0.0, 0.0)
GEN_MEANS_K = 5
GEN_SKEW = [5, 1, 1, 1, 2]


def query(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql.portable_round(oracle)
        return fn
    return deco


_SCALE6 = 1_000_000.0


def r6(c) -> F.Column:
    """Six decimals as ``round(x * 1e6) / 1e6`` (same result in both engines)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x * F.lit(_SCALE6)) / F.lit(_SCALE6)


def _done(res):
    """The result of a loop that must have converged; a cut-off one is no answer."""
    if not res.converged:
        raise RuntimeError(f"not converged after {res.iterations} supersteps")
    return res


def _released(res) -> DataFrame:
    """The result of a loop, checkpointed, and its state files given up."""
    out = res.df.checkpoint()
    res.extra["release"]()
    return out


def _measured(spark: SparkSession) -> Measured:
    """Parallelism by CPU use, from a quarter of the cores on and down to one task."""
    return Measured(spark, max(1, spark.sparkContext.defaultParallelism // 4), minimum=1)


@contextmanager
def _folder(spark: SparkSession, name: str):
    """A scratch folder in the shared checkpoint folder, deleted at the end."""
    path = _scratch(spark, name)
    try:
        yield path
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark, name)}/{uuid.uuid4().hex}"


# --- sources and sinks (S1-S14) ----------------------------------------------

def _through_file(spark, name, write, read) -> DataFrame:
    """What a reader gives back from the files of a writer; the folder is deleted."""
    with _folder(spark, name) as path:
        write(path)
        return read(path).checkpoint()


def _edge_text(spark, sf):
    li = tb.table(spark, sf, "lineitem")
    line = F.when(F.col("l_linenumber") == 7,
                  F.concat(F.lit("% comment "), F.col("l_orderkey").cast("string"))) \
        .otherwise(F.concat_ws("\t", F.col("l_partkey").cast("string"),
                               F.col("l_suppkey").cast("string"),
                               F.col("l_orderkey").cast("string")))
    return li.select(line.alias("value"))


@query("edges_text_parse",
       "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber <> 7")
def q_edges_text_parse(spark, sf):
    return _through_file(spark, "edges", _edge_text(spark, sf).write.text, lambda p: tx.read_edges(spark, p))


@query("edges_text_undirected",
       f"SELECT src, dst FROM ({sql.PR_LINKS}) a UNION ALL SELECT dst AS src, src AS dst FROM ({sql.PR_LINKS}) b")
def q_edges_text_undirected(spark, sf):
    return _through_file(spark, "edges", lambda p: tx.write_edges(tb.pr_links(spark, sf), p),
                         lambda p: tx.read_undirected_edges(spark, p))


@query("edges_undirected",
       f"SELECT src, dst FROM ({sql.PR_LINKS}) a UNION ALL SELECT dst AS src, src AS dst FROM ({sql.PR_LINKS}) b")
def q_edges_undirected(spark, sf):
    return g.undirected(tb.pr_links(spark, sf))


@query("csv_points_roundtrip", "SELECT l_quantity AS x, l_extendedprice / 1000.0 AS y FROM lineitem")
def q_csv_points(spark, sf):
    return _through_file(spark, "points", lambda p: tx.write_rows(tb.points(spark, sf), p),
                         lambda p: dl.read_points(spark, p))


@query("csv_centers_roundtrip",
       "SELECT CAST(s_suppkey AS INTEGER) AS id, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier")
def q_csv_centers(spark, sf):
    s = tb.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("int").alias("id"), F.col("s_acctbal").alias("x"),
        F.col("s_nationkey").cast("double").alias("y"))
    return _through_file(spark, "centers", lambda p: tx.write_rows(s, p), lambda p: dl.read_centers(spark, p))


@query("params_text_roundtrip", "SELECT l_discount AS theta0, l_tax AS theta1 FROM lineitem")
def q_params_text(spark, sf):
    params = tb.table(spark, sf, "lineitem").select(F.col("l_discount").alias("theta0"),
                                                     F.col("l_tax").alias("theta1"))
    return _through_file(spark, "params", lambda p: tx.write_params(params, p), lambda p: dl.read_params(spark, p))


@query("samples_roundtrip", sql.SAMPLES)
def q_samples_roundtrip(spark, sf):
    return _through_file(spark, "samples", lambda p: tx.write_rows(tb.samples(spark, sf), p),
                         lambda p: dl.read_samples(spark, p))


@query("rows_overwrite", "SELECT CAST(s_suppkey AS INTEGER) AS id, s_acctbal AS x, "
                         "CAST(s_nationkey AS DOUBLE) AS y FROM supplier")
def q_rows_overwrite(spark, sf):
    """A second write to the folder replaces the first."""
    s = tb.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_acctbal").alias("x"),
                                               F.col("s_nationkey").cast("double").alias("y"))

    def write(p):
        tx.write_rows(s.union(s), p)
        tx.write_rows(s, p)
    return _through_file(spark, "overwrite", write, lambda p: dl.read_centers(spark, p))


@query("rows_fail_if_present", "SELECT l_quantity AS x, l_extendedprice / 1000.0 AS y, true AS second_failed FROM lineitem")
def q_rows_fail_if_present(spark, sf):
    """A second write fails and leaves the first as it is."""
    failed = []

    def write(p):
        tx.write_rows(tb.points(spark, sf), p, mode="errorifexists")
        try:
            tx.write_rows(tb.points(spark, sf), p, mode="errorifexists")
        except AnalysisException as e:
            failed.append("PATH_ALREADY_EXISTS" in str(e))
    back = _through_file(spark, "present", write, lambda p: dl.read_points(spark, p))
    return back.withColumn("second_failed", F.lit(failed == [True]))


@query("formatted_file", "SELECT CAST(printf('%.2f', l_quantity) AS DOUBLE) AS x, "
                         "CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS y FROM lineitem")
def q_formatted_file(spark, sf):
    """Two decimals written to files and read back."""
    li = tb.table(spark, sf, "lineitem")
    return _through_file(spark, "formatted", lambda p: tx.write_formatted(li, p, ["l_quantity", "l_extendedprice"]),
                         lambda p: dl.read_points(spark, p))


@query("state_roundtrip", "SELECT DISTINCT l_partkey AS id, 1.0::DOUBLE AS rank FROM lineitem")
def q_state_roundtrip(spark, sf):
    return _through_file(spark, "state", lambda p: st.write_state(g.rank_init(tb.pr_links(spark, sf)), p, "ranks", 1),
                         lambda p: st.read_state(spark, p, "ranks", 1))


@query("formatted_points", "SELECT printf('%.2f %.2f', l_quantity, l_extendedprice) AS value FROM lineitem")
def q_formatted_points(spark, sf):
    li = tb.table(spark, sf, "lineitem")
    return tx.formatted_lines(li, ["l_quantity", "l_extendedprice"])


# --- initial values and adjacency (P1-P4, A4) -----------------------------------

@query("component_init", sql.with_ctes(sql.cc_base(), "SELECT v, comp FROM s0"))
def q_component_init(spark, sf):
    return g.component_init(g.undirected(tb.cc_edges(spark, sf)))


@query("rank_init", sql.with_ctes(sql.pr_base(sql.PR_LINKS), "SELECT id, rank FROM s0"))
def q_rank_init(spark, sf):
    return g.rank_init(tb.pr_links(spark, sf))


@query("delta_init", sql.with_ctes(sql.pr_base(sql.PR_LINKS) + sql.pr_delta_steps(0, 0.1),
                                   "SELECT id, round(delta, 6) AS delta FROM w0"))
def q_delta_init(spark, sf):
    links = tb.pr_links(spark, sf)
    d = g.delta_init(g.rank_init(links), g.num_vertices(links))
    return d.select("id", r6("delta").alias("delta"))


@query("adjacency_list", sql.adjacency(sql.PR_LINKS, LIST_ROWS))
def q_adjacency_list(spark, sf):
    return g.adjacency_list(tb.pr_links(spark, sf), LIST_ROWS)


@query("out_degree", f"SELECT src, count(*) AS deg FROM ({sql.PR_LINKS}) l GROUP BY src")
def q_out_degree(spark, sf):
    return g.out_degree(tb.pr_links(spark, sf))


# --- connected components ----------------------------------------------------------

def _cc_first(spark, sf, **links):
    """Links and the first solution, as the loops start."""
    lk = g.Links(g.undirected(tb.cc_edges(spark, sf)), **links)
    return lk, lk.sources.select(F.col("src").alias("v"), F.col("src").alias("comp"))


@query("cc_candidates", sql.CC_CANDIDATES)
def q_cc_candidates(spark, sf):
    lk, init = _cc_first(spark, sf)
    return g.cc_candidates(init, lk, lk.n_sources)


@query("cc_min_candidate", sql.CC_MIN)
def q_cc_min(spark, sf):
    lk, init = _cc_first(spark, sf)
    return g.cc_min_candidate(g.cc_candidates(init, lk, lk.n_sources))


@query("cc_delta", sql.CC_DELTA)
def q_cc_delta(spark, sf):
    lk, init = _cc_first(spark, sf)
    return g.cc_delta(g.cc_min_candidate(g.cc_candidates(init, lk, lk.n_sources)), init)


@query("cc_update", sql.CC_UPDATE)
def q_cc_update(spark, sf):
    lk, init = _cc_first(spark, sf)
    return g.cc_update(init, g.cc_delta(g.cc_min_candidate(g.cc_candidates(init, lk, lk.n_sources)), init))


@query("cc_relax", sql.CC_RELAX)
def q_cc_relax(spark, sf):
    lk, init = _cc_first(spark, sf)
    return g.cc_relax_step(init, g.cc_candidates(init, lk, lk.n_sources))


@query("cc_bulk", sql.components(CC_STEPS))
def q_cc_bulk(spark, sf):
    return _done(cc.components_bulk(tb.cc_edges(spark, sf), CC_STEPS)).df


@query("cc_delta_iter", sql.components(CC_STEPS))
def q_cc_delta_iter(spark, sf):
    return _done(cc.components_delta(tb.cc_edges(spark, sf), CC_STEPS)).df


@query("cc_staged", sql.components(CC_STEPS))
def q_cc_staged(spark, sf):
    with _folder(spark, "cc") as path:
        return _released(_done(cc.components_staged(tb.cc_edges(spark, sf), path, CC_STEPS)))


@query("cc_resumed", sql.components(CC_STEPS))
def q_cc_resumed(spark, sf):
    """A staged loop that ended after three steps goes on from its files."""
    edges = tb.cc_edges(spark, sf)
    with _folder(spark, "cc-resumed") as path:
        cc.components_staged(edges, path, RESUME_AFTER).extra["release"]()
        return _released(_done(cc.components_staged(edges, path, CC_STEPS, resume=True)))


def _scale_links(edges: DataFrame, split_rows: int | None = None, max_hot: int = 0,
                 symmetric: bool = False) -> g.Links:
    """Links as at scale: every state is shuffled, and with ``split_rows`` hot sources are salted.

    Up to ``max_hot`` of them have a table of their own instead.
    """
    lk = g.Links(edges, split_rows=split_rows, broadcast_state=False, count_vertices=True, max_hot=max_hot,
                 symmetric=symmetric, lists=symmetric)
    if split_rows and not (lk.two_way if max_hot else lk.salted):
        raise RuntimeError("no source is hot; the plan for hot sources would not run")
    return lk


@query("cc_delta_shuffled", sql.components(CC_STEPS))
def q_cc_delta_shuffled(spark, sf):
    und = g.undirected(tb.cc_edges(spark, sf))
    return _done(cc.components_delta(und, CC_STEPS, directed=True, prepared=_scale_links(und, symmetric=True))).df


@query("cc_delta_salted", sql.components(CC_STEPS))
def q_cc_delta_salted(spark, sf):
    und = g.undirected(tb.cc_edges(spark, sf))
    lk = _scale_links(und, SPLIT_ROWS, symmetric=True)
    return _done(cc.components_delta(und, CC_STEPS, directed=True, prepared=lk)).df


@query("cc_delta_hot", sql.components(CC_STEPS))
def q_cc_delta_hot(spark, sf):
    """Hot sources by a broadcast, the others on the partitioning that their state keeps."""
    und = g.undirected(tb.cc_edges(spark, sf))
    lk = _scale_links(und, SPLIT_ROWS, g.MAX_BROADCAST_HOT, symmetric=True)
    return _done(cc.components_delta(und, CC_STEPS, directed=True, prepared=lk)).df


@query("cc_counters", sql.cc_delta_counters(CC_STEPS))
def q_cc_counters(spark, sf):
    """M1 of the components loop: rows in and out of every operator that ran."""
    res = _done(cc.components_delta(tb.cc_edges(spark, sf), CC_STEPS, counters=True))
    return res.stats().where("operator <> 'components-solution'")


@query("cc_delta_lookup", sql.components(CC_STEPS))
def q_cc_delta_lookup(spark, sf):
    """E2 as for large graphs: links and state in files by hash bucket, late steps look up their keys."""
    res = _done(cc.components_delta(tb.cc_edges(spark, sf), CC_STEPS, lookup=True))
    return _released(res)


@query("cc_lookup_counters", sql.cc_delta_counters(CC_STEPS))
def q_cc_lookup_counters(spark, sf):
    """M1 of the same loop: the counters do not depend on the form of a step."""
    res = _done(cc.components_delta(tb.cc_edges(spark, sf), CC_STEPS, lookup=True, counters=True))
    res.extra["release"]()
    return res.stats().where("operator <> 'components-solution'")


# --- PageRank ------------------------------------------------------------------------

def _pr_step_inputs(spark, sf):
    links = tb.pr_links(spark, sf)
    lk = g.Links(links, count_vertices=True)
    return lk, lk.sources.select(F.col("src").alias("id"), F.lit(1.0).alias("rank")), lk.vertex_count


@query("pr_shares", sql.PR_SHARES)
def q_pr_shares(spark, sf):
    lk, ranks, _ = _pr_step_inputs(spark, sf)
    s = g.rank_shares(ranks, lk, lk.n_sources)
    return s.select("id", r6("share").alias("share"))


def _pr_sums(spark, sf):
    lk, ranks, n = _pr_step_inputs(spark, sf)
    return g.sum_shares(g.rank_shares(ranks, lk, lk.n_sources)), ranks, n


@query("pr_sum", sql.PR_SUM)
def q_pr_sum(spark, sf):
    sums, _, _ = _pr_sums(spark, sf)
    return sums.select("id", r6("rank").alias("rank"))


@query("pr_dampen", sql.PR_DAMPEN)
def q_pr_dampen(spark, sf):
    sums, _, n = _pr_sums(spark, sf)
    return g.dampened(sums, n).select("id", r6("rank").alias("rank"))


@query("pr_changed", sql.PR_CHANGED)
def q_pr_changed(spark, sf):
    sums, ranks, n = _pr_sums(spark, sf)
    ch = g.flag_changed(g.dampened(sums, n), ranks)
    return ch.select("id", r6("rank").alias("rank"), "changed")


def _rounded_ranks(df: DataFrame) -> DataFrame:
    return df.select("id", r6("rank").alias("rank"))


@query("pagerank_bulk", sql.pagerank_bulk(sql.PR_LINKS, PR_STEPS))
def q_pagerank_bulk(spark, sf):
    return _rounded_ranks(prp.pagerank_bulk(tb.pr_links(spark, sf), max_iter=PR_STEPS).df)


def _deltas0(spark, sf):
    lk, ranks, n = _pr_step_inputs(spark, sf)
    return lk, ranks, g.delta_init(ranks, n)


@query("prd_shares", sql.PRD_SHARES)
def q_prd_shares(spark, sf):
    lk, _, w0 = _deltas0(spark, sf)
    return g.delta_shares(w0, lk, rows=lk.n_sources).select("id", r6("share").alias("share"))


@query("prd_sum_filter", sql.PRD_SUM_FILTER)
def q_prd_sum_filter(spark, sf):
    lk, _, w0 = _deltas0(spark, sf)
    d = g.sum_and_filter(g.delta_shares(w0, lk, rows=lk.n_sources))
    return d.select("id", r6("delta").alias("delta"))


@query("prd_update", sql.PRD_UPDATE)
def q_prd_update(spark, sf):
    lk, ranks, w0 = _deltas0(spark, sf)
    d = g.sum_and_filter(g.delta_shares(w0, lk, rows=lk.n_sources))
    return _rounded_ranks(g.add_deltas(ranks, d))


@query("pagerank_delta", sql.pagerank_delta(sql.PR_LINKS, PR_STEPS))
def q_pagerank_delta(spark, sf):
    return _rounded_ranks(prp.pagerank_delta(tb.pr_links(spark, sf), max_iter=PR_STEPS).df)


@query("pagerank_staged", sql.pagerank_delta(sql.PR_LINKS, PR_STEPS))
def q_pagerank_staged(spark, sf):
    with _folder(spark, "pagerank") as path:
        return _rounded_ranks(_released(prp.pagerank_staged(tb.pr_links(spark, sf), path, max_iter=PR_STEPS)))


@query("pagerank_resumed", sql.pagerank_delta(sql.PR_LINKS, PR_STEPS))
def q_pagerank_resumed(spark, sf):
    """The staged ranks, in two runs over one folder of state."""
    links = tb.pr_links(spark, sf)
    with _folder(spark, "pagerank-resumed") as path:
        prp.pagerank_staged(links, path, max_iter=RESUME_AFTER).extra["release"]()
        return _rounded_ranks(_released(prp.pagerank_staged(links, path, max_iter=PR_STEPS, resume=True)))


@query("resumed_counters", sql.pagerank_counters(sql.PR_LINKS, PR_STEPS))
def q_resumed_counters(spark, sf):
    """M1 across a restart: the counters of both runs are those of one."""
    links = tb.pr_links(spark, sf)
    with _folder(spark, "counters-resumed") as path:
        for steps in (RESUME_AFTER, PR_STEPS):
            res = prp.pagerank_delta(links, max_iter=steps, state_dir=path, counters=True, resume=True)
            res.extra["release"]()
    return res.stats().where("operator <> 'pagerank-solution'")


def _delta_counts(res) -> list[tuple[int, int]]:
    return [(i, n) for op, i, n in res.counts if op == "pagerank-delta"]


@query("pagerank_active_pages", sql.pagerank_active(sql.PR_LINKS, PR_STEPS))
def q_pagerank_active(spark, sf):
    res = prp.pagerank_delta(tb.pr_links(spark, sf), max_iter=PR_STEPS)
    return spark.createDataFrame(_delta_counts(res), "iteration int, active_pages long")


@query("pagerank_bulk_shuffled", sql.pagerank_bulk(sql.SINK_LINKS, PR_STEPS))
def q_pagerank_bulk_shuffled(spark, sf):
    links = tb.sink_links(spark, sf)
    lk = _scale_links(links)
    return _rounded_ranks(prp.pagerank_bulk(links, lk.vertex_count, PR_STEPS, prepared=lk).df)


@query("pagerank_shuffled", sql.pagerank_delta(sql.PR_LINKS, PR_STEPS))
def q_pagerank_shuffled(spark, sf):
    links = tb.pr_links(spark, sf)
    lk = _scale_links(links)
    return _rounded_ranks(prp.pagerank_delta(links, lk.vertex_count, PR_STEPS, prepared=lk).df)


@query("pagerank_salted", sql.pagerank_delta(sql.PR_LINKS, PR_STEPS))
def q_pagerank_salted(spark, sf):
    links = tb.pr_links(spark, sf)
    lk = _scale_links(links, SPLIT_ROWS)
    return _rounded_ranks(prp.pagerank_delta(links, lk.vertex_count, PR_STEPS, prepared=lk).df)


@query("pagerank_hot", sql.pagerank_delta(sql.PR_LINKS, PR_STEPS))
def q_pagerank_hot(spark, sf):
    links = tb.pr_links(spark, sf)
    lk = _scale_links(links, SPLIT_ROWS, g.MAX_BROADCAST_HOT)
    return _rounded_ranks(prp.pagerank_delta(links, lk.vertex_count, PR_STEPS, prepared=lk).df)


@query("pagerank_threshold_sweep", sql.threshold_sweep(sql.SINK_LINKS, SWEEP_THRESHOLDS, SWEEP_STEPS))
def q_threshold_sweep(spark, sf):
    res = _done(prp.pagerank_delta_sweep(tb.sink_links(spark, sf), SWEEP_THRESHOLDS, max_iter=SWEEP_STEPS))
    return res.df.select("threshold", "id", r6("rank").alias("rank"))


@query("repartitioned_pagerank", sql.pagerank_delta(sql.PR_LINKS, PR_STEPS))
def q_repartitioned_pagerank(spark, sf):
    res = prp.pagerank_delta(tb.pr_links(spark, sf), max_iter=PR_STEPS,
                             partitions=lambda i: 2 + 2 * (i % 4))
    return _rounded_ranks(res.df)


# --- counters (M1, M2) ------------------------------------------------------------------

def _pagerank_counters(spark, sf) -> DataFrame:
    res = prp.pagerank_delta(tb.pr_links(spark, sf), max_iter=PR_STEPS, counters=True)
    return res.stats().where("operator <> 'pagerank-solution'")


@query("iteration_stats", sql.pagerank_counters(sql.PR_LINKS, PR_STEPS))
def q_iteration_stats(spark, sf):
    """M1: rows in and out of every operator, executed supersteps only, and the first workset."""
    return _pagerank_counters(spark, sf)


@query("iteration_stats_sorted", sql.pagerank_counters(sql.PR_LINKS, PR_STEPS, dump=True))
def q_iteration_stats_sorted(spark, sf):
    """M2: the dump of all counters, sorted by name."""
    c = _pagerank_counters(spark, sf)
    return c.select(F.concat_ws("", "operator", F.lit("-iter_"), "iteration").alias("name"),
                    F.col("rows").alias("value")).orderBy("name")


@query("iteration_partition_stats", sql.delta_totals(sql.PR_LINKS, PR_STEPS))
def q_iteration_partition_stats(spark, sf):
    """M1 per subtask, summed over the partitions, whose assignment is engine-specific."""
    res = prp.pagerank_delta(tb.pr_links(spark, sf), max_iter=PR_STEPS, partition_stats=True)
    return res.partition_stats().groupBy("operator", "iteration").agg(F.sum("rows").alias("rows"))


@query("pagerank_adaptive", sql.pagerank_delta(sql.PR_LINKS, PR_STEPS))
def q_pagerank_adaptive(spark, sf):
    with _folder(spark, "pagerank-adaptive") as path:
        res = prp.pagerank_staged(tb.pr_links(spark, sf), path, max_iter=PR_STEPS, adaptive_rows=250)
        return _rounded_ranks(res.df).checkpoint()


@query("pagerank_measured", sql.pagerank_delta(sql.PR_LINKS, PR_STEPS))
def q_pagerank_measured(spark, sf):
    """The same for the steps of the staged delta loop."""
    with _folder(spark, "pagerank-measured") as path:
        res = prp.pagerank_staged(tb.pr_links(spark, sf), path, max_iter=PR_STEPS, partitions=_measured(spark))
        return _rounded_ranks(res.df).checkpoint()


@query("duplicate_value",
       f"SELECT DISTINCT id AS v, id AS comp FROM (SELECT src AS id FROM ({sql.PR_LINKS}) a "
       f"UNION ALL SELECT dst AS id FROM ({sql.PR_LINKS}) b) u")
def q_duplicate_value(spark, sf):
    from stepwise.functions.columns import duplicate_value
    return g.vertices(tb.pr_links(spark, sf)).select(*duplicate_value("id"))


# --- k-means -------------------------------------------------------------------------------

def _km_points(spark, sf):
    return tb.points(spark, sf)


@query("km_distance", sql.km_distance(KM_START))
def q_km_distance(spark, sf):
    p = _km_points(spark, sf)
    return p.select("x", "y", r6(km.nearest_distance(KM_START)).alias("distance"))


@query("km_assign", sql.km_assign(KM_START))
def q_km_assign(spark, sf):
    return km.assign(_km_points(spark, sf), KM_START).select("x", "y", "cluster")


@query("km_sums", sql.km_sums(KM_START))
def q_km_sums(spark, sf):
    s = km.cluster_sums(km.assign(_km_points(spark, sf), KM_START))
    return s.select(F.col("id").cast("int").alias("id"), r6("sum_x").alias("sum_x"),
                    r6("sum_y").alias("sum_y"), "n")


def _rounded_centers(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("int").alias("id"), r6("x").alias("x"), r6("y").alias("y"))


@query("km_means", sql.km_means(KM_START))
def q_km_means(spark, sf):
    return _rounded_centers(km.kmeans_step(_km_points(spark, sf), KM_START))


def _start_centers(spark):
    return spark.createDataFrame(KM_START, dl.CENTER_SCHEMA)


@query("kmeans_bulk", sql.km_assignment(KM_START, KM_STEPS))
def q_kmeans_bulk(spark, sf):
    pts = _km_points(spark, sf)
    res = kmp.kmeans_bulk(pts, _start_centers(spark), KM_STEPS)
    return kmp.final_assignment(res.extra["points"], res).select("x", "y", "cluster")


def _many_centers(spark, sf):
    return tb.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("int").alias("id"), (F.col("c_custkey") % 50 + 0.5).alias("x"),
        (F.col("c_custkey") % 97 + 0.25).alias("y"))


@query("kmeans_many_centers", sql.km_assignment(sql.MANY_CENTERS, KM_STEPS))
def q_kmeans_many_centers(spark, sf):
    res = kmp.kmeans_bulk(_km_points(spark, sf), _many_centers(spark, sf), KM_STEPS)
    return kmp.final_assignment(res.extra["points"], res).select("x", "y", "cluster")


@query("kmeans_joined_centers", sql.km_assignment(sql.MANY_CENTERS, KM_STEPS))
def q_kmeans_joined_centers(spark, sf):
    """The same centers as a DataFrame that never reaches the driver, as any number of them would be."""
    res = kmp.kmeans_bulk(_km_points(spark, sf), _many_centers(spark, sf), KM_STEPS, joined=True)
    return kmp.final_assignment(res.extra["points"], res).select("x", "y", "cluster")


@query("kmeans_adaptive", sql.km_assignment(KM_START, KM_STEPS))
def q_kmeans_adaptive(spark, sf):
    pts = _km_points(spark, sf)
    with _folder(spark, "kmeans") as path:
        res = kmp.kmeans_staged(pts, _start_centers(spark), path, KM_STEPS, adaptive_rows=20_000)
    return kmp.final_assignment(res.extra["points"], res).select("x", "y", "cluster")


@query("kmeans_measured", sql.km_assignment(KM_START, KM_STEPS))
def q_kmeans_measured(spark, sf):
    """The CPU use of a step sets the parallelism of the next, from a quarter of the cores on."""
    pts = _km_points(spark, sf)
    with _folder(spark, "kmeans") as path:
        res = kmp.kmeans_staged(pts, _start_centers(spark), path, KM_STEPS, partitions=_measured(spark))
    return kmp.final_assignment(res.extra["points"], res).select("x", "y", "cluster")


@query("kmeans_staged", sql.km_assignment(KM_START, KM_STEPS))
def q_kmeans_staged(spark, sf):
    pts = _km_points(spark, sf)
    with _folder(spark, "kmeans") as path:
        res = kmp.kmeans_staged(pts, _start_centers(spark), path, KM_STEPS)
    return kmp.final_assignment(res.extra["points"], res).select("x", "y", "cluster")


@query("kmeans_centers", sql.km_centers(KM_START, KM_STEPS))
def q_kmeans_centers(spark, sf):
    res = kmp.kmeans_bulk(_km_points(spark, sf), _start_centers(spark), KM_STEPS)
    return _rounded_centers(res.df)


# --- linear regression ------------------------------------------------------------------------

def _rounded_params(df: DataFrame) -> DataFrame:
    return df.select(r6("theta0").alias("theta0"), r6("theta1").alias("theta1"))


@query("lr_step", sql.lr_step(LR_START))
def q_lr_step(spark, sf):
    return _rounded_params(lr.sample_steps(tb.samples(spark, sf), *LR_START))


@query("lr_sums", sql.lr_sums(LR_START))
def q_lr_sums(spark, sf):
    s = lr.step_sums(lr.sample_steps(tb.samples(spark, sf), *LR_START))
    return s.select(r6("sum_t0").alias("sum_t0"), r6("sum_t1").alias("sum_t1"), "n")


@query("lr_update", sql.linreg(LR_START, 1))
def q_lr_update(spark, sf):
    return _rounded_params(lr.regression_step(tb.samples(spark, sf), *LR_START))


@query("linreg_bulk", sql.linreg(LR_START, LR_STEPS))
def q_linreg_bulk(spark, sf):
    return _rounded_params(lrp.linreg_bulk(tb.samples(spark, sf), LR_START, LR_STEPS).df)


@query("linreg_staged", sql.linreg(LR_START, LR_STEPS))
def q_linreg_staged(spark, sf):
    with _folder(spark, "linreg") as path:
        return _rounded_params(lrp.linreg_staged(tb.samples(spark, sf), LR_START, path, LR_STEPS).df)


# --- generators (G1-G7) -----------------------------------------------------------------------

SUPPLIER_IDS = "SELECT s_suppkey AS id FROM supplier"


def _supplier_ids(spark, sf):
    return tb.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))


def _rounded_xy(df: DataFrame) -> DataFrame:
    return df.select("id", r6("x").alias("x"), r6("y").alias("y"))


@query("gen_centers", sql.gen_centers(SUPPLIER_IDS, "centers"))
def q_gen_centers(spark, sf):
    return _rounded_xy(gen.centers_for(_supplier_ids(spark, sf), "centers"))


@query("gen_start_centers", sql.gen_centers(SUPPLIER_IDS, "start"))
def q_gen_start_centers(spark, sf):
    return _rounded_xy(gen.centers_for(_supplier_ids(spark, sf), "start"))


def _gen_means(spark, k: int) -> list[tuple[int, float, float]]:
    rows = gen.uniform_centers(spark, k).collect()      # k rows
    return sorted((int(r["id"]), float(r["x"]), float(r["y"])) for r in rows)


@query("gen_points_skewed",
       sql.gen_points(sql.ROW_IDS, "SELECT range AS id FROM range(5)", "CASE id WHEN 0 THEN 5 WHEN 4 THEN 2 ELSE 1 END"))
def q_gen_points_skewed(spark, sf):
    return _rounded_xy(gen.points_for(tb.row_ids(spark, sf), _gen_means(spark, GEN_MEANS_K), GEN_SKEW))


@query("gen_points_many_means",
       sql.gen_points(sql.ROW_IDS, "SELECT range AS id FROM range((SELECT count(*) FROM part))", "1 + id % 7"))
def q_gen_points_many_means(spark, sf):
    k = tb.table(spark, sf, "part").count()
    means = gen.centers_for(gen.ids(spark, k)).withColumn("weight", (1 + F.col("id") % 7).cast("long"))
    return _rounded_xy(gen.points_for_table(tb.row_ids(spark, sf), means))


@query("gen_samples_seeded", sql.gen_samples(sql.ROW_IDS, "42/samples"))
def q_gen_samples_seeded(spark, sf):
    return _rounded_xy(gen.samples_for(tb.row_ids(spark, sf), seed=42))


@query("gen_samples", sql.gen_samples(sql.ROW_IDS))
def q_gen_samples(spark, sf):
    return _rounded_xy(gen.samples_for(tb.row_ids(spark, sf)))


@query("gen_uniform", sql.gen_uniform(sql.ROW_IDS))
def q_gen_uniform(spark, sf):
    u = gen.uniform_for(tb.row_ids(spark, sf))
    return u.select("id", r6("u").alias("u"))


# --- reports (J10, A11, A12, M3-M5) ---------------------------------------------------------------

RUNTIME_SQL = """
SELECT c_mktsegment AS suite, c_name AS name,
       CAST(min(t) AS INTEGER) AS min_time, CAST(max(t) AS INTEGER) AS max_time,
       CAST(sum(t) - min(t) - max(t) AS BIGINT) AS median_time,
       CAST(median(t) AS DOUBLE) AS p50_time
FROM customer JOIN (SELECT o_custkey, CAST(floor(o_totalprice) AS INTEGER) AS t FROM orders) r
  ON c_custkey = r.o_custkey
GROUP BY c_mktsegment, c_name
ORDER BY suite, name"""


@query("runtime_report", RUNTIME_SQL)
def q_runtime_report(spark, sf):
    return rp.runtime_report(tb.experiments(spark, sf), tb.experiment_runs(spark, sf))


@query("runtime_report_suite", RUNTIME_SQL.replace("GROUP BY", "WHERE c_mktsegment = 'BUILDING'\nGROUP BY"))
def q_runtime_report_suite(spark, sf):
    return rp.runtime_report(tb.experiments(spark, sf), tb.experiment_runs(spark, sf), "BUILDING")


CPU_AVG_CTE = ("wa AS MATERIALIZED (SELECT job, iteration, worker, avg(sample) AS worker_avg "
               f"FROM ({sql.CPU}) c GROUP BY job, iteration, worker), "
               "ca AS MATERIALIZED (SELECT job, iteration, avg(worker_avg) AS utilization, "
               "count(*) AS workers FROM wa GROUP BY job, iteration)")


@query("cpu_averages", f"WITH {CPU_AVG_CTE} SELECT job, iteration, round(utilization, 6) AS utilization, "
                       "workers FROM ca")
def q_cpu_averages(spark, sf):
    a = rp.cpu_averages(tb.cpu_samples(spark, sf))
    return a.select("job", "iteration", r6("utilization").alias("utilization"), "workers")


JOBS_SQL = ("SELECT job, CAST(length(job) * 4 AS INTEGER) AS current, 320 AS slots FROM "
            "(SELECT event_type AS job FROM events UNION SELECT o_orderpriority AS job FROM orders) u")
PROPOSAL_SQL = (
    f"WITH {CPU_AVG_CTE}, raw AS (SELECT j.job, ca.iteration, ca.utilization, j.slots, "
    f"CAST(floor((ca.utilization / 0.7::DOUBLE) * j.current) AS INTEGER) AS p "
    f"FROM ({JOBS_SQL}) j LEFT JOIN ca ON ca.job = j.job) "
    "SELECT job, iteration, round(utilization, 6) AS utilization, "
    "CAST(CASE WHEN p IS NULL THEN -1 ELSE greatest(least(p, slots), 8) END AS INTEGER) AS parallelism FROM raw")


@query("parallelism_proposal", PROPOSAL_SQL)
def q_parallelism_proposal(spark, sf):
    p = rp.parallelism_proposal(tb.cpu_samples(spark, sf), tb.job_slots(spark, sf))
    return p.select("job", "iteration", r6("utilization").alias("utilization"), "parallelism")


SUMMARY_SQL = (
    f"WITH {CPU_AVG_CTE}, rt AS (SELECT job, iteration, "
    "CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS BIGINT) AS runtime_ms "
    f"FROM ({sql.CPU}) c GROUP BY job, iteration), "
    "ov AS (SELECT job, avg(utilization) AS job_utilization FROM ca GROUP BY job) "
    "SELECT ca.job, ca.iteration, ca.workers, round(ca.utilization, 6) AS utilization, rt.runtime_ms, "
    "round(ov.job_utilization, 6) AS job_utilization, j.current AS parallelism "
    "FROM ca JOIN rt USING (job, iteration) JOIN ov ON ov.job = ca.job "
    f"JOIN ({JOBS_SQL}) j ON j.job = ca.job")


@query("execution_summary", SUMMARY_SQL)
def q_execution_summary(spark, sf):
    e = tb.table(spark, sf, "events")
    ts = e.select(F.col("event_type").alias("job"), F.dayofyear("ts").alias("iteration"), "ts")
    s = rp.execution_summary(tb.cpu_samples(spark, sf), ts, tb.job_slots(spark, sf))
    return s.select("job", "iteration", "workers", r6("utilization").alias("utilization"),
                    "runtime_ms", r6("job_utilization").alias("job_utilization"), "parallelism")
