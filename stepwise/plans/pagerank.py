"""PageRank jobs: bulk (E4), delta (E5) and staged delta."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.functions.columns import DAMPENING, DELTA_THRESHOLD, EPSILON
from stepwise.operators import graph as g
from stepwise.plans.iterate import (
    BucketStore, IterationResult, ParquetStore, StateStore, bulk_iterate, by_rows, delta_iterate,
)

# Rows of the delta log, as a multiple of the ranks, that are added up in one pass.
LOG_SHARE = 4.0


def pagerank_bulk(links: DataFrame, num_pages: int | None = None, max_iter: int = 10,
                  d: float = DAMPENING, eps: float = EPSILON,
                  store: StateStore | None = None, prepared: g.Links | None = None,
                  partitions: Callable[[int], int | None] | None = None) -> IterationResult:
    """Bulk PageRank with the epsilon stop test.

    Ranks start at 1.0 on pages with out-links; a page that receives no rank
    in a step leaves the state; the loop ends after the first step in which
    no page present in both steps moved by more than ``eps``.
    """
    lk = prepared or g.Links(links, count_vertices=num_pages is None)
    n = num_pages or lk.vertex_count or lk.count_vertices()

    def step(ranks: DataFrame, i: int, rows: int | None = None) -> DataFrame:
        return g.flag_changed(g.bulk_rank_step(ranks, lk, n, d, rows), ranks, eps)

    ranks = lk.sources.select(F.col("src").alias("id"), F.lit(1.0).alias("rank"))
    try:
        res = bulk_iterate(ranks, step, max_iter, stop_flag="changed",
                           store=store, partitions=partitions, layout=lk.layout,
                           initial_rows=lk.n_sources, name="ranks")
    finally:
        if prepared is None:
            lk.unpersist()
    res.extra["num_pages"] = n
    return res


def pagerank_delta(links: DataFrame, num_pages: int | None = None, max_iter: int = 10,
                   threshold: float = DELTA_THRESHOLD, d: float = DAMPENING,
                   store: StateStore | None = None, prepared: g.Links | None = None,
                   state_dir: str | None = None,
                   partitions: Callable[[int], int | None] | None = None,
                   counters: bool = False, partition_stats: bool = False,
                   resume: bool = False) -> IterationResult:
    """E5: delta PageRank.

    The workset holds rank deltas; each step spreads ``d * delta / deg``,
    sums per page and keeps sums above ``threshold``.  Those deltas are added
    to the ranks of pages already in the solution (pages with out-links) and
    form the next workset, sinks included.  Ends on an empty workset.

    Steps do not read the ranks, so deltas stay a log that is added up once it
    is ``LOG_SHARE`` times the ranks, and when the result is read.  ``state_dir``
    keeps the state in files: by hash bucket, read without a shuffle, unless
    ``partitions`` are given; ``resume`` goes on from them.
    """
    lk = prepared or g.Links(links, count_vertices=num_pages is None)
    if store is None and state_dir:
        store = (BucketStore(links.sparkSession, "id", lk.layout, state_dir) if lk.layout and partitions is None
                 else ParquetStore(state_dir))
    n = num_pages or lk.vertex_count or lk.count_vertices()
    ranks = lk.sources.select(F.col("src").alias("id"), F.lit(1.0).alias("rank"))
    deltas = g.delta_init(ranks, n)

    def step(solution: DataFrame, workset: DataFrame, i: int, rows: int | None = None, meter=None):
        shares = meter(g.delta_shares(meter(workset, "workset-in"), lk, d, rows), "shares-out")
        new = g.sum_and_filter(shares, threshold)
        return new, new

    try:
        res = delta_iterate(ranks, deltas, step, max_iter, key="id", merge=g.add_deltas, fold=g.fold_deltas,
                            store=store, compact_share=LOG_SHARE,
                            save_final=state_dir is not None, partitions=partitions, layout=lk.layout,
                            counters=counters, partition_stats=partition_stats,
                            initial_rows=lk.n_sources, resume=resume, name="pagerank")
    finally:
        if prepared is None:
            lk.unpersist()
    res.extra["release"] = getattr(store, "close", lambda: None)
    res.extra["num_pages"] = n
    return res


def pagerank_staged(links: DataFrame, state_dir: str, num_pages: int | None = None,
                    max_iter: int = 10, threshold: float = DELTA_THRESHOLD,
                    d: float = DAMPENING, prepared: g.Links | None = None,
                    partitions: Callable[[int], int | None] | None = None,
                    adaptive_rows: int | None = None, resume: bool = False) -> IterationResult:
    """Delta PageRank, one job per step, state in Parquet per step.

    Every step writes its deltas, the ranks are written when the deltas outgrow
    them and at the end, so the result equals ``pagerank_delta``; the stop test
    uses the delta count observed while the delta is written.  ``adaptive_rows`` sets each step's
    parallelism from the previous step's workset (``by_rows``),
    ``partitions=Measured(spark, start)`` from its CPU use.  ``resume`` goes on after the last finished step in ``state_dir``.
    """
    if adaptive_rows and partitions is None:
        partitions = by_rows(adaptive_rows)
    return pagerank_delta(links, num_pages, max_iter, threshold, d, state_dir=state_dir,
                          prepared=prepared, partitions=partitions, resume=resume)


def pagerank_delta_sweep(links: DataFrame, thresholds: list[float],
                         num_pages: int | None = None, max_iter: int = 10,
                         d: float = DAMPENING, store: StateStore | None = None,
                         prepared: g.Links | None = None) -> IterationResult:
    """E5 for several thresholds in one loop.

    Ranks and deltas are tagged with their threshold (``threshold, id``
    keys); every superstep advances all runs in one job and the loop ends
    when every run's workset is empty.  The result is ``threshold, id, rank``
    and equals separate runs.
    """
    lk = prepared or g.Links(links, count_vertices=num_pages is None)
    n = num_pages or lk.vertex_count or lk.count_vertices()
    tags = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    start = lk.sources.select(F.col("src").alias("id"), F.lit(1.0).alias("rank"))
    ranks = start.select(tags, "id", "rank")
    deltas = g.delta_init(start, n).select(tags, "id", "delta")
    keys = ("threshold", "id")

    def step(solution: DataFrame, workset: DataFrame, i: int, rows: int | None = None):
        new = g.sum_and_filter(g.delta_shares(workset, lk, d, rows), keys=keys)
        return new, new

    try:
        res = delta_iterate(ranks, deltas, step, max_iter, key="id",
                            merge=lambda s, dl: g.add_deltas(s, dl, keys), store=store,
                            compact_share=0.0, layout=lk.layout,
                            initial_rows=lk.n_sources * len(thresholds), name="pagerank")
    finally:
        if prepared is None:
            lk.unpersist()
    res.extra["num_pages"] = n
    return res
