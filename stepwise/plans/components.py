"""Connected components: bulk (E1), delta (E2) and staged."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.operators import graph as g
from stepwise.plans.iterate import (
    BucketStore, IterationResult, ParquetStore, StateStore, bulk_iterate, delta_iterate,
)


def _prepare(edges: DataFrame, prepared: g.Links | None, directed: bool):
    und = edges if directed else g.undirected(edges)
    return und, (prepared or g.Links(und, symmetric=not directed, lists=True))


def _useful(offers: DataFrame) -> DataFrame:
    """Offers that may be smaller than the component of their vertex, which is never above its id."""
    return offers.where(F.col("comp") < F.col("v"))


def components_bulk(edges: DataFrame, max_iter: int = 10, *, directed: bool = False,
                    store: StateStore | None = None, prepared: g.Links | None = None,
                    partitions: Callable[[int], int | None] | None = None) -> IterationResult:
    """Every vertex offers its component to all neighbours each step.

    Ends after the first step in which no component got smaller.
    """
    und, lk = _prepare(edges, prepared, directed)

    def step(sol: DataFrame, i: int, rows: int | None = None) -> DataFrame:
        first = i == 1 and lk.symmetric
        return g.cc_relax_step(sol, _useful(g.cc_first_least(lk) if first else g.cc_candidates(sol, lk, rows)))

    init = lk.sources.select(F.col("src").alias("v"), F.col("src").alias("comp"))
    try:
        return bulk_iterate(init, step, max_iter, stop_flag="changed",
                            store=store, partitions=partitions, layout=lk.layout,
                            initial_rows=lk.n_sources, name="components")
    finally:
        if prepared is None:
            lk.unpersist()


def components_delta(edges: DataFrame, max_iter: int = 10, *, directed: bool = False,
                     store: StateStore | None = None, prepared: g.Links | None = None,
                     state_dir: str | None = None, lookup: bool | None = None,
                     partitions: Callable[[int], int | None] | None = None,
                     counters: bool = False, partition_stats: bool = False,
                     resume: bool = False) -> IterationResult:
    """Only vertices whose component changed offer it again.

    A step joins the workset to its links (J1), takes the minimum per target
    (A1) and keeps what is smaller than the solution's component (J2); that is
    the delta and the next workset.  Ends on an empty delta.

    While much of the solution changes a step writes the next solution, from
    which the changed rows are read; later it writes its delta, which is merged
    (J3) into the solution when that is read.  With ``lookup`` (by default from
    ``LOOKUP_LINKS`` links on) links and state lie in files by hash bucket, and a
    workset of a few rows reads the links and components of its own keys only.
    Prepared links, hot sources and given ``partitions`` or stores scan all
    links.  ``state_dir`` keeps all state files, from which ``resume`` goes on.
    """
    und = edges if directed else g.undirected(edges)
    spark, files = edges.sparkSession, []

    def in_files(table: DataFrame, key: str, n: int) -> DataFrame:
        files.append(BucketStore(spark, key, n))
        return files[0].save(table, "links", 0)

    own = prepared is None and store is None and partitions is None
    lk = prepared or g.Links(und, save=in_files if own and lookup is not False else None,
                             save_from=0 if lookup else g.LOOKUP_LINKS, symmetric=not directed, lists=True)
    if store is None and own and lk.layout and (state_dir or lk.in_files):
        store = BucketStore(spark, "v", lk.layout, state_dir)
        files.append(store)
    elif store is None and state_dir:
        store = ParquetStore(state_dir)
    init = lk.sources.select(F.col("src").alias("v"), F.col("src").alias("comp"))

    def offers(ws: DataFrame, rows, meter) -> DataFrame:
        made = meter(g.cc_candidates(meter(ws, "workset-in"), lk, rows), "candidates-out")
        return made if counters else _useful(made)      # counters tell of every offer

    def step(sol: DataFrame, ws: DataFrame, i: int, rows: int | None = None, meter=None):
        delta = g.cc_delta(meter(g.cc_min_candidate(offers(ws, rows, meter)), "minima-out"), sol)
        return delta, delta

    def rewrite(sol: DataFrame, ws: DataFrame, i: int, rows: int | None = None, meter=None):
        if i == 1 and lk.symmetric:     # workset and solution are the same rows
            made = meter(g.cc_first_candidates(lk), "candidates-out") if counters else _useful(g.cc_first_least(lk))
            return g.cc_relax_step(meter(ws, "workset-in"), made, meter=meter)
        return g.cc_relax_step(sol, offers(ws, rows, meter), meter=meter)

    def tail(sol: DataFrame, rows: list, i: int, meter=None):
        return g.cc_tail(sol, rows, lk, meter)

    try:
        res = delta_iterate(init, init, step, max_iter, key="v", merge=g.cc_update, fold=g.cc_fold,
                            rewrite=rewrite, tail=tail if lk.in_files else None, store=store,
                            save_final=state_dir is not None, partitions=partitions, layout=lk.layout,
                            counters=counters, partition_stats=partition_stats, initial_rows=lk.n_sources,
                            resume=resume, name="components")
    finally:
        if prepared is None:
            lk.unpersist()
        if lk.in_files and files:
            files[0].close()
    res.extra["release"] = lambda: [f.close() for f in files]
    return res


def components_staged(edges: DataFrame, state_dir: str, max_iter: int = 10, *,
                      directed: bool = False, prepared: g.Links | None = None,
                      partitions: Callable[[int], int | None] | None = None,
                      resume: bool = False) -> IterationResult:
    """The delta job with its state in files: the delta of every step that
    writes one (``components-delta``) and the merged solution whenever the
    deltas outgrow it and at the end (``components-solution``).

    Stops on an empty delta (the result is the same as running all steps).
    ``resume`` goes on after the last finished step in ``state_dir``.
    """
    return components_delta(edges, max_iter, directed=directed, state_dir=state_dir, prepared=prepared,
                            partitions=partitions, resume=resume)
