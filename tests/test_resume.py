"""Staged loops that are stopped and go on from their files."""

import random

import pytest

from stepwise.operators import graph as g
from stepwise.plans import components as cc
from stepwise.plans import iterate as it
from stepwise.plans import kmeans as kmp
from stepwise.plans import linreg as lrp
from stepwise.plans import pagerank as pr
from conftest import rows


class Lost(Exception):
    """Stands for the loss of the driver."""


def dies_in(monkeypatch, module, name, call):
    """``module.name`` raises at its ``call``-th call."""
    real, seen = getattr(module, name), []

    def run(*a, **k):
        seen.append(1)
        if len(seen) == call:
            raise Lost
        return real(*a, **k)

    monkeypatch.setattr(module, name, run)


@pytest.fixture(scope="module")
def chain(spark):
    """Two chains, a loop and a link back."""
    pairs = [(i, i + 1) for i in range(1, 10) if i != 6] + [(2, 2), (8, 7)]
    return spark.createDataFrame(pairs, "src long, dst long").cache()


@pytest.mark.parametrize("at", [1, 4])
def test_components_go_on_after_a_loss(spark, chain, tmp_path, monkeypatch, at):
    partitions = (lambda i: 3) if at == 1 else None
    want = cc.components_bulk(chain, 20)
    with monkeypatch.context() as m:
        dies_in(m, it, "save_counted", at)
        with pytest.raises(Lost):
            cc.components_staged(chain, str(tmp_path), 20, partitions=partitions)
    saved = []
    real = it.save_counted
    monkeypatch.setattr(it, "save_counted", lambda *a, **k: saved.append(a[3]) or real(*a, **k))
    res = cc.components_staged(chain, str(tmp_path), 20, partitions=partitions, resume=True)
    assert res.converged and rows(res.df, "v", "comp") == rows(want.df, "v", "comp")
    assert min(saved) >= at // 2 and len(saved) < 2 * res.iterations      # finished steps are not run again
    assert [n for op, _, n in res.counts if op == "components-delta"][-1] == 0
    again = cc.components_staged(chain, str(tmp_path), 20, partitions=partitions, resume=True)
    assert again.iterations == res.iterations and again.step_ms == []
    assert rows(again.df, "v", "comp") == rows(want.df, "v", "comp")


@pytest.mark.parametrize("first,second", [(2, 4)])
def test_ranks_and_counters_of_two_runs(spark, chain, tmp_path, first, second):
    one = pr.pagerank_delta(chain, max_iter=second, threshold=1e-3, state_dir=str(tmp_path / "one"), counters=True)
    for steps in (first, second):
        two = pr.pagerank_delta(chain, max_iter=steps, threshold=1e-3, state_dir=str(tmp_path / "two"),
                                counters=True, resume=True)
    assert rows(one.df, nd=9) == rows(two.df, nd=9)
    drop = lambda res: [c for c in res.counts if c[0] != "pagerank-solution"]
    assert drop(one) == drop(two)


def test_resume_with_other_partitions_and_hot_sources(spark, chain, tmp_path):
    und = g.undirected(chain)
    want = rows(cc.components_bulk(chain, 20).df, "v", "comp")
    for n, prepared in enumerate([g.Links(und, partitions=7), g.Links(und, split_rows=3)]):
        path = str(tmp_path / str(n))
        cc.components_staged(chain, path, 2)
        res = cc.components_staged(und, path, 20, directed=True, prepared=prepared, resume=True)
        assert rows(res.df, "v", "comp") == want


def test_bulk_loops_go_on(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    pts = spark.createDataFrame([(r.random() * 9, r.random() * 9) for _ in range(300)], "x double, y double")
    centers = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 8.0, 2.0)], "id int, x double, y double")
    samples = spark.createDataFrame([(x / 9, x / 3 + 1) for x in range(50)], "x double, y double")
    runs = {"km": lambda p, n, resume: kmp.kmeans_staged(pts, centers, p, n, resume=resume).df,
            "joined": lambda p, n, resume: kmp.kmeans_staged(pts, centers, p, n, joined=True, resume=resume).df,
            "lr": lambda p, n, resume: lrp.linreg_staged(samples, (0.0, 0.0), p, n, resume=resume).df}
    for name, run in runs.items():
        want = rows(run(str(tmp_path / (name + "1")), 3, False), nd=9)
        with monkeypatch.context() as m:
            dies_in(m, it, "save_counted", 2)
            with pytest.raises(Lost):
                run(str(tmp_path / name), 3, False)
        assert rows(run(str(tmp_path / name), 3, True), nd=9) == want


def test_a_new_run_forgets_the_old_records(spark, chain, tmp_path):
    cc.components_staged(chain, str(tmp_path), 3)
    cc.components_staged(chain, str(tmp_path), 2)
    assert it.Commits(spark, str(tmp_path), "components").last()["iteration"] == 2


def test_a_loop_without_files_cannot_be_resumed(chain):
    with pytest.raises(ValueError, match="keeps every step"):
        cc.components_delta(chain, 3, resume=True)
