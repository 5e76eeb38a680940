import __spark_entry__ as se
from conftest import SF001


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["id", "rank"]
    assert df.count() > 0


def test_registry_has_sql_for_every_query():
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_queries_run_at_smallest_scale(spark):
    q = se.queries()
    for name in ["edges_text_parse", "cc_update", "pr_changed", "km_sums", "lr_update",
                 "gen_uniform", "runtime_report", "execution_summary"]:
        assert q[name](spark, SF001).count() >= 0
