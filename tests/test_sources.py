import pytest

from conftest import rows
from stepwise.operators.graph import undirected
from stepwise.sources import delimited as dl
from stepwise.sources import state as st
from stepwise.sources import text as tx


def test_f1_edge_text(edges_t):
    assert rows(edges_t) == sorted([(1, 2), (2, 12), (1, 12), (42, 63)])


def test_undirected(edges_t):
    got = rows(undirected(edges_t))
    assert len(got) == 8 and (2, 1) in got and (63, 42) in got


def test_bad_id_fails(spark, tmp_path):
    p = tmp_path / "bad.txt"
    p.write_text("1\tx\n")
    with pytest.raises(Exception):
        tx.read_edges(spark, str(p)).collect()


def test_points_centers_samples_roundtrip(spark, tmp_path):
    pts = spark.createDataFrame([(1.2, 2.3), (5.3, 7.2)], dl.POINT_SCHEMA)
    tx.write_rows(pts, str(tmp_path / "p"))
    assert rows(dl.read_points(spark, str(tmp_path / "p"))) == [(1.2, 2.3), (5.3, 7.2)]
    c = spark.createDataFrame([(1, 6.2, 3.2), (2, 2.9, 5.7)], dl.CENTER_SCHEMA)
    tx.write_rows(c, str(tmp_path / "c"))
    assert rows(dl.read_centers(spark, str(tmp_path / "c"))) == [(1, 6.2, 3.2), (2, 2.9, 5.7)]
    s = spark.createDataFrame([(-0.02, -0.04), (5.3, 10.6)], dl.SAMPLE_SCHEMA)
    tx.write_rows(s, str(tmp_path / "s"))
    assert rows(dl.read_samples(spark, str(tmp_path / "s"))) == [(-0.02, -0.04), (5.3, 10.6)]


def test_write_fails_if_exists(spark, tmp_path):
    pts = spark.createDataFrame([(1.0, 2.0)], dl.POINT_SCHEMA)
    tx.write_rows(pts, str(tmp_path / "p"), mode="errorifexists")
    with pytest.raises(Exception):
        tx.write_rows(pts, str(tmp_path / "p"), mode="errorifexists")
    tx.write_rows(pts, str(tmp_path / "p"))          # overwrite is fine


def test_params_text(spark, tmp_path):
    p = spark.createDataFrame([(0.0528, 0.280904)], dl.PARAMS_SCHEMA)
    tx.write_params(p, str(tmp_path / "params"))
    assert spark.read.text(str(tmp_path / "params")).first()[0] == "0.0528 0.280904"
    assert rows(dl.read_params(spark, str(tmp_path / "params"))) == [(0.0528, 0.280904)]


def test_two_decimals_half_even(spark):
    df = spark.createDataFrame([(0.125, 0.375, 1234.5)], "a double, b double, c double")
    got = tx.formatted_lines(df, ["a", "b", "c"]).first()[0]
    assert got == "0.12 0.38 1234.50"
    ids = spark.createDataFrame([(1000, 1.0, 2.0)], "id int, x double, y double")
    assert tx.formatted_lines(ids, ["x", "y"], id_col="id").first()[0] == "1000 1.00 2.00"


def test_state_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 0.5)], "id long, rank double")
    st.write_state(df, str(tmp_path), "ranks", 3)
    back = st.read_state(spark, str(tmp_path), "ranks", 3)
    assert rows(back) == [(1, 1.0), (2, 0.5)]
    assert back.schema == st.STATE_SCHEMAS["ranks"]
