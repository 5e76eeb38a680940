from conftest import EDGE_TEXT, rows
from stepwise import jobs
from stepwise.sources import delimited as dl


def _edges(tmp_path):
    p = tmp_path / "edges.txt"
    p.write_text(EDGE_TEXT)
    return str(p)


def test_components_job(spark, tmp_path):
    out = str(tmp_path / "cc")
    jobs.main(["components", "--edges", _edges(tmp_path), "--out", out, "--mode", "staged",
               "--state", str(tmp_path / "state")], spark)
    lines = sorted(r.value for r in spark.read.text(out).collect())
    assert lines == sorted(["1 1", "2 1", "12 1", "42 42", "63 42"])


def test_pagerank_job(spark, tmp_path):
    out = str(tmp_path / "pr")
    jobs.main(["pagerank", "--links", _edges(tmp_path), "--out", out, "--num-pages", "5"], spark)
    got = sorted((int(a), round(float(b), 6)) for a, b in
                 (r.value.split(" ") for r in spark.read.text(out).collect()))
    assert got == [(1, 1.0), (2, 1.34), (42, 1.0)]


def test_generate_then_cluster_and_regress(spark, tmp_path):
    g = str(tmp_path / "gen")
    jobs.main(["gen-kmeans", "--points", "500", "--k", "3", "--output", g, "--skew", "1,1,2"], spark)
    lines = spark.read.text(f"{g}/points").collect()
    assert len(lines) == 500 and all(len(v.value.split(" ")[0].split(".")[1]) == 2 for v in lines)
    out = str(tmp_path / "km")
    jobs.main(["kmeans", "--points", f"{g}/points", "--centers", f"{g}/centers", "--out", out,
               "--iterations", "3"], spark)
    assert spark.read.text(out).count() == 500
    jobs.main(["gen-linreg", "--points", "300", "--output", g], spark)
    out = str(tmp_path / "lr")
    jobs.main(["linreg", "--data", f"{g}/data", "--out", out, "--theta0", "0", "--theta1", "0",
               "--iterations", "3"], spark)
    params = rows(dl.read_params(spark, out))
    assert len(params) == 1 and params[0][1] > 0
