import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stepwise.session import build_session, checkpoint_dir  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

# Edge text T of FIXTURES.md (TAB between fields).
EDGE_TEXT = "% comment\n1\t2\n2\t12\n1\t12\textra\n42\t63\n"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="stepwise-tests", shuffle_partitions=4)
    checkpoint_dir(s)   # the configured one, or a private one for local tests
    yield s


@pytest.fixture
def edges_t(spark, tmp_path):
    from stepwise.sources.text import read_edges
    p = tmp_path / "edges.txt"
    p.write_text(EDGE_TEXT)
    return read_edges(spark, str(p))


def rows(df, *cols, nd=None):
    cols = cols or df.columns
    out = []
    for r in df.select(*cols).collect():
        t = tuple(r[c] for c in cols)
        if nd is not None:
            t = tuple(round(v, nd) if isinstance(v, float) else v for v in t)
        out.append(t)
    return sorted(out)
