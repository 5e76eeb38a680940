"""stepwise: iterative analytics on Spark DataFrames.

Bulk, delta and staged iteration with lineage control, convergence tests
and per-iteration statistics; PageRank, connected components, k-means and
linear regression built on them; deterministic generators; runtime and
utilization reports.  Every operator is a DataFrame -> DataFrame function
made of built-in column expressions, so Catalyst plans each step.

    from stepwise import pagerank_delta, read_edges
    res = pagerank_delta(read_edges(spark, "edges.txt"), threshold=0.1)
    res.df            # id, rank
    res.summary()     # per iteration: runtime, parallelism, rows
"""

__version__ = "0.1.0"

from stepwise.operators.graph import Links  # noqa: E402,F401
from stepwise.plans.components import (  # noqa: E402,F401
    components_bulk, components_delta, components_staged,
)
from stepwise.plans.iterate import (  # noqa: E402,F401
    CheckpointStore, IterationResult, ParquetStore, bulk_iterate, by_rows, delta_iterate, upsert,
)
from stepwise.plans.kmeans import final_assignment, kmeans_bulk, kmeans_staged  # noqa: E402,F401
from stepwise.plans.linreg import linreg_bulk, linreg_staged  # noqa: E402,F401
from stepwise.plans.pagerank import (  # noqa: E402,F401
    pagerank_bulk, pagerank_delta, pagerank_delta_sweep, pagerank_staged,
)
from stepwise.sources.delimited import read_centers, read_points, read_samples  # noqa: E402,F401
from stepwise.sources.text import read_edges, read_undirected_edges, write_rows  # noqa: E402,F401
