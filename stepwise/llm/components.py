"""Connected components of a link table by repeated contraction.

In each round every vertex joins the neighbour (or itself) that comes first
in a random order of the ids; links are rewritten to the joined vertices and
repeated links and loops drop out.  The order changes per round, so long
chains shrink as fast as dense groups.  Minima combine before the shuffle and
the joins carry no aggregate above them, so a hub is split by the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.storage import saved


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (src, dst long); component is the smallest id.

    Links count in both directions; loops and repeated links have no effect;
    no links give no rows.
    """
    pairs = links.select("src", "dst").where("src != dst")
    edges = saved(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
                  .distinct(), "cc-links")
    if edges.isEmpty():
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    root, turn = None, 0
    while not edges.isEmpty():
        first = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), c.alias("v"))
        join = saved(edges.groupBy("src").agg(F.min(first(F.col("dst"))).alias("best"))
                     .select("src", F.least("best", first(F.col("src"))).getField("v").alias("to")),
                     "cc-join")
        step = lambda side: join.select(F.col("src").alias(side), F.col("to").alias(f"{side}_to"))  # noqa: E731,B023
        edges = saved(edges.join(step("src"), "src").join(step("dst"), "dst")
                      .where("src_to != dst_to")
                      .select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).distinct(),
                      "cc-links")
        if root is None:
            root = join.select(F.col("src").alias("id"), F.col("to").alias("root"))
        else:
            # a root without links in this round keeps its place
            root = saved(root.join(join, F.col("root") == F.col("src"), "left")
                         .select("id", F.coalesce("to", "root").alias("root")), "cc-roots")
        turn += 1
    smallest = root.groupBy("root").agg(F.min("id").alias("component"))
    return saved(root.join(smallest, "root").select("id", "component"), "cc-labels")
