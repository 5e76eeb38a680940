"""Graph operators for PageRank and connected components.

Edges are ``src long, dst long``.  Inside loops the edges are a prepared
``Links`` table of ``(src, salt, dst, w, deg)`` rows - ``w`` folds parallel
edges into a multiplicity, ``deg`` is the out-degree counting parallel
edges - hash-partitioned once on ``(src, salt)`` and persisted, so a
superstep shuffles only the small state side and the contributions.

Skew: the links of a source with very many distinct targets lie in a table
of their own, spread over all partitions; the state of these few hot sources
is broadcast to it, while all others keep the partitioning of their state.
Beyond a checked number of hot sources the hottest are taken: any other has
at most one link in ``MAX_BROADCAST_HOT``, too few to slow a partition.
Without broadcast (``max_hot=0``) hot sources are split over several ``salt``
buckets, and their state is replicated per bucket by a shuffle.
"""

from __future__ import annotations

import functools
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from stepwise.functions.columns import (
    DAMPENING, DELTA_THRESHOLD, EPSILON, changed, dampen, over_threshold, smaller,
)
from stepwise.session import default_partitions

# A source is split only when it has more distinct targets than this and
# more than its fair share (rows / partitions) of the link table.
MIN_SPLIT_ROWS = 100_000
# Most targets in one adjacency-list row.
MAX_LIST_NEIGHBORS = 100_000
# Target rows of the link table per partition when no count is given.
ROWS_PER_PARTITION = 4_000_000
# Most hot sources whose ids and state rows are broadcast.
MAX_BROADCAST_HOT = 100_000
# Most rows that a tail step, which looks up its keys, brings to the driver.
MAX_TAIL_ROWS = 100_000
# Most keys in a filter of a scan.
MAX_KEYS = 1000
# Links from which on looking up few keys in files is faster than scanning a cached table.
LOOKUP_LINKS = 50_000_000


# --------------------------------------------------------------------------- 
# initial values (P1-P4) and adjacency (A4)
# ---------------------------------------------------------------------------

def vertices(edges: DataFrame) -> DataFrame:
    """All vertex ids of a directed edge list (``id``)."""
    return (edges.select(F.col("src").alias("id"))
            .union(edges.select(F.col("dst").alias("id"))).distinct())


def num_vertices(edges: DataFrame) -> int:
    return vertices(edges).count()


def component_init(edges: DataFrame) -> DataFrame:
    """One ``(v, comp=v)`` row per vertex that starts an edge."""
    v = edges.select(F.col("src").alias("v")).distinct()
    return v.select("v", F.col("v").alias("comp"))


def rank_init(links: DataFrame, rank: float = 1.0) -> DataFrame:
    """Rank 1.0 for every page with an out-link (``id, rank``)."""
    return links.select(F.col("src").alias("id")).distinct().withColumn("rank", F.lit(rank))


def delta_init(ranks: DataFrame, num_pages: int) -> DataFrame:
    """Initial delta ``rank - 1/numPages`` (``id, delta``)."""
    return ranks.select("id", (F.col("rank") - F.lit(1.0 / num_pages)).alias("delta"))


def out_degree(links: DataFrame) -> DataFrame:
    """A4 as counts: out-degree with parallel edges counted (``src, deg``)."""
    return links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))


def adjacency_list(links: DataFrame, max_neighbors: int = MAX_LIST_NEIGHBORS) -> DataFrame:
    """A4: ``(src, chunk, neighbors array<long>)``, parallel edges kept, sorted.

    Every source has the chunks ``0 .. ceil(degree / max_neighbors) - 1`` (an
    empty one is left out), each of about ``max_neighbors`` targets, so no
    record holds an unbounded neighbourhood.  The chunk of a link is a hash of
    its target and its number among parallel links, hence the same on a retry
    and in any engine.  The loops use the ``Links`` rows instead.
    """
    pairs = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    chunks = out_degree(links).select("src", F.ceil(F.col("deg") / F.lit(max_neighbors))
                                      .cast("long").alias("__chunks"))
    each = (pairs.join(chunks, "src")
            .select("src", "dst", "__chunks", F.explode(F.sequence(F.lit(1).cast("long"), "w")).alias("__copy")))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", "dst", "__copy")), 1, 8), 16, 10).cast("long")
    return (each.groupBy("src", F.pmod(bits, F.col("__chunks")).alias("chunk"))
            .agg(F.sort_array(F.collect_list("dst")).alias("neighbors")))


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    ).select("e.src", "e.dst")


# ---------------------------------------------------------------------------
# prepared links
# ---------------------------------------------------------------------------

STATE_ROW_BYTES = 32     # conservative size of one state row in a broadcast
MAX_BROADCAST_STATE_ROWS = 100_000   # larger worksets are shuffled (no gain measured)


def broadcast_rows(spark) -> int:
    """Most state rows broadcast to the link table: the session's broadcast
    threshold over ``STATE_ROW_BYTES`` (0 when broadcasting is disabled),
    capped at ``MAX_BROADCAST_STATE_ROWS``."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        limit = int(raw)
    except ValueError:
        limit = _parse_bytes(raw)
    return min(MAX_BROADCAST_STATE_ROWS, max(0, limit) // STATE_ROW_BYTES)


def _parse_bytes(text: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    t = text.strip().lower().rstrip("b") or "0"
    mult = units.get(t[-1], 1) if t[-1].isalpha() else 1
    return int(float(t[:-1] if t[-1].isalpha() else t) * mult)


class Links:
    """Loop-invariant edge table, partitioned on the join key and persisted.

    Out-degrees come from map-side sums; then the edges are shuffled once, to
    ``(src, salt)``, and parallel edges are folded and degrees attached on
    that partitioning.  Without an explicit ``partitions`` the count grows
    with the data (``ROWS_PER_PARTITION``).  ``broadcast_state=False`` shuffles
    the state of every superstep, however small.  ``save`` (a function of a
    table, its key and the number of partitions) puts the table into files by
    hash bucket instead of the cache, where few sources can be looked up, if
    there are at least ``save_from`` links; with hot sources all stay in the cache.

    The hot sources, the hottest ``max_hot`` if there are more, have their links
    in ``hot_table``, spread by target, and the others in ``table``
    (``two_way``); with ``max_hot=0`` ``table`` holds all links, salted.
    ``symmetric`` says that every edge is there in both directions.

    With ``lists`` symmetric links lie in ``table`` as ``(src, salt, neighbors)``,
    up to about ``MAX_LIST_NEIGHBORS`` different targets a row and neither ``w`` nor
    ``deg``: a superstep then joins one row per vertex instead of one per link.
    """

    def __init__(self, edges: DataFrame, partitions: int | None = None,
                 split_rows: int | None = None, persist: bool = True,
                 count_vertices: bool = False, broadcast_state: bool = True, save=None, save_from: int = 0,
                 max_hot: int = MAX_BROADCAST_HOT, symmetric: bool = False, lists: bool = False):
        spark = edges.sparkSession
        self.broadcast_state = broadcast_state
        per_src = out_degree(edges)
        if persist:
            per_src = per_src.persist(StorageLevel.MEMORY_AND_DISK)
        total, widest, n_src, no_src = per_src.agg(
            F.sum("deg"), F.max("deg"), F.count(F.lit(1)), F.count_if(F.col("src").isNull())).first()
        total, widest = total or 0, widest or 0
        self.n_sources, self.widest = int(n_src or 0), int(widest)
        # links of null sources are dropped, those to null targets are not
        self.symmetric = symmetric and not no_src
        self.lists = lists and self.symmetric       # a list holds no null targets
        self.partitions = partitions or max(default_partitions(spark),
                                            math.ceil(total / ROWS_PER_PARTITION))
        if split_rows is None:
            split_rows = max(MIN_SPLIT_ROWS, math.ceil(total / self.partitions))
        self.split_rows = split_rows
        hot = (per_src.where(F.col("deg") > split_rows)
               .select("src", F.ceil(F.col("deg") / split_rows).cast("int").alias("nsalt"), "deg"))
        self.hot = hot.persist(StorageLevel.MEMORY_AND_DISK) if persist else hot
        # buckets of the hot sources: how many rows more a salted state can have
        self.n_hot, self.n_buckets = self._hot_counts() if widest > split_rows else (0, 0)
        if self.n_hot > max_hot > 0:
            self.hot.unpersist()
            hot = hot.orderBy(F.desc("deg"), "src").limit(max_hot)
            self.hot = hot.persist(StorageLevel.MEMORY_AND_DISK) if persist else hot
            self.n_hot, self.n_buckets = self._hot_counts()
        self.two_way = 0 < self.n_hot <= max_hot
        self.salted = self.n_hot > 0 and not self.two_way
        if self.salted:         # by source, as the states that are spread over its buckets lie
            self.hot.unpersist()
            hot = hot.repartition(self.partitions, "src")
            self.hot = hot.persist(StorageLevel.MEMORY_AND_DISK) if persist else hot
        self.hot_table = None
        if self.two_way:
            ids = F.broadcast(self.hot.select("src"))
            few = F.broadcast(self.hot.select("src", "deg"))
            self.hot_table = (edges.select("src", "dst").join(ids, "src", "left_semi")
                              .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
                              .join(few, "src").select("src", F.lit(0).alias("salt"), "dst", "w", "deg"))
            edges = edges.select("src", "dst").join(ids, "src", "left_anti")
        self.keys = ["src", "salt"] if self.salted else ["src"]
        salted = self._with_salts(edges.select("src", "dst"), "src", F.pmod(
            F.xxhash64("dst"), F.coalesce("nsalt", F.lit(1))).cast("int"))
        if self.lists:
            table = self._listed(salted, per_src)
        else:
            degs = self._explode_salts(per_src, "src") if self.salted else per_src.withColumn("salt", F.lit(0))
            table = (salted.repartition(self.partitions, *self.keys)
                     .groupBy("src", "salt", "dst").agg(F.count(F.lit(1)).alias("w"))
                     .join(degs.repartition(self.partitions, *self.keys).hint("shuffle_hash"),
                           ["src", "salt"] if self.salted else "src")
                     .select("src", salted["salt"] if self.salted else F.lit(0).alias("salt"), "dst", "w", "deg"))
        self.table = table
        # one row per source: (src, deg); the start set of PageRank and components
        self.sources = self._per_src = per_src
        self.vertex_count = None
        self.in_files = save is not None and total >= save_from and not self.n_hot
        if self.in_files:
            self.table = save(table.drop("salt"), "src", self.partitions).withColumn("salt", F.lit(0))
            if count_vertices:
                self.vertex_count = self.count_vertices()
        elif persist:
            self.table = self.table.persist(StorageLevel.MEMORY_AND_DISK)
            if self.two_way:
                self.hot_table = self.hot_table.persist(StorageLevel.MEMORY_AND_DISK)
                self.hot_table.count()
            if not count_vertices or self.symmetric:
                self.table.count()
            if count_vertices:
                self.vertex_count = self.count_vertices()   # this scan fills the cache

    @property
    def layout(self) -> int | None:
        """Partitions by ``src`` that loop state can keep between supersteps.

        With salted sources what a step reads of it is spread over their buckets
        anew, but it meets the table of buckets and the offers where it lies.
        """
        return self.partitions

    def rows(self) -> DataFrame:
        """All links; those of lists without ``w`` and ``deg``."""
        table = self._one_by_one(self.table) if self.lists else self.table
        return table.unionByName(self.hot_table.select(*table.columns)) if self.two_way else table

    def _listed(self, salted: DataFrame, per_src: DataFrame) -> DataFrame:
        """The links as lists of different targets, on the partitioning of their source."""
        chunk = F.lit(0)
        if self.widest > MAX_LIST_NEIGHBORS:        # no more sources than links / MAX_LIST_NEIGHBORS
            wide = per_src.where(F.col("deg") > MAX_LIST_NEIGHBORS).select(
                F.col("src").alias("__wide"), F.ceil(F.col("deg") / MAX_LIST_NEIGHBORS).alias("__chunks"))
            salted = salted.join(F.broadcast(wide), salted["src"] == wide["__wide"], "left")
            # another seed than that of the salt, which is a remainder of the same hash
            chunk = F.pmod(F.xxhash64("dst", F.lit(1)), F.coalesce("__chunks", F.lit(1)))
        keyed = salted.select("src", "salt", chunk.cast("int").alias("__chunk"), "dst")
        return (keyed.repartition(self.partitions, *self.keys).groupBy("src", "salt", "__chunk")
                .agg(F.collect_set("dst").alias("neighbors")).select("src", "salt", "neighbors"))

    @staticmethod
    def _one_by_one(listed: DataFrame) -> DataFrame:
        """Lists as one row per target ``dst``."""
        return listed.select(*[c for c in listed.columns if c != "neighbors"], F.explode("neighbors").alias("dst"))

    def _hot_counts(self) -> tuple[int, int]:
        n, buckets = self.hot.agg(F.count(F.lit(1)), F.sum("nsalt")).first()
        return int(n or 0), int(buckets or 0)

    def count_vertices(self) -> int:
        """Distinct ids among sources and targets (numPages)."""
        if self.symmetric:      # every target is a source
            return self.n_sources
        t = self.rows()
        return (t.select(F.col("src").alias("id")).union(t.select(F.col("dst").alias("id")))
                .distinct().count())

    def _with_salts(self, df: DataFrame, key: str, salt) -> DataFrame:
        """``df`` plus a ``salt`` column, an expression over ``nsalt`` (null if not hot)."""
        if not self.salted:
            return df.withColumn("salt", F.lit(0))
        h = self.hot.select(F.col("src").alias("__hk"), "nsalt")
        j = df.join(h, df[key] == h["__hk"], "left")
        return j.select(*df.columns, salt.alias("salt"))

    def _explode_salts(self, df: DataFrame, key: str) -> DataFrame:
        n = F.coalesce(F.col("nsalt"), F.lit(1))
        return self._with_salts(df, key, F.explode(F.sequence(F.lit(0), n - 1)))

    def join_state(self, state: DataFrame, key: str, rows: int | None = None, alike: str | None = None) -> DataFrame:
        """Join per-vertex state (keyed by ``key``) to its out-links.

        Output carries the state columns plus ``dst, w, deg`` (of lists ``dst`` only,
        those with a like value of ``alike`` next to each other, which makes what is
        shuffled of them smaller).  The persisted
        link table is never shuffled.  The state side is broadcast when its
        measured row count ``rows``, with what salting can add, fits the
        session's broadcast threshold (``broadcast_rows``); otherwise it is shuffled to the link partitioning
        and used as the hash-join build side.  With ``two_way`` links that is the
        way of the cold sources; the state rows of hot ones, at most one per hot
        source (and tag), are broadcast to their own links.
        """
        if self.salted:
            state = self._explode_salts(state, key)
            out_cols = [c for c in state.columns if c != "salt"]
        else:
            out_cols = state.columns
        small = (self.broadcast_state and rows is not None
                 and rows + (self.n_buckets if self.salted else 0) <= broadcast_rows(state.sparkSession))
        s = F.broadcast(state) if small else state.hint("shuffle_hash")
        s, lt = s.alias("__s"), self.table.alias("__l")
        cond = F.col(f"__s.{key}") == F.col("__l.src")
        if self.salted:
            cond = cond & (F.col("__s.salt") == F.col("__l.salt"))
        kept = [F.col(f"__s.{c}") for c in out_cols]
        out = [*kept, F.col("__l.dst")] if self.lists else [
            *kept, F.col("__l.dst"), F.col("__l.w"), F.col("__l.deg")]
        if self.lists:
            found = s.join(lt, cond).select(*kept, "__l.neighbors")
            found = self._one_by_one(found.sortWithinPartitions(alike) if alike and not small else found)
        else:
            found = s.join(lt, cond).select(*out)
        if not self.two_way:
            return found
        ids = F.broadcast(self.hot.select(F.col("src").alias(key)))
        hot = F.broadcast(state.join(ids, key, "left_semi").alias("__s"))
        return found.unionByName(self.hot_table.alias("__l").join(hot, cond).select(*out))

    def few(self, rows: list) -> bool:
        """Whether the links of these state rows can be looked up and their targets brought to the driver."""
        return self.in_files and len(rows) <= MAX_KEYS and len(rows) * self.widest <= MAX_TAIL_ROWS

    def of(self, rows: DataFrame, key: str, keys: list) -> DataFrame:
        """As ``join_state`` for a few rows with the given keys: reads the buckets and pages of these keys only."""
        found = self.table.where(F.col("src").isin(keys))
        found = found.join(F.broadcast(rows), found["src"] == rows[key])
        kept = [rows[c] for c in rows.columns]
        return self._one_by_one(found.select(*kept, "neighbors")) if self.lists else found.select(
            *kept, "dst", "w", "deg")

    def unpersist(self):
        self.table.unpersist()
        if self.two_way:
            self.hot_table.unpersist()
        self.hot.unpersist()
        self._per_src.unpersist()


# ---------------------------------------------------------------------------
# PageRank (J4-J7, A2, A3)
# ---------------------------------------------------------------------------

def rank_shares(ranks: DataFrame, links: Links, rows: int | None = None) -> DataFrame:
    """Each page's rank split equally over its out-links (``id, share``).

    One row per different target; parallel edges count separately (``w``
    copies of ``rank/deg``).  Pages
    without out-links send nothing.
    """
    j = links.join_state(ranks, "id", rows)
    return j.select(F.col("dst").alias("id"),
                    (F.col("rank") / F.col("deg") * F.col("w")).alias("share"))


def sum_shares(shares: DataFrame, value: str = "share", out: str = "rank") -> DataFrame:
    """A2: sum per page; partial sums combine map-side (hub-safe)."""
    return shares.groupBy("id").agg(F.sum(value).alias(out))


def dampened(sums: DataFrame, num_pages: int, d: float = DAMPENING) -> DataFrame:
    """P5 over summed ranks."""
    return sums.select("id", dampen(F.col("rank"), num_pages, d).alias("rank"))


def bulk_rank_step(ranks: DataFrame, links: Links, num_pages: int,
                   d: float = DAMPENING, rows: int | None = None) -> DataFrame:
    """One bulk PageRank superstep: shares, sum, dampen."""
    return dampened(sum_shares(rank_shares(ranks, links, rows)), num_pages, d)


def flag_changed(new: DataFrame, old: DataFrame, eps: float = EPSILON,
                 flag: str = "changed") -> DataFrame:
    """J7 + P6: new ranks plus a stop-test flag, true if the page was in the old
    ranks and moved by more than ``eps`` (pages new in this step are not compared)."""
    o = old.select("id", F.col("rank").alias("__old"))
    j = new.join(o, "id", "left")
    return j.select("id", "rank",
                    F.coalesce(changed("rank", "__old", eps), F.lit(False)).alias(flag))


def delta_shares(deltas: DataFrame, links: Links, d: float = DAMPENING,
                 rows: int | None = None) -> DataFrame:
    """``d * delta / outdegree`` to every target (``id, share``).

    Extra state columns (a ``threshold`` tag) are carried along.
    """
    j = links.join_state(deltas, "id", rows)
    extra = [c for c in deltas.columns if c not in ("id", "delta")]
    return j.select(*extra, F.col("dst").alias("id"),
                    (F.lit(d) * F.col("delta") / F.col("deg") * F.col("w")).alias("share"))


def sum_and_filter(shares: DataFrame, threshold: float = DELTA_THRESHOLD,
                   keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """A3 + P7: sum of deltas per page, kept if ``abs(sum) > threshold``.

    With ``keys=("threshold", "id")`` the threshold is read from that column.
    """
    s = shares.groupBy(*keys).agg(F.sum("share").alias("delta"))
    t = F.col("threshold") if "threshold" in keys else threshold
    return s.where(over_threshold("delta", t))


def fold_deltas(log: list[DataFrame], keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One delta of several: their sums."""
    if len(log) == 1:
        return log[0]
    every = functools.reduce(DataFrame.unionByName, [d.select(*keys, "delta") for d in log])
    return every.groupBy(*keys).agg(F.sum("delta").alias("delta"))


def add_deltas(solution: DataFrame, deltas: DataFrame,
               keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """J6 + J3 fused: every page of the solution, ``rank + delta`` where a delta exists.

    Deltas for pages outside the solution (sinks) are ignored, as the
    inner join of J6 drops them.
    """
    j = solution.join(deltas.select(*keys, "delta").hint("shuffle_hash"), list(keys), "left")
    return j.select(*keys, F.when(F.col("delta").isNull(), F.col("rank"))
                    .otherwise(F.col("rank") + F.col("delta")).alias("rank"))


# ---------------------------------------------------------------------------
# connected components
# ---------------------------------------------------------------------------

def cc_candidates(components: DataFrame, links: Links, rows: int | None = None) -> DataFrame:
    """Every neighbour of a vertex may take its component (``v, comp``)."""
    j = links.join_state(components.withColumnRenamed("v", "__v"), "__v", rows, alike="comp")
    return j.select(F.col("dst").alias("v"), "comp")


def cc_first_candidates(links: Links) -> DataFrame:
    """J1 of the first step, when every vertex is its own component, on symmetric links.

    The offers along all links are then the links themselves read backwards, and
    lie on the partitioning of their vertex.
    """
    return links.rows().select(F.col("src").alias("v"), F.col("dst").alias("comp"))


def cc_first_least(links: Links) -> DataFrame:
    """The smallest offers of ``cc_first_candidates``: of lists one a list, without reading them out."""
    if not links.lists:
        return cc_first_candidates(links)
    least = links.table.select(F.col("src").alias("v"), F.array_min("neighbors").alias("comp"))
    if not links.two_way:
        return least
    return least.unionByName(links.hot_table.select(F.col("src").alias("v"), F.col("dst").alias("comp")))


def cc_min_candidate(candidates: DataFrame) -> DataFrame:
    """A1: smallest candidate per vertex; partial minima combine map-side."""
    return candidates.groupBy("v").agg(F.min("comp").alias("comp"))


def cc_delta(min_candidates: DataFrame, solution: DataFrame) -> DataFrame:
    """J2 + P8: candidates smaller than the current component."""
    cur = solution.select("v", F.col("comp").alias("__cur"))
    return (cur.join(min_candidates.hint("shuffle_hash"), "v")
            .where(smaller("comp", "__cur")).select("v", "comp"))


def cc_tail(solution: DataFrame, rows: list, links: Links, meter) -> list | None:
    """J1 + A1 + J2 for a few changed vertices: keys are looked up, nothing is scanned whole.

    The smallest offers come to the driver (at most ``MAX_TAIL_ROWS``), as do
    those that change a component; None if there could be more.
    """
    if not links.few(rows):
        return None
    spark, schema = solution.sparkSession, "__v long, comp long"
    ws = meter(spark.createDataFrame([(r["v"], r["comp"]) for r in rows], schema), "workset-in")
    offers = meter(links.of(ws, "__v", [r["v"] for r in rows]).select(F.col("dst").alias("v"), "comp"),
                   "candidates-out")
    smallest = meter(cc_min_candidate(offers), "minima-out").collect()
    if not smallest:
        return []
    keys, offered = [r["v"] for r in smallest], [(r["v"], r["comp"]) for r in smallest]
    if len(keys) <= MAX_KEYS:
        solution = solution.where(F.col("v").isin(keys))
    better = F.broadcast(spark.createDataFrame(offered, "v long, offer long"))
    return [Row(v=r["v"], comp=r["offer"]) for r in solution.join(better, "v")
            .where(smaller("offer", "comp")).select("v", "offer").collect()]


def cc_fold(log: list[DataFrame]) -> DataFrame:
    """One delta of several: components only get smaller."""
    if len(log) == 1:
        return log[0]
    return cc_min_candidate(functools.reduce(DataFrame.unionByName, [d.select("v", "comp") for d in log]))


def cc_update(solution: DataFrame, delta: DataFrame) -> DataFrame:
    """Component from the delta where present, else the old one (``merge`` of the loop)."""
    d = delta.select("v", F.col("comp").alias("__new")).hint("shuffle_hash")
    j = solution.join(d, "v", "left")
    return j.select("v", F.coalesce("__new", "comp").alias("comp"))


def cc_relax_step(solution: DataFrame, candidates: DataFrame, flag: str = "changed", meter=None) -> DataFrame:
    """A1 + J2 + J3 as one job: the next solution and which rows of it changed.

    Only the candidates are shuffled (partial minima combine map-side) where the
    solution keeps its partitioning between steps.  Candidates for vertices
    outside the solution are dropped, as the inner join of J2 does.  ``meter``
    counts the vertices that got an offer (the minima of A1).
    """
    least = cc_min_candidate(candidates)
    if meter is not None:
        least = meter(least, "minima-out")
    offered = least.select("v", F.col("comp").alias("__new")).hint("shuffle_hash")
    better = F.coalesce(smaller("__new", "comp"), F.lit(False))
    return (solution.where(F.col("comp").isNotNull()).join(offered, "v", "left")
            .select("v", F.when(better, F.col("__new")).otherwise(F.col("comp")).alias("comp"), better.alias(flag)))
