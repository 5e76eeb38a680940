"""Mixing sources to target weights by proportionate-fair scheduling.

The documents of a source are cut into blocks.  With target weight w, block j
of a source may start at floor(j / w) and must be out by ceil((j + 1) / w);
earliest deadline first among the released blocks meets every deadline on one
lane because the weights sum to 1, so at any moment each source is less than
one block away from its target share.

The weights are taken as they are, as exact fractions of their sum, so the
distance to them does not grow with the corpus.  A block's window follows from
its number; only the order of the blocks is a sequence, and one task streams
it with the next block of each source in memory (blocks, not documents).  The
rest is counting: a document's rank in its source comes from the counts of
hash ranges plus a rank inside a small range, so no source is ever sorted in
one task, and the order does not depend on the number of ranges.

A source that has run out leaves its slots empty and the others keep their
order, so every document appears exactly once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.llm.storage import shuffle_partitions

# Largest number of sources of one mixture: a mixture names its sources, and
# their weights come from the driver.
MAX_SOURCES = 10_000
DEAL_BATCH = 1 << 16        # slots of one batch of the schedule


def _checked(weights: dict) -> list:
    """The sources in their fixed order."""
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"{len(weights)} sources; a mixture has at most {MAX_SOURCES}")
    if any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("target weights must be positive numbers")
    return sorted(weights, key=lambda s: (s is None, s or ""))


def exact_weights(weights: dict) -> tuple[dict, int]:
    """The weights as integers in the same ratio, and their sum; nothing is rounded."""
    parts = {s: Fraction(weights[s]) for s in _checked(weights)}
    scale = math.lcm(*(f.denominator for f in parts.values()))
    out = {s: int(f * scale) for s, f in parts.items()}
    by = math.gcd(*out.values()) or 1
    return {s: a // by for s, a in out.items()}, sum(out.values()) // by


def integer_weights(weights: dict, period: int = 1000) -> tuple[dict, int]:
    """Weights rounded to blocks per period (at least 1), and the period.

    Largest remainders are rounded up; the period grows with the number of
    sources so that small weights are not lost.
    """
    if not weights:
        return {}, max(1, period)
    names = _checked(weights)
    period = max(period, 10 * len(weights))
    total = math.fsum(weights.values())
    share = {s: weights[s] / total * period for s in names}
    out = {s: max(1, math.floor(share[s])) for s in names}
    left = period - sum(out.values())
    by_rest = sorted(names, key=lambda s: math.floor(share[s]) - share[s])
    for s in by_rest[:max(0, left)]:
        out[s] += 1
    while sum(out.values()) > period:       # many sources raised to 1
        out[max(out, key=out.get)] -= 1
    return out, period


def _window(j: int, share: int, total: int) -> tuple[int, int]:
    """Release and deadline of block j of a source with weight share / total."""
    return j * total // share, -(-(j + 1) * total // share)


def _deal(shares: list[int], total: int, blocks: list[int]) -> Iterator[tuple]:
    """(source number, index, release, deadline, slot) of every block, by slot.

    Windows of one source overlap by one slot at most and their deadlines
    rise, so only the next block of each source is at hand.
    """
    at = [0] * len(shares)
    waiting = [(0, s) for s in range(len(shares)) if blocks[s]]     # by release
    ready, slot = [], 0                                             # by deadline
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s = heapq.heappop(waiting)
            heapq.heappush(ready, (_window(at[s], shares[s], total)[1], s, release))
        deadline, s, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline was missed; weights exceed the lane")
        yield s, at[s], release, deadline, slot
        at[s] += 1
        if at[s] < blocks[s]:
            heapq.heappush(waiting, (_window(at[s], shares[s], total)[0], s))
        slot += 1


def schedule(shares: dict, total: int, blocks: dict | None = None) -> list[tuple]:
    """(source, index, release, deadline, slot) of ``blocks`` (default: ``shares``) per source."""
    names = list(shares)
    count = [(blocks or shares)[s] for s in names]
    return [(names[s], *rest) for s, *rest in _deal(list(shares.values()), total, count)]


def _dealt(spark, shares: list[int], total: int, blocks: list[int]) -> DataFrame:
    """The schedule as a table, streamed by one task."""
    names = ["__no", "__j", "__release", "__deadline", "__slot"]
    for share, n in zip(shares, blocks):
        if n and _window(n - 1, share, total)[1] >= 1 << 62:
            raise ValueError("a target weight is too small for its blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):                 # one row
                deal, more = _deal(shares, total, blocks), True
                while more:
                    some = list(islice(deal, DEAL_BATCH))
                    more = len(some) == DEAL_BATCH
                    cols = np.array(some, np.int64).reshape(-1, len(names)).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names)

    return spark.range(0, 1, 1, 1).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def temperature_weights(docs: DataFrame, alpha: float, source_col: str = "source") -> dict:
    """Target weights proportional to (documents of the source) ** alpha."""
    counts = docs.groupBy(source_col).count().take(MAX_SOURCES + 1)
    return {r[0]: float(r[1]) ** alpha for r in counts}


def mix_sources(docs: DataFrame, weights: dict, *, source_col: str = "source",
                id_col: str = "doc_id", block_docs: int = 16, period: int | None = None,
                seed: int = 0) -> DataFrame:
    """``docs`` plus mix_block, mix_release, mix_deadline, mix_slot, mix_place.

    Sort by (mix_slot, mix_place) for the mixture.  Inside a source the order
    is a seeded hash of id and row, so repeated rows are ties without effect.
    A null source is a source of its own; a source without a weight is an
    error; no documents give no rows.  With a ``period`` the targets are first
    rounded to its multiples.  Columns that carry one of the five names are
    replaced; names that start with ``__`` are reserved.
    """
    spark = docs.sparkSession
    made = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"]
    shares, total = integer_weights(weights, period) if period else exact_weights(weights)
    # one row per source: bounded by the number of weights
    docs_of = {r[0]: r[1] for r in docs.groupBy(source_col).count().take(MAX_SOURCES + 1)}
    if not docs_of.keys() <= shares.keys():
        raise ValueError("a source has no target weight")
    blocks = [-(-docs_of.get(s, 0) // block_docs) for s in shares]
    known = F.broadcast(spark.createDataFrame(
        [(s, no) for no, s in enumerate(shares)],
        T.StructType([T.StructField("__src", docs.schema[source_col].dataType),
                      T.StructField("__no", T.LongType())])))
    base = docs.drop(*made, "__h", "__r", "__b", "__src", "__no")
    # a document's place in its source: count of the hash ranges before + rank inside its own
    ranges = max(4 * shuffle_partitions(spark), -(-sum(docs_of.values()) // 20_000))
    ident = [F.col(id_col), F.lit(seed)]
    rest = [F.col(c) for c in base.columns if c != id_col and _hashable(base.schema[c].dataType)]
    base = (base.withColumn("__h", F.xxhash64(*ident))
            .withColumn("__r", F.xxhash64(F.lit(seed), *rest))
            .withColumn("__b", F.shiftright(
                (F.shiftright("__h", 32) + F.lit(1 << 31)) * F.lit(ranges).cast("long"), 32))
            .join(known, F.col(source_col).eqNullSafe(F.col("__src"))).drop("__src"))
    counts = base.groupBy("__no", "__b").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("__no").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    block_of = lambda rank: F.expr(f"({rank}) div {int(block_docs)}")
    spans = (counts.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
             .withColumn("__first", block_of("__before"))
             .withColumn("__j", F.explode(F.sequence("__first", block_of("__before + __n - 1")))))
    # each range takes the slots of its own blocks along, so documents are shuffled once
    offsets = (spans.join(_dealt(spark, list(shares.values()), total, blocks), ["__no", "__j"])
               .groupBy("__no", "__b")
               .agg(F.first("__before").alias("__before"), F.first("__first").alias("__first"),
                    F.sort_array(F.collect_list(F.struct("__j", "__release", "__deadline", "__slot")))
                    .alias("__deals")))
    inside = Window.partitionBy("__no", "__b").orderBy("__h", id_col, "__r")
    out = (base.withColumn("__k", F.row_number().over(inside) - 1).join(offsets, ["__no", "__b"])
           .withColumn("__rank", F.col("__before") + F.col("__k"))
           .withColumn("mix_block", block_of("__rank")))
    deal = F.col("__deals")[(F.col("mix_block") - F.col("__first")).cast("int")]
    return out.select(*[F.col(c) for c in docs.columns if c not in made and c not in ("__h", "__r", "__b")],
                      "mix_block", deal["__release"].alias("mix_release"),
                      deal["__deadline"].alias("mix_deadline"), deal["__slot"].alias("mix_slot"),
                      (F.col("__rank") % block_docs).cast("int").alias("mix_place"))


def _hashable(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.VariantType))


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """Rows laid out in mixture order: range-partitioned and sorted by slot."""
    return (mixed.repartitionByRange(shuffle_partitions(mixed.sparkSession), "mix_slot", "mix_place")
            .sortWithinPartitions("mix_slot", "mix_place"))

