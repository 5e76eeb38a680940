"""Embedding near-duplicates by int8 tile products with error bounds.

Every unit vector u is written as s * q + e with 8-bit integers q, and the
norm of its rest e is kept.  For two vectors

    |u.v - s_u s_v (q_u . q_v)| <= |e_u| (1 + |e_v|) + |e_v| (1 + |e_u|) + |e_u| |e_v|

so the integer product of two tiles settles all pairs but those within the
bound of the threshold, and only these are computed again in double
precision.  No pair is left out.

Equal vectors are folded first.  A tile hands back link counts and a spanning
forest of its links, never its pairs, so a large group of near copies costs
rows in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm import textops as tx
from stepwise.llm.components import connected_components
from stepwise.llm.storage import saved

# Vectors of a tile side: small tables are cut into at least 16 sides.
MIN_SIDE, MAX_SIDE, SIDES = 512, 16_384, 16
ROWS, COLS = 1024, 4096         # part of a tile whose products are held at once
EXACT_DIMS = 1024               # 127 * 127 * 1024 < 2**24: exact in 32-bit floats
SLACK = 1e-9                    # above all rounding errors of the bound itself


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit parts, scales and norms of the rests of unit vectors."""
    scale = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(u - q * scale[:, None], axis=1) + SLACK


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of 8-bit rows (as 32-bit floats, in which they are exact)."""
    out = None
    for i in range(0, a.shape[1], EXACT_DIMS):
        part = a[:, i:i + EXACT_DIMS].astype(np.float32) @ b[:, i:i + EXACT_DIMS].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


class Side:
    """One side of a tile: ids, copies and vectors, ready for products."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.ids, self.copies = ids, copies
        self.unit = unit(vectors.astype(np.float64))
        self.q, self.scale, self.rest = quantise(self.unit)


def linked(a: Side, b: Side, rows: slice, cols: slice, threshold: float) -> np.ndarray | None:
    """Mask of the pairs with cosine >= threshold in a part of the tile, None without any.

    One comparison with the least product that any pair of the part would need
    leaves few pairs; each of these is settled by its own bound, or in double
    precision where the bound does not tell.
    """
    product = integer_products(a.q[rows], b.q[cols])
    ra, rb, sa, sb = a.rest[rows], b.rest[cols], a.scale[rows], b.scale[cols]
    widest = ra.max() + rb.max() + 3.0 * ra.max() * rb.max() + SLACK
    least = max(0.0, threshold - widest) / (sa.max() * sb.max()) * (1 - SLACK)
    possible = np.flatnonzero(product.reshape(-1) >= least)
    if not len(possible):
        return None
    mask = np.zeros(product.shape, bool)
    for k in range(0, len(possible), 1 << 18):
        i, j = np.divmod(possible[k:k + (1 << 18)], product.shape[1])
        near = product[i, j] * (sa[i] * sb[j])
        bound = ra[i] + rb[j] + 3.0 * ra[i] * rb[j] + SLACK
        hit = near - bound >= threshold
        unsure = np.flatnonzero(~hit & (near + bound >= threshold))
        hit[unsure] = np.einsum("ij,ij->i", a.unit[rows][i[unsure]], b.unit[cols][j[unsure]]) >= threshold
        mask[i[hit], j[hit]] = True
    return mask


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining the labels of u[k] and v[k] for every k."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def tile_links(a: Side, b: Side, same: bool, threshold: float):
    """Copies linked to every row of both sides, and a spanning forest (pairs of rows).

    ``same`` marks a tile of a side with itself, where a row is not its own
    partner and each pair counts for both rows once.
    """
    na, nb = len(a.ids), len(b.ids)
    count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    label = np.arange(na if same else na + nb)
    shift = 0 if same else na
    forest = []
    for r in range(0, na, ROWS):
        for c in range(0, nb, COLS):
            rows, cols = slice(r, min(na, r + ROWS)), slice(c, min(nb, c + COLS))
            mask = linked(a, b, rows, cols, threshold)
            if mask is not None and same:
                mask &= np.arange(rows.start, rows.stop)[:, None] != np.arange(cols.start, cols.stop)[None]
            if mask is None or not mask.any():
                continue
            count_a[rows] += (mask * b.copies[None, cols]).sum(1)
            if not same:
                count_b[cols] += (mask * a.copies[rows, None]).sum(0)
            while True:     # join each row and column to one partner of another label
                other = mask & (label[rows][:, None] != label[shift + c:shift + cols.stop][None])
                i, j = np.flatnonzero(other.any(1)), np.flatnonzero(other.any(0))
                if not len(i):
                    break
                u = r + np.concatenate((i, other[:, j].argmax(0)))
                v = shift + c + np.concatenate((other[i].argmax(1), j))
                one = tx.first_of(label[u], label[v])       # one link for two labels
                forest.append(np.stack((u[one], v[one]), 1))
                label = _merge(label, u[one], v[one])
    return count_a, count_b, np.concatenate(forest) if forest else np.zeros((0, 2), np.int64)


def link_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors are linked if their cosine in double precision reaches the
    threshold (above 0).  A vector that is null, zero, or holds null or
    non-finite components is linked with nothing, and neither are vectors of
    different lengths or without id; repeated rows count as vectors of their own; other
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(vector_col).cast("array<float>").alias("vector"))
    sound = F.col("id").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)
                                & (F.abs(x) < float("inf")))
                       & F.exists("vector", lambda x: x != 0), F.lit(False))
    key = F.when(sound, F.sha2(F.concat_ws(",", F.transform("vector", lambda x: F.hex(
        F.xxhash64(x + F.lit(0.0).cast("float"))))), 256))
    keyed = saved(base.select("id", F.when(sound, F.unhex(key)).alias("key"),
                              F.when(sound, F.col("vector")).alias("vector")), "vectors")
    # one row for equal vectors; the counts combine before the shuffle
    classes = saved(keyed.where("key is not null").groupBy("key")
                    .agg(F.min("id").alias("rep"), F.count("*").alias("copies"),
                         F.min("vector").alias("vector"))
                    .select("key", F.size("vector").alias("dim"), "rep", "copies", "vector"), "classes")
    sides = {r.dim: max(SIDES if r.n >= SIDES * MIN_SIDE else -(-r.n // MIN_SIDE), -(-r.n // MAX_SIDE))
             for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sides:
        return keyed.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                            F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    n_sides = spark.createDataFrame(list(sides.items()), "dim int, sides long")   # one row per vector length
    packed = (classes.join(F.broadcast(n_sides), "dim")
              .withColumn("side", F.pmod(F.xxhash64("rep"), "sides"))
              .select("dim", "sides", "side", "rep", "copies", "vector")
              .groupBy("dim", "sides", "side").applyInArrow(
                  _pack, "dim int, sides long, side long, reps binary, copies binary, vectors binary"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    tiles = (packed.withColumn("other", other)
             .select("dim", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                     "side", "reps", "copies", "vectors"))
    found = saved(tiles.groupBy("dim", "i", "j").applyInArrow(
        _tile_runner(threshold), "src long, dst long, links long"), "tile-links")
    counts = (found.where("dst is null").groupBy(F.col("src").alias("rep"))
              .agg(F.sum("links").alias("links")))
    comp = connected_components(found.where("dst is not null"))
    judged = saved(classes.select("key", "rep", "copies").join(counts, "rep", "left")
                   .join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
                   .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                           F.coalesce("component", "rep").alias("component_id")), "judged")
    return (keyed.select("id", "key").join(judged, "key", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def _pack(key, rows):
    """One row of flat arrays for one side, ordered by id."""
    rows = rows.sort_by("rep").combine_chunks()
    flat = lambda a: np.asarray(a).tobytes()
    vectors = rows.column("vector").combine_chunks()
    return pa.table({
        "dim": rows.column("dim")[:1], "sides": rows.column("sides")[:1], "side": rows.column("side")[:1],
        "reps": pa.array([flat(rows.column("rep"))], pa.binary()),
        "copies": pa.array([flat(rows.column("copies"))], pa.binary()),
        "vectors": pa.array([flat(vectors.flatten())], pa.binary())})


def _tile_runner(threshold: float):
    def run(key, rows):
        dim, i, j = (k.as_py() for k in key)
        sides = {}
        for row in rows.select(["side", "reps", "copies", "vectors"]).to_pylist():
            sides[row["side"]] = Side(np.frombuffer(row["reps"], np.int64),
                                      np.frombuffer(row["copies"], np.int64),
                                      np.frombuffer(row["vectors"], np.float32).reshape(-1, dim))
        if i not in sides or j not in sides:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()),
                             "links": pa.array([], pa.int64())})
        a, b = sides[i], sides[j]
        count_a, count_b, forest = tile_links(a, b, i == j, threshold)
        ids = a.ids if i == j else np.concatenate((a.ids, b.ids))
        count = count_a if i == j else np.concatenate((count_a, count_b))
        has = np.flatnonzero(count)
        n = len(has)
        return pa.table({
            "src": pa.array(np.concatenate((ids[has], ids[forest[:, 0]]))),
            "dst": pa.array(np.concatenate((np.zeros(n, np.int64), ids[forest[:, 1]])),
                            mask=np.arange(n + len(forest)) < n),
            "links": pa.array(np.concatenate((count[has], np.zeros(len(forest), np.int64))))})
    return run

