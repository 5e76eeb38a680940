"""Near-duplicate documents by SuperMinHash, banding and exact verification.

Signature: every shingle visits the m slots in the order of its own random
permutation, its j-th visit offering the value j + r with r in [0, 1); a slot
keeps the minimum.  The ranks of one shingle differ in all slots, which makes
the estimate less variable than independent hashes, and a document stops as
soon as every slot has a value, since later visits offer larger ones.

Documents with equal shingle sets are folded first.  Sets that share a band
are candidates.  In every bucket all members are verified against one centre
on their full sets, and verified links form components; a bucket whose members
then lie in one component is settled.  Of the other buckets, members that the
triangle inequality of the Jaccard distance to the centre leaves possible are
compared in tiles of full sets, which hand back links between components and
never pairs.  So no pair of a bucket is skipped, and no bucket is expanded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm import bitset
from stepwise.llm import textops as tx
from stepwise.llm.components import connected_components
from stepwise.llm.storage import saved
from stepwise.llm.textops import U64

SHINGLE = 5                 # words
BANDS, ROWS = 32, 6         # P(a pair with similarity 0.85 shares no band) < 3e-7
SLOTS = BANDS * ROWS
SHARE = 85                  # per cent of the union that linked sets have in common
SLICE_BYTES = 1 << 20
SIDE = 512                  # members of a tile side
COLUMNS = 4096              # shingles compared at once in a tile
EAGER = 6                   # visits made without a permutation table
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_WAY = U64(48)              # a value is visit number << 48 | 48 random bits


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and offsets per document.

    Words are lower-cased in A-Z; a document of 1 to 4 words has its whole
    sequence as its only shingle, one without words has none.
    """
    n = len(off) - 1
    starts, ends, doc = tx.words(buf, off)
    h = tx.span_hash(buf, starts, ends, tx.LOWER_CODE)
    win = tx.window_hash(h, SHINGLE)
    first = np.searchsorted(doc, np.arange(n + 1))
    sets, counts = [], np.zeros(n + 1, np.int64)
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b - a >= SHINGLE:
            s = np.sort(win[a:b - SHINGLE + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = tx.mix64(tx.window_hash(h[a:b], int(b - a)) + U64(b - a))
        else:
            continue
        sets.append(s)
        counts[d + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.cumsum(counts)


def _draw(x: np.ndarray, visit: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's choice among the places still open, and its value, at a visit."""
    z = tx.mix64(x + U64((0xD1B54A32D192ED03 * (visit + 1)) & (2 ** 64 - 1)))
    place = visit + (((z & U64(0xFFFF)) * U64(SLOTS - visit)) >> U64(16)).astype(np.int64)
    return place, (U64(visit) << _WAY) | (z >> U64(16))


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Signature (documents x SLOTS) of the shingle sets; empty sets keep empty slots."""
    n = len(off) - 1
    sig = np.full((n, SLOTS), _EMPTY)
    flat = sig.reshape(-1)
    x, doc = sets, np.repeat(np.arange(n), np.diff(off))
    places: list[np.ndarray] = []
    table = None
    for visit in range(SLOTS):
        if visit:
            open_doc = (sig == _EMPTY).any(1)           # later visits cannot lower a full signature
            keep = open_doc[doc]
            if not keep.all():
                x, doc = x[keep], doc[keep]
                places = [p[keep] for p in places]
                table = table[keep] if table is not None else None
        if not len(x):
            break
        place, value = _draw(x, visit)
        if visit < EAGER:
            # the slot at a place, from the swaps made so far, latest first
            slot = place
            for i in range(visit - 1, -1, -1):
                slot = np.where(slot == places[i], i, slot)
            places.append(place)
        else:
            lanes = np.arange(len(x))
            if table is None:
                table = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(x), 1))
                for i, p in enumerate(places):
                    table[lanes, i], table[lanes, p] = table[lanes, p], table[lanes, i].copy()
                places = []
            slot = table[lanes, place].astype(np.int64)
            table[lanes, place] = table[lanes, visit]
            table[lanes, visit] = slot
        np.minimum.at(flat, doc * SLOTS + slot, value)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band."""
    out = np.zeros((len(sig), BANDS), U64)
    for b in range(BANDS):
        h = np.full(len(sig), U64(b + 1))
        for r in range(ROWS):
            h = tx.mix64(h * U64(tx._BASE) + sig[:, b * ROWS + r])
        out[:, b] = h
    return out


def _list(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64)))


def _set_keys(sets: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    ends = off.tolist()
    return [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None
            for a, b in zip(ends, ends[1:])]


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text", SLICE_BYTES):
            sets, off = shingle_sets(*tx.flat(part.column("text")))
            bands = band_keys(signatures(sets, off))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(off)), pa.array(_set_keys(sets, off), pa.binary()),
                 _list(bands.reshape(-1), np.arange(part.num_rows + 1) * BANDS)],
                ["id", "n_shingles", "set_key", "bands"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text", SLICE_BYTES):
            sets, off = shingle_sets(*tx.flat(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(_set_keys(sets, off), pa.binary()), _list(sets, off)],
                ["id", "set_key", "shingles"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with common (shared shingles) and either (their union)."""
    one = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.select("a", "b").distinct().join(one("b"), "b").join(one("a"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return (both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
            .select("a", "b", "common", (F.col("total") - F.col("common")).alias("either")))


def _tile_links(share: int):
    def run(key, rows):
        """Links between components among the members of one tile.

        A tile of a side with itself compares all its members, any other tile
        those of different sides.
        """
        rows = rows.sort_by("rep").combine_chunks()
        cross = key[1].as_py() != key[2].as_py()
        lists = rows.column("shingles").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        side, comp = rows.column("side").to_numpy(), rows.column("comp").to_numpy()
        n = len(size)
        common = np.zeros((n, n), np.float64)
        who = np.repeat(np.arange(n), size)
        _, what, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        keep = seen[what] > 1                       # a shingle of one member is common to nobody
        who, what = who[keep], (np.cumsum(seen > 1) - 1)[what[keep]]
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        for c in range(0, int(what[-1]) + 1 if len(what) else 0, COLUMNS):
            a, b = np.searchsorted(what, (c, c + COLUMNS))
            has = np.zeros((n, COLUMNS), np.float32)
            has[who[a:b], what[a:b] - c] = 1.0
            common += has @ has.T                   # exact: counts below 2**24
        mask = 100 * common >= share * (size[:, None] + size[None] - common)
        if cross:
            mask &= side[:, None] != side[None]
        label = np.unique(comp, return_inverse=True)[1]
        src, dst = np.nonzero(mask & (label[:, None] < label[None]))
        one = tx.first_of(label[src], label[dst])       # one link for two components
        return pa.table({"src": pa.array(comp[src[one]]), "dst": pa.array(comp[dst[one]])})
    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    share: int = SHARE) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (id = component_id).

    Documents are linked if their shingle sets share at least ``share`` per
    cent of their union; component_id is the smallest id reachable.  A null
    or empty text, or one of blanks, is linked with nothing; repeated rows
    stay, and rows with one id share a component; a row without id is linked
    with nothing; other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = saved(base.mapInArrow(_sketch_batches, "id long, n_shingles long, set_key binary, "
                                   "bands array<long>"), "sketches")
    # equal sets are one class; its smallest id stands for it
    classes = saved(sketch.where("set_key is not null and id is not null").groupBy("set_key")
                    .agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"),
                         F.min("bands").alias("bands")), "classes")
    rows = classes.select("rep", "n", "set_key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    buckets = saved(rows.join(shared, "band").select("band", "rep", "n", "set_key"), "buckets")
    wanted = buckets.select(F.col("rep").alias("id"), F.col("set_key").alias("wanted_key")).distinct()
    sets = saved(base.join(wanted.hint("shuffle_hash"), "id").select("id", "text")
                 .mapInArrow(_set_batches, "id long, set_key binary, shingles array<long>")
                 .join(wanted.withColumnRenamed("wanted_key", "set_key"), ["id", "set_key"])
                 .dropDuplicates(["id", "set_key"]).select("id", "shingles"), "sets")
    comp = _bucket_components(buckets.select("band", "rep", "n"), sets, share)
    labels = saved(classes.select("set_key", "rep")
                   .join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
                   .select("set_key", F.coalesce("component", "rep").alias("component")), "labels")
    return (sketch.select("id", "n_shingles", "set_key").join(labels, "set_key", "left")
            .select(F.col("id").alias(id_col), "n_shingles",
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def _bucket_components(rows: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(id, component) of the members (band, rep, n) that are linked inside buckets."""
    centres = rows.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("c"))
    rows = saved(rows.join(centres, "band").select(
        "band", "rep", "n", F.col("c.rep").alias("centre"), F.col("c.n").alias("nc")), "members")
    room = 100 * F.least("n", "nc") >= share * F.greatest("n", "nc")
    met = saved(_compared(rows.where(room & (F.col("rep") != F.col("centre")))
                          .select(F.col("centre").alias("a"), F.col("rep").alias("b")), sets), "compared")
    comp = connected_components(met.where(100 * F.col("common") >= share * F.col("either"))
                                .select(F.col("a").alias("src"), F.col("b").alias("dst")))
    known = comp.select(F.col("id").alias("rep"), F.col("component").alias("comp"))
    rows = rows.join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    home = known.select(F.col("rep").alias("centre"), F.col("comp").alias("home"))
    rows = rows.join(home, "centre", "left").withColumn("home", F.coalesce("home", "centre"))
    # unsettled buckets, and what the distances to the centre leave possible in them
    near = met.select(F.col("a").alias("centre"), F.col("b").alias("rep"),
                      (1 - F.col("common") / F.col("either")).alias("d"))
    away = F.col("comp") != F.col("home")
    rows = rows.join(near, ["centre", "rep"], "left").withColumn(
        "low", F.when(F.col("rep") == F.col("centre"), 0.0)
        .otherwise(F.coalesce("d", 1 - F.least("n", "nc") / F.greatest("n", "nc")))).withColumn(
        "high", F.when(F.col("rep") == F.col("centre"), 0.0).otherwise(F.coalesce("d", F.lit(1.0))))
    rows = saved(rows, "placed")
    reach = 1 - share / 100 + 1e-9
    strays = rows.where(away).groupBy("band").agg(F.min("low").alias("closest"))
    left = rows.join(strays, "band").where(away | (F.col("high") + reach >= F.col("closest")))
    left = saved(left.select("band", "rep", "comp"), "left")
    # bands often gather the same members: one bucket stands for all of these
    groups = (left.groupBy("band").agg(F.count("*").alias("k"), F.countDistinct("comp").alias("comps"),
                                       F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("one"),
                                       F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(20,0)")).alias("two"))
              .where("comps > 1").groupBy("k", "one", "two").agg(F.min("band").alias("band")))
    sides = F.ceil(F.col("k") / SIDE).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    tiles = (left.join(groups.select("band", sides.alias("sides")), "band")
             .withColumn("side", F.pmod(F.xxhash64("rep"), "sides")).withColumn("other", other)
             .select("band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                     "side", "rep", "comp")
             .join(sets.select(F.col("id").alias("rep"), "shingles"), "rep"))
    more = saved(tiles.groupBy("band", "i", "j").applyInArrow(_tile_links(share), "src long, dst long"), "tile-links")
    joined = connected_components(more)
    top = joined.select(F.col("id").alias("component"), F.col("component").alias("top"))
    both = (comp.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
            .unionByName(joined.join(comp, "id", "left_anti")))
    return both


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                share: int = SHARE) -> DataFrame:
    """``docs`` with one document of each component (its smallest id) and one row per id.

    Rows without id stay; names that start with ``__`` are reserved.  Only rows whose id is dropped or repeated, or looks
    so to a filter of fixed size, are shuffled with their texts.
    """
    spark = docs.sparkSession
    judged = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, share=share)
    drop = saved(judged.where("not kept").select(F.col(id_col).cast("long").alias("__drop")).distinct(), "dropped")
    often = (docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__drop"))
             .count().where("count > 1").select("__drop"))
    bits = spark.sparkContext.broadcast(bitset.build(drop.unionByName(often), 25))
    marked = docs.withColumn("__doc", F.col(id_col).cast("long"))
    suspect = (bitset.passing(marked, "__doc", bits, True)
               .join(drop.hint("shuffle_hash"), F.col("__doc") == F.col("__drop"), "left_anti")
               .dropDuplicates(["__doc"]))
    return bitset.passing(marked, "__doc", bits, False).unionByName(suspect).drop("__doc")
