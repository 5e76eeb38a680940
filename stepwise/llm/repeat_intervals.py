"""Removal of repeated byte strings by the interval tree of a suffix array.

Every string of LENGTH bytes has an anchor: the start of the smallest hash
among its GRAM-byte substrings.  Equal strings have equal anchors, so a text
is cut into spans (all strings of one anchor), and only spans whose anchor
gram occurs twice go on:

1. Equal spans are settled by their first place, counted with partial sums.
2. Different spans with one anchor gram repeat in parts.  Their suffixes are
   sorted, neighbouring common prefixes give the tree of common-prefix
   intervals by one scan with a stack, and every interval whose occurrences
   differ in the byte before them is a maximal repeat.  All its occurrences
   but the first are removed.
3. A gram with more than CROWD different spans (a passage that stands in very
   many texts) is not gathered in a task; the strings of its spans are settled
   like whole spans in 1, one string at a time.

Filters of fixed size keep texts and anchors that cannot matter out of the
shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.llm import bitset
from stepwise.llm import textops as tx
from stepwise.llm.storage import saved
from stepwise.llm.textops import U64

LENGTH = 100                # bytes of a repeat
GRAM = 32                   # bytes of an anchor gram
WINDOWS = LENGTH - GRAM + 1
DOC_BITS = 25               # of the filters over documents: 4 MB
CROWD = 4096                # spans of one gram that are sorted in one task
CHUNK_BYTES = 1 << 19       # text of one suffix array
SLICE_BYTES = 1 << 19       # also the piece of a long text that is hashed at once
_POSITION = U64((1 << 24) - 1)      # a piece's places fit in 24 bits
_END = 0xFF                 # no byte of UTF-8 text
_CODE_2 = tx.mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


# -- anchors ---------------------------------------------------------------

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def spans(buf: np.ndarray, off: np.ndarray):
    """Anchor gram, content hash, document, start and number of strings of every span.

    Documents shorter than LENGTH have none.  Text is taken in pieces that
    overlap by one string, so that long documents need no more memory.
    """
    parts = []
    step = SLICE_BYTES
    for a in range(0, max(len(buf), 1), step):
        parts.append(_spans_of_piece(buf, off, a, min(len(buf), a + step + LENGTH - 1)))
    return [np.concatenate(x) for x in zip(*parts)]


def _spans_of_piece(buf, off, a, b):
    part = buf[a:b]
    m = len(part) - GRAM + 1
    if len(part) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    up, down = tx.powers(len(part) + 1)
    pre = np.concatenate((np.zeros(1, U64), np.cumsum(tx.BYTE_CODE[part] * up[:len(part)], dtype=U64)))
    h = tx.mix64((pre[GRAM:] - pre[:m]) * down[:m])
    # the smallest hash, with its place in the low bits; the leftmost of equal ones
    least = _sliding_min((h & ~_POSITION) | np.arange(m, dtype=U64), WINDOWS)
    doc = tx.owners(off, np.arange(a, a + len(least)))
    string = np.flatnonzero(np.arange(a, a + len(least)) + LENGTH <= off[doc + 1])
    at = (least[string] & _POSITION).astype(np.int64)
    new = np.ones(len(string), bool)
    new[1:] = (at[1:] != at[:-1]) | (string[1:] != string[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(string)))
    lo, at = string[first], at[first]
    content = tx.mix64((pre[lo + count + LENGTH - 1] - pre[lo]) * down[lo])
    content = tx.mix64(content ^ tx.mix64((at - lo).astype(U64) * U64(1 << 20) + count.astype(U64)))
    d = doc[lo]
    return h[at].view(np.int64), content.view(np.int64), d, lo + a - off[d], count


# -- suffix array and interval tree ------------------------------------------

def suffix_array(buf: np.ndarray, off: np.ndarray):
    """Sorted suffixes of the texts that have LENGTH bytes and share them with another.

    Returns text and offset of every suffix in sorted order, the common prefix
    of each with the one before (0 at first), and the byte before it (negative
    and different for every text at its start).
    """
    size = np.diff(off)
    text = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    at = tx.spread(off[:-1], np.maximum(size - LENGTH + 1, 0))
    key = tx.span_hash(buf, at, at + LENGTH)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order] = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(key) else False
    text, at = text[twice], at[twice]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none
    left = np.where(at > off[text], buf[np.maximum(at - 1, 0)].astype(np.int64), -1 - text)
    width = int(size.max())
    rest = off[text + 1] - at
    padded = np.concatenate((buf, np.full(width, _END, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[at]      # a copy of the suffixes
    rows[np.arange(width) >= rest[:, None]] = _END
    order = np.argsort(rows.view(f"S{width}").reshape(-1), kind="stable")
    rows, text, at, left, rest = rows[order], text[order], at[order], left[order], rest[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.concatenate(([0], np.minimum(common, np.minimum(rest[1:], rest[:-1]))))
    return text, at - off[text], lcp, left


def interval_tree(lcp: np.ndarray, left: np.ndarray, rank: np.ndarray, least: int = LENGTH) -> Iterator[tuple]:
    """(length, first row, last row, row of the first occurrence, other rows) of every maximal repeat.

    One scan with a stack over the common prefixes: an interval closes when
    the prefix gets shorter and becomes a child of the one that stays open.
    ``rank`` orders occurrences; "other rows" are the first occurrences of the
    children that are not the interval's first, each row being such a loser
    at most once, in the longest repeat in which it is not first.
    """
    n = len(lcp)
    stack: list[list] = []          # length, first row, best row, left byte or None, losers
    lcp, left, rank = lcp.tolist(), left.tolist(), rank.tolist()
    for i in range(1, n + 1):
        now = lcp[i] if i < n and lcp[i] >= least else 0
        if not now and not stack:
            continue
        start, best, byte = i - 1, i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            top = stack.pop()
            _add(top, best, byte, rank)
            if top[3] is None:
                yield top[0], top[1], i - 1, top[2], top[4]
            start, best, byte = top[1], top[2], top[3]
        if now:
            if stack and stack[-1][0] == now:
                _add(stack[-1], best, byte, rank)
            else:
                stack.append([now, start, best, byte, []])


def _add(node: list, best: int, byte, rank: list) -> None:
    """Makes a row or closed interval a child of an open one."""
    if rank[best] < rank[node[2]]:
        node[4].append(node[2])
        node[2] = best
    elif best != node[2]:
        node[4].append(best)
    if node[3] != byte:
        node[3] = None              # occurrences differ on the left


def maximal_repeats(texts: list[bytes], least: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences as (text, offset)) of the maximal repeats of some texts."""
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    text, at, lcp, left = suffix_array(np.frombuffer(b"".join(texts), np.uint8), off)
    place = list(zip(text.tolist(), at.tolist()))
    return [(length, sorted(place[a:b + 1]))
            for length, a, b, _, _ in interval_tree(lcp, left, np.lexsort((at, text)).argsort(), least)]


def later_copies(buf, off, doc, start):
    """(document, start, end) of the repeats of some spans, without first occurrences."""
    text, at, lcp, left = suffix_array(buf, off)
    where_doc, where = doc[text], start[text] + at
    rank = np.empty(len(text), np.int64)
    order = np.lexsort((where, where_doc))
    # the same place may be cut into a span twice; equal places are one occurrence
    new = np.ones(len(order), bool)
    new[1:] = (where[order][1:] != where[order][:-1]) | (where_doc[order][1:] != where_doc[order][:-1])
    rank[order] = np.cumsum(new)
    rows, length = [], []
    for size, _, _, first, losers in interval_tree(lcp, left, rank):
        keep = [x for x in losers if rank[x] != rank[first]]
        rows += keep
        length += [size] * len(keep)
    rows = np.array(rows, np.int64)
    return where_doc[rows], where[rows], where[rows] + np.array(length, np.int64)


# -- plan ----------------------------------------------------------------------

def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text", SLICE_BYTES):
            gram = spans(*tx.flat(part.column("text")))[0]
            gram, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])


_SPAN = "gram long, content long, doc long, start long, strings long"


def _span_batches(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                got = spans(*tx.flat(part.column("text")))
                keep = bitset.contains(bits.value, got[0])
                gram, content, d, start, count = [x[keep] for x in got]
                ids = part.column("doc").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (gram, content, ids[d], start, count)],
                    ["gram", "content", "doc", "start", "strings"])
    return run


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of the asked spans; a span that is not what was asked for is left out."""
    names = ["gram", "crowded", "doc", "start", "piece"]
    for batch in batches:
        for part in tx.slices(batch, "text", SLICE_BYTES):
            buf, off = tx.flat(part.column("text"))
            asked = part.column("asked")
            row = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
            item = asked.flatten()
            start, count = (item.field(c).to_numpy() for c in ("start", "strings"))
            ok = start + count + LENGTH - 1 <= np.diff(off)[row]
            a = (off[row] + start)[ok]
            b = a + count[ok] + LENGTH - 1
            row, item = row[ok], item.filter(pa.array(ok))
            size = b - a
            ends = np.concatenate(([0], np.cumsum(size)))
            data = buf[tx.spread(a, size)]
            piece = pa.Array.from_buffers(pa.large_binary(), len(size), [
                None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [item.field("gram"), item.field("crowded"), part.column("doc").take(pa.array(row)),
                 item.field("start"), piece.cast(pa.binary())], names)


def _later_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Interval trees over the sorted grams of a partition, some grams at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column("piece").nbytes for b in held) >= CHUNK_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))      # the last gram may go on
            if cut:
                yield from _later(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held:
        yield from _later(pa.Table.from_batches(held))


def _later(table: pa.Table) -> Iterator[pa.RecordBatch]:
    gram = table.column("gram").to_numpy()
    size = table.column("piece").combine_chunks()
    bounds = np.concatenate((np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))), [len(gram)]))
    weight = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(size)))))[bounds]
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(weight, weight[i] + CHUNK_BYTES, "right")) - 1)
        part = table.slice(bounds[i], bounds[j] - bounds[i]).combine_chunks()
        buf, off = tx.flat(part.column("piece"))
        doc, start, end = later_copies(buf, off, part.column("doc").to_numpy(), part.column("start").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(end)], ["doc", "start", "end"])
        i = j


def _string_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes and the place of every string of the spans."""
    for batch in batches:
        buf, off = tx.flat(batch.column("piece"))
        count = np.diff(off) - LENGTH + 1
        at = tx.spread(off[:-1], count)
        row = np.repeat(np.arange(batch.num_rows), count)
        one, two = (tx.span_hash(buf, at, at + LENGTH, c).view(np.int64) for c in (tx.BYTE_CODE, _CODE_2))
        doc = batch.column("doc").to_numpy()[row]
        start = batch.column("start").to_numpy()[row] + at - off[row]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, doc, start)],
                                         ["one", "two", "doc", "start"])


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc, spans) of every document that loses something; docs has doc (long) and text."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    docs = docs.where("doc is not null")
    grams = saved(docs.mapInArrow(_gram_batches, "gram long, n long").groupBy("gram")
                  .agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "grams")
    found = saved(docs.mapInArrow(_span_batches(share(bitset.build(grams))), _SPAN).join(grams, "gram"), "spans")
    place = F.struct("doc", "start")
    kinds = saved(found.groupBy("gram", "content").agg(
        F.min(place).alias("first"), F.min("strings").alias("strings"), F.count("*").alias("n")), "span-kinds")
    whole = (found.join(kinds.where("n > 1").select("gram", "content", "first"), ["gram", "content"])
             .where(place != F.col("first"))
             .select("doc", "start", (F.col("start") + F.col("strings") + (LENGTH - 1)).alias("end")))
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = (kinds.join(several, "gram")
             .select(F.col("first.doc").alias("doc"), F.struct(
                 "gram", F.col("first.start").alias("start"), "strings",
                 (F.col("kinds") > CROWD).alias("crowded")).alias("one"))
             .groupBy("doc").agg(F.collect_list("one").alias("asked")))     # bounded by the text's length
    asked = saved(asked, "asked")
    near = bitset.passing(docs, "doc", share(bitset.build(asked.select("doc"), DOC_BITS)), True)
    cut = saved(near.join(asked.hint("shuffle_hash"), "doc").select("doc", "text", "asked")
                .mapInArrow(_cut_batches, "gram long, crowded boolean, doc long, start long, piece binary"), "cut")
    parts = (cut.where("not crowded").repartition("gram").sortWithinPartitions("gram")
             .mapInArrow(_later_batches, "doc long, start long, end long"))
    strings = saved(cut.where("crowded").mapInArrow(
        _string_batches, "one long, two long, doc long, start long"), "strings")
    firsts = (strings.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    single = (strings.join(saved(firsts, "string-kinds"), ["one", "two"]).where(place != F.col("first"))
              .select("doc", "start", (F.col("start") + LENGTH).alias("end")))
    every = whole.unionByName(parts).unionByName(single)
    return saved(every.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "repeats")


# -- use -----------------------------------------------------------------------

_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _cut_out(docs: DataFrame, id_col: str, text_col: str, cut, schema: T.StructType) -> DataFrame:
    """``cut`` (record batch with __runs to record batch) over all documents.

    Only texts that may lose something are shuffled; the others are cut with
    no runs where they are read.
    """
    base = docs.withColumn("__doc", F.col(id_col).cast("long"))
    repeats = find_repeats(base.select(F.col("__doc").alias("doc"), F.col(text_col).alias("text")))
    bits = docs.sparkSession.sparkContext.broadcast(bitset.build(repeats.select("doc"), DOC_BITS))
    touched = (bitset.passing(base, "__doc", bits, True)
               .join(repeats.select(F.col("doc").alias("__doc"), F.col("runs").alias("__runs"))
                     .hint("shuffle_hash"), "__doc", "left")
               .select(*base.columns, "__runs"))

    def run(rest: bool):
        def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if rest:
                    batch = batch.filter(pa.array(~bitset.lets_through(bits.value, batch.column("__doc"))))
                for part in tx.slices(batch, text_col, SLICE_BYTES):
                    yield cut(part)
        return batches

    others = base.withColumn("__runs", F.lit(None).cast(_RUNS))
    return touched.mapInArrow(run(False), schema).unionByName(others.mapInArrow(run(True), schema))


def _kept_bytes(buf: np.ndarray, off: np.ndarray, runs: pa.Array) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Merged runs and remaining bytes of every text."""
    runs = runs.fill_null([]) if runs.null_count else runs
    row = np.repeat(np.arange(len(off) - 1), np.diff(runs.offsets.to_numpy()))
    flat = runs.flatten()
    depth = np.zeros(len(buf) + 1, np.int32)
    # ends of one text and starts of the next may share a place, so they cancel out
    np.add.at(depth, off[row] + flat.field("start").to_numpy(), 1)
    np.add.at(depth, off[row] + flat.field("end").to_numpy(), -1)
    gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
    a, b = tx.segments(gone, off)
    doc = tx.owners(off, a)
    merged = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(len(off))), pa.int32()),
        pa.StructArray.from_arrays([pa.array(a - off[doc]), pa.array(b - off[doc])], ["start", "end"]))
    ends = np.concatenate(([0], np.cumsum(~gone)))[off].tolist()
    data = buf[~gone].tobytes()
    return gone, merged, [data[x:y] for x, y in zip(ends, ends[1:])]


def repeat_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (removed runs as byte ranges), kept (bytes).

    A byte goes if a LENGTH-byte string that covers it also starts earlier: in
    a document with a smaller id, or earlier in the same document, as the
    input stands.  A null text counts as empty; a text shorter than LENGTH
    stays whole; rows that repeat an id are one document; rows without id are
    left alone; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = tx.flat(part.column("text"))
        _, merged, kept = _kept_bytes(buf, off, part.column("__runs"))
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(np.diff(off)), merged, pa.array(kept, pa.binary())],
            ["id", "n_bytes", "spans", "kept"])

    return _cut_out(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", cut,
                    T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()),
                                  T.StructField("spans", _RUNS), T.StructField("kept", T.BinaryType())])
                    ).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the text.

    Bytes of a character that was cut in two are dropped, a null text stays
    null; names that start with ``__`` are reserved; for the rest see
    ``repeat_spans``.
    """
    names, schema = docs.columns, docs.schema
    schema[text_col].nullable = True

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = tx.flat(part.column(text_col))
        gone, _, kept = _kept_bytes(buf, off, part.column("__runs"))
        text = part.column(text_col)
        if gone.any():
            text = pc.if_else(text.is_null(), pa.scalar(None, pa.string()),
                              pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
        return pa.RecordBatch.from_arrays([text if c == text_col else part.column(c) for c in names], names)

    return _cut_out(docs, id_col, text_col, cut, schema)
