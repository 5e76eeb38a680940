"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted, one over the trusted
documents and one over the whole raw corpus.  A document's verdict is the
mean over its n-grams of log(p_trusted / p_raw) against a fixed threshold, so
equal texts always get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm import bitset
from stepwise.llm import textops as tx

GRAM = 4                    # bytes of an n-gram
BUCKET_BITS = 16
SMOOTHING = 0.5             # pseudo count of every bucket
THRESHOLD = -0.5            # mean log ratio below which a document is dropped
SLICE_BYTES = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_stats(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counted statistics of every document of a batch."""
    n = len(off) - 1
    starts, ends, doc = tx.words(buf, off)
    n_words = np.bincount(doc, minlength=n).astype(np.int64)
    chars = ((buf & 0xC0) != 0x80) & ~tx.SPACE[buf]
    # lines with a word, equal to an earlier line of the document
    ls, le = tx.segments(buf != 10, off)
    line_doc = tx.owners(off, ls)
    before = np.searchsorted(starts, ls, "left")
    worded = np.searchsorted(starts, le, "left") > before
    ls, le, line_doc = ls[worded], le[worded], line_doc[worded]
    first = tx.first_of(line_doc, tx.span_hash(buf, ls, le))
    dup_lines = np.bincount(line_doc[~first], minlength=n).astype(np.int64)
    # words covered by a 5-word window that the document has twice or more
    win = tx.window_hash(tx.span_hash(buf, starts, ends), 5)
    m = len(win)
    whole = doc[:m] == doc[4:4 + m] if m else np.zeros(0, bool)
    twice = np.zeros(m, bool)
    twice[whole] = tx.repeated(doc[:m][whole], win[whole])
    cover = np.zeros(len(doc) + 1, np.int64)
    if m:
        cover[:m] += twice
        cover[5:5 + m] -= twice
    covered = np.cumsum(cover[:-1]) > 0
    return {"n_words": n_words, "word_chars": tx.per_doc(off, chars),
            "n_symbols": tx.per_doc(off, _SYMBOL[buf]), "n_dup_lines": dup_lines,
            "n_repeat_words": np.bincount(doc[covered], minlength=n).astype(np.int64)}


def gram_buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each byte, and whether it fits its document."""
    n = len(buf)
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    m = n - GRAM + 1
    h = np.zeros(m, np.uint32)
    for i in range(GRAM):
        h = (h << np.uint32(8)) | buf[i:i + m]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    fits = np.ones(n, bool)
    for i in range(1, GRAM):
        last = off[1:] - i
        fits[last[last >= off[:-1]]] = False
    return h, fits[:m]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task: bucket, grams of all documents, grams of trusted ones."""
    raw = np.zeros(1 << BUCKET_BITS, np.int64)
    trusted = raw.copy()
    for batch in batches:
        for part in tx.slices(batch, "text", SLICE_BYTES):
            buf, off = tx.flat(part.column("text"))
            h, fits = gram_buckets(buf, off)
            raw += np.bincount(h[fits], minlength=len(raw))
            good = np.repeat(part.column("trusted").to_numpy(zero_copy_only=False).astype(bool),
                             np.diff(off))[:len(h)] & fits
            trusted += np.bincount(h[good], minlength=len(raw))
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(trusted[at])],
        ["bucket", "raw", "trusted"])


def fit(docs: DataFrame, trusted_ids: DataFrame, text_col: str = "text",
        id_col: str = "doc_id") -> np.ndarray:
    """Log ratio per bucket; all zero when no trusted document has an n-gram.

    Counts cover every document and every trusted one.  The model has 2**16
    buckets whatever the corpus, which bounds what comes back to the driver.
    Only rows whose id is trusted, or looks so to a filter of fixed size, are
    shuffled with their texts.
    """
    spark = docs.sparkSession
    ids = trusted_ids.where("label_id is not null").select("label_id").distinct()
    bits = spark.sparkContext.broadcast(bitset.build(ids.select(F.xxhash64("label_id"))))
    base = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col).try_cast(ids.schema["label_id"].dataType)).alias("__key"))
    suspect = (bitset.passing(base, "__key", bits, True)
               .join(ids.withColumn("trusted", F.lit(True)).hint("shuffle_hash"), "label_id", "left")
               # every counting task sends a table of its own, so a few tasks read all shuffle partitions
               .coalesce(2 * spark.sparkContext.defaultParallelism))
    marked = (bitset.passing(base, "__key", bits, False).select("text", F.lit(False).alias("trusted"))
              .unionByName(suspect.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))))
    counts = (marked.mapInArrow(_count_batches, "bucket int, raw long, trusted long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
              .toPandas())
    raw = np.zeros(1 << BUCKET_BITS)
    good = raw.copy()
    raw[counts["bucket"]] = counts["raw"]
    good[counts["bucket"]] = counts["trusted"]
    return log_ratio(good, raw)


def log_ratio(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if good.sum() == 0:
        return np.zeros(len(raw))
    p = (good + SMOOTHING) / (good + SMOOTHING).sum()
    q = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    return np.log(p / q)


def ratio_scores(buf: np.ndarray, off: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Mean log ratio of every document's n-grams; 0 for a text shorter than one.

    Each document is summed on its own, so its score does not depend on
    which documents share the batch.
    """
    h, fits = gram_buckets(buf, off)
    n = len(off) - 1
    value = np.zeros(len(buf) + 1)
    value[:len(h)] = model[h] * fits
    grams = np.maximum(np.diff(off) - GRAM + 1, 0)
    total = np.zeros(n)
    filled = np.flatnonzero(np.diff(off))
    if len(filled):
        # each sum runs to the next start, which is the document's end
        total[filled] = np.add.reduceat(value, off[filled])
    return np.where(grams > 0, total / np.maximum(grams, 1), 0.0)


def judge(docs: DataFrame, model: np.ndarray, *, id_col: str = "doc_id",
          text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, statistics, base_failed, score, kept.

    A null or empty text has no words and fails the base rules; repeated rows
    stay; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                buf, off = tx.flat(part.column("text"))
                s = base_stats(buf, off)
                score = ratio_scores(buf, off, shared.value)
                failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *[pa.array(s[c]) for c in _STATS], pa.array(failed),
                     pa.array(score), pa.array(~failed & (score >= threshold))],
                    ["id", *_STATS, "base_failed", "score", "kept"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _STATS)
                        + ", base_failed boolean, score double, kept boolean")
            .withColumnRenamed("id", id_col))


def trusted_sample(labels: DataFrame) -> DataFrame:
    """Ids of all trusted documents (label quality 1)."""
    return labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").alias("label_id")).distinct()
