"""Corpus pipeline: documents to tokenised training data in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet to the shared folder and rereads it for the next one.
All stages but the last return the columns of ``documents``; the last one
gives every document its place in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import line_crf, pfair_mix, piece_codec, repeat_intervals, super_minhash
from stepwise.llm.queries import MIX_ALPHA, tokenizer_path
from stepwise.llm.storage import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Text that is segmented at once: less than alone, as workers of earlier stages still hold memory.
SLICE_BYTES = 1 << 20


def _known(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; others are left behind."""
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line model rejects (score below 0.5).

    Learns from ``labels``; without labels of both kinds nothing is dropped.
    """
    docs = _known(docs)
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return line_crf.accepted(docs, model) if model.learned else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the smallest id) of each group of near copies."""
    return super_minhash.one_of_each(_known(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes and more that stand earlier; n_chars follows the text.

    A document that loses everything stays with an empty text.
    """
    return (repeat_intervals.without_repeats(_known(docs))
            .withColumn("n_chars", F.length("text").cast("long")))


def _mixed(docs: DataFrame) -> DataFrame:
    """``docs`` in mixture order (temperature weights of the sources), with their places."""
    docs = _known(docs)
    mixed = pfair_mix.mix_sources(docs, pfair_mix.temperature_weights(docs, MIX_ALPHA))
    return pfair_mix.in_mix_order(mixed)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays all documents out in mixture order.

    The columns of ``documents`` have no room for the place, and a reader may
    take the files in another order; ``pieces`` finds the same places again.
    """
    return _mixed(docs).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, whether decoding gives its text back, and its place.

    By (mix_slot, mix_place) any prefix holds each source to within a block of
    its target share until a source has run out.  Each file is sorted by them
    and holds a range of its own.
    """
    key = F.struct("doc_id", "mix_slot", "mix_place")
    coded = piece_codec.encode_documents(_mixed(docs).withColumn("doc_id", key),
                                         tokenizer_path("piece_bpe_32k.model"), slice_bytes=SLICE_BYTES)
    return coded.select("doc_id.doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "exact",
                        "doc_id.mix_slot", "doc_id.mix_place")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("mix", mix),
    ("pieces", pieces),
]

# a trained model, a fixpoint and a tokenizer have no SQL form; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
