"""Nulls, empty and very long texts, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepwise.llm import (
    int8_tiles, line_crf, ngram_ratio, pfair_mix, piece_codec, repeat_intervals, super_minhash,
    token_cache, toxicity_fm, url_sweep)
from stepwise.llm.queries import URL_RULES, tokenizer_path

LONG = " ".join(f"word{i % 997} tail{i}" for i in range(20_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),    # repeated row
    (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 4),
    (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", None, len(LONG)), (7, "x" * 20_000, "en", "b", 20_000),
    (None, "a text without id that is somewhat longer than ten words in all", "en", "a", 1),
    (None, None, None, None, None),
    (8, "él niño 日本語 😀 ok\nnext line\nnext line", "es", "a", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """The rows above, with columns that clash with names the operators use."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("id", "score", "kept", "component", "label_id", "trusted", "digest", "shard", "rep", "_doc", "gram"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


def _ops(labels, spark):
    crf = lambda d: line_crf.score_documents(d, line_crf.fit(d, labels, F.lit(True)))
    fm = lambda d: toxicity_fm.score_documents(d, toxicity_fm.fit(d, labels, F.lit(True)))
    grams = lambda d: ngram_ratio.judge(d, ngram_ratio.fit(d, ngram_ratio.trusted_sample(labels)))
    return {
        "pieces": lambda d: piece_codec.encode_documents(d, tokenizer_path("piece_bpe_32k.model")),
        "quality": crf, "tokens": lambda d: token_cache.count_tokens(d, tokenizer_path("word_bpe_49k.json")),
        "near": super_minhash.near_duplicates, "repeats": repeat_intervals.repeat_spans,
        "mix": lambda d: pfair_mix.mix_sources(d, {"a": 1.0, "b": 2.0, None: 1.0}),
        "toxicity": fm, "rules": grams,
    }


@pytest.mark.parametrize("name", ["pieces", "quality", "tokens", "near", "repeats", "mix", "toxicity", "rules"])
def test_edge_rows_and_empty_table(spark, docs, labels, name):
    op = _ops(labels, spark)[name]
    out = op(docs)
    got = out.collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r[0] or 0 for r in ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0] == by_id[1][1] or name == "mix"      # repeated rows get the same result
    if name == "pieces":
        assert by_id[2][0].ids == [] and by_id[3][0].decoded == "" and all(r.exact for r in got)
    if name in ("quality", "toxicity"):
        assert all(0.0 <= r.score <= 1.0 and r.predicted == (r.score >= 0.5) for r in got)
    if name == "tokens":
        assert by_id[2][0].n_tokens == by_id[3][0].n_tokens == by_id[4][0].n_tokens == 0
        assert by_id[5][0].over_limit and by_id[5][0].n_tokens == by_id[6][0].n_tokens
    if name == "near":
        assert by_id[6][0].component_id == 5 and not by_id[6][0].kept
        assert all(by_id[i][0].kept for i in (1, 2, 3, 4, 5, 7, 8, None))
        assert by_id[2][0].n_shingles == by_id[4][0].n_shingles == 0 and by_id[7][0].n_shingles == 1
    if name == "repeats":
        assert by_id[6][0].kept == b"" and by_id[5][0].spans == [] and by_id[1][0].spans == []
        assert by_id[7][0].kept == b"x"        # every later string of x stands earlier too
    if name == "rules":
        assert by_id[2][0].base_failed and by_id[2][0].n_words == 0 and not by_id[3][0].kept
        assert by_id[8][0].n_dup_lines == 1
    empty = op(docs.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_urls_edge_rows(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.net/en/x"), (4, "http://EXAMPLE.net/en/x"),
         (None, "ftp://a.b.org/fr/?q"), (6, "http://example.net"), (7, "x://" + "a." * 300 + "net/" + "p" * 5000),
         (8, "http://notexample.com/de/"), (9, "http://w.example.com/de/#f"), (10, "a://b://net/")],
        "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("shard", F.lit(1))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {(r.page_id, r.host[:12], r.rule, r.verdict) for r in url_sweep.judge_urls(pages, rules).collect()}
    assert got == {(1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"),
                   (4, "example.net", "example.net/en/", "allow"), (None, "a.b.org", "org/fr/", "allow"),
                   (6, "example.net", None, "allow"), (7, "a.a.a.a.a.a.", "net/", "block"),
                   (8, "notexample.c", None, "allow"), (9, "w.example.co", "example.com/de/", "block"),
                   (10, "b:", None, "allow")}
    assert url_sweep.judge_urls(pages, rules).where("page_id = 4").count() == 2
    assert url_sweep.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_sweep.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_vectors_edge_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, None], 0),
            (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [], 0),
            (10, [-0.0, 1.0], 0), (11, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (12, [1e-30, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in int8_tiles.link_embeddings(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False), 10: (1, 10, True), 11: (1, 10, False),
                   None: (0, None, True), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}}
    assert int8_tiles.link_embeddings(df.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stage_edge_rows(spark, docs, labels, stage, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    for table in (docs, docs.limit(0)):
        out = run(spark, table, str(tmp_path))
        n = out.count()
        assert n <= table.count()
        if name != "pieces":
            assert out.columns == corpus_pipeline.COLUMNS
        if name in ("repeats", "mix", "pieces"):
            assert n == table.count()
        if name == "near_duplicates" and n:
            ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
            assert ids == [1, 2, 3, 4, 5, 7, 8] and n == 9
