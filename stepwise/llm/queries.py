"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import (
    int8_tiles, labelled, line_crf, merge_align, ngram_ratio, pfair_mix, piece_codec, prefix_targets,
    repeat_intervals, super_minhash, threshold_clusters, token_cache, toxicity_fm, url_sweep)
from stepwise.llm.storage import table

# The url rules of the contract: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

# Text of the added conversation of the contract.
CONTROL_TEXT = r"\### Assistant: </turn> ok"

# Exponent of the temperature weights of the mixture.
MIX_ALPHA = 0.5


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of every text's piece ids, and whether decoding gives the text back."""
    coded = piece_codec.encode_documents(table(spark, sf_dir, "documents"),
                                         tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"),
                        F.xxhash64("ids").alias("ids_hash"),
                        F.length("decoded").cast("long").alias("decoded_chars"), "exact")


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: labelled.fold(F.col(c), 3) == 1
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return (line_crf.score_documents(docs, model)
            .select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call fills a cache of its own, so its figures are those of a first run."""
    return token_cache.count_tokens(table(spark, sf_dir, "documents"),
                                    tokenizer_path("word_bpe_49k.json"))


def op4_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_sweep.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix.mix_sources(docs, pfair_mix.temperature_weights(docs, MIX_ALPHA))


def op7_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeat_intervals.repeat_spans(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: labelled.fold(F.col(c), 5) == 0
    model = toxicity_fm.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return (toxicity_fm.score_documents(docs, model)
            .select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted"))


def op9_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return int8_tiles.link_embeddings(table(spark, sf_dir, "embeddings"))


def op10_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_ratio.fit(docs, ngram_ratio.trusted_sample(table(spark, sf_dir, "labels")))
    return ngram_ratio.judge(docs, model).drop("score")


def op11_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = threshold_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    shown = centroids.select("cluster", "cluster_inertia", "inertia",
                             F.sha2(F.concat_ws(",", "centroid"), 256).alias("centroid_sha256"))
    return (found.join(F.broadcast(shown), "cluster")        # one row per centroid
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def op12_merge_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups' text is digested where it is made, as it is larger than the documents."""
    return (merge_align.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                        tokenizer_path("piece_bpe_32k.model"), groups="sha256")
            .withColumnRenamed("groups", "groups_sha256"))


def op13_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts look like control strings."""
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = prefix_targets.read_examples(prefix_targets.expand_conversations(turns))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       "formatted_chars")


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_crf": op2_line_crf,
    "op3_token_counts": op3_token_counts,
    "op4_super_minhash": op4_super_minhash,
    "op5_url_filter": op5_url_filter,
    "op6_pfair_mix": op6_pfair_mix,
    "op7_repeat_intervals": op7_repeat_intervals,
    "op8_toxicity_fm": op8_toxicity_fm,
    "op9_int8_tiles": op9_int8_tiles,
    "op10_ngram_ratio": op10_ngram_ratio,
    "op11_threshold_clusters": op11_threshold_clusters,
    "op12_merge_align": op12_merge_align,
    "op13_prefix_targets": op13_prefix_targets,
}

# Smallest id reachable over the links x - y of a table l, for ids of a table n.
_REACH = """
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT id, id AS r FROM n UNION SELECT reach.id, e.y FROM reach JOIN e ON e.x = reach.r),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""



def _clusters_sql(rounds: int) -> str:
    """The contract's rounds as unrolled tables: e components, k<i> centroids, a<i> assignments."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, c, dist FROM (
    SELECT r, c, dist, row_number() OVER (PARTITION BY r ORDER BY dist, c) AS place
    FROM (SELECT r, c, sum((x - y) * (x - y)) AS dist FROM e JOIN k{i} USING (d) GROUP BY r, c) t) t
  WHERE place = 1)""")
        if i < rounds:
            steps.append(f"""
k{i + 1} AS MATERIALIZED (
  SELECT c, d, coalesce(m, y) AS y FROM k{i} LEFT JOIN (
    SELECT c, d, (s - ((s % n) + n) % n) // n AS m
    FROM (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN e USING (r) GROUP BY c, d) t) t USING (c, d))""")
    return f"""
WITH n AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
u AS MATERIALIZED (
  SELECT r, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS d FROM n),
v AS MATERIALIZED (
  SELECT r, vec_id FROM n JOIN (SELECT r FROM u GROUP BY r HAVING count(x) = 64 AND bool_and(isfinite(x))) t USING (r)),
e AS MATERIALIZED (SELECT r, CAST(floor(x * 1024) AS HUGEINT) AS x, d FROM u JOIN v USING (r)),
k0 AS MATERIALIZED (
  SELECT c, d, x AS y
  FROM e JOIN (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), r) - 1 AS c FROM v) t USING (r)
  WHERE c < 8),{",".join(steps)},
s AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS h FROM k{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS "cluster", CAST(dist AS BIGINT) AS distance,
       CAST(sum(dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(dist) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN s ON s.c = a.c"""


_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (
  SELECT *, length('### ' || role || chr(10) || replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/')
                   || '</turn>' || chr(10)) AS chars
  FROM t),
w AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR from_end = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id"""


ORACLE = {
    "op11_threshold_clusters": _clusters_sql(10),
    "op13_prefix_targets": _CHAT_SQL,
    "op4_super_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, least(len(ws), 5) AS size, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0) t),
n AS MATERIALIZED (
  SELECT w.doc_id AS id, coalesce(k, 0) AS n_shingles
  FROM w LEFT JOIN (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id) c ON c.doc_id = w.doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
      FROM s a JOIN s b ON a.sh = b.sh AND a.size = b.size AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON a.id = x JOIN n b ON b.id = y
                   WHERE 100 * k >= 85 * (a.n_shingles + b.n_shingles - k)),""" + _REACH + """
SELECT n.id AS doc_id, n_shingles, component_id, n.id = component_id AS kept FROM n JOIN comp USING (id)""",
    "op9_int8_tiles": """
WITH RECURSIVE n AS (SELECT vec_id AS id FROM embeddings),
v AS MATERIALIZED (
  SELECT vec_id, d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS d FROM embeddings
                         WHERE len(embedding) = list_count(embedding)) t
  WHERE list_dot_product(d, d) > 0 AND isfinite(list_dot_product(d, d))),
l AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id
  WHERE CASE WHEN len(a.d) = len(b.d) THEN list_cosine_similarity(a.d, b.d) >= 0.9 ELSE false END),""" + _REACH + """,
k AS (SELECT x AS id, count(*) AS n_links FROM e GROUP BY x)
SELECT comp.id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, comp.id = component_id AS kept
FROM comp LEFT JOIN k USING (id)""",
    "op5_url_filter": r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')
      THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')
      THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM j""",
}
