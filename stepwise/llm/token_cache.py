"""Token counts through a digest cache.

A text is looked up by two digests: one of its normalised content and one of
the tokenizer (file bytes and library version).  Only distinct contents that
the cache lacks are encoded; their counts are appended to the cache table,
and every document reads its count from there.

Normalisation may only remove what the tokenizer itself ignores: a tokenizer
that collapses and drops white space gets runs of ASCII white space collapsed
and ends trimmed; for every other tokenizer the content is taken as it is.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm.storage import saved, shared_path
from stepwise.llm.textops import slices

_CACHE = "version string, digest binary, n_tokens long"
_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
# Words of a memo's generation; of the generation before, those that come back are kept.
MEMO_WORDS = 250_000


@functools.lru_cache(maxsize=8)
def drops_blanks(path: str) -> bool:
    """Whether blanks only separate: collapsed by the normaliser, removed by the splitter.

    True for a ``.json`` whose normaliser rewrites ``\\s+`` to one blank and
    whose splitter keeps only matches that exclude white space.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm = spec.get("normalizer") or {}
    norms = norm.get("normalizers", [norm])
    pre = spec.get("pre_tokenizer") or {}
    pres = pre.get("pretokenizers", [pre])
    collapses = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"}
                    and x.get("content") == " " for x in norms)
    splits = any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert")
                 and "[^\\s" in x.get("pattern", {}).get("Regex", "") for x in pres)
    plain = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"]
                and not t["single_word"] for t in spec.get("added_tokens", []))
    return collapses and splits and plain


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    if path.endswith(".json"):
        import tokenizers as lib
    else:
        import sentencepiece as lib
    h = hashlib.sha256(f"{lib.__name__} {lib.__version__} ".encode())
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()


def normalised(text: Column, blanks: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, _BLANKS, " ")) if blanks else text


class Counter:
    """Counts tokens of texts; loaded once per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.blanks = drops_blanks(path)
        if path.endswith(".json"):
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._encode = lambda xs: [
                len(e.ids) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
        else:
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda xs: [len(e) for e in sp.encode(xs, num_threads=1)]
        self._memo: dict[str, int] = {"": 0}
        self._older: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Where blanks only separate, each different word is encoded once."""
        if not self.blanks:
            return self._encode(texts)
        if len(self._memo) > MEMO_WORDS:
            self._memo, self._older = {"": 0}, self._memo
        memo, older, split = self._memo, self._older, [t.split(" ") for t in texts]
        new = set()
        for ws in split:
            new |= set(ws).difference(memo)
        for w in new.intersection(older):
            memo[w] = older[w]
        new = list(new.difference(older))
        for i in range(0, len(new), 4096):
            memo.update(zip(new[i:i + 4096], self._encode(new[i:i + 4096])))
        return [sum(map(memo.__getitem__, ws)) for ws in split]


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in slices(batch, "content", 2 << 20):
                n = counter.count(part.column("content").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])
    return run


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    """Digest and count stored for one tokenizer; empty when there is no table yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return (spark.read.schema(_CACHE).parquet(cache_dir).where(F.col("version") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def count_tokens(docs: DataFrame, tokenizer: str, *, cache_dir: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``cache_dir`` is a shared folder kept between runs; without one a new
    cache is filled.  No special tokens are added, special strings in a text
    count as the library's default has them, nothing is truncated.  A null
    text counts as empty (0 tokens); repeated rows stay; other columns are
    ignored; an empty table gives no rows and adds nothing to the cache.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    cache_dir = cache_dir or shared_path(spark, "token-cache")
    content = normalised(F.col("text"), drops_blanks(tokenizer))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    digest = F.substring(F.unhex(F.sha2(content, 256)), 1, 16)
    keyed = saved(base.select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
                              .alias("n_bytes"), digest.alias("digest")), "token-keys")
    # one document stands for each content; the minimum combines before the shuffle
    missing = (keyed.groupBy("digest").agg(F.min(F.struct("id")).alias("pick"))
               .join(read_cache(spark, cache_dir, version), "digest", "left_anti")
               .select("digest", F.col("pick.id").alias("pick")))
    texts = base.select("id", content.alias("content"))
    found = (texts.join(missing.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("pick")))
             .where(F.substring(F.unhex(F.sha2("content", 256)), 1, 16) == F.col("digest")))
    counts = found.select("digest", "content").mapInArrow(
        _encode_batches(tokenizer), "digest binary, n_tokens long")
    # equal rows may stand for one content twice; the cache is read by maximum
    counts.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_dir)
    # a written table of one row per digest lets a frequent content's join be split
    known = saved(read_cache(spark, cache_dir, version)
                  .join(keyed.select("digest").distinct(), "digest", "left_semi"), "token-counts")
    return (keyed.join(known, "digest")
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))
