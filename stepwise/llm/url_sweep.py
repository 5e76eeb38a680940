"""URL filter: prefix rules as intervals over reversed-host keys, swept in order.

A rule (host, path) covers its host, every subdomain and every path that
starts with its path.  A url is looked up once per ancestor host (its own
host and each parent domain); for one ancestor the rules are plain prefixes,
so each rule is the key interval [key, key + "G") and rules nest.  Urls and
interval ends are sorted together; the running top of the stack of open
intervals is the longest rule that covers the url.  Every sorted shard holds
all rule events and a hash share of the urls, so neither a popular host nor a
popular rule gathers in one task.

Built from DataFrame operations alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.storage import shuffle_partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    raw = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """Text after the host up to ``? #``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_key(labels: Column, path: Column) -> Column:
    """Sort key of reversed host labels and a path.

    Hexadecimal text keeps the byte order, makes ``-`` and ``G`` safe as
    lower and upper bounds, and cannot mistake host text for path text.
    """
    return F.concat(F.hex(F.array_join(labels, ".")), F.lit("-"), F.hex(path))


def _rule_events(rules: DataFrame) -> DataFrame:
    """Open and close events; a close hands the stack back to the parent rule."""
    r = (rules.select(F.col("host"), F.col("path"),
                      (F.col("verdict") == "block").alias("blocks"))
         .where("host is not null and path is not null and blocks is not null")
         .groupBy("host", "path").agg(F.max("blocks").alias("blocks")))
    n = F.length("path")
    up = (r.where(n > 0)
          .select("host", "path",
                  F.explode(F.transform(F.sequence(F.lit(0), n - 1),
                                        lambda i: F.col("path").substr(F.lit(1), i))).alias("prefix")))
    parent = (up.join(r.select("host", F.col("path").alias("prefix"),
                               F.col("blocks").alias("p_blocks")), ["host", "prefix"])
              .groupBy("host", "path")
              .agg(F.max_by(F.struct(F.col("prefix").alias("path"), F.col("p_blocks").alias("blocks")),
                            F.length("prefix")).alias("parent")))
    key = canonical_key(F.reverse(F.split("host", r"\.")), F.col("path"))
    both = r.join(parent, ["host", "path"], "left").withColumn("key", key)
    top = lambda path, blocks: F.struct(
        F.col("host").alias("host"), path.alias("path"), blocks.alias("blocks"))
    opened = both.select("key", F.lit(1).alias("kind"), top(F.col("path"), F.col("blocks")).alias("top"))
    # after the close either the parent is on top or nothing (path null)
    closed = both.select(F.concat("key", F.lit("G")).alias("key"), F.lit(0).alias("kind"),
                         top(F.col("parent.path"), F.col("parent.blocks")).alias("top"))
    return opened.unionByName(closed)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow",
               shards: int | None = None) -> DataFrame:
    """One row per page: id, host, path, rule (or null) and verdict.

    ``rules`` has host, path and verdict (``block`` or ``allow``); of two
    equal rules ``block`` wins.  The longest rule text wins, a tie goes to
    the longer host.  A null url or one without ``://`` has an empty host and
    path and so the default verdict; repeated rows stay repeated; other
    columns are ignored.  No rules: every page has the default verdict.
    """
    n = shards or shuffle_partitions(pages.sparkSession)
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    p = p.withColumn("shard", F.pmod(F.xxhash64("id", "url"), F.lit(n)))
    labels = F.reverse(F.split(url_host(F.col("url")), r"\."))
    probes = (p.withColumn("labels", labels)
              .select("shard", "id", "url", "labels",
                      F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("depth"))
              .select("shard", "id", "url", "depth",
                      canonical_key(F.slice("labels", F.lit(1), F.col("depth")),
                                    url_path(F.col("url"))).alias("key"),
                      F.lit(2).alias("kind")))
    events = (_rule_events(rules)
              .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))))
    lane = probes.unionByName(events, allowMissingColumns=True)
    sweep = Window.partitionBy("shard").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # a rule may only open for its own host, so the top of the stack always
    # belongs to the ancestor that was probed: key order keeps hosts apart
    hit = lane.withColumn("open", F.last("top", ignorenulls=True).over(sweep)).where("kind = 2")
    size = F.length("open.host") + F.length("open.path")
    best = (hit.groupBy("shard", "id", "url")
            .agg(F.max(F.when(F.col("open.path").isNotNull(),
                              F.struct(size.alias("n"), F.length("open.host").alias("h"),
                                       F.concat("open.host", "open.path").alias("rule"),
                                       F.col("open.blocks").alias("blocks")))).alias("best"),
                 F.count_if(F.col("depth") == 1).alias("copies")))
    one = best.select(F.col("id").alias(id_col), url_host(F.col("url")).alias("host"),
                      url_path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"),
                      F.when(F.col("best.blocks"), "block").when(F.col("best").isNotNull(), "allow")
                      .otherwise(F.lit(default)).alias("verdict"), "copies")
    return (one.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
            .drop("copies", "_"))
