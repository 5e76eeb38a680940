"""Edge text (S1-S4) and row writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.functions.columns import format_2dp
from stepwise.operators.graph import undirected

# Fixed values of the edge-text format.
COMMENT_PREFIX = "%"
FIELD_SEP = "\t"
OUT_SEP = " "


def parse_edge_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """S2 + S3: drop ``%`` comment lines, split on TAB, keep fields 0 and 1.

    A malformed id fails the job (ANSI cast), as ``Long.parseLong`` does.
    """
    v = F.col(column)
    parts = F.split(v, FIELD_SEP)
    return (lines.where(~v.startswith(COMMENT_PREFIX))
            .select(parts.getItem(0).cast("long").alias("src"),
                    parts.getItem(1).cast("long").alias("dst")))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Directed edges from a text file or folder."""
    return parse_edge_lines(spark.read.text(path))


def read_undirected_edges(spark: SparkSession, path: str) -> DataFrame:
    """Every edge in both directions."""
    return undirected(read_edges(spark, path))


def edge_lines(edges: DataFrame, extra: str | None = None) -> DataFrame:
    """Edges as TAB-separated text lines (optionally with a third field)."""
    cols = [F.col("src").cast("string"), F.col("dst").cast("string")]
    if extra:
        cols.append(F.col(extra).cast("string"))
    return edges.select(F.concat_ws(FIELD_SEP, *cols).alias("value"))


def write_edges(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S1 written: TAB-separated edge text."""
    edge_lines(edges).write.mode(mode).text(path)


def write_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S9 (``overwrite``) / S10 (``errorifexists``): blank-separated rows."""
    df.write.mode(mode).option("sep", OUT_SEP).option("header", "false").csv(path)


def params_lines(params: DataFrame) -> DataFrame:
    """``theta0 theta1`` text lines."""
    return params.select(F.concat_ws(OUT_SEP, F.col("theta0").cast("string"),
                                     F.col("theta1").cast("string")).alias("value"))


def write_params(params: DataFrame, path: str, mode: str = "overwrite") -> None:
    params_lines(params).write.mode(mode).text(path)


def formatted_lines(df: DataFrame, cols: list[str], id_col: str | None = None) -> DataFrame:
    """Numbers with two decimals, blank-separated; an id as plain integer."""
    parts = [F.col(id_col).cast("string")] if id_col else []
    parts += [format_2dp(c) for c in cols]
    return df.select(F.concat_ws(OUT_SEP, *parts).alias("value"))


def write_formatted(df: DataFrame, path: str, cols: list[str], id_col: str | None = None,
                    mode: str = "overwrite") -> None:
    formatted_lines(df, cols, id_col).write.mode(mode).text(path)
