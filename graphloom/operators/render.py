"""Diagram text from edges: one block of lines for each source, edges from the best on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From this confidence on an arrow is drawn thick.
THICK = 0.8


def _blocks(edges: DataFrame, line) -> DataFrame:
    rows = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "dst", line.alias("line")))).alias("rows"))
    return rows.select("src", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("chart"))


def mermaid(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Flowchart lines with the names of both ends."""
    named = edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("_x")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("_y")), "dst")
    arrow = F.when(F.col("confidence") >= THICK, "==>").otherwise("-->")
    return _blocks(named, F.format_string('    n%s["%s"] %s n%s["%s"]', "src", "_x", arrow, "dst", "_y"))


def dot(edges: DataFrame) -> DataFrame:
    width = F.greatest(F.lit(1), F.floor(3 * F.col("confidence")).cast("int"))
    return _blocks(edges, F.format_string("  n%s -> n%s [penwidth=%s];", "src", "dst", width))
