"""Call edges: merging, sanity, degrees, neighbours, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.shared import dealt


def merge_calls(sites: DataFrame) -> DataFrame:
    """One row per pair: the highest confidence, its reason (the first by name on ties), all lines, the smallest line.

    One aggregate with a combine on the map side; a pair's lines are its call sites only.
    """
    return sites.groupBy("src", "dst").agg(
        F.max("confidence").alias("confidence"),
        F.min_by("reason", F.struct(-F.col("confidence"), F.col("reason"))).alias("reason"),
        F.array_sort(F.collect_set("line")).alias("lines"),
        F.min("line").alias("line"),
        F.count("*").alias("sites"),
    )


def is_suspect_loop(src: Column, dst: Column, confidence: Column, reason: Column) -> Column:
    """A self loop that only a guess of the name supports."""
    return (src == dst) & (confidence < 0.9) & reason.isin("fuzzy", "method_call")


def drop_suspect_loops(edges: DataFrame) -> DataFrame:
    return edges.where(~is_suspect_loop(*map(F.col, ("src", "dst", "confidence", "reason"))))


def with_known_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose ends both exist."""
    return edges.join(sources.select(F.col(key).alias("src")), "src", "left_semi").join(targets.select(F.col(key).alias("dst")), "dst", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges of which an end is missing; they are counted first, and dealt out by their number."""
    rows = edges.count()
    ids = nodes.select(F.col(key)).distinct()
    each = dealt(edges.select("src", "dst"), rows, "src", "dst").distinct()
    lacks = lambda end: dealt(each, rows, end).join(dealt(ids.withColumnRenamed(key, end), rows, end), end, "left_anti").select("src", "dst")
    return dealt(lacks("src").unionByName(lacks("dst")), rows, "src", "dst").distinct()


def repeated_keys(nodes: DataFrame, key: str = "id") -> DataFrame:
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """``nodes`` with ``callers`` and ``callees``: both counted in one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counted = ends.groupBy(F.col("e.n").alias(key)).agg(F.sum("e.i").alias("callers"), F.sum("e.o").alias("callees"))
    return nodes.join(counted, key, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("callers", "callees")})


def callers_of(edges: DataFrame, nodes: DataFrame, targets: DataFrame, key: str = "id") -> DataFrame:
    """(target, id, name, confidence): who calls each of ``targets`` (column ``target``)."""
    hit = edges.join(targets, F.col("dst") == F.col("target"))
    return hit.join(nodes, F.col("src") == F.col(key)).select("target", F.col(key).alias("id"), "name", "confidence")


def callees_of(edges: DataFrame, nodes: DataFrame, targets: DataFrame, key: str = "id") -> DataFrame:
    hit = edges.join(targets, F.col("src") == F.col("target"))
    return hit.join(nodes, F.col("dst") == F.col(key)).select("target", F.col(key).alias("id"), "name", "confidence")


def importers_of(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct importers of any target: a semi join, then one row each."""
    return imports.join(targets.select(F.col("target").alias("dst")), "dst", "left_semi").select("src").distinct()


def top_fan_out(edges: DataFrame, most: int = 4) -> DataFrame:
    """The ``most`` best edges of each source, by confidence and then target.

    The rank filter reaches below the window (WindowGroupLimit), so a map task
    sends ``most`` edges of a source at most, also of a hub.
    """
    order = Window.partitionBy("src").orderBy(F.desc("confidence"), "dst")
    return edges.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")
