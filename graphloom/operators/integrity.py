"""Checks of a stored graph: each gives the violations it finds as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.edges import dangling, repeated_keys
from graphloom.schemas import ENDS

#: Edges by the check that looks at them.
STRUCTURE, IMPORTS = ("defines", "defines_class", "has_method"), ("imports",)
TOPOLOGY = ("contains", "in_folder", "member_of", "class_in", "step_in_pathway", "var_in_pathway", "step_in_process", "coupled_with", "makes_http_call")


def typed_counts(edges: DataFrame, sources: DataFrame, targets: DataFrame, name: str, key: str = "id") -> DataFrame:
    """(rel, typed, total): the edges whose ends are nodes of the right kinds, and all: one row."""
    ends = edges.join(sources.select(F.col(key).alias("src"), F.lit(1).alias("_a")).distinct(), "src", "left").join(targets.select(F.col(key).alias("dst"), F.lit(1).alias("_b")).distinct(), "dst", "left")
    return ends.agg(F.coalesce(F.sum((F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("long")), F.lit(0)).alias("typed"), F.count("*").alias("total")).select(F.lit(name).alias("rel"), "typed", "total")


def edge_kinds(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], kinds) -> DataFrame:
    """The counts of all edge kinds of ``kinds`` that are there."""
    return reduce(DataFrame.unionByName, [typed_counts(edges[k], nodes[ENDS[k][0]], nodes[ENDS[k][1]], k) for k in kinds if k in edges])


def _violation(check: str, rows: DataFrame, detail) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), detail.alias("detail"))


def stats_consistency(stats: DataFrame, nodes: dict[str, DataFrame]) -> DataFrame:
    """(table, told, counted): node tables whose recorded ``n`` is not their number of rows."""
    counted = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("counted")).select(F.lit(t).alias("table"), "counted") for t, df in nodes.items()])
    return stats.join(counted, "table").where("n != counted").select("table", F.col("n").alias("told"), "counted")


def run_checks(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], stats: DataFrame | None = None) -> DataFrame:
    """(check, detail) of all violations: repeated ids, edges of the wrong kinds, dangling calls, wrong statistics."""
    found = [_violation("Q1", repeated_keys(df), F.concat(F.lit(f"{t} "), F.col("id").cast("string"))) for t, df in nodes.items()]
    for check, kinds in (("Q2", STRUCTURE), ("Q3", IMPORTS), ("Q4", TOPOLOGY)):
        if any(k in edges for k in kinds):
            found.append(_violation(check, edge_kinds(nodes, edges, kinds).where("typed != total"), F.format_string("%s %d of %d", "rel", "typed", "total")))
    if "calls" in edges:
        found.append(_violation("Q5", dangling(edges["calls"], nodes["function"]), F.format_string("%s -> %s", F.col("src").cast("string"), F.col("dst").cast("string"))))
    if stats is not None:
        found.append(_violation("Q6", stats_consistency(stats, nodes), F.format_string("%s %d, counted %d", "table", "told", "counted")))
    return reduce(DataFrame.unionByName, found)
