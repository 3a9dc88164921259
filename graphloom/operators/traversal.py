"""Bounded traversals: hops, impact, pathways, hierarchies.

All walk frontiers: a hop joins the frontier with the edges and drops what was
seen, so each node is expanded once. The number of hops is a parameter and
small, so the plan of a few hops is one query; longer walks cut their plan into
the shared folder every hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.shared import cut


def reach(edges: DataFrame, seeds: DataFrame, hops: int, forward: bool = True, keep_plan: int = 2) -> DataFrame:
    """(id, hop): the nodes within ``hops`` of ``seeds`` (column ``id``) at their smallest hop."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    steps = edges.select(F.col(a).alias("id"), F.col(b).alias("to")).distinct()
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        found = frontier.join(steps, "id").select(F.col("to").alias("id")).distinct()
        frontier = found.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        if hop % keep_plan == 0 and hop < hops:
            frontier = cut(frontier, "reach-frontier")
            seen = cut(seen.unionByName(frontier), "reach-seen")
        else:
            seen = seen.unionByName(frontier)
    return seen


def spread(edges: DataFrame, seeds: DataFrame, hops: int, decay: float = 0.7) -> DataFrame:
    """(id, hop, score): the change impact of ``seeds`` (id, score) on their callers.

    A caller gets score * decay * confidence; a node keeps its smallest hop and the best
    score at that hop, so that the result does not depend on the order of arrival.
    """
    steps = edges.select(F.col("dst").alias("id"), F.col("src").alias("to"), "confidence")
    seen = seeds.groupBy("id").agg(F.max("score").alias("score")).withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        found = frontier.join(steps, "id").groupBy(F.col("to").alias("id")).agg(F.max(F.col("score") * decay * F.col("confidence")).alias("score"))
        frontier = cut(found.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), "impact-frontier")
        seen = seen.unionByName(frontier)
    return seen.select("id", "hop", "score")


def impact_edges(edges: DataFrame, seeds: DataFrame, hops: int = 4) -> DataFrame:
    """The edges between the nodes that lie within ``hops`` forward of ``seeds``."""
    nodes = cut(reach(edges, seeds, hops), "impact-nodes").select("id")
    return edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")


def pathways(edges: DataFrame, entries: DataFrame, steps: int = 50, depth: int = 15) -> DataFrame:
    """(entry, step, id, depth): breadth-first steps of each entry over ``edges`` that are cut to the best of each source.

    Order of discovery: depth, then the order of the parent, then the rank of the edge; the first
    ``steps`` nodes of an entry count. All entries walk together.
    """
    ranked = cut(edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("confidence"), "dst"))).select("src", "dst", "rank"), "pathway-edges")
    seen = cut(entries.select(F.col("id").alias("entry"), "id", F.lit(0).alias("depth"), F.lit(1).alias("step")), "pathway-steps")
    frontier = seen
    for d in range(1, depth + 1):
        arrived = frontier.join(ranked, F.col("id") == F.col("src")).groupBy("entry", F.col("dst").alias("to")).agg(F.min(F.struct("step", "rank")).alias("at"))
        fresh = arrived.join(seen.select("entry", F.col("id").alias("to")), ["entry", "to"], "left_anti")
        have = seen.groupBy("entry").agg(F.max("step").alias("have"))
        numbered = fresh.join(have, "entry").select("entry", F.col("to").alias("id"), F.lit(d).alias("depth"), (F.col("have") + F.row_number().over(Window.partitionBy("entry").orderBy("at", "to"))).alias("step"))
        frontier = cut(numbered.where(F.col("step") <= steps), "pathway-frontier")
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier), "pathway-steps")
    return seen


def descendants(levels: list[DataFrame]) -> DataFrame:
    """(root, id, depth) over a chain of (parent, child) tables: all descendants of the first table's parents."""
    out = None
    for i in range(len(levels)):
        path = levels[0].select(F.col("parent").alias("root"), F.col("child").alias("id"))
        for level in levels[1 : i + 1]:
            path = path.join(level, F.col("id") == F.col("parent")).select("root", F.col("child").alias("id"))
        path = path.withColumn("depth", F.lit(i + 1))
        out = path if out is None else out.unionByName(path)
    return out


def role_of_step(order: Column, category: Column) -> Column:
    return F.when(order == 0, "entry").when(category.isNotNull(), category).when(order <= 2, "handler").otherwise("service")


def trim_to_budget(steps: DataFrame, by: list[str], order: str, confidence: str, tokens: Column) -> DataFrame:
    """The steps that fit ``tokens``: the first, the last and the best of the middle, in their order.

    max(2, (4 * tokens - 400) // 150) steps stay.
    """
    room = F.greatest(F.lit(2), F.floor((4 * tokens - 400) / 150))
    group = Window.partitionBy(*by)
    ends = (F.col(order) == F.min(order).over(group)) | (F.col(order) == F.max(order).over(group))
    rank = F.row_number().over(group.orderBy(F.when(ends, 0).otherwise(1), F.desc(confidence), order))
    return steps.withColumn("_rank", rank).where((F.col("_rank") <= room)).drop("_rank")
