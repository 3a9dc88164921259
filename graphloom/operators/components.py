"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import cut, dealt


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id reachable from each endpoint of ``edges``, direction ignored.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so that a path of n edges needs about log n rounds; each round's
    labels are a table in the shared folder. The loop looks at one number a round; the links are dealt out by their number.
    """
    there = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v")), "component-edges")
    rows = 2 * there.count()
    links = cut(dealt(there.unionByName(there.select(F.col("v").alias("u"), F.col("u").alias("v"))), rows, "u", "v").distinct(), "component-links")
    labels = cut(links.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("label")), "component-labels")
    for _ in range(rounds):
        near = dealt(links, rows, "u").join(dealt(labels, rows, "id"), F.col("u") == F.col("id")).groupBy("v").agg(F.min("label").alias("near"))
        better = labels.join(near, F.col("id") == F.col("v"), "left").select("id", "label", F.least("label", "near").alias("low"))
        above = better.select(F.col("id").alias("up"), F.col("low").alias("up_low"))
        # a label is an id of the same component, so its own label is one too
        jumped = better.join(above, F.col("low") == F.col("up"), "left").select("id", F.coalesce("up_low", "low").alias("label"), (F.col("label") != F.coalesce("up_low", "low")).alias("moved"))
        jumped = cut(jumped, "component-labels")
        labels = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
