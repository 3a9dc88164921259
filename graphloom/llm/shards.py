"""Sharding by global prefix sums of byte sizes.

Rows are put in one global order over range partitions; the totals of the
partitions give each its offset, a running sum inside a partition gives each row
its place on the global byte axis, and cutting that axis at equal targets gives
contiguous shards of near equal size.

Defined results: a null size counts as 0 bytes, negative sizes are refused
nowhere but count as 0; null keys sort first; rows that agree in all order
columns are told apart by where they were read, so repeated rows are dealt like
any others; an empty table gives an empty result; extra columns are carried
along, and those named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import cut


def assign_shards(df: DataFrame, shards: int, size: str, order: list[str]) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    A row goes where the middle of its bytes falls, so a shard misses its target
    by one row's size at most. One shuffle by range and one by partition number;
    what is sent to every task is one row per partition and one per shard.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    tied = df.select(*keep, F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("_bytes"), F.monotonically_increasing_id().alias("_tie"))
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_tie"]]
    ranged = cut(tied.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "shard-ranges")

    parts = ranged.groupBy("_part").agg(F.sum("_bytes").alias("_b"), F.count("*").alias("_n"))
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: bounded by the number of partitions, not by the data
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_b").over(whole), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_n0"),
        F.sum("_b").over(Window.partitionBy()).alias("_all"),
        F.sum("_n").over(Window.partitionBy()).alias("_rows"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys)
    placed = ranged.join(F.broadcast(offsets), "_part").select(
        *keep,
        (F.col("_n0") + F.row_number().over(inside) - 1).alias("_index"),
        (F.col("_b0") + F.sum("_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bytes") / 2).alias("_middle"),
        "_all",
        "_rows",
    )
    # without any bytes the rows themselves are dealt equally
    share = F.when(F.col("_all") > 0, F.col("_middle") / F.col("_all")).otherwise(F.col("_index") / F.col("_rows"))
    dealt = cut(placed.select(*keep, "_index", F.least(F.floor(share * shards), F.lit(shards - 1)).cast("int").alias("shard")), "shard-places")
    firsts = dealt.groupBy("shard").agg(F.min("_index").alias("_first"))  # a row per shard
    return dealt.join(F.broadcast(firsts), "shard").select(*keep, "shard", (F.col("_index") - F.col("_first")).alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Writes a folder per shard, its rows in slot order inside each file."""
    assigned.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
