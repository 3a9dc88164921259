"""Where results go: versioned tables, artifacts, per-file documents, a health report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schemas import EDGES, ENDS, NODES, conform


def save(df: DataFrame, root: str, table: str) -> None:
    """Replaces a table; its columns are those of the model."""
    conform(df, table).write.mode("overwrite").parquet(f"{root}/{table}")


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of any older version: columns that it lacks get their defaults."""
    return conform(spark.read.option("mergeSchema", "true").parquet(f"{root}/{table}"), table)


def clear(spark: SparkSession, root: str, table: str) -> None:
    save(spark.createDataFrame([], (NODES | EDGES)[table]), root, table)


def save_edges(edges: DataFrame, nodes: dict[str, DataFrame], root: str, table: str) -> None:
    """Edges whose ends both exist; others are left out."""
    a, b = ENDS[table]
    there = edges.join(nodes[a].select(F.col("id").alias("src")), "src", "left_semi").join(nodes[b].select(F.col("id").alias("dst")), "dst", "left_semi")
    save(there, root, table)


def per_file_documents(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(file_path, document): each file's functions with their callers and callees as JSON."""
    named = functions.select("id", "qualified_name")
    into = calls.join(named.select(F.col("id").alias("src"), F.col("qualified_name").alias("n")), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("n")).alias("callers"))
    out_of = calls.join(named.select(F.col("id").alias("dst"), F.col("qualified_name").alias("n")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("n")).alias("callees"))
    rows = functions.join(into, "id", "left").join(out_of, "id", "left")
    entry = F.struct("qualified_name", "signature", "callers", "callees")
    return rows.groupBy("file_path").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("document"))


def health(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(measure, value): totals and calls by reason."""
    total = functions.agg(F.count("*").alias("value")).select(F.lit("functions").alias("measure"), "value")
    by_reason = calls.groupBy(F.concat(F.lit("calls_"), F.col("reason")).alias("measure")).agg(F.count("*").alias("value"))
    return total.unionByName(by_reason)


def log_records(records: DataFrame, path: str) -> None:
    """Log records by subsystem; errors are those of level 40 and more."""
    records.withColumn("is_error", F.col("level") >= 40).write.partitionBy("subsystem").mode("append").json(path)
