"""The driver's tables seen as nodes and edges of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans.shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: a brand is a class, type and brand a file, small parts are tests."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"),
        F.concat_ws("/", F.lower("p_type"), "p_brand").alias("file_path"),
        F.col("p_brand").alias("class_name"),
        F.lower("p_type").alias("module"),
        F.col("p_size").cast("long").alias("line_count"),
        (F.col("p_size") <= 10).alias("is_test"),
        F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("source_hash"),
        F.concat(F.lit("def "), F.col("p_name"), F.lit("(self,  size) -> int")).alias("signature"),
    )


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call from each line of an order to its next line: src, dst, line, confidence, reason.

    The long order makes the next line the same one in every run. An order is small, so its
    window is; only the columns of the order and the edge are read.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    lines = table(spark, sf_dir, "lineitem")
    sites = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag"), lines.count(), "l_orderkey").select(
        F.col("l_partkey").alias("src"),
        F.lead("l_partkey").over(order).alias("dst"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.round(1 - 5 * F.col("l_discount"), 4).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "direct_call").when(F.col("l_returnflag") == "N", "import_resolved").otherwise("fuzzy").alias("reason"),
    )
    return sites.where(F.col("dst").isNotNull())


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged call graph without self loops."""
    from graphloom.operators.edges import merge_calls

    rows = table(spark, sf_dir, "lineitem").count()
    return merge_calls(dealt(raw_calls(spark, sf_dir).where("src <> dst"), rows, "src", "dst"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers import the parts that they deliver."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as call records: the caller is the user's event before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "ts", F.lit("call").alias("kind"), F.col("event_type").alias("fn"), F.lag("event_type").over(order).alias("caller"), "props", "value")
