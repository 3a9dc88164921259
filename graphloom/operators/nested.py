"""Nested JSON taken apart: every value that is no container, with where it stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import cut

# Keys under which a route, a symbol or a file is named.
COLLECTED = {
    "route": ("route", "path", "url", "endpoint"),
    "symbol": ("symbol", "function", "qualified_name", "handler"),
    "file": ("file", "file_path", "module"),
}


def scalars(rows: DataFrame, keys: list[str], json: Column, levels: int = 1000) -> DataFrame:
    """(``keys``, path, key, kind, value): all scalars of JSON texts, whatever their depth.

    The texts become variants; each round opens the containers that the round before left, so there are as many
    rounds as levels and each holds one level. ``kind`` is a type as Spark names it, VOID for a null; ``key`` is the
    name in the object, the place in the array, null at the top. What is not JSON gives nothing; repeated rows each
    give their own.
    """
    spark = rows.sparkSession
    level = rows.select(*keys, F.try_parse_json(json).alias("v"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key")).where("v IS NOT NULL")
    found = []
    for n in range(levels):
        held = cut(level.withColumn("kind", F.substring_index(F.schema_of_variant("v"), "<", 1)), f"json-{n}")
        container = F.col("kind").isin("OBJECT", "ARRAY")
        found.append(held.where(~container).select(*keys, "path", "key", "kind", F.try_variant_get("v", "$", "string").alias("value")))
        open_ = held.where(container)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
        inner = open_.select(*keys, F.col("path").alias("_path"), F.col("kind").alias("_kind"), "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        step = F.when(F.col("_kind") == "ARRAY", F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "_key"))
        level = inner.select(*keys, F.col("_value").alias("v"), F.concat("_path", step).alias("path"), F.coalesce("_key", F.col("_pos").cast("string")).alias("key"))
    raise RuntimeError(f"more than {levels} levels")


def collected(values: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, what, value): routes, symbols and files that scalars name by their keys; a route begins with a slash."""
    what = F.lit(None).cast("string")
    for name, under in COLLECTED.items():
        what = F.when(F.col("key").isin(*under), name).otherwise(what)
    named = values.where("kind = 'STRING' AND value <> ''").withColumn("what", what).where("what IS NOT NULL")
    return named.where((F.col("what") != "route") | F.startswith("value", F.lit("/"))).select(*keys, "what", "value").distinct()
