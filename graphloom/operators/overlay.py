"""Runtime traces laid over the static graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import last_part

# When unresolved calls become a finding, how many top calls are listed.
UNRESOLVED_SHARE, UNRESOLVED_LEAST, TOP_CALLS = 0.2, 100, 20


def resolve_traces(calls: DataFrame, functions: DataFrame, record: str = "fn", file: str | None = None) -> DataFrame:
    """``calls`` with ``function_id`` and ``via``: by qualified name, by file and last part, by the tail of either.

    Each index is one row a key, its last writer, so no join multiplies records.
    """
    tail = last_part(F.col("qualified_name"))
    index = lambda key, name: functions.groupBy(key.alias(f"_{name}")).agg(F.max("id").alias(f"_{name}_id"))
    out = calls.withColumn("_q", F.col(record)).withColumn("_tail", last_part(F.col(record)))
    out = out.join(index(F.col("qualified_name"), "q"), "_q", "left")
    steps: list[tuple[str, Column]] = [("qualified_name", F.col("_q_id"))]
    if file:
        by_file = functions.groupBy(F.col("file_path").alias("_file"), tail.alias("_tail")).agg(F.max("id").alias("_file_id"))
        out = out.withColumn("_file", F.col(file)).join(by_file, ["_file", "_tail"], "left")
        steps.append(("file", F.col("_file_id")))
    out = out.join(index(tail, "tail"), "_tail", "left")
    out = out.join(functions.groupBy(F.col("name").alias("_tail")).agg(F.max("id").alias("_name_id")), "_tail", "left")
    steps += [("qualified_tail", F.col("_tail_id")), ("name", F.col("_name_id"))]
    via = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in steps))
    return out.select(*calls.columns, F.coalesce(*(c for _, c in steps)).alias("function_id"), via.alias("via"))


def new_edges(observed: DataFrame, static: DataFrame) -> DataFrame:
    """Observed calls (src, dst) that the static graph lacks; a call that was seen twice stands twice."""
    return observed.join(static.select("src", "dst"), ["src", "dst"], "left_anti")


def top_calls(calls: DataFrame, by: str = "fn", most: int = TOP_CALLS) -> DataFrame:
    return calls.groupBy(by).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), by).limit(most)


def quality(resolved: DataFrame) -> DataFrame:
    """One row: calls, unresolved ones, their share, and whether that is a finding."""
    counted = resolved.agg(F.count("*").alias("calls"), F.count_if(F.col("function_id").isNull()).alias("unresolved"))
    share = F.coalesce(F.col("unresolved") / F.nullif(F.col("calls"), F.lit(0)), F.lit(0.0))
    return counted.select("calls", "unresolved", F.round(share, 6).alias("share"), ((share >= UNRESOLVED_SHARE) & (F.col("calls") >= UNRESOLVED_LEAST)).alias("is_finding"))


def observed(functions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Functions with what was observed of them; a body that ran is not dead."""
    seen = resolved.where("function_id IS NOT NULL").groupBy(F.col("function_id").alias("id")).agg(F.count("*").alias("_calls"))
    ran = F.col("_calls").isNotNull() & F.col("source_hash").isNotNull()
    out = functions.join(seen, "id", "left")
    return out.withColumns({
        "runtime_observed": ran,
        "runtime_calls": F.when(ran, F.col("_calls")).otherwise(0),
        "runtime_for_hash": F.when(ran, F.col("source_hash")),
        "is_dead": F.when(ran, False).otherwise(F.col("is_dead")) if "is_dead" in functions.columns else F.lit(False),
    }).drop("_calls")
