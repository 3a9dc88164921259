"""Scores of functions and pathways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths


def base_score(callers: Column, callees: Column) -> Column:
    """Many callees of few callers make an entry; so does being called by many."""
    log = F.log1p(callers)
    return F.round(callees / (log + 1) + 7 * log, 4)


# What multiplies an entry score, in this order.
NAME_ENTRY = r"(?i)^(handle|on_|controller|view|route)"
ROUTE_DIRECTORY = r"(^|/)(routes?|api|views?|controllers?|endpoints?|handlers?)/"
CLI_DIRECTORY = r"(^|/)cli/commands/"


def entry_score(df: DataFrame) -> Column:
    """The entry score of rows with callers, callees, name, file_path and, where present, decorators and flags.

    Sentinels, dead functions and tests score 0; so does what stays at 0.5 or below.
    """
    has = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in df.columns else F.lit(other)
    decorators = F.array_join(F.col("decorators"), " ") if "decorators" in df.columns else F.lit("")
    name, path = F.col("name"), F.col("file_path")
    times = [
        (F.col("callers") == 0, 2.0),
        (has("is_exported", False), 2.0),
        (name.rlike(NAME_ENTRY), 1.5),
        (path.rlike(ROUTE_DIRECTORY), 3.0),
        (path.rlike(CLI_DIRECTORY), 1.4),
        (path.rlike(r"(^|/)pipeline/runner\.py$") & name.startswith("run_"), 2.0),
        (path.rlike(r"(^|/)__main__\.py$"), 5.0),
        (decorators.rlike(r"(?i)\b(route|get|post|put|patch|delete)\b"), 4.0),
        (decorators.rlike(r"(?i)\b(task|job|command)\b") & ~decorators.rlike(r"(?i)\b(route|get|post|put|patch|delete)\b"), 3.5),
        (has("is_abc_implementor", False), 2.5),
        (name.startswith("_") & ~name.startswith("__"), 0.35),
        (paths.is_script_path(path), 0.1),
    ]
    score = base_score(F.col("callers"), F.col("callees"))
    for when, factor in times:
        score = score * F.when(when, factor).otherwise(1.0)
    none = has("is_dead", False) | has("is_module_caller", False) | has("is_test", False) | paths.is_test_path(path)
    return F.when(none | (score <= 0.5), 0.0).otherwise(score)


def importance(steps: Column, files: Column, entry: Column) -> Column:
    return F.round(steps * files * (entry + 1) / 100, 4)


def votes(rows: DataFrame, by: list[str], label: str, weight: str, cap: float = 0.95, gap: float = 0.03) -> DataFrame:
    """(``by``, label, score, confidence): the label of most weight, the first by name on ties.

    Confidence is min(cap, 0.45 + 0.08 * best + gap * (best - second)).
    """
    summed = rows.groupBy(*by, label).agg(F.sum(weight).alias("score"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), label)
    ranked = summed.withColumns({"_at": F.row_number().over(order), "_next": F.lead("score", 1, 0).over(order)}).where("_at = 1")
    sure = F.round(F.least(F.lit(cap), 0.45 + 0.08 * F.col("score") + gap * (F.col("score") - F.col("_next"))), 3)
    return ranked.select(*by, label, "score", sure.alias("confidence"))


def is_entry_point(score: Column, callers: Column, test_callers: Column, callees: Column, route_style: Column) -> Column:
    """A positive score, unless tests alone call it; in a route-style directory callees suffice."""
    only_tests = (callers > 0) & (callers == test_callers)
    return (score > 0) & (~only_tests | (route_style & (callees > 0)))
