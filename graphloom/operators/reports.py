"""Summaries over findings, modules, logs and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths

# Directories whose leftovers are one bucket; severities in order; what a finding may be.
BUCKETS = ("utils", "util", "helpers", "helper", "common", "shared", "lib", "libs")
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}
STATUSES = ("open", "accepted", "fixed", "ignored")
HOTSPOTS, KEY_CLASSES, LEAST_METHODS = 5, 5, 2


def _titled(part: Column) -> Column:
    """Underscores as blanks; every letter that follows none is a capital."""
    opened = F.regexp_replace(F.replace(part, F.lit("_"), F.lit(" ")), r"([^\p{L}])", "$1\x01 ")
    return F.replace(F.initcap(opened), F.lit("\x01 "), F.lit(""))


def package_label(path: Column) -> Column:
    """What a path's package is called: the second directory of source trees, tests and scripts, the second part elsewhere."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    n, top, second = F.size(parts), F.lower(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
    below = lambda name: F.when(n >= 3, F.concat(F.lit(f"{name} · "), _titled(second))).otherwise(name)
    return F.when(n == 0, "Unknown").when(top == "tests", below("Tests")).when(top.isin("scripts", "script"), below("Scripts")).otherwise(_titled(F.coalesce(second, F.get(parts, F.lit(0)))))


def isolation_bucket(path: Column) -> Column:
    """The first utility directory of a path, spelled as a title; else its package."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.coalesce(_titled(F.get(F.filter(parts, lambda p: F.lower(p).isin(*BUCKETS)), F.lit(0))), package_label(path))


def bucket_communities(functions: DataFrame) -> DataFrame:
    """(label, members): communities where no edge says anything: by bucket."""
    return functions.groupBy(isolation_bucket(F.col("file_path")).alias("label")).agg(F.count("*").alias("members"))


def hotspots(modules: DataFrame, most: int = HOTSPOTS) -> DataFrame:
    """The modules with most issues, production first, then by complexity and name."""
    scored = modules.withColumns({"issue_count": F.col("dead_code_count") + F.col("duplicate_count"), "complexity": F.col("function_count") + 2 * F.col("class_count") + F.col("test_function_count")})
    order = [F.desc("issue_count"), (F.col("category") != "production").cast("int"), F.desc("complexity"), F.col("module")]
    return scored.where((F.col("issue_count") > 0) | (F.col("complexity") > 0)).orderBy(*order).limit(most)


def key_classes(methods: DataFrame, most: int = KEY_CLASSES, least: int = LEAST_METHODS) -> DataFrame:
    """(module, class_name, methods, rank): the classes of a module with most methods."""
    counted = methods.groupBy("module", "class_name").agg(F.count("*").alias("methods")).where(F.col("methods") >= least)
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("methods"), "class_name"))).where(F.col("rank") <= most)


def log_sessions(records: DataFrame) -> DataFrame:
    """(run_id, records, errors, first, last) of log records (run_id, ts, level)."""
    return records.groupBy("run_id").agg(F.count("*").alias("records"), F.count_if(F.col("level") >= 40).alias("errors"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def annotate_findings(findings: DataFrame, policy: DataFrame, overrides: DataFrame, statuses: DataFrame) -> DataFrame:
    """Findings (id, kind, pack, severity) with category and score by kind, the pack's override and their status.

    Findings of a pack that is switched off go; unknown statuses count as open. Policy and overrides have a row per kind and pack.
    """
    packs = overrides.select("pack", F.col("severity").alias("_severity"), "enabled")
    told = findings.join(policy, "kind", "left").join(packs, "pack", "left").where(F.coalesce("enabled", F.lit(True))).join(statuses.select("id", "status", "note"), "id", "left")
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("open")
    return told.select("id", "kind", "pack", F.coalesce("_severity", "severity").alias("severity"), F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("score", F.lit(0)).alias("score"), status.alias("status"), F.coalesce("note", F.lit("")).alias("note"))


def family(findings: DataFrame, packs: DataFrame, name: str) -> DataFrame:
    """The findings of the packs of one family that are switched on."""
    return findings.join(packs.where((F.col("family") == name) & F.col("enabled")).select("pack"), "pack", "left_semi")


def risks(counts: DataFrame) -> DataFrame:
    """Risk kinds (kind, severity, n) that occur, the gravest and most frequent first, as ``place`` from 1."""
    grave = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("severity")), F.lit(len(SEVERITY)))
    # a row per kind of risk
    return counts.where("n > 0").withColumn("place", F.row_number().over(Window.orderBy(grave, F.desc("n"), "kind")))


def report_warnings(shown: Column, total: Column, healthy: Column) -> Column:
    """What a report leaves out or cannot vouch for."""
    return F.array_compact(F.array(F.when(shown < total, F.format_string("pathways_truncated_%d_of_%d", shown, total)), F.when(~healthy, "health_not_ok"), F.when(total == 0, "no_pathways")))


def module_summary(initial: Column, file_doc: Column, class_doc: Column, functions: Column, classes: Column) -> Column:
    """A module's summary: the first document that is there, else its size in words."""
    given = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (initial, file_doc, class_doc)))
    return F.coalesce(given, F.format_string("%d functions, %d classes", functions, classes))


def candidate_files(files: DataFrame, most: int) -> DataFrame:
    """The files whose documents sum a module up best: by functions, classes, lines, path."""
    order = Window.partitionBy("module").orderBy(F.desc("functions"), F.desc("classes"), F.desc("lines"), "path")
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def readiness(inputs: DataFrame, wanted) -> DataFrame:
    """(input, present, n): which inputs of the overlays are there."""
    every = inputs.sparkSession.createDataFrame([(w,) for w in wanted], "input string")
    counted = inputs.groupBy("input").agg(F.count("*").alias("n"))
    return every.join(counted, "input", "left").select("input", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n"))
