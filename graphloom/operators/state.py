"""Keyed tables and their changes: upserts, deletes, diffs, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: that of the largest ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; columns that one lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def sparse_update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Sets the columns of ``changes`` that are not null."""
    named = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    out = old.join(named, key, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in named.columns else F.col(c) for c in old.columns))


def keep_observation(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` functions with the runtime observation of the stored ones where the body is still the one observed."""
    seen = old.select("id", *(F.col(c).alias(f"_{c}") for c in ("runtime_observed", "runtime_calls", "runtime_for_hash")))
    same = F.col("_runtime_for_hash") == F.col("source_hash")
    base = new.drop("runtime_observed", "runtime_calls", "runtime_for_hash").join(seen, "id", "left")
    return base.withColumns({
        "runtime_observed": F.when(same, F.col("_runtime_observed")).otherwise(False),
        "runtime_calls": F.when(same, F.col("_runtime_calls")).otherwise(0),
        "runtime_for_hash": F.when(same, F.col("_runtime_for_hash")),
    }).drop("_runtime_observed", "_runtime_calls", "_runtime_for_hash")


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone`` and edges without those that touch one."""
    ids = gone.select(F.col(key))
    left = nodes.join(ids, key, "left_anti")
    kept = edges.join(ids.withColumnRenamed(key, "src"), "src", "left_anti").join(ids.withColumnRenamed(key, "dst"), "dst", "left_anti")
    return left, kept


def diff(old: DataFrame, new: DataFrame, key: str = "path", hash_: str = "source_hash") -> DataFrame:
    """(key, change): added, removed, changed; a full outer join of two columns each."""
    a, b = old.select(F.col(key), F.col(hash_).alias("_old")), new.select(F.col(key), F.col(hash_).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def to_reparse(changes: DataFrame, calls: DataFrame, imports: DataFrame, current: DataFrame) -> DataFrame:
    """(path): added and changed files, callers of changed and removed ones, importers of all; current files only.

    ``calls`` and ``imports`` have (src, dst) paths.
    """
    own = changes.where("change <> 'removed'").select("path")
    touched = changes.select(F.col("path").alias("dst"), "change")
    callers = calls.join(touched.where("change <> 'added'"), "dst", "left_semi").select(F.col("src").alias("path"))
    importers = imports.join(touched, "dst", "left_semi").select(F.col("src").alias("path"))
    return own.unionByName(callers).unionByName(importers).distinct().join(current.select("path"), "path", "left_semi")


def stale_artifacts(artifacts: DataFrame, current: DataFrame) -> DataFrame:
    """Artifacts (name, sources: map of path to hash) of which some source is gone or differs."""
    each = artifacts.select("name", F.explode("sources").alias("path", "was"))
    told = each.join(current.select("path", F.col("source_hash").alias("now")), "path", "left")
    return told.groupBy("name").agg(F.bool_or(F.coalesce(F.col("was") != F.col("now"), F.lit(True))).alias("is_stale")).where("is_stale").select("name")
