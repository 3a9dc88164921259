"""Grouped analyses: coupling, duplicates, dead code, coverage, modules, communities, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.plans.shared import dealt


def coupling(changes: DataFrame, least: int = 3, strength: float = 0.2) -> DataFrame:
    """(a, b, change_count, strength) of files that change together; ``changes`` has (commit, path).

    Pairs are made inside a commit only. Files that alone changed in fewer than ``least``
    commits go before the pairs are made, which is exact and keeps the join small. The changes are
    counted first, and dealt out by their number.
    """
    rows = changes.count()
    each = dealt(changes.select("commit", "path"), rows, "path").distinct()
    solo = each.groupBy("path").agg(F.count("*").alias("solo")).where(F.col("solo") >= least)
    often = dealt(each.join(solo, "path"), rows, "commit")
    a, b = often.alias("a"), often.alias("b")
    pairs = a.join(b, (F.col("a.commit") == F.col("b.commit")) & (F.col("a.path") < F.col("b.path")))
    pairs = dealt(pairs.select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), F.greatest("a.solo", "b.solo").alias("most")), 2 * rows, "a", "b")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("change_count"), F.max("most").alias("most"))
    share = F.col("change_count") / F.col("most")
    return counted.where((F.col("change_count") >= least) & (share >= strength)).select("a", "b", "change_count", F.round(share, 6).alias("strength"))


# --- duplicates


def same_name(functions: DataFrame, name: str = "qualified_name", file: str = "file_path", hash_: str = "source_hash") -> DataFrame:
    """(name, files, severity): names in two files at least; high if all bodies are equal and known, else medium."""
    equal = (F.count_distinct(hash_) == 1) & (F.count(F.nullif(F.col(hash_), F.lit(""))) == F.count("*"))
    return functions.groupBy(F.col(name).alias("name")).agg(F.array_sort(F.collect_set(file)).alias("files"), F.when(equal, "high").otherwise("medium").alias("severity")).where(F.size("files") >= 2)


def same_signature(functions: DataFrame) -> DataFrame:
    """(name, signature, files, qualified): one name and normalised signature in two files under several qualified names."""
    grouped = functions.groupBy("name", T.normalise_signature(F.col("signature")).alias("signature"))
    return grouped.agg(F.count_distinct("file_path").alias("files"), F.count_distinct("qualified_name").alias("qualified")).where("files >= 2 AND qualified > 1")


def repeated_in_file(functions: DataFrame, least: int = 3) -> DataFrame:
    return functions.groupBy("file_path", "name").agg(F.count("*").alias("copies")).where(F.col("copies") >= least)


def canonical(copies: DataFrame, group: str) -> DataFrame:
    """Each copy with its score and whether it is its group's canonical one.

    Dead -5, alive +1; the file named like the function +2; depth of the path up to 4; called +3.
    """
    stem = F.regexp_extract("file_path", r"([^/.]+)(\.[^/]*)?$", 1)
    depth = F.least(F.size(F.split("file_path", "/")) - 1, F.lit(4))
    score = F.when(F.col("is_dead"), -5).otherwise(1) + F.when(F.lower(stem) == F.lower("name"), 2).otherwise(0) + depth + F.when(F.col("callers") > 0, 3).otherwise(0)
    scored = copies.withColumn("score", score)
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "file_path", "id"))
    return scored.withColumn("is_canonical", best == 1)


# --- dead code


def caller_info(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Callers of each function by kind. A fuzzy call counts as fuzzy only."""
    kinds = functions.select(F.col("id").alias("src"), F.col("is_test").alias("_test"), F.col("is_script").alias("_script"))
    seen = calls.join(kinds, "src", "left")
    fuzzy = F.col("reason") == "fuzzy"
    sure = ~fuzzy
    test, script = F.coalesce("_test", F.lit(False)), F.coalesce("_script", F.lit(False))
    counts = seen.groupBy(F.col("dst").alias("id")).agg(
        F.count("*").alias("total"),
        F.count_if(fuzzy).alias("fuzzy"),
        F.count_if(sure & test).alias("test"),
        F.count_if(sure & ~test & script).alias("script"),
        F.count_if(sure & ~test & ~script).alias("prod"),
    )
    return functions.join(counts, "id", "left").fillna(0, ["total", "fuzzy", "test", "script", "prod"])


def dead_tier(utility: Column, exported: Column) -> Column:
    """The tier of a function that no exemption saves, from its ``caller_info``."""
    total, fuzzy, test, script, prod = map(F.col, ("total", "fuzzy", "test", "script", "prod"))
    return (
        F.when((total == 0) & (utility | exported), "possibly_dead")
        .when(total == 0, "definitely_dead")
        .when(fuzzy == total, "probably_dead")
        .when((test > 0) & (test + fuzzy == total), "probably_dead")
        .when((script > 0) & (prod == 0), "probably_dead")
        .otherwise("possibly_dead")
    )


def dead_context() -> Column:
    total, test, script = map(F.col, ("total", "test", "script"))
    return F.when(total == 0, "dead_everywhere").when(total <= test + script, "dead_in_production").otherwise("dead_everywhere")


# --- coverage


def tested_share(functions: DataFrame, calls: DataFrame, by: str) -> DataFrame:
    """Per ``by``: functions, those that a test calls, and the share in percent with one digit."""
    tests = functions.where("is_test").select(F.col("id").alias("src"))
    tested = calls.join(tests, "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("_tested", F.lit(True))
    own = functions.where("NOT is_test").join(tested, "id", "left")
    return own.groupBy(by).agg(F.count("*").alias("total"), F.count_if("_tested").alias("tested")).withColumn("pct", F.round(100 * F.col("tested") / F.col("total"), 1))


def covered_by_lines(spans: DataFrame, executed: DataFrame, by: str, first: str, last: str, line: str) -> DataFrame:
    """Spans (id, by, first, last) that any executed line of the same ``by`` lies in: after the first line, or on it if it is the only one.

    A range join on an equality: lines and spans of one ``by`` meet, partial results combine first.
    """
    inside = (F.col(line) > F.col(first)) & (F.col(line) <= F.col(last)) | (F.col(first) == F.col(last)) & (F.col(line) == F.col(first))
    hit = spans.join(executed.select(by, line).distinct(), by).where(inside).select("id").distinct().withColumn("_hit", F.lit(True))
    return spans.join(hit, "id", "left").withColumn("is_covered", F.coalesce("_hit", F.lit(False))).drop("_hit")


# --- modules and communities


def modules(files: DataFrame, most: int = 15, depth: int = 3) -> DataFrame:
    """Each file with its module: its first directory, split deeper while more than ``most`` files share it."""
    from graphloom.functions.paths import directory_key

    out = files.withColumn("module", directory_key(F.col("path"), 1))
    for d in range(2, depth + 1):
        size = F.count("*").over(Window.partitionBy("module"))
        out = out.withColumn("_size", size).withColumn("module", F.when((F.col("_size") > most) & (F.col("module") != ""), directory_key(F.col("path"), d)).otherwise(F.col("module"))).drop("_size")
    return out


def cohesion(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(community, members, internal, cohesion): directed internal edges over n (n - 1) / 2 pairs; 1 as the denominator of a single member."""
    size = members.groupBy("community").agg(F.count("*").alias("members"))
    side = lambda name, as_: members.select(F.col("id").alias(name), F.col("community").alias(as_))
    inside = calls.select("src", "dst").join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("internal"))
    pairs = F.greatest(F.col("members") * (F.col("members") - 1) / 2, F.lit(1.0))
    return size.join(inside, "community", "left").select("community", "members", F.coalesce("internal", F.lit(0)).alias("internal"), F.round(F.coalesce("internal", F.lit(0)) / pairs, 6).alias("cohesion"))


def merge_targets(members: DataFrame, calls: DataFrame, least: int = 3) -> DataFrame:
    """(community, target, links): for each community below ``least`` members the neighbour that most of its pairs lead to."""
    small = members.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.col("community"))
    both = calls.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(calls.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    side = lambda name, as_: members.select(F.col("id").alias(name), F.col("community").alias(as_))
    linked = both.join(side("x", "community"), "x").join(small, "community", "left_semi").join(side("y", "target"), "y").where("community <> target")
    counted = linked.groupBy("community", "target").agg(F.count("*").alias("links"))
    best = Window.partitionBy("community").orderBy(F.desc("links"), "target")
    return counted.withColumn("_at", F.row_number().over(best)).where("_at = 1").drop("_at")


def most_common(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the most frequent value, the first by order on ties."""
    counted = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    top = counted.groupBy(by).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("top"))
    return top.select(by, "top.*")


# --- findings


def summaries(findings: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): counts by each of ``columns``, all from one pass."""
    long = findings.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f"))
    return long.groupBy("f.column", "f.value").agg(F.count("*").alias("n"))


def at_least(rows: DataFrame, column: str, ordered: list[str], threshold: str) -> DataFrame:
    """Rows whose value of an ordered list stands at or before ``threshold``; unknown values come last."""
    return rows.where(T.rank_of(F.col(column), ordered, len(ordered)) <= ordered.index(threshold))
