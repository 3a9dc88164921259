"""Name resolution: prefixes, suffixes, positions, and calls by tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths

# Methods of mappings that say nothing about their receiver, and confidences by how a call was resolved.
MAPPING_METHODS = ("get", "setdefault", "pop", "keys", "values", "items", "update")
CONFIDENCE = {"direct_call": 1.0, "import_resolved": 0.9, "method_call": 0.7, "typed_local": 0.7, "script_global": 0.3, "fuzzy": 0.3}
MOST_CANDIDATES = 5


def longest_prefix(rows: DataFrame, path: str, index: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """``rows`` with the longest leading part of ``path`` that the index has; rows without one go."""
    parts = rows.withColumn("_prefix", F.explode(paths.prefixes(F.col(path), separator)))
    hit = parts.join(index.select(F.col(prefix).alias("_prefix")).distinct(), "_prefix", "left_semi")
    return hit.groupBy(*rows.columns).agg(F.max_by("_prefix", F.length("_prefix")).alias(prefix))


def unique_suffixes(files: DataFrame, path: str, key: str) -> DataFrame:
    """(suffix, key): the trailing parts of paths that one file alone has."""
    each = files.select(F.explode(paths.suffixes(F.col(path))).alias("suffix"), key).distinct()
    return each.groupBy("suffix").agg(F.min(key).alias(key), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def bind_positions(arguments: DataFrame, parameters: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, position, argument, parameter): the i-th argument of a call meets the i-th parameter.

    The arrays of one call meet as arrays, so the join has a row per call and nothing is shuffled per word.
    """
    both = arguments.join(parameters, by)
    pairs = F.slice(F.arrays_zip("argument", "parameter"), 1, F.least(F.size("argument"), F.size("parameter")))
    return both.select(*by, F.posexplode(pairs).alias("_i", "_p")).select(*by, F.col("_i").cast("long").alias("position"), "_p.argument", "_p.parameter")


def by_tiers(sites: DataFrame, keys: list[str], tiers: list[DataFrame]) -> DataFrame:
    """The candidates of the first tier that has any for a site. A tier has ``keys`` and the result columns."""
    every = reduce(DataFrame.unionByName, (t.withColumn("_tier", F.lit(i)) for i, t in enumerate(tiers)))
    first = F.min("_tier").over(Window.partitionBy(*keys))
    return every.withColumn("_first", first).where("_tier = _first").drop("_tier", "_first").join(sites.select(*keys).distinct(), keys, "left_semi")


def candidate_rank(caller: Column, candidate: Column) -> Column:
    """Which of several definitions is nearest: same directory, source tree, elsewhere, scripts, tests."""
    directory = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return (
        F.when(directory(caller) == directory(candidate), 0)
        .when(candidate.rlike(r"(^|/)(src|lib|app)/"), 1)
        .when(candidate.rlike(r"(^|/)tests?/"), 4)
        .when(candidate.rlike(r"(^|/)scripts?/"), 3)
        .otherwise(2)
    )


def resolve_calls(sites: DataFrame, symbols: DataFrame, imports: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """(site, caller, callee, line, confidence, reason): the call sites that resolve.

    ``sites``: site, caller, file_path, callee, line. ``symbols``: id, name, qualified_name,
    file_path. ``imports``: file_path, name (as used), resolved_path, original. ``typed``:
    file_path, name, class_name of variables whose class is known.

    Tiers for a dotted callee: the whole text in its file; a typed receiver; ``self`` or ``cls``; the
    method alone once in the file; an import; one to five definitions anywhere, the nearest. For a
    bare name: an import where the file has no plain definition, the file, an import, one to five anywhere.
    """
    method, receiver = F.substring_index("callee", ".", -1), F.regexp_extract("callee", r"^(.*)\.[^.]*$", 1)
    s = sites.select("site", "caller", "file_path", "line", "callee", F.contains("callee", F.lit(".")).alias("dotted"), method.alias("method"), receiver.alias("receiver"))
    own = symbols.select(F.col("id").alias("target"), F.col("name").alias("t_name"), F.col("qualified_name").alias("t_qualified"), F.col("file_path").alias("t_path"))
    in_file = (F.col("file_path") == F.col("t_path"))

    def told(df: DataFrame, reason: str, confidence: float | None = None) -> DataFrame:
        return df.select("site", "target", F.lit(CONFIDENCE[reason] if confidence is None else confidence).alias("confidence"), F.lit(reason).alias("reason"))

    def alone(df: DataFrame) -> DataFrame:
        return df.withColumn("_n", F.count("*").over(Window.partitionBy("site"))).where("_n = 1")

    dotted, bare = s.where("dotted"), s.where("NOT dotted")
    typed = typed if typed is not None else s.select("file_path", F.col("receiver").alias("name"), F.lit(None).cast("string").alias("class_name")).limit(0)
    known = typed.where(F.col("class_name").rlike(r"^[A-Z]\w*$")).groupBy("file_path", F.col("name").alias("receiver")).agg(F.max("class_name").alias("class_name"))
    with_type = dotted.join(known, ["file_path", "receiver"], "left")
    guarded = with_type.where(~(F.col("method").isin(*MAPPING_METHODS) & F.col("class_name").isNull() & ~F.col("receiver").isin("self", "cls")))

    tiers = [
        told(s.join(own, in_file & (F.col("callee") == F.col("t_qualified")) & F.col("dotted")), "direct_call"),
        told(alone(with_type.where("class_name IS NOT NULL").join(own, F.concat_ws(".", "class_name", "method") == F.col("t_qualified"))), "typed_local"),
        told(alone(dotted.where(F.col("receiver").isin("self", "cls")).join(own, in_file & (F.col("method") == F.col("t_name")))), "method_call"),
        told(alone(guarded.join(own, in_file & (F.col("method") == F.col("t_name")))), "method_call"),
    ]
    used = imports.select("file_path", F.col("name").alias("method"), "resolved_path", F.coalesce("original", "name").alias("original"))
    first_part = F.substring_index("callee", ".", 1)
    by_import = lambda df, on: df.join(used.withColumnRenamed("method", "_used"), (df["file_path"] == used["file_path"]) & (on == F.col("_used"))).drop(used["file_path"])
    imported = by_import(bare, F.col("method")).join(own, (F.col("resolved_path") == F.col("t_path")) & (F.col("original") == F.col("t_name")))
    module = by_import(dotted, first_part).join(own, (F.col("resolved_path") == F.col("t_path")) & F.col("method").eqNullSafe(F.col("t_name")))
    tiers.append(told(module, "import_resolved"))
    plain = bare.join(own, in_file & (F.col("method") == F.col("t_name")))
    unqualified = plain.where("t_qualified = t_name").select("site").distinct()
    tiers.append(told(imported.join(unqualified, "site", "left_anti"), "import_resolved"))
    tiers.append(told(plain, "direct_call"))
    tiers.append(told(imported, "import_resolved"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(candidate_rank(F.col("file_path"), F.col("t_path")), "target"))
    few = lambda df: df.withColumns({"_n": F.count("*").over(Window.partitionBy("site")), "_r": rank}).where((F.col("_n") <= MOST_CANDIDATES) & (F.col("_r") == 1))
    # names with more definitions go first, so a frequent one never meets its calls
    rare = own.join(own.groupBy("t_name").agg(F.count("*").alias("_d")).where(F.col("_d") <= MOST_CANDIDATES).select("t_name"), "t_name", "left_semi")
    tiers.append(told(few(guarded.join(rare, F.col("method") == F.col("t_name"))), "method_call"))
    tiers.append(told(few(bare.join(rare, F.col("method") == F.col("t_name"))), "fuzzy"))

    best = by_tiers(sites, ["site"], tiers).groupBy("site").agg(F.min_by(F.struct("target", "confidence", "reason"), F.struct(-F.col("confidence"), F.col("target"))).alias("r"))
    out = sites.join(best, "site").select("site", "caller", F.col("r.target").alias("callee"), "line", "r.confidence", "r.reason")
    from graphloom.operators.edges import is_suspect_loop

    return out.where(~is_suspect_loop(*map(F.col, ("caller", "callee", "confidence", "reason"))))
