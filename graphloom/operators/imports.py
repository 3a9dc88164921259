"""Resolution of imports to files: dotted, relative, through package roots, re-exports, script paths, other languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import code, paths

SCRIPT_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")


def package_roots(files: DataFrame, path: str = "path") -> DataFrame:
    """(root): first directories that have two child packages or more."""
    packages = files.where(F.endswith(F.col(path), F.lit("/__init__.py"))).select(F.regexp_replace(path, "/__init__\\.py$", "").alias("package")).distinct()
    inner = packages.where(F.contains("package", F.lit("/")))
    return inner.groupBy(F.substring_index("package", "/", 1).alias("root")).agg(F.count("*").alias("children")).where("children >= 2").select("root")


def relative_target(module: Column, importer: Column) -> Column:
    """The file that a dotted relative import names: each dot beyond the first climbs a directory; null above the root."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    parts = F.split(importer, "/")
    left = F.size(parts) - 1 - (dots - 1)
    base, rest = F.array_join(F.slice(parts, 1, F.greatest(left, F.lit(0))), "/"), F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    return F.when((dots > 0) & (left >= 0), F.concat(base, F.lit("/"), F.when(rest != "", F.concat(rest, F.lit(".py"))).otherwise(F.lit("__init__.py"))))


def script_index(files: DataFrame, path: str = "path") -> DataFrame:
    """(stem, path): scripts by their path without extension, and index files by their folder where that is free."""
    scripts = files.where(paths.extension(F.col(path)).isin(*SCRIPT_EXTENSIONS)).select(F.col(path).alias("path"), F.regexp_replace(path, r"\.[^./]+$", "").alias("stem"))
    own = scripts.select("stem", "path", F.lit(0).alias("rank"))
    folder = scripts.where(F.endswith("stem", F.lit("/index"))).select(F.regexp_replace("stem", "/index$", "").alias("stem"), "path", F.lit(1).alias("rank"))
    return own.unionByName(folder).groupBy("stem").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def script_target(module: Column, importer: Column) -> Column:
    """The stem that a script import names; null for packages."""
    folder = F.array_join(F.slice(F.split(importer, "/"), 1, F.size(F.split(importer, "/")) - 1), "/")
    joined = F.when(module.startswith("/"), F.regexp_replace(module, "^/+", "")).otherwise(paths.resolve_dots(F.when(folder != "", F.concat(folder, F.lit("/"), module)).otherwise(module)))
    return F.when(module.rlike(r"^[./]"), F.regexp_replace(joined, r"\.(js|jsx|ts|tsx)$", ""))


def resolve_scripts(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (importer, module) of scripts with ``resolved``: the stem itself, then its index file."""
    index = script_index(files)
    asked = imports.withColumn("_stem", script_target(F.col("module"), F.col("importer")))
    candidates = asked.select("*", F.posexplode(F.array(F.col("_stem"), F.concat("_stem", F.lit("/index")))).alias("_rank", "_try"))
    found = candidates.join(index.select(F.col("stem").alias("_try"), F.col("path").alias("_path")), "_try", "left")
    return found.groupBy(*imports.columns).agg(F.min_by("_path", F.when(F.col("_path").isNotNull(), F.col("_rank"))).alias("resolved"))


def reexports(imports: DataFrame) -> DataFrame:
    """(path, symbol, source): where a file's imported names come from, for resolved imports (importer, resolved, names)."""
    return imports.where("resolved IS NOT NULL").select(F.col("importer").alias("path"), F.explode("names").alias("symbol"), F.col("resolved").alias("source")).distinct()


def through_reexports(imports: DataFrame) -> DataFrame:
    """(importer, symbol, source): imported names, followed one file further where that only passes them on."""
    known = reexports(imports)
    onward = known.select(F.col("path").alias("source"), "symbol", F.col("source").alias("_origin"))
    return known.join(onward, ["source", "symbol"], "left").select(F.col("path").alias("importer"), "symbol", F.coalesce("_origin", "source").alias("source")).distinct()


def resolve_dotted(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``imports`` (importer, module) with ``resolved``: relative ones by their dots, others by the longest known prefix of (module, path)."""
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), ".").alias("prefix")))
    absolute = imports.where(~F.col("module").startswith("."))
    tried = absolute.select(*imports.columns, F.explode(prefixes).alias("_p")).join(modules.select(F.col("module").alias("_module"), F.col("path").alias("_path")), F.col("_p.prefix") == F.col("_module"), "left")
    longest = tried.groupBy(*imports.columns).agg(F.max_by("_path", F.when(F.col("_path").isNotNull(), F.col("_p.k"))).alias("resolved"))
    relative = imports.where(F.col("module").startswith(".")).withColumn("resolved", relative_target(F.col("module"), F.col("importer")))
    return longest.unionByName(relative)


def cross_language(names: DataFrame) -> DataFrame:
    """(a, b, norm): pairs of functions (id, name, language) of two languages whose names agree; the other language answers.

    A name's list per language is aggregated first, so a common name meets once per pair of languages.
    """
    index = names.groupBy(code.cross_language_name(F.col("name")).alias("norm"), "language").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    a, b = index.alias("a"), index.alias("b")
    return a.join(b, (F.col("a.norm") == F.col("b.norm")) & (F.col("a.language") != F.col("b.language"))).select("a.norm", F.col("a.language").alias("language"), F.col("a.ids").alias("ids"), F.col("b.language").alias("other"), F.col("b.ids").alias("candidates"))


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    at = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(at)).where("_at = 1").drop("_at")
