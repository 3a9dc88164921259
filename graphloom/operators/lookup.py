"""Lookups of nodes and of what stands beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_value(nodes: DataFrame, column: str, value) -> DataFrame:
    """The rows that hold ``value``: function by id, functions of a file or layer, variables of a function, file by its derived id."""
    return nodes.where(F.col(column) == F.lit(value))


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return by_value(files, "id", f"file:{path}")


def among(nodes: DataFrame, column: str, wanted: DataFrame, other: str | None = None) -> DataFrame:
    """The rows whose ``column`` stands in ``wanted``."""
    return nodes.join(wanted.select(F.col(other or column).alias(column)).distinct(), column, "left_semi")


def outside(nodes: DataFrame, column: str, excluded: DataFrame, other: str | None = None) -> DataFrame:
    """The rows whose ``column`` stands not in ``excluded``."""
    return nodes.join(excluded.select(F.col(other or column).alias(column)), column, "left_anti")


def endpoints(functions: DataFrame) -> DataFrame:
    """Functions with an HTTP method."""
    return functions.where(F.coalesce(F.col("http_method"), F.lit("")) != "")


def http_callees(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, id, name, edge_type): functions reached over the network."""
    return edges.join(functions.select("id", "name"), F.col("dst") == F.col("id")).select("src", "id", "name", F.lit("http").alias("edge_type"))


def pathway_cascade(pathways: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, id, tier): for each ``term`` the one pathway it means: by name, display name, id, then a part of the name; shortest name first.

    The three exact tiers are equi-joins; only terms that none of them answers look at all names.
    """
    exact = None
    for tier, column in enumerate(("name", "display_name", "id")):
        hit = asked.join(pathways, F.col("term") == F.col(column)).select("term", F.lit(tier).alias("tier"), "name", "id")
        exact = hit if exact is None else exact.unionByName(hit)
    rest = asked.join(exact.select("term").distinct(), "term", "left_anti")
    part = rest.join(pathways, F.contains(F.lower("name"), F.lower("term"))).select("term", F.lit(3).alias("tier"), "name", "id")
    best = exact.unionByName(part).groupBy("term").agg(F.min(F.struct("tier", F.length("name").alias("n"), "name", "id")).alias("b"))
    return best.select("term", "b.id", "b.tier")


def confident_pathways(pathways: DataFrame, least: float, include_tests: bool = False) -> DataFrame:
    kept = pathways.where(F.col("confidence") >= least)
    return kept if include_tests else kept.where(~F.col("is_test"))


def node_details(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Each function with the ids of who calls it and whom it calls, counted and smallest first, five at most of either."""
    few = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, 5)
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_callers"), few("src").alias("callers"))
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_callees"), few("dst").alias("callees"))
    none = F.array().cast("array<bigint>")
    both = functions.select("id", "name", "file_path").join(ins, "id", "left").join(outs, "id", "left")
    return both.withColumns({"n_callers": F.coalesce("n_callers", F.lit(0)), "n_callees": F.coalesce("n_callees", F.lit(0)), "callers": F.coalesce("callers", none), "callees": F.coalesce("callees", none)})


def files_with_called_methods(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path): files of which some method is called."""
    return methods.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").select("file_path").distinct()


def type_references(annotated: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, uses): classes named in annotations (file_path, names); one of the same file answers before all others of the name."""
    used = annotated.select("file_path", F.explode("names").alias("name"))
    near = used.join(classes.select("file_path", "name", F.col("id").alias("class_id")), ["file_path", "name"])
    far = used.join(near.select("file_path", "name").distinct(), ["file_path", "name"], "left_anti").join(classes.select("name", F.col("id").alias("class_id")), "name")
    return near.select("class_id").unionByName(far.select("class_id")).groupBy("class_id").agg(F.count("*").alias("uses"))


def mark(nodes: DataFrame, marked: DataFrame, flag: str, key: str = "id") -> DataFrame:
    """``nodes`` with ``flag`` true where the key stands in ``marked``; what was true stays."""
    found = marked.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    was = F.coalesce(F.col(flag), F.lit(False)) if flag in nodes.columns else F.lit(False)
    return nodes.join(found, key, "left").withColumn(flag, was | F.coalesce("_hit", F.lit(False))).drop("_hit")


def first_variable(variables: DataFrame) -> DataFrame:
    """The first variable of each name in a function, by line and id."""
    order = F.struct("line_number", "id")
    return variables.groupBy("function_id", "name").agg(F.min_by("id", order).alias("id"), F.min("line_number").alias("line_number"))


def call_sites(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst, line) with ``site``: the site of that line, else the only one of the pair, else null."""
    every = sites.groupBy("src", "dst").agg(F.count("*").alias("_n"), F.min("site").alias("_only"))
    exact = sites.groupBy("src", "dst", "line").agg(F.min("site").alias("_exact"))
    joined = edges.join(exact, ["src", "dst", "line"], "left").join(every, ["src", "dst"], "left")
    return joined.withColumn("site", F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_only")))).drop("_exact", "_n", "_only")


def base_methods(methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(id, base_id): the smallest method of the same name in an ancestor class; ``ancestors`` has (class_name, ancestor).

    The smallest is taken per class and name first: methods of one name in one class meet one row, not each other.
    """
    above = methods.groupBy(F.col("class_name").alias("ancestor"), "name").agg(F.min("id").alias("base_id"))
    return methods.join(ancestors, "class_name").join(above, ["ancestor", "name"]).groupBy("id").agg(F.min("base_id").alias("base_id"))


def with_class_role(methods: DataFrame, roles: DataFrame) -> DataFrame:
    """Methods with the layer and role of their class."""
    return methods.join(roles.select("class_name", F.col("role").alias("class_role")), "class_name", "left").withColumn("role", F.coalesce("class_role", F.lit("unknown"))).drop("class_role")


def script_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path): scripts that some page loads."""
    pages = files.where("language = 'html'").select(F.col("path").alias("src"))
    scripts = files.where("language IN ('javascript', 'typescript')").select(F.col("path").alias("dst"))
    return imports.join(pages, "src", "left_semi").join(scripts, "dst", "left_semi").select(F.col("dst").alias("path")).distinct()


def script_globals(functions: DataFrame) -> DataFrame:
    """Functions of scripts that stand in no other function of their file: none begins on an earlier line and ends on or behind their last.

    Methods and callers of modules, where the columns are there, are no globals and hold none. One window over
    a file's functions, by line: those of one line do not see each other.
    """
    plain = functions
    for flag in {"is_method", "is_module_caller"} & set(functions.columns):
        plain = plain.where(~F.coalesce(flag, F.lit(False)))
    before = Window.partitionBy("file_path").orderBy("line_start").rangeBetween(Window.unboundedPreceding, -1)
    return plain.withColumn("_furthest", F.max("line_end").over(before)).where(F.col("_furthest").isNull() | (F.col("_furthest") < F.col("line_end"))).drop("_furthest")


def recent_commits(changes: DataFrame, days: int = 180, ts: str = "ts", until: Column | None = None) -> DataFrame:
    """Changes of the last ``days`` days before ``until``, the newest change if that is not given."""
    newest = changes.agg(F.max(ts)).scalar() if until is None else until
    return changes.where(F.col(ts) >= newest - F.make_dt_interval(F.lit(days)))


def tail(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group; a group's other rows go before the shuffle's window holds them."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= n).drop("_at")


def capped(rows: DataFrame, limit: int | None, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows; all where it is None."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)
