"""Routes, pages and components by what web frameworks look like in parsed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decorators by the verb they stand for, verbs of exported handlers, hooks of components.
VERBS = {".get": "GET", ".post": "POST", ".put": "PUT", ".patch": "PATCH", ".delete": "DELETE", ".websocket": "WEBSOCKET"}
_EXPORTED = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
_COMPONENT = r"export\s+default\s+function\s+([A-Z][A-Za-z0-9_]*)|function\s+([A-Z][A-Za-z0-9_]*)\s*\("
_HOOK = r"function\s+(use[A-Z][A-Za-z0-9_]*)\s*\("
_HOOKS_USED = r"(useState|useEffect|useMemo|useCallback|useReducer)\("
_SERVER, _CLIENT = r"""'use server'|"use server\"""", r"""'use client'|"use client\""""


def python_routes(functions: DataFrame) -> DataFrame:
    """(file_path, qualified_name, framework, http_method, route_path) of functions with a route's decorator.

    ``functions``: file_path, qualified_name, decorators, http_method, route_path. A decorator called ``route`` is
    flask's; one that ends in a verb is fastapi's, and its verb holds where the function tells no method.
    """
    verb = F.lit(None).cast("string")
    for suffix, method in VERBS.items():
        verb = F.when(F.endswith("decorator", F.lit(suffix)), method).otherwise(verb)
    each = functions.select("file_path", "qualified_name", F.explode(F.array_distinct("decorators")).alias("decorator"), "http_method", "route_path").withColumn("verb", verb)
    route = (F.col("decorator") == "route") | F.endswith("decorator", F.lit(".route"))
    told = each.select("file_path", "qualified_name", F.when(route, "flask").when(F.col("verb").isNotNull(), "fastapi").alias("framework"), F.when(route, F.col("http_method")).otherwise(F.coalesce("http_method", "verb")).alias("http_method"), "route_path")
    return told.where("framework IS NOT NULL").distinct()


def file_route(path: Column) -> Column:
    """The address of a ``route`` file of an application folder; null for other files."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(slashed, r"^app/", ""), r"/?route\.(ts|js)$", ""), F.lit("/"))
    return F.when(slashed.rlike(r"/route\.(ts|js)$"), F.concat(F.lit("/"), bare))


def script_routes(files: DataFrame) -> DataFrame:
    """The routes that scripts (path, language, text) export by the name of a verb, at the address of their file."""
    scripts = files.where("language IN ('javascript', 'typescript')")
    verbs = F.array_distinct(F.regexp_extract_all("text", F.lit(_EXPORTED), F.lit(1)))
    each = scripts.select(F.col("path").alias("file_path"), F.explode(verbs).alias("qualified_name"), F.coalesce(file_route(F.col("path")), F.lit("")).alias("route_path"))
    return each.select("file_path", "qualified_name", F.lit("nextjs").alias("framework"), F.col("qualified_name").alias("http_method"), "route_path")


def script_marks(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, frameworks, components, hooks, is_page, is_client) of scripts that look like a framework's.

    ``imports``: file_path, module_path.
    """
    used = imports.groupBy(F.col("file_path").alias("path")).agg(F.collect_set("module_path").alias("modules"))
    scripts = files.where("language IN ('javascript', 'typescript')").select("path", "text").join(used, "path", "left")
    uses = lambda test: F.coalesce(F.exists("modules", test), F.lit(False))
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    both = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(_COMPONENT), F.lit(1)), F.regexp_extract_all("text", F.lit(_COMPONENT), F.lit(2))))
    components = F.array_sort(F.filter(both, lambda c: c != ""))
    page, route, routed = path.rlike(r"/(page|layout)\.(tsx|jsx)$"), path.rlike(r"/route\.(ts|js)$"), F.concat(F.lit("/"), path).rlike("/app/")
    next_ = uses(lambda m: m.startswith("next")) | routed | page | route | F.col("text").rlike(_EXPORTED) | F.col("text").rlike(_SERVER)
    react = uses(lambda m: (m == "react") | m.startswith("react/")) | F.col("text").rlike(_HOOKS_USED) | path.rlike(r"\.(jsx|tsx)$") | (F.size(components) > 0)
    told = scripts.select("path", F.array_compact(F.array(F.when(next_, "nextjs"), F.when(react, "react"))).alias("frameworks"), components.alias("components"), F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(_HOOK), F.lit(1)))).alias("hooks"), page.alias("is_page"), F.col("text").rlike(_CLIENT).alias("is_client"))
    return told.where(F.size("frameworks") > 0)


def tagged(functions: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, layer, role, http_method, route_path): the functions that routes name by file and qualified name."""
    return functions.select("id", "file_path", "qualified_name").join(routes, ["file_path", "qualified_name"]).select("id", F.lit("api").alias("layer"), F.lit("handler").alias("role"), "http_method", "route_path").distinct()
