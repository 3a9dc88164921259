"""Layers, roles and boundary rules of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The modules whose import tells a file's layer.
IMPORT_LAYERS = {
    "persistence": (
        "sqlalchemy", "alembic", "psycopg2", "asyncpg", "aiopg",
        "pymongo", "motor", "redis", "aioredis", "aiomysql",
        "django.db", "peewee", "tortoise", "databases", "prisma",
        "pymysql", "cx_Oracle", "pyodbc", "sqlite3",
    ),
    "api": (
        "flask", "fastapi", "django.views", "django.http",
        "django.urls", "starlette", "falcon", "tornado",
        "aiohttp.web", "sanic", "quart", "litestar",
        "express", "koa", "hapi", "nestjs",
        "@nestjs",
    ),
    "ui": (
        "react", "vue", "svelte", "next/navigation", "next/router",
        "@angular", "preact", "@remix-run", "gatsby",
    ),
    "business_logic": (
        "celery", "dramatiq", "rq", "apscheduler",
    ),
}
# The part of a path that tells a file's layer; the first that fits decides.
PATH_LAYERS = (
    ("/models/", "persistence"),
    ("/model/", "persistence"),
    ("/entities/", "persistence"),
    ("/entity/", "persistence"),
    ("/repositories/", "persistence"),
    ("/repository/", "persistence"),
    ("/db/", "persistence"),
    ("/database/", "persistence"),
    ("/migrations/", "persistence"),
    ("/dao/", "persistence"),
    ("/routes/", "api"),
    ("/route/", "api"),
    ("/handlers/", "api"),
    ("/handler/", "api"),
    ("/controllers/", "api"),
    ("/controller/", "api"),
    ("/views/", "api"),
    ("/api/", "api"),
    ("/endpoints/", "api"),
    ("/pages/", "ui"),
    ("/page/", "ui"),
    ("/components/", "ui"),
    ("/component/", "ui"),
    ("/templates/", "ui"),
    ("/template/", "ui"),
    ("/services/", "business_logic"),
    ("/service/", "business_logic"),
    ("/domain/", "business_logic"),
    ("/usecases/", "business_logic"),
    ("/use_cases/", "business_logic"),
    ("/utils/", "util"),
    ("/util/", "util"),
    ("/helpers/", "util"),
    ("/helper/", "util"),
    ("/lib/", "util"),
    ("/libs/", "util"),
    ("/common/", "util"),
    ("/shared/", "util"),
)
# The part of a path that tells a file's role; the first that fits decides.
PATH_ROLES = (
    ("/repositories/", "repository"),
    ("/repository/", "repository"),
    ("/services/", "service"),
    ("/service/", "service"),
    ("/controllers/", "controller"),
    ("/controller/", "controller"),
    ("/routes/", "handler"),
    ("/route/", "handler"),
    ("/views/", "handler"),
    ("/api/", "handler"),
    ("/endpoints/", "handler"),
    ("/handlers/", "handler"),
    ("/handler/", "handler"),
    ("/pages/", "page"),
    ("/page/", "page"),
    ("/components/", "component"),
    ("/component/", "component"),
    ("/utils/", "util"),
    ("/util/", "util"),
    ("/helpers/", "helper"),
    ("/models/", "model"),
    ("/model/", "model"),
    ("/entities/", "model"),
    ("/db/", "repository"),
    ("/database/", "repository"),
)


def _first(pairs: list[tuple[Column, str]]) -> Column:
    """The value of the first condition that holds, or null."""
    return F.coalesce(*(F.when(when, value) for when, value in pairs))


def layer_of_module(module: Column) -> Column:
    """The layer of an imported module: the module itself or what lies below it."""
    below = lambda names: "^(" + "|".join(n.replace(".", r"\.") for n in names) + r")([./]|$)"
    return _first([(module.rlike(below(names)), layer) for layer, names in IMPORT_LAYERS.items()])


def layer_of_path(path: Column) -> Column:
    return _first([(F.contains(F.lower(path), F.lit(part)), layer) for part, layer in PATH_LAYERS])


def role_of_path(path: Column) -> Column:
    return _first([(F.contains(F.lower(path), F.lit(part)), role) for part, role in PATH_ROLES])


def classify(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``files`` with layer and role: by the first import in its file that tells one, else by path; tests are helpers.

    ``imports`` has (file_path, module_path, line_number). One pass decides, so nothing is overwritten.
    """
    told = imports.select(F.col("file_path").alias("path"), layer_of_module(F.col("module_path")).alias("_layer"), "line_number").where("_layer IS NOT NULL")
    first = told.groupBy("path").agg(F.min_by("_layer", F.struct("line_number", "_layer")).alias("_layer"))
    out = files.join(first, "path", "left")
    layer = F.coalesce("_layer", layer_of_path(F.col("path")), F.lit("unknown"))
    role = F.when(F.col("is_test"), "test_helper").otherwise(F.coalesce(role_of_path(F.col("path")), F.lit("unknown")))
    return out.withColumns({"layer": layer, "role": role}).drop("_layer")


def boundary_findings(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(kind, severity, path, module_path): interface code that reaches past its neighbours.

    ``files`` has (path, layer) as ``classify`` gives them.
    """
    used = imports.select(F.col("file_path").alias("path"), "module_path", layer_of_module(F.col("module_path")).alias("_to"))
    seen = files.select("path", "layer").join(used, "path")
    db = F.col("_to") == "persistence"
    kind = F.when((F.col("layer") == "ui") & db, "ui_to_db_shortcut").when((F.col("layer") == "api") & db, "api_to_db_shortcut").when((F.col("layer") == "ui") & F.col("module_path").rlike(r"(^|[./])(domain|entities)([./]|$)"), "ui_domain_bypass")
    private = F.when(F.col("module_path").rlike(r"(^|[./])(_[a-z]\w*|internal|private)([./]|$)"), "private_surface_bypass")
    found = seen.select("path", "module_path", F.explode(F.array_compact(F.array(kind, private))).alias("kind"))
    severity = F.when(F.col("kind").isin("ui_to_db_shortcut", "api_to_db_shortcut"), "high").when(F.col("kind") == "private_surface_bypass", "medium").otherwise("low")
    return found.distinct().select("kind", severity.alias("severity"), "path", "module_path")
