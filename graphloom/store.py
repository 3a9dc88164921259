"""The tables of a source tree, kept in a folder and brought up to date by what changed.

Every table has rows by path, dealt to a fixed number of folders by the path's
hash. A sync reads the tree once, parses the files whose hash is new, finds the
files whose calls may resolve differently now, resolves those alone, and
overwrites the folders that hold any of these paths; the rest is not touched.

The files to resolve are written down before anything is overwritten and the
table of hashes is written last: a sync that breaks off is done again, whole, by
the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import edges as E
from graphloom.operators import imports as M
from graphloom.operators import resolve as N
from graphloom.operators import state as U
from graphloom.plans.shared import cut
from graphloom.sources import tree

#: Folders of a table.
BUCKETS = 16

SCHEMAS = {
    "files": "path string, name string, extension string, language string, size_bytes long, line_count long, source_hash string, is_test boolean, is_config boolean",
    "parsed": tree.PARSED,
    "imports": "path string, name string, resolved_path string, original string",
    "calls": "path string, src string, dst string, confidence double, reason string, line long, lines array<long>, sites long",
    "pending": "path string",
}


@dataclass
class Synced:
    """What a sync did: changes (path, change), and how many files it parsed and resolved."""

    changes: DataFrame
    parsed: int
    resolved: int


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def read(self, table: str) -> DataFrame:
        """A table without the rows that only mark a folder as written; empty before the first sync."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(f"{SCHEMAS[table]}, bucket int").parquet(f"{self.folder}/{table}").where("path IS NOT NULL")

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _replace(self, table: str, rows: DataFrame, paths: DataFrame) -> list[int]:
        """Puts ``rows`` in place of all rows of ``paths``; writes the folders of these paths and no others."""
        touched = sorted(r.bucket for r in paths.select(self._bucket().alias("bucket")).distinct().collect())  # one number per folder
        if not touched:
            return touched
        names = self.spark.createDataFrame([], SCHEMAS[table]).columns
        old = self.read(table)
        kept = old.where(F.col("bucket").isin(touched)).join(paths, "path", "left_anti") if "bucket" in old.columns else old
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")  # a folder whose last path is gone is written too
        out = kept.select(*names).unionByName(rows.select(*names)).withColumn("bucket", self._bucket()).unionByName(marks, allowMissingColumns=True)
        out = cut(out.repartition("bucket"), f"sync-{table}")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{table}")
        return touched

    def sync(self, root: str) -> Synced:
        """Brings the tables up to the state of the tree below ``root``."""
        index = self.read("files").select("path", F.col("source_hash").alias("_was"))
        scanned = tree.scan_files(self.spark, root).join(index, "path", "left")
        # the text of a file that did not change goes no further
        now = cut(scanned.withColumn("text", F.when(F.col("_was").isNull() | (F.col("_was") != F.col("source_hash")), F.col("text"))).drop("_was"), "sync-scan")
        changes = cut(U.diff(index.withColumnRenamed("_was", "source_hash"), now.select("path", "source_hash")), "sync-changes")
        pending = cut(self.read("pending").select("path"), "sync-pending")
        if changes.isEmpty() and pending.isEmpty():
            return Synced(changes, 0, 0)
        gone = changes.select("path")
        new = now.join(changes.where("change <> 'removed'"), "path", "left_semi")
        fresh = cut(tree.parse(new), "sync-parsed")
        old = self.read("parsed").select(*fresh.columns)
        parsed = old.join(gone, "path", "left_anti").unionByName(fresh)

        imports = cut(resolved_imports(tree.exploded(parsed, "imports"), now.drop("text")).withColumnRenamed("file_path", "path"), "sync-imports")
        before = self.read("imports").select(*imports.columns)
        moved = imports.exceptAll(before).unionByName(before.exceptAll(imports)).select("path").distinct()
        links = imports.unionByName(before).select(F.col("path").alias("src"), F.col("resolved_path").alias("dst"))
        called = self.read("calls").select(F.col("path").alias("src"), F.regexp_extract("dst", r"^function:(.*):[^:]*$", 1).alias("dst"))
        # a call by name may mean another function now if one of its name came or went, wherever that is
        names = old.join(gone, "path", "left_semi").unionByName(fresh).select(F.inline("functions")).select("name").distinct()
        named = tree.exploded(parsed, "calls").select(F.col("file_path").alias("path"), F.substring_index("callee", ".", -1).alias("name")).join(names, "name", "left_semi").select("path")
        expanded = U.to_reparse(changes, called, links, now)
        affected = expanded.unionByName(moved).unionByName(named).unionByName(pending).distinct().join(now.select("path"), "path", "left_semi")
        affected = cut(affected, "sync-affected")
        stale = cut(affected.unionByName(gone).unionByName(moved).unionByName(pending).distinct(), "sync-stale")
        self._write_pending(stale)

        calls = self._calls(parsed, now.drop("text"), imports, affected)
        self._replace("calls", calls, stale)
        self._replace("imports", imports.join(stale, "path", "left_semi"), stale)
        self._replace("parsed", fresh, gone)
        self._replace("files", new, gone)
        self._write_pending(stale.limit(0))
        return Synced(changes, fresh.count(), affected.count())

    def _write_pending(self, paths: DataFrame) -> None:
        paths.select("path").withColumn("bucket", F.lit(0)).write.mode("overwrite").parquet(f"{self.folder}/pending")

    def _calls(self, parsed: DataFrame, files: DataFrame, imports: DataFrame, affected: DataFrame) -> DataFrame:
        """The merged calls of the affected files; all functions are candidates."""
        own = parsed.join(affected, "path", "left_semi")
        symbols = functions_of(parsed, files).where("NOT is_module_caller").select("id", "name", "qualified_name", "file_path")
        used = imports.join(affected, "path", "left_semi").withColumnRenamed("path", "file_path")
        typed = tree.exploded(own, "variables").select("file_path", "name", F.col("inferred_type").alias("class_name")).where("class_name IS NOT NULL")
        sites = cut(tree.exploded(own, "calls").select(F.monotonically_increasing_id().alias("site"), T.node_id("function", F.col("file_path"), F.col("caller")).alias("caller"), "file_path", "callee", "line"), "sites")
        resolved = N.resolve_calls(sites, symbols, used, typed)
        merged = E.merge_calls(resolved.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "line", "confidence", "reason"))
        return merged.join(sites.select(F.col("caller").alias("src"), F.col("file_path").alias("path")).distinct(), "src")

    def functions(self) -> DataFrame:
        return functions_of(self.read("parsed"), self.read("files"))


    def variables(self) -> DataFrame:
        """(id, function, name, position, is_return, file_path, line_number): a function's variables, each name once."""
        each = tree.exploded(self.read("parsed"), "variables")
        owner = T.node_id("function", F.col("file_path"), F.col("function"))
        once = each.groupBy("file_path", owner.alias("function"), "name").agg(F.min("position").alias("position"), F.bool_or("is_return").alias("is_return"), F.min("line_number").alias("line_number"))
        return once.withColumn("id", _variable("function", "name"))

    def sites(self) -> DataFrame:
        """(site, caller, callee, arguments, keywords, target, confidence): call sites with the functions that they resolve to."""
        said = tree.exploded(self.read("parsed"), "calls").withColumn("src", T.node_id("function", F.col("file_path"), F.col("caller")))
        named = said.withColumn("_said", F.substring_index("callee", ".", -1))
        used = self.read("imports").select(F.col("path").alias("file_path"), F.col("name").alias("_said"), "original").distinct()
        meant = named.join(used, ["file_path", "_said"], "left").withColumn("_name", F.coalesce("original", "_said"))
        calls = self.read("calls").select("src", "dst", "confidence", F.explode("lines").alias("line"), F.regexp_extract("dst", r"([^:.]*)$", 1).alias("_name"))
        site = F.xxhash64("src", "line", "callee", "argument_exprs", "target")
        return meant.join(calls, ["src", "line", "_name"]).select(site.alias("site"), F.col("src").alias("caller"), F.col("dst").alias("callee"), F.col("argument_exprs").alias("arguments"), F.col("keyword_args").alias("keywords"), "target", "confidence")

    def assignments(self) -> DataFrame:
        """(src, dst): flows between the variables of one function."""
        each = tree.exploded(self.read("parsed"), "flows").withColumn("function", T.node_id("function", F.col("file_path"), F.col("function")))
        return each.select(_variable("function", "source").alias("src"), _variable("function", "target").alias("dst")).distinct()


def _variable(function: str, name: str):
    return F.concat(F.lit("variable:"), F.substr(function, F.lit(len("function:") + 1)), F.lit(":"), F.col(name))


def functions_of(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """All functions with their ids, and a caller for each file that calls when it is loaded."""
    found = tree.exploded(parsed, "functions")
    loads = tree.exploded(parsed, "calls").where(F.col("caller") == tree.MODULE).select("file_path").distinct()
    modules = loads.select("file_path", F.lit(tree.MODULE).alias("qualified_name"), F.lit(tree.MODULE).alias("name"), F.lit(True).alias("is_module_caller"))
    both = found.withColumn("is_module_caller", F.lit(False)).unionByName(modules, allowMissingColumns=True)
    return both.join(files.select(F.col("path").alias("file_path"), "is_test", "language"), "file_path").withColumn("id", T.node_id("function", F.col("file_path"), F.col("qualified_name")))


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, name, resolved_path, original) of imports that name a file of the tree.

    Dotted ones by the longest known module, also below the package roots; relative ones by their dots;
    those of scripts by their paths; names that a file only passes on come from where it got them, one file on.
    """
    asked = found.join(files.select(F.col("path").alias("file_path"), "language"), "file_path")
    pairs = asked.select(F.col("file_path").alias("importer"), F.col("module_path").alias("module"), "language").distinct()
    python = files.where("language = 'python'")
    dotted = python.select("path", F.replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit(".")).alias("module"))
    rooted = dotted.join(M.package_roots(python), F.substring_index("path", "/", 1) == F.col("root")).select("path", F.expr("substr(module, length(root) + 2)").alias("module"))
    modules = dotted.unionByName(rooted.where("module != ''")).groupBy("module").agg(F.min("path").alias("path"))
    scripts = M.resolve_scripts(pairs.where("language IN ('javascript', 'typescript')").drop("language"), files)
    resolved = M.resolve_dotted(pairs.where("language = 'python'").drop("language"), modules).unionByName(scripts).where("resolved IS NOT NULL")
    there = resolved.join(files.select(F.col("path").alias("resolved")), "resolved", "left_semi").select(F.col("importer").alias("file_path"), F.col("module").alias("module_path"), F.col("resolved").alias("resolved_path"))
    used = found.join(there, ["file_path", "module_path"]).select("file_path", "name", "resolved_path", F.coalesce("original", "name").alias("original"))
    by_name = used.select(F.col("resolved_path").alias("_source"), F.col("original").alias("_name"), F.col("file_path").alias("resolved_path"), F.col("name").alias("original"))
    passed = by_name.groupBy("resolved_path", "original").agg(F.min(F.struct("_source", "_name")).alias("from"))
    return used.join(passed, ["resolved_path", "original"], "left").select("file_path", "name", F.coalesce("from._source", "resolved_path").alias("resolved_path"), F.coalesce("from._name", "original").alias("original"))
