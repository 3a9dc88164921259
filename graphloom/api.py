"""The engine: a graph of tables and the questions that can be asked of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators import flow as W
from graphloom.operators import groups as G
from graphloom.operators import modularity as C
from graphloom.operators import score as S
from graphloom.operators import search as R
from graphloom.operators import traversal as V
from graphloom.plans.shared import cut, shared_dir
from graphloom.store import Store, Synced


class Engine:
    """Functions and calls as tables; all answers are DataFrames."""

    def __init__(self, spark: SparkSession, functions: DataFrame | None = None, calls: DataFrame | None = None, store: Store | None = None):
        self.spark, self.functions, self.calls, self.store = spark, functions, calls, store
        self.files: DataFrame | None = None
        self.synced: Synced | None = None

    @classmethod
    def build(cls, spark: SparkSession, root: str, folder: str | None = None) -> Engine:
        """Scans and parses a source tree, resolves its calls and scores its functions.

        The tables stay in ``folder`` (by default a new one in the shared folder): an engine built on the
        same folder again takes up what changed since.
        """
        engine = cls(spark, store=Store(spark, folder or f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"))
        engine.sync(root)
        return engine

    def sync(self, root: str) -> DataFrame | None:
        """Brings the tables up to date; returns what changed since the last time (path, change), or None the first time."""
        first = self.files is None
        self.synced = self.store.sync(root)
        self.files = self.store.read("files").drop("bucket")
        self.calls = self.store.read("calls").drop("bucket", "path")
        scored = E.degrees(self.store.functions(), self.calls)
        self.functions = cut(scored.withColumn("entry_score", S.entry_score(scored)), "functions")
        return None if first else self.synced.changes

    def register(self) -> None:
        """Makes the tables known to SQL."""
        self.functions.createOrReplaceTempView("function")
        self.calls.createOrReplaceTempView("calls")
        if self.files is not None:
            self.files.createOrReplaceTempView("file")

    def query(self, sql: str, **args) -> DataFrame:
        """A read-only SQL query over the registered tables."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        logical = "org.apache.spark.sql.catalyst.plans.logical."
        if any(self.spark._jvm.java.lang.Class.forName(logical + kind).isInstance(plan) for kind in ("Command", "ParsedStatement")):
            raise PermissionError("only queries that read are allowed")
        self.register()
        return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)

    def _ids(self, symbol: str) -> DataFrame:
        return R.resolve(self.functions, symbol).select("id")

    def callers(self, symbol: str) -> DataFrame:
        return E.callers_of(self.calls, self.functions, self._ids(symbol).withColumnRenamed("id", "target"))

    def callees(self, symbol: str) -> DataFrame:
        return E.callees_of(self.calls, self.functions, self._ids(symbol).withColumnRenamed("id", "target"))

    def dependents(self, symbol: str, depth: int = 3) -> DataFrame:
        return V.reach(self.calls, self._ids(symbol), depth, forward=False).where("hop > 0")

    def dependencies(self, symbol: str, depth: int = 3) -> DataFrame:
        return V.reach(self.calls, self._ids(symbol), depth).where("hop > 0")

    def impact(self, paths: list[str], hops: int = 5) -> DataFrame:
        """What a change of ``paths`` reaches, most affected first."""
        seeds = self.functions.where(F.col("file_path").isin(*paths)).select("id", F.greatest("entry_score", F.lit(0.01)).alias("score"))
        return V.spread(self.calls, seeds, hops).join(self.functions.select("id", "qualified_name", "file_path"), "id").orderBy(F.desc("score"), "hop", "qualified_name")

    def entry_points(self, limit: int | None = 20) -> DataFrame:
        ranked = self.functions.where("entry_score > 0").orderBy(F.desc("entry_score"), "id").select("id", "qualified_name", "file_path", "entry_score")
        return ranked if limit is None else ranked.limit(limit)

    def pathways(self, limit: int = 50) -> DataFrame:
        return V.pathways(E.top_fan_out(self.calls), self.entry_points(limit).select("id"))

    def flows(self) -> DataFrame:
        """(site, src, dst, confidence): variables given as arguments and the parameters that they flow into."""
        return W.bind_arguments(self.store.sites(), self.store.variables())

    def trace_variable(self, name: str) -> tuple[DataFrame, DataFrame]:
        """The variables of a name and the flows that touch them."""
        found = cut(W.occurrences(self.store.variables(), name), "occurrences")
        return found, W.touching(self.flows(), found)

    def value_trace(self, variable: str) -> DataFrame:
        """(id): all variables that a value of one (by id) may flow into, calls and returns matched."""
        sites, variables = cut(self.store.sites(), "sites"), cut(self.store.variables(), "variables")
        seeds = self.spark.createDataFrame([(variable,)], "id string")
        return W.trace(seeds, W.bind_arguments(sites, variables), W.bind_returns(sites, variables), self.store.assignments())

    def communities(self, small: int = 8) -> DataFrame:
        """(community, label, members, internal, cohesion) by modularity, small ones merged."""
        own = self.functions.where("NOT is_module_caller").select("id", "file_path")
        labels = cut(C.communities(own, self.calls, small=small), "communities")
        return C.describe(labels, own, self.calls)

    def duplicates(self) -> DataFrame:
        return G.same_name(self.functions.where("NOT is_test AND NOT is_module_caller"))

    def search(self, text: str, limit: int = 10) -> DataFrame:
        body = F.concat_ws(" ", "name", "qualified_name", "docstring", "signature")
        lists = {"keyword": R.keyword(self.functions, text, "name", body, "id", 2 * limit), "fuzzy": R.fuzzy(self.functions, text, "name", "qualified_name", "id", 2 * limit)}
        return R.fuse(lists, "id", limit)

    def status(self) -> DataFrame:
        """(table, rows)"""
        tables = {"function": self.functions.where("NOT is_module_caller"), "calls": self.calls} | ({"file": self.files} if self.files is not None else {})
        parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
