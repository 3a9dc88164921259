"""How a query is written down: a function over (spark, sf_dir) and the SQL that tells the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Catalogue(list):
    """A list of queries; ``@catalogue.query(sql)`` adds a function under its name."""

    def query(self, sql: str | None = None):
        def add(run):
            self.append(Query(run.__name__, run, sql))
            return run

        return add


# What the projections of the driver's tables are in SQL.
RAW_CALLS = """raw AS (
  SELECT * FROM (
    SELECT l_partkey AS src,
      lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag) AS dst,
      CAST(l_linenumber AS BIGINT) AS line,
      round(1 - 5 * l_discount, 4) AS confidence,
      CASE l_returnflag WHEN 'A' THEN 'direct_call' WHEN 'N' THEN 'import_resolved' ELSE 'fuzzy' END AS reason
    FROM lineitem) WHERE dst IS NOT NULL)"""
CALLS = (
    RAW_CALLS
    + """, calls AS (
  SELECT src, dst, max(confidence) AS confidence, first(reason ORDER BY confidence DESC, reason) AS reason, min(line) AS line, count(*) AS sites
  FROM raw WHERE src <> dst GROUP BY src, dst)"""
)
FUNCTIONS = """fn AS (
  SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name, lower(p_type) || '/' || p_brand AS file_path,
    p_brand AS class_name, lower(p_type) AS module, CAST(p_size AS BIGINT) AS line_count, p_size <= 10 AS is_test
  FROM part)"""
DEGREES = """deg AS (
  SELECT fn.*, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees
  FROM fn LEFT JOIN (SELECT dst, count(*) AS n FROM calls GROUP BY dst) i ON i.dst = fn.id
  LEFT JOIN (SELECT src, count(*) AS n FROM calls GROUP BY src) o ON o.src = fn.id)"""
