"""Runtime traces and coverage reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "kind string, ts double, fn string, file string, line long, caller string, args map<string,string>, retval string, exc string, tracer string, version string, repo_root string, python string"


def read_traces(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The records of the ``*.jsonl`` files of a folder; lines that are no records are left out."""
    reader = (spark.readStream if stream else spark.read).schema(RECORD).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl")
    return reader.json(folder).where("kind IS NOT NULL")


def select_records(records: DataFrame, include: str | None = None, exclude: str | None = None, rate: float = 1.0, key: str = "fn") -> DataFrame:
    """Records whose function fits ``include`` and not ``exclude``, sampled by a hash so that a rerun takes the same."""
    out = records.where(F.col(key).rlike(include)) if include else records
    out = out.where(~F.col(key).rlike(exclude)) if exclude else out
    place = F.pmod(F.xxhash64(F.lit("sample"), *map(F.col, records.columns)) if "args" not in records.columns else F.xxhash64(F.lit("sample"), "ts", key, "line"), F.lit(1_000_000))
    return out if rate >= 1 else out.where(place < int(max(rate, 0) * 1_000_000))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of the executed lines of a coverage report."""
    schema = "files map<string, struct<executed_lines: array<long>, missing_lines: array<long>>>"
    report = spark.read.schema(schema).option("multiLine", "true").json(path)
    return report.select(F.explode("files").alias("path", "f")).select("path", F.explode("f.executed_lines").alias("line"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(file, records) of the trace files of a folder."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(folder)
    return lines.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("records"))
