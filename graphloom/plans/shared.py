"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows of one partition of a table that ``dealt`` deals out.
ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in one partition for each ``ROWS`` of ``rows``, if shuffles have fewer than these anyway.

    The number of shuffle partitions is fixed, so that without this a task's sorts and hash tables grow with the input.
    """
    parts = -(-rows // ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cut(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    The plan that made it is cut there: a lost executor costs only the tasks
    that were running, and several consumers read one and the same result.
    Without ``dictionary`` values are written as they are: hashes, which seldom repeat, read faster so.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
