"""Event sessions, offsets and per-key state, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, keys: list[str], ts: str, quiet: str, late: str | None = None) -> DataFrame:
    """(``keys``, session_start, session_end, events): runs of events of which each follows in less than ``quiet``.

    A session window merges on the map side, so no key's events have to be sorted as a whole. On a
    stream give ``late``, the delay after which a session is final.
    """
    rows = events.withWatermark(ts, late) if late else events
    window = F.session_window(ts, quiet).alias("_session")
    out = rows.groupBy(*keys, window).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("events"))
    return out.drop("_session")


def after_offset(records: DataFrame, key: str, order: list[str], offset: int) -> DataFrame:
    """Records of each key after its first ``offset`` ones."""
    return records.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_at") > offset).drop("_at")


_STATE = "calls long, source_hash string, past array<string>"
#: Earlier bodies of a function whose late records are known as such.
PAST = 64
_OUT = "function_id string, calls long, source_hash string"


def observations(records: DataFrame) -> DataFrame:
    """A stream of (function_id, source_hash) to running (function_id, calls, source_hash).

    The state of a function holds for one body: a record with a hash not seen before starts it anew,
    a late one of an earlier body is left out. ``PAST`` bodies of a function are remembered.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls, current, past = state.get if state.exists else (0, None, [])
        past = list(past)
        for batch in batches:
            for h, n in batch.groupby("source_hash", sort=False).size().items():
                if h == current:
                    calls += int(n)
                elif h not in past:
                    past = [*past, current][-PAST:] if current is not None else past
                    calls, current = int(n), h
        state.update((calls, current, past))
        yield pd.DataFrame([{"function_id": key[0], "calls": calls, "source_hash": current}])

    return records.groupBy("function_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_stream(changes: DataFrame, path: str, keys: list[str], checkpoint: str, order: str = "_order"):
    """Starts a query that folds each batch of ``changes`` into the table at ``path``.

    The table has a folder per batch, and a batch that is tried again writes the same folder, so
    the fold happens once.
    """
    from graphloom.operators.state import last_write, upsert

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = last_write(batch, keys, order).withColumn("_batch", F.lit(number))
        old = f"{path}/v={number - 1}"
        if number and not _exists(spark, old):
            raise FileNotFoundError(f"{old}: the table of the batch before is gone")
        merged = upsert(spark.read.parquet(old), new, keys) if number else new
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).outputMode("append").start()


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
