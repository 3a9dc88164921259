"""Live sessions close by event time, late records are dropped, a restart goes on where it was."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphloom.streaming import live

START = datetime(2024, 1, 1)
RECORDS = "session string, ts timestamp, kind string, trace_path string"


def test_silent_sessions_close_and_late_records_are_dropped(spark, tmp_path):
    own = live.stateful(spark)
    feed, out = f"file://{tmp_path}/feed", f"file://{tmp_path}/out"

    def told(*rows):
        """Appends records (session, minute, kind), starts the query on the one checkpoint, and gives the new updates."""
        data = [(s, START + timedelta(minutes=m) if m is not None else None, kind, f"/t/{s}.jsonl") for s, m, kind in rows]
        spark.createDataFrame(data, RECORDS).coalesce(1).write.mode("append").parquet(feed)
        stream = live.live_sessions(own.readStream.schema(RECORDS).parquet(feed), quiet_s=600, late="2 minutes")
        write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/{n:03d}")
        seen = {tuple(r) for r in rows_of()}
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.session, r.state, r.reason, r.records, (r.last_seen - START).seconds // 60) for r in rows_of() if tuple(r) not in seen)

    def rows_of():
        import pathlib

        return spark.read.parquet(f"{out}/*").collect() if list(pathlib.Path(tmp_path).glob("out/*")) else []

    assert told(("a", 0, "session"), ("a", 1, "call"), ("b", 1, "session"), (None, 1, "call"), ("x", None, "call")) == [("a", "live", None, 2, 1), ("b", "live", None, 1, 1)]
    # b goes on, so time passes for a
    assert told(("b", 14, "call")) == [("a", "closed", "silent", 2, 1), ("b", "live", None, 2, 14)]
    # a's late record is no new session; b ends and begins again
    assert told(("a", 2, "call"), ("b", 15, "session_end"), ("b", 16, "session")) == [("b", "closed", "ended", 3, 15), ("b", "live", None, 1, 16)]
    assert [tuple(r)[0] for r in live.listing(spark.read.parquet(f"{out}/*")).collect()] == ["b"]
    # a comes back on time, and is a session of its own
    assert told(("a", 17, "call"), ("c", 60, "session")) == [("a", "closed", "silent", 1, 17), ("a", "live", None, 1, 17), ("b", "closed", "silent", 1, 16), ("c", "live", None, 1, 60)]
    assert {r.session for r in live.listing(spark.read.parquet(f"{out}/*")).collect()} == {"c"}
