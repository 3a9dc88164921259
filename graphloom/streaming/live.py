"""Live trace sessions: who is being traced now, and when a silent one is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_RECORD = "session string, ts timestamp, kind string, trace_path string"
_UPDATE = "session string, state string, reason string, started_at timestamp, last_seen timestamp, records long, trace_path string"
_STATE = "started long, seen long, records long, path string, timer long"


def stateful(spark: SparkSession) -> SparkSession:
    """A session for streams with state of their own: RocksDB, and no store left on an executor after its task."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    return own


class Sessions(StatefulProcessor):
    """One traced process: opened by its first record, closed by its last word or by a timer when it has been silent.

    The state of a session is five numbers and a path; a closed one leaves none. Times are kept in microseconds.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def _told(self, key, state: str, reason: str | None, started: int, seen: int, records: int, path: str | None) -> pd.DataFrame:
        at = lambda us: pd.Timestamp(us, unit="us")
        return pd.DataFrame([{"session": key[0], "state": state, "reason": reason, "started_at": at(started), "last_seen": at(seen), "records": records, "trace_path": path}])

    def _close(self) -> None:
        timer = self.open.get()[4]
        self.open.clear()
        if timer is not None:
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new["us"] = new["ts"].astype("datetime64[us]").astype("int64")
        new = new.sort_values("us", kind="stable")
        while len(new):
            last = (new["kind"] == "session_end").to_numpy().nonzero()[0]
            part, new = (new[: last[0] + 1], new[last[0] + 1 :]) if len(last) else (new, new[:0])
            before = self.open.get() if self.open.exists() else (int(part["us"].min()), 0, 0, None, None)
            paths = part["trace_path"].dropna()
            started, seen = min(before[0], int(part["us"].min())), max(before[1], int(part["us"].max()))
            records, path = before[2] + len(part), before[3] if before[3] is not None else paths.iloc[0] if len(paths) else None
            if len(last):
                if self.open.exists():
                    self._close()
                yield self._told(key, "closed", "ended", started, seen, records, path)
            else:
                timer = seen // 1000 + self.quiet_ms
                if before[4] is not None and before[4] != timer:
                    self.handle.deleteTimer(before[4])
                if before[4] != timer:
                    self.handle.registerTimer(timer)
                self.open.update((started, seen, records, path, timer))
                yield self._told(key, "live", None, started, seen, records, path)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            started, seen, records, path, _ = self.open.get()
            self.open.clear()
            yield self._told(key, "closed", "silent", started, seen, records, path)

    def close(self) -> None:
        pass


def live_sessions(records: DataFrame, quiet_s: int = 600, late: str = "2 minutes") -> DataFrame:
    """A stream of trace records (session, ts, kind, trace_path) to what changed about sessions, in update mode.

    A session without a record for ``quiet_s`` seconds of event time closes as silent, one with a ``session_end`` as
    ended; a later record of that name opens a new one. Records older than the watermark (``late`` behind the latest)
    are dropped, so a closed session does not come back. Records without a name or time are left out.
    """
    known = records.where("session IS NOT NULL AND ts IS NOT NULL").select("session", "ts", "kind", "trace_path").withWatermark("ts", late)
    return known.groupBy("session").transformWithStateInPandas(Sessions(quiet_s * 1000), _UPDATE, "Update", "EventTime")


def listing(updates: DataFrame) -> DataFrame:
    """The sessions that are live now, with an absolute path, from all updates so far (with ``batch``, their number)."""
    last = updates.groupBy("session").agg(F.max_by(F.struct("state", "started_at", "last_seen", "records", "trace_path"), F.struct("batch", "last_seen", F.col("state") == "live")).alias("u"))
    return last.where("u.state = 'live'").select("session", "u.started_at", "u.last_seen", "u.records", "u.trace_path").where(F.startswith("trace_path", F.lit("/")))
