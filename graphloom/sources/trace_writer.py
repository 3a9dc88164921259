"""Trace records as JSON lines, within bounds that each task keeps for itself.

    spark.dataSource.register(BoundedTraces)
    records.write.format("bounded_traces").option("path", folder).option("max_records", 10000).mode("append").save()

Each task fills files of ``max_file_bytes`` at most and opens ``rotate_files``
further ones; what does not fit is dropped and counted by its reason. Files are
written under a hidden folder and moved when all tasks are done, so a task that
fails, or a job that does, leaves none; counts stand in a file beside them.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SUFFIX, COUNTS = ".jsonl", "_counts"


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)


class BoundedTraces(DataSource):
    """Options: path, session (``trace``), max_records, max_file_bytes (0: no bound), rotate_files (0: one file a task)."""

    @classmethod
    def name(cls) -> str:
        return "bounded_traces"

    def writer(self, schema, overwrite: bool) -> BoundedWriter:
        if overwrite:
            raise ValueError("traces are only appended")
        return BoundedWriter(dict(self.options))


class BoundedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.session = options["path"], options.get("session", "trace")
        self.most, self.size, self.rotate = (int(options.get(k, 0)) for k in ("max_records", "max_file_bytes", "rotate_files"))
        self.job = uuid.uuid4().hex

    def _open(self):
        """The file system of the path, which all executors and the driver see, and the path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def _hidden(self, root: str) -> str:
        return posixpath.join(root, f"_job-{self.job}")

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = self._open()
        stem = f"{self.session}_{self.job[:8]}_{context.partitionId():05d}"
        hidden = self._hidden(root)
        store.create_dir(hidden, recursive=True)
        counts, files, out, held = Counter(), [], None, 0
        try:
            for row in rows:
                line = (json.dumps(row.asDict(recursive=True), separators=(",", ":"), default=str, ensure_ascii=False) + "\n").encode()
                if self.most and counts["written"] >= self.most:
                    counts["dropped_max_records"] += 1
                    continue
                if self.size and held + len(line) > self.size and (held or len(line) > self.size):
                    if len(line) > self.size or len(files) > self.rotate:
                        counts["dropped_max_file_bytes"] += 1
                        continue
                    out.close()
                    out, held = None, 0
                    counts["rotated"] += 1
                if out is None:
                    files.append(f"{stem}_{len(files)}{SUFFIX}")
                    out = store.open_output_stream(posixpath.join(hidden, f"{context.taskAttemptId()}-{files[-1]}"))
                out.write(line)
                held += len(line)
                counts["written"] += 1
                counts["bytes"] += len(line)
        except BaseException:
            if out is not None:
                out.close()
            for name in files:
                store.delete_file(posixpath.join(hidden, f"{context.taskAttemptId()}-{name}"))
            raise
        if out is not None:
            out.close()
        return Written([f"{context.taskAttemptId()}-{name}" for name in files], dict(counts))

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the files that the tasks told of into place; attempts that did not count are left behind and go."""
        store, root = self._open()
        told = [m for m in messages if m is not None]
        for name in (f for m in told for f in m.files):
            store.move(posixpath.join(self._hidden(root), name), posixpath.join(root, name.split("-", 1)[1]))
        counts = sum((Counter(m.counts) for m in told), Counter())
        store.create_dir(root, recursive=True)
        with store.open_output_stream(posixpath.join(root, f"{COUNTS}_{self.job[:8]}.json")) as out:
            out.write(json.dumps({"files": sum(len(m.files) for m in told), **counts}, sort_keys=True).encode())
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self._hidden(root)).type != fs.FileType.NotFound:
            store.delete_dir(self._hidden(root))
