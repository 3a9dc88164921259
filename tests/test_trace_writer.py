"""The bounded trace writer: bounds, rotation, drop counts, and nothing left by what fails."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.sources.trace_writer import BoundedTraces


@pytest.fixture(scope="module")
def records(spark):
    spark.dataSource.register(BoundedTraces)
    return spark.range(0, 100, 1, 2).select(F.format_string("f%03d", "id").alias("fn"), F.lit("call").alias("kind"))


def saved(records, path, **options):
    writer = records.write.format("bounded_traces").option("path", str(path)).mode("append")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()
    files = sorted(Path(path).glob("*.jsonl"))
    counts = [json.loads(p.read_text()) for p in Path(path).glob("_counts*.json")]
    return files, counts, [json.loads(line) for f in files for line in f.read_text().splitlines()]


LINE = len('{"fn":"f000","kind":"call"}\n')


def test_all_without_bounds_and_again(records, tmp_path):
    files, counts, lines = saved(records, tmp_path / "a")
    assert len(files) == 2 and sorted(x["fn"] for x in lines) == [f"f{i:03d}" for i in range(100)]
    assert counts == [{"bytes": 100 * LINE, "files": 2, "written": 100}]
    files, counts, lines = saved(records, tmp_path / "a")
    assert len(files) == 4 and len(lines) == 200 and len(counts) == 2
    assert not list((tmp_path / "a").glob("_job*"))


def test_bounds_and_reasons(records, tmp_path):
    files, counts, lines = saved(records, tmp_path / "b", max_records=10)
    assert len(lines) == 20 and counts[0]["dropped_max_records"] == 80
    # two files of ten lines a task, the rest of its fifty goes
    files, counts, lines = saved(records, tmp_path / "c", max_file_bytes=10 * LINE, rotate_files=1)
    assert len(files) == 4 and len(lines) == 40 and all(f.stat().st_size <= 10 * LINE for f in files)
    assert counts[0] == {"bytes": 40 * LINE, "dropped_max_file_bytes": 60, "files": 4, "rotated": 2, "written": 40}
    # a line that fits no file is dropped, those that follow it are not
    long = records.limit(3).withColumn("fn", F.when(F.col("fn") == "f001", F.repeat("fn", 99)).otherwise(F.col("fn"))).coalesce(1)
    files, counts, lines = saved(long, tmp_path / "d", max_file_bytes=3 * LINE)
    assert [x["fn"] for x in lines] == ["f000", "f002"] and counts[0]["dropped_max_file_bytes"] == 1
    files, counts, lines = saved(records.limit(0), tmp_path / "e")
    assert not files and counts == [{"files": 0}]


def test_a_failed_task_leaves_nothing(records, tmp_path):
    with pytest.raises(Exception, match="lost"):
        saved(records.withColumn("x", F.when(F.col("fn") == "f077", F.raise_error(F.lit("lost"))).otherwise(F.lit(1))), tmp_path / "f")
    assert not [p for p in (tmp_path / "f").rglob("*") if p.is_file()] and not list((tmp_path / "f").glob("_job*"))
    with pytest.raises(Exception, match="appended"):
        records.write.format("bounded_traces").option("path", str(tmp_path / "g")).mode("overwrite").save()
