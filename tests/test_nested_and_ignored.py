"""Recursive JSON values and ignore rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import ignore, nested


def walk(value, path="$", key=None):
    if isinstance(value, dict | list):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from walk(v, f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", str(k))
    else:
        yield path, key, None if value is None else value if isinstance(value, str) else json.dumps(value)


def drawn(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind >= 4:
        return {f"k{i}": drawn(rng, depth - 1) for i in range(rng.randrange(4))} if kind == 4 else [drawn(rng, depth - 1) for _ in range(rng.randrange(3))]
    return (rng.randrange(99), rng.choice(["x", "", "é"]), None, rng.random() < 0.5)[kind]


def test_scalars_of_any_depth(spark):
    rng = random.Random(3)
    deep = "end"
    for i in range(30):
        deep = {"a": deep} if i % 2 else [deep]
    values = [{"k": drawn(rng, 5)} for _ in range(60)] + [deep, 7, "top", None, {}, []]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{broken"), (902, ""), (0, json.dumps(values[0]))]
    got = sorted(map(str, (tuple(r) for r in nested.scalars(spark.createDataFrame(rows, "id long, j string"), ["id"], F.col("j")).select("id", "path", "key", "value").collect())))
    assert got == sorted(map(str, ((i, *x) for i, v in [*enumerate(values), (0, values[0])] for x in walk(v))))
    assert any(p.count("[") == 15 for p in got)
    assert nested.scalars(spark.createDataFrame([], "id long, j string"), ["id"], F.col("j")).collect() == []


def test_collected_by_key(spark):
    rows = [(1, json.dumps({"route": "/a", "url": "b", "x": [{"path": "/c", "handler": "h"}, {"file": "f.py", "handler": "h"}], "module": 3, "symbol": ""}))]
    values = nested.scalars(spark.createDataFrame(rows, "id long, j string"), ["id"], F.col("j"))
    assert {(r.what, r.value) for r in nested.collected(values, ["id"]).collect()} == {("route", "/a"), ("route", "/c"), ("symbol", "h"), ("file", "f.py")}


CASES = [
    (["*.log"], {"a.log": 1, "d/b.log": 1, "a.logs": 0}),
    (["/a.txt"], {"a.txt": 1, "d/a.txt": 0}),
    (["d/a.txt"], {"d/a.txt": 1, "x/d/a.txt": 0}),  # a slash inside ties it to the folder
    (["build/"], {"build/x": 1, "s/build/x/y": 1, "build": 0}),  # a file of that name stays
    (["*.py", "!keep.py"], {"a.py": 1, "d/keep.py": 0}),
    (["!keep.py", "*.py"], {"keep.py": 1}),  # the last one decides
    (["d/", "!d/keep.py"], {"d/keep.py": 1}),  # a folder that is out is not entered
    (["d/*", "!d/keep.py"], {"d/keep.py": 0, "d/a/b": 1}),
    (["a/**/b"], {"a/b": 1, "a/x/b": 1, "a/x/y/b": 1, "a/xb": 0}),
    (["**/foo"], {"foo": 1, "x/foo": 1, "x/foo/y": 1}),
    (["abc/**"], {"abc/x": 1, "abc/x/y": 1, "abc": 0}),
    (["?.c", "[a-c]x", "[!a-c]y"], {"a.c": 1, "ab.c": 0, "bx": 1, "dx": 0, "dy": 1, "ay": 0}),
    (["# note", "\\#x", "\\!y", "z\\ ", "w  ", ""], {"#x": 1, "!y": 1, "z ": 1, "w": 1, "note": 0}),
    (["a+b(1).$"], {"a+b(1).$": 1, "aab1x": 0}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_rules(case):
    """Without Spark: each pattern of a root file, the last that matches a part decides."""
    import re

    lines, wanted = CASES[case]
    told = [r for r in map(ignore.rule_of, lines) if r]
    for path, out in wanted.items():
        parts = path.split("/")
        gone = False
        for n in range(1, len(parts) + 1):
            hits = [negated for negated, folders, regex in told if (n < len(parts) or not folders) and re.search(regex, "/".join(parts[:n]))]
            gone = gone or bool(hits) and not hits[-1]
        assert gone == bool(out), path


def test_ignored_files_with_nested_rules(spark):
    rows = [(str(i), n, line) for i, (lines, _) in enumerate(CASES) for n, line in enumerate(lines)] + [("", 0, "*.tmp"), ("in", 0, "!b.tmp"), ("in", 1, "/only"), ("in/deep", 0, "b.tmp")]
    paths = [(f"{i}/{p}", out) for i, (_, wanted) in enumerate(CASES) for p, out in wanted.items()]
    paths += [("a.tmp", 1), ("in/a.tmp", 1), ("in/b.tmp", 0), ("in/x/b.tmp", 0), ("in/deep/b.tmp", 1), ("in/only", 1), ("in/x/only", 0), ("only", 0)]
    files = spark.createDataFrame([(p,) for p, _ in paths] + [paths[0][:1]], "path string")
    told = ignore.rules(spark.createDataFrame(rows, "folder string, line_no int, line string"))
    assert {r.path for r in ignore.ignored(files, told).collect()} == {p for p, out in paths if out}
    assert ignore.ignored(files.limit(0), told).collect() == []
