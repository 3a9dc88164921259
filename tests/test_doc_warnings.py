"""Warnings about symbols that documents name."""

from __future__ import annotations

from graphloom.operators import doc_warnings as D

DOC = """---
title: x
---
# Guide
Call `save_all` and `Store.open` from `other.store.open`.
`no` `True` `not an identifier` `gone.thing` `unknown_name` `a1`

```
fenced `Store.open` in wrong.py
```
Use `load` in app/store.py, or `load` in wrong.py.

The `status` column of wrong.py holds text.
<!-- examples-only -->

Example: `load` in wrong.py
still `load` in wrong.py
<!-- examples-only -->

After: `load` in wrong.py
<!-- examples-only -->
```py
`load` in wrong.py
```
behind `load` in wrong.py
"""


def frames(spark, docs):
    symbols = [("save_all", "save_all", "app/main.py"), ("open", "Store.open", "app/store.py"), ("open", "other.store.open", "other/store.py"), ("load", "load", "app/store.py"), ("load", "load", "app/io.py"), ("status", "status", "app/s.py")]
    return spark.createDataFrame(docs, "path string, text string"), spark.createDataFrame(symbols, "name string, qualified_name string, file_path string")


def told(df):
    return sorted((r.path, r.line_number, r.symbol, r.kind, r.severity) for r in df.collect())


def test_warnings_by_line(spark):
    docs, symbols = frames(spark, [("g.md", DOC), ("skip.md", "---\nskip_doc_check: true\n---\n`load` in wrong.py\n"), ("null.md", None), ("e.md", "")])
    wrong = [("g.md", n, "load", "moved_reference", "high") for n in (11, 20, 25)]
    # the second of two mentions on line 11 shares the line's first path; one place, one warning
    assert told(D.warnings(docs, symbols)) == sorted([("g.md", 5, "Store.open", "moved_reference", "high"), *wrong[1:]])
    unknown = [("g.md", 6, "gone.thing", "unknown_reference", "medium")]
    assert told(D.warnings(docs, symbols, flag_unknown=True)) == sorted([("g.md", 5, "Store.open", "moved_reference", "high"), *wrong[1:], *unknown])
    assert ("g.md", 9, "Store.open", "moved_reference", "high") in told(D.warnings(docs, symbols, fenced=True))
    assert told(D.warnings(docs.limit(0), symbols)) == []
    ids = [r.id for r in D.warnings(docs, symbols).collect()]
    assert len(set(ids)) == len(ids) and all(len(i) == 24 for i in ids)


def test_states_of_lines(spark):
    docs, _ = frames(spark, [("a", "```\nx\n```\ny\r\n```\nopen"), ("b", f"{D.EXAMPLES}\n\n\np\nq {D.EXAMPLES}\n\nr")])
    rows = {(r.path, r.line_number): (r.fenced, r.example) for r in D.lines_of(docs).collect()}
    assert [rows["a", n][0] for n in range(1, 7)] == [False, True, True, False, False, True]
    assert [rows["b", n][1] for n in range(1, 8)] == [False, False, False, True, True, False, False]  # a mark inside a block marks nothing


def test_doc_index(spark):
    files = [("docs/b.md", "# Title #\nx"), ("docs/a.md", ""), ("doc/z.md", "  ## Zed  "), ("docs/c.txt", "no"), ("src/d.md", "no"), ("documentation/x/y.md", None)]
    got = [tuple(r) for r in D.doc_index(spark.createDataFrame(files, "path string, text string"), 3).collect()]
    assert got == [("docs/a.md", "a.md"), ("docs/b.md", "Title #"), ("doc/z.md", "Zed")]
