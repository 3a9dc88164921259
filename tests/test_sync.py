"""An incremental sync does what a full build does, and less."""

from __future__ import annotations

import pytest

from graphloom.store import Store

TREE = {
    "pkg/a.py": "from pkg.b import helper as h\nfrom pkg.gone import old\n\ndef main():\n    h()\n    shared()\n    old()\n",
    "pkg/b.py": "def helper():\n    return inner()\n\ndef inner():\n    return 1\n",
    "pkg/c.py": "def shared():\n    return 2\n\nclass Box:\n    def open(self):\n        return shared()\n",
    "pkg/d.py": "def alone():\n    return 3\n",
    "pkg/e.py": "import pkg.d\n\ndef uses():\n    pkg.d.alone()\n    late()\n",
    "web/x.js": "import { load } from './y';\nfunction start() {\n  load();\n}\n",
    "web/y.js": "export function load() {\n}\n",
}


def put(root, files):
    for name, source in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        if source is None:
            path.unlink()
        else:
            path.write_text(source)


def tables(store: Store) -> dict:
    return {t: sorted(map(repr, store.read(t).drop("bucket").collect())) for t in ("files", "parsed", "imports", "calls")}


def calls(store: Store) -> set:
    return {(r.src.split(":", 1)[1], r.dst.split(":", 1)[1]) for r in store.read("calls").collect()}


STEPS = [
    # a changed body: its callers, and who imports it, are resolved again
    ({"pkg/b.py": TREE["pkg/b.py"].replace("return 1", "return 5")}, 1, {"pkg/a.py", "pkg/b.py"}),
    # a new file makes an import and a call by name resolve
    ({"pkg/gone.py": "def old():\n    pass\n\ndef late():\n    pass\n"}, 1, {"pkg/gone.py", "pkg/a.py", "pkg/e.py"}),
    # removed and added again elsewhere: calls move along
    ({"pkg/c.py": None, "pkg/z.py": "def shared():\n    return 7\n"}, 1, {"pkg/a.py", "pkg/z.py"}),
    # nothing parses: its calls go
    ({"pkg/e.py": "def (:\n"}, 1, {"pkg/e.py"}),
]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    root, folder = tmp_path_factory.mktemp("tree"), tmp_path_factory.mktemp("store")
    put(root, TREE)
    store = Store(spark, str(folder), buckets=4)
    first = store.sync(str(root))
    assert (first.parsed, first.resolved) == (7, 7)
    assert calls(store) == {("pkg/a.py:main", "pkg/b.py:helper"), ("pkg/a.py:main", "pkg/c.py:shared"), ("pkg/b.py:helper", "pkg/b.py:inner"), ("pkg/c.py:Box.open", "pkg/c.py:shared"), ("pkg/e.py:uses", "pkg/d.py:alone"), ("web/x.js:start", "web/y.js:load")}
    again = store.sync(str(root))
    assert (again.parsed, again.resolved) == (0, 0) and again.changes.isEmpty()
    return root, store


@pytest.mark.parametrize("step", range(len(STEPS)))
def test_a_sync_equals_a_full_build(spark, kept, tmp_path, step):
    root, store = kept
    files, parsed, resolved = STEPS[step]
    put(root, files)
    done = store.sync(str(root))
    assert (done.parsed, done.resolved) == (parsed, len(resolved))
    full = Store(spark, str(tmp_path / "full"), buckets=4)
    full.sync(str(root))
    assert tables(store) == tables(full)


def test_only_touched_folders_are_written(spark, kept):
    root, store = kept
    from pathlib import Path

    stamp = lambda: {p.relative_to(store.folder): p.stat().st_mtime_ns for p in Path(store.folder).rglob("*.parquet") if "pending" not in str(p)}
    before = stamp()
    put(root, {"pkg/d.py": "def alone():\n    return 4\n"})
    store.sync(str(root))
    after = stamp()
    changed = {p.parts[:2] for p in before.keys() ^ after.keys()}
    assert changed and len({b for _, b in changed}) < 4 and before.keys() & after.keys()


def test_a_sync_that_broke_off_is_done_again(spark, kept, tmp_path, monkeypatch):
    """It breaks before the hashes are written, when the old names of a file are gone already."""
    root, store = kept
    put(root, {"pkg/z.py": "def other():\n    return 7\n"})
    replace = Store._replace
    monkeypatch.setattr(Store, "_replace", lambda self, table, rows, paths: replace(self, table, rows, paths) if table in ("parsed",) else (_ for _ in ()).throw(OSError("lost")) if table == "files" else [])
    with pytest.raises(OSError):
        store.sync(str(root))
    monkeypatch.undo()
    assert store.sync(str(root)).resolved >= 2
    full = Store(spark, str(tmp_path / "full"), buckets=4)
    full.sync(str(root))
    assert tables(store) == tables(full)


def test_ignore_files_of_the_tree(spark, tmp_path):
    from graphloom.sources import tree

    put(tmp_path, {".gitignore": "# out\n*.js\n!keep.js\ngen/\n", **dict.fromkeys(("a.py", "x.js", "sub/keep.js", "gen/b.py", "sub/only.py", "sub/deep/only.py"), "x\n")})
    assert {r.path for r in tree.scan_files(spark, str(tmp_path)).collect()} == {"a.py", "sub/keep.js", "sub/only.py", "sub/deep/only.py"}
    lines = spark.createDataFrame([("", 0, "*.js"), ("sub", 0, "/only.py")], "folder string, line_no int, line string")
    assert {r.path for r in tree.scan_files(spark, str(tmp_path), ignore=lines).collect()} == {"a.py", "gen/b.py", "sub/deep/only.py"}
