"""A small source tree, from files to answers."""

from __future__ import annotations

import pytest

from graphloom.api import Engine

FILES = {
    "app/main.py": "from app.store import save\n\nclass Service:\n    def run(self):\n        self.check()\n        save(1)\n    def check(self):\n        return True\n\nService().run()\n",
    "app/store.py": "def save(x):\n    return _write(x)\n\ndef _write(x):\n    return x\n",
    "web/app.js": "import { load } from './x';\nfunction start() {\n  load();\n  render();\n}\nconst render = () => { };\nstart();\n",
    "app/broken.py": "def (:\n",
    "node_modules/skip.js": "function no() {}\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, source in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(source)
    built = Engine.build(spark, str(root))
    built.root = root
    return built


def test_calls(engine):
    got = {(r.src, r.dst, r.reason) for r in engine.calls.collect()}
    assert ("function:app/main.py:Service.run", "function:app/main.py:Service.check", "method_call") in got
    assert ("function:app/main.py:Service.run", "function:app/store.py:save", "import_resolved") in got
    assert ("function:app/store.py:save", "function:app/store.py:_write", "direct_call") in got
    assert ("function:web/app.js:start", "function:web/app.js:render", "direct_call") in got


def test_answers(engine):
    assert {r.id for r in engine.dependents("_write").collect()} == {"function:app/store.py:save", "function:app/main.py:Service.run"}
    assert engine.search("save").first().id == "function:app/store.py:save"
    assert engine.entry_points().count() > 0
    assert {r["table"]: r["rows"] for r in engine.status().collect()}["file"] == 4
    assert engine.query("SELECT count(*) AS n FROM calls").first().n == engine.calls.count()
    with pytest.raises(PermissionError):
        engine.query("DROP TABLE calls")


def test_sync_tells_changes(engine):
    (engine.root / "app/store.py").write_text(FILES["app/store.py"] + "\n")
    changes = engine.sync(str(engine.root))
    assert [(r.path, r.change) for r in changes.collect()] == [("app/store.py", "changed")]


def test_values_flow_through_matched_calls(spark, tmp_path):
    source = """from lib import same as twin

def one(a):
    x = twin(a)
    return x

def two(b):
    y = twin(v=b)
    z = y + 1
    return z
"""
    (tmp_path / "main.py").write_text(source)
    (tmp_path / "lib.py").write_text("def same(v):\n    w = v\n    return w\n")
    engine = Engine.build(spark, str(tmp_path))
    name = lambda path, f, v: f"variable:{path}:{f}:{v}"
    assert {(r.src, r.dst) for r in engine.flows().collect()} == {(name("main.py", "one", "a"), name("lib.py", "same", "v")), (name("main.py", "two", "b"), name("lib.py", "same", "v"))}
    got = {r.id for r in engine.value_trace(name("main.py", "one", "a")).collect()}
    inside = {name("lib.py", "same", v) for v in ("v", "w", "<return>")}
    assert got == inside | {name("main.py", "one", v) for v in ("a", "x", "<return>")}  # and nothing of two
    found, touching = engine.trace_variable("v")
    assert [r.id for r in found.collect()] == [name("lib.py", "same", "v")] and touching.count() == 2
    assert {r.label: r.members for r in engine.communities().collect()} == {"Lib.Py": 3} or engine.communities().count() == 1
