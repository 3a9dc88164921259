"""Symbols, imports, plugins and checks on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.api import Engine
from graphloom.functions import code as C
from graphloom.operators import communities, imports, integrity, lookup, reports
from graphloom.plugins import Manifest, Plugin, Registry, ordered, summary

TREE = {
    "src/app/__init__.py": "from .store import save\n",
    "src/app/store.py": "def save(x):\n    return x\n",
    "src/tools2/__init__.py": "",
    "src/tools2/run.py": "from app import save\nfrom ..app.store import save as keep\n\ndef go():\n    save(1)\n    keep(2)\n",
    "web/main.js": "import { load } from './lib';\nimport { draw } from './draw.js';\nfunction start() {\n  load();\n  draw();\n}\n",
    "web/lib/index.ts": "export function load() {\n}\n",
    "web/draw.js": "export function draw() {\n}\n",
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_imports_resolve_through_roots_dots_reexports_and_folders(spark, tmp_path):
    for name, source in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(source)
    got = {(r.src, r.dst, r.reason) for r in Engine.build(spark, str(tmp_path)).calls.collect()}
    assert ("function:src/tools2/run.py:go", "function:src/app/store.py:save", "import_resolved") in got
    assert ("function:web/main.js:start", "function:web/lib/index.ts:load", "import_resolved") in got
    assert ("function:web/main.js:start", "function:web/draw.js:draw", "import_resolved") in got


@pytest.mark.parametrize(("module", "importer", "target"), [(".x", "a/b/c.py", "a/b/x.py"), ("..x.y", "a/b/c.py", "a/x/y.py"), (".", "a/b/c.py", "a/b/__init__.py"), ("...x", "a/c.py", None), ("x", "a/c.py", None)])
def test_relative_imports(spark, module, importer, target):
    assert one(spark, imports.relative_target(F.lit(module), F.lit(importer))) == target


@pytest.mark.parametrize(
    ("signature", "want"),
    [
        ("def __init__(self, a: int, b: Dict[str, List[int]] = None, *args, c=(1, 2))", [("a", "int"), ("b", "Dict[str, List[int]]"), ("args", ""), ("c", "")]),
        ("def f()", []),
        ("def f(self)", []),
    ],
)
def test_parameters(spark, signature, want):
    assert [tuple(p) for p in one(spark, C.parameters(F.lit(signature)))] == want


def test_expressions(spark):
    event = lambda x: one(spark, C.is_event(F.lit(x)))
    assert [event(x) for x in ("EventType.TICK", "Event(type=A.B)", "Kind.make(1)", "tick", "", "self.tick")] == [True, True, True, False, False, False]
    assert [one(spark, C.string_literal(F.lit(x))) for x in ("'a'", 'f"/b"', "'''c'''", "x", "")] == ["a", "/b", "c", "", ""]
    assert one(spark, C.first_string_argument(F.lit("get('/x', 1)"))) == "/x" and one(spark, C.first_string_argument(F.lit("get"))) == ""
    assert one(spark, C.callback_refs(F.array(*map(F.lit, (" self.on ", "'t'", "10", "E.UP", "f(x)", "h", "None"))))) == ["self.on", "h"]
    assert [one(spark, C.cross_language_name(F.lit(x))) for x in ("getUser", "GetUser", "get_user", "HTTPClient")] == ["get_user", "get_user", "get_user", "http_client"]
    assert one(spark, C.skips_language(F.lit("a.py"), F.lit("b.tsx"))) and not one(spark, C.skips_language(F.lit("a.py"), F.lit("b.md")))
    assert one(spark, C.path_hint(F.lit("see src/a.py now"), F.lit("a.b"))) == "src/a.py" and one(spark, C.path_hint(F.lit("see"), F.lit("a.b.c"))) == "a.b"
    assert one(spark, C.skipped_by_front_matter(F.lit("---\ntitle: x\nskip_doc_check: true\n---\n"))) and not one(spark, C.skipped_by_front_matter(F.lit("text\nskip_doc_check: true")))
    assert one(spark, C.is_schema_prose(F.lit("the id column"), F.lit("id"), ("id",))) and not one(spark, C.is_schema_prose(F.lit("the id"), F.lit("id"), ("id",)))
    assert one(spark, C.instantiated_classes(F.lit("x = new Foo(1); new Bar (); new Foo()"))) == ["Bar", "Foo"]
    assert one(spark, C.may_be_live_method(F.lit("Foo.run"), F.lit("a.js"), F.array(F.lit("Foo")))) and not one(spark, C.may_be_live_method(F.lit("run"), F.lit("a.js"), F.array(F.lit("Foo"))))
    emit = lambda *bases: one(spark, C.is_handler_emit(F.lit("emit"), F.array(*map(F.lit, bases))))
    assert [emit("logging.Handler"), emit("Base", "my.logging.Handler"), emit("logging.StreamHandler"), emit("BaseHTTPRequestHandler"), emit("x.Handler")] == [True, True, False, False, False]
    assert event("Signal(1).name") and event("a.Kind(1)") == event("kind(1).x")


def test_script_files_and_marks(spark):
    files = spark.createDataFrame([("a.html", "html"), ("b.js", "javascript"), ("c.css", "css")], "path string, language string")
    edges = spark.createDataFrame([("a.html", "b.js"), ("a.html", "c.css"), ("b.js", "b.js")], "src string, dst string")
    assert [r.path for r in lookup.script_files(edges, files).collect()] == ["b.js"]
    marked = lookup.mark(files.withColumnRenamed("path", "id"), spark.createDataFrame([("b.js",), ("b.js",)], "id string"), "is_type_referenced")
    assert {r.id: r.is_type_referenced for r in marked.collect()} == {"a.html": False, "b.js": True, "c.css": False}
    assert lookup.capped(files, None, [F.col("path")]).count() == 3 and lookup.capped(files, 2, [F.col("path")]).count() == 2


def test_integrity_names_each_violation(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    pairs = lambda *x: spark.createDataFrame(list(x), "src string, dst string")
    nodes = {"file": ids("f", "f"), "function": ids("a", "b"), "class": ids("c"), "community": ids("m")}
    edges = {"defines": pairs(("f", "a"), ("c", "b")), "imports": pairs(("f", "f")), "member_of": pairs(("a", "m")), "calls": pairs(("a", "b"), ("a", "gone"))}
    stats = spark.createDataFrame([("function", 2), ("class", 5)], "table string, n long")
    got = sorted(tuple(r) for r in integrity.run_checks(nodes, edges, stats).collect())
    assert got == [("Q1", "file f"), ("Q2", "defines 1 of 2"), ("Q5", "a -> gone"), ("Q6", "class 5, counted 1")]


def test_labels_settle(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.9), (4, 5, 0.9), (3, 5, 0.9)], "src long, dst long, confidence double")
    labels = {r.id: r.community for r in communities.label_propagation(edges).collect()}
    assert labels[1] == labels[2] and labels[3] == labels[4] == labels[5] != labels[1]
    with pytest.raises(RuntimeError):
        communities.label_propagation(edges, rounds=1)


def test_reports(spark):
    assert one(spark, reports.isolation_bucket(F.lit("/x/my_app/Utils/a.py"))) == "Utils" and one(spark, reports.isolation_bucket(F.lit("a/b_c/c.py"))) == "B C"
    names = {"src/advisor/engine.py": "Advisor", "app/x.py": "X.Py", "tests/phase_2/test_risk.py": "Tests · Phase 2", "tests/t.py": "Tests", "scripts\\training\\run.py": "Scripts · Training", "script/a.py": "Scripts", "a/my_app-v2/x": "My App-V2", "main.py": "Main.Py", "": "Unknown"}
    assert {p: one(spark, reports.package_label(F.lit(p))) for p in names} == names
    assert one(spark, reports.report_warnings(F.lit(1), F.lit(3), F.lit(False))) == ["pathways_truncated_1_of_3", "health_not_ok"]
    seen = spark.createDataFrame([("traces",), ("traces",)], "input string")
    assert {(r.input, r.present, r.n) for r in reports.readiness(seen, ["traces", "coverage"]).collect()} == {("traces", True, 2), ("coverage", False, 0)}


def test_plugins_keep_their_wishes_and_survive_failures():
    made = lambda i, **k: Plugin(Manifest(i, "exporter", hooks=("on_export",), **k), lambda hook, **a: (i, a["x"]))
    a, b, c = made("a", order=5), made("b", order=1, after=("a",)), made("c", order=9, before=("a",))
    assert [p.manifest.id for p in ordered([a, b, c])] == ["c", "a", "b"]
    assert [p.manifest.id for p in ordered([made("x", after=("y",)), made("y", order=1, after=("x",))])] == ["y", "x"]
    registry = Registry()
    for p in (a, b):
        registry.register(p.manifest, p.run)
    registry.register(Manifest("bad", "exporter", hooks=("on_export",), order=2), lambda **k: 1 / 0)
    out = registry.sequence(x=3)
    assert [(o.plugin, o.value) for o in out if not o.error] == [("a", ("a", 3)), ("b", ("b", 3))]
    assert summary(out)["failed"] == ["bad"] and "ZeroDivisionError" in summary(out)["error"]
    with pytest.raises(ValueError):
        registry.register(a.manifest, a.run)
    with pytest.raises(ValueError):
        Manifest("z", "unknown")
