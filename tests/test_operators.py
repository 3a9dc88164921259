"""Small cases of operators that the driver's tables do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import resolve, state
from graphloom.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_paths(spark):
    assert one(spark, paths.resolve_dots(F.lit("a/./b/../c.py"))) == "a/c.py"
    assert one(spark, paths.language_of(F.lit("src/App.TSX"))) == "typescript"
    assert one(spark, paths.directory_key(F.lit("a/b/c.py"), 2)) == "a/b"
    assert one(spark, paths.directory_key(F.lit("c.py"), 1)) == ""
    assert one(spark, paths.classify_path(F.lit("src/vendor/requests/api.py"), ["requests"])) == "vendor"


def test_text(spark):
    assert one(spark, text.unquote(F.lit("rb'x y'"))) == "x y"
    assert one(spark, text.unquote(F.lit("name"))) is None
    assert one(spark, text.normalise_identifier(F.lit("A::b#c()"))) == "A.b.c"
    assert one(spark, text.similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, text.lines_hash(F.lit("a\nb\nc"), F.lit(2), F.lit(3))) == one(spark, F.sha2(F.lit("b\nc"), 256))


def test_calls_resolve_by_tiers(spark):
    symbols = spark.createDataFrame(
        [("f1", "save", "save", "a.py"), ("f2", "save", "Store.save", "b.py"), ("f3", "load", "load", "b.py"), ("f4", "get", "Cache.get", "c.py"), ("f5", "helper", "helper", "tests/x.py"), ("f6", "helper", "helper", "src/y.py")],
        "id string, name string, qualified_name string, file_path string",
    )
    sites = spark.createDataFrame(
        [(1, "m", "a.py", "save", 1), (2, "m", "a.py", "load", 2), (3, "m", "a.py", "s.save", 3), (4, "m", "a.py", "d.get", 4), (5, "m", "a.py", "helper", 5), (6, "m", "a.py", "nothing", 6)],
        "site long, caller string, file_path string, callee string, line long",
    )
    imports = spark.createDataFrame([("a.py", "load", "b.py", None)], "file_path string, name string, resolved_path string, original string")
    typed = spark.createDataFrame([("a.py", "s", "Store")], "file_path string, name string, class_name string")
    got = {r.site: (r.callee, r.confidence, r.reason) for r in resolve.resolve_calls(sites, symbols, imports, typed).collect()}
    assert got == {1: ("f1", 1.0, "direct_call"), 2: ("f3", 0.9, "import_resolved"), 3: ("f2", 0.7, "typed_local"), 5: ("f6", 0.3, "fuzzy")}


def test_observation_holds_for_one_body(spark):
    old = spark.createDataFrame([("a", True, 3, "h1"), ("b", True, 4, "h2")], "id string, runtime_observed boolean, runtime_calls long, runtime_for_hash string")
    new = spark.createDataFrame([("a", "h1", False, 0, None), ("b", "h9", False, 0, None)], "id string, source_hash string, runtime_observed boolean, runtime_calls long, runtime_for_hash string")
    got = {r.id: (r.runtime_observed, r.runtime_calls) for r in state.keep_observation(old, new).collect()}
    assert got == {"a": (True, 3), "b": (False, 0)}


def test_stale_artifacts(spark):
    artifacts = spark.createDataFrame([("x", {"a": "1"}), ("y", {"a": "1", "b": "2"}), ("z", {"gone": "1"})], "name string, sources map<string,string>")
    current = spark.createDataFrame([("a", "1"), ("b", "3")], "path string, source_hash string")
    assert sorted(r.name for r in state.stale_artifacts(artifacts, current).collect()) == ["y", "z"]


def test_streamed_observations(spark, tmp_path):
    schema = "function_id string, source_hash string"
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("f", "h1"), ("f", "h1"), ("g", "h1")], schema).coalesce(1).write.json(str(source / "1"))
    spark.createDataFrame([("f", "h2")], schema).coalesce(1).write.json(str(source / "2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source / "*"))
    seen = sessions.observations(stream).writeStream.outputMode("update").format("memory").queryName("seen").option("checkpointLocation", str(out)).trigger(availableNow=True).start()
    seen.awaitTermination(120)
    rows = [(r.function_id, r.calls, r.source_hash) for r in spark.table("seen").collect()]
    assert ("g", 1, "h1") in rows and ("f", 2, "h1") in rows


def test_streamed_upserts(spark, tmp_path):
    schema = "id long, name string, _order long"
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).coalesce(1).write.json(str(source / "1"))
    changes = spark.readStream.schema(schema).json(str(source / "*"))
    query = sessions.upsert_stream(changes, f"file://{tmp_path}/table", ["id"], str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert {(r.id, r.name) for r in spark.read.parquet(f"{tmp_path}/table/v=0").collect()} == {(1, "b"), (2, "c")}


def test_text_functions_on_small_texts(spark):
    html = [
        "<button onclick=\"save()\">x</button><a onClick='return go(1)'>y</a><script>el.addEventListener('click', open_menu)</script>",
        '<script src="js/app.js?v=2"></script><script type="module" src="m.js"></script><script src="https://cdn.example.com/x.js"></script><script src="./lib/b.js#x"></script>',
        "<p>nothing</p>",
    ]
    told = [(one(spark, text.html_handlers(F.lit(h))), one(spark, text.script_sources(F.lit(h)))) for h in html]
    assert told == [(["go", "open_menu", "save"], []), ([], ["./lib/b.js", "js/app.js"]), ([], [])]
    assert [one(spark, text.backtick_tokens(F.lit(x))) for x in ("Call `save_all()` and `Store.open`.", "no `1x` token")] == [["save_all", "Store.open"], []]
    names = {"handleSubmitOrder": ("LiveBroker.handle_submit", "handle_submit_order", "live_broker_submitorder_flow"), "on_open": ("on_open", "on_open", "open_flow"), "HTTPServer": ("net.HTTPServer", "http_server", "net_httpserver_flow"), "run_all_flow": ("Jobs.run_all_flow", "run_all_flow", "jobs_all_flow")}
    assert {n: (q, one(spark, text.camel_to_snake(F.lit(n))), one(spark, text.pathway_name(F.lit(n), F.lit(q)))) for n, (q, _, _) in names.items()} == names
