"""Queries over symbols, expressions, imports, lookups, integrity and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import code as C
from graphloom.operators import imports as I
from graphloom.operators import integrity as Q
from graphloom.operators import lookup as L
from graphloom.operators import reports as R
from graphloom.plans.registry import CALLS, FUNCTIONS, Catalogue
from graphloom.plans.shared import cut
from graphloom.sources import projection as P

CATALOGUE = Catalogue()
query = CATALOGUE.query

# Parts as files of source trees: the words of a type are directories, the language follows the size.
FILES = """files AS (
  SELECT p_partkey AS id, replace(lower(p_type), ' ', '/') || '/' || replace(lower(p_name), ' ', '_') || CASE p_size % 4 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '.js' WHEN 2 THEN '/index.ts' ELSE '.py' END AS path,
    p_name AS name, p_size AS size FROM part)"""


def files(spark, sf_dir):
    end = F.when(F.col("p_size") % 4 == 0, "/__init__.py").when(F.col("p_size") % 4 == 1, ".js").when(F.col("p_size") % 4 == 2, "/index.ts").otherwise(".py")
    part = P.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.lit("/"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), end).alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))


# --- lookups


@query(f"WITH {FUNCTIONS} SELECT id, name, qualified_name FROM fn WHERE file_path IN (SELECT file_path FROM fn WHERE id <= 5)")
def functions_in_files(spark, sf_dir):
    fn = P.functions(spark, sf_dir)
    return L.among(fn, "file_path", fn.where("id <= 5")).select("id", "name", "qualified_name")


@query(f"WITH {FUNCTIONS} SELECT id, name FROM fn WHERE module = (SELECT min(module) FROM fn)")
def functions_by_layer(spark, sf_dir):
    fn = P.functions(spark, sf_dir)
    return fn.where(F.col("module") == fn.agg(F.min("module")).scalar()).select("id", "name")


@query(f"WITH {FUNCTIONS} SELECT id, name FROM fn WHERE id = 7")
def function_by_id(spark, sf_dir):
    return L.by_value(P.functions(spark, sf_dir), "id", 7).select("id", "name")


@query("SELECT l_orderkey AS function_id, l_linenumber AS line_number, l_suppkey AS file FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000)")
def variables_outside_files(spark, sf_dir):
    variables = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").alias("line_number"), F.col("l_suppkey").alias("file"))
    return L.outside(variables, "file", P.table(spark, sf_dir, "supplier").where("s_acctbal < 5000"), "s_suppkey")


@query("SELECT function_id, name, min(id) FILTER (WHERE line_number = first) AS id, min(line_number) AS line_number FROM (SELECT l_suppkey AS function_id, l_shipdate::DATE::VARCHAR AS name, l_orderkey AS id, l_linenumber AS line_number, min(l_linenumber) OVER (PARTITION BY l_suppkey, l_shipdate::DATE::VARCHAR) AS first FROM lineitem) GROUP BY function_id, name")
def scope_variables(spark, sf_dir):
    variables = P.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("function_id"), F.to_date("l_shipdate").cast("string").alias("name"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line_number"))
    return L.first_variable(variables).select("function_id", "name", "id", "line_number")


@query("SELECT p_partkey AS id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'GET' ELSE 'POST' END AS http_method FROM part WHERE p_size % 3 < 2 AND p_size % 5 > 0")
def http_endpoints(spark, sf_dir):
    method = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 3 == 0, "GET").when(F.col("p_size") % 3 == 1, "POST")
    return L.endpoints(P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), method.alias("http_method")))


@query(f"WITH {CALLS}, {FUNCTIONS} SELECT c.src, fn.id, fn.name, 'http' AS edge_type FROM calls c JOIN fn ON fn.id = c.dst WHERE c.reason = 'import_resolved'")
def http_callees(spark, sf_dir):
    return L.http_callees(P.calls(spark, sf_dir).where("reason = 'import_resolved'"), P.functions(spark, sf_dir))


@query("""WITH p AS (SELECT 'pathway:' || p_partkey AS id, p_name AS name, p_type AS display_name FROM part), t AS (
  SELECT name AS term FROM p WHERE id IN ('pathway:3', 'pathway:11') UNION SELECT display_name FROM p WHERE id = 'pathway:5' UNION SELECT 'pathway:9' UNION SELECT 'pathway:' UNION SELECT upper(substr(name, 2, 3)) FROM p WHERE id = 'pathway:17' UNION SELECT 'no such one'),
h AS (SELECT term, id, CASE WHEN name = term THEN 0 WHEN display_name = term THEN 1 WHEN id = term THEN 2 ELSE 3 END AS tier, length(name) AS n, name FROM t JOIN p ON name = term OR display_name = term OR id = term OR contains(lower(name), lower(term)))
SELECT term, id, tier FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tier, n, name, id) AS k FROM h) WHERE k = 1""")
def pathway_lookup(spark, sf_dir):
    part = P.table(spark, sf_dir, "part")
    p = part.select(F.concat(F.lit("pathway:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("display_name"))
    some = lambda i: p.where(F.col("id") == f"pathway:{i}")
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, ("pathway:9", "pathway:", "no such one")))).alias("term"))
    terms = p.where(F.col("id").isin("pathway:3", "pathway:11")).select(F.col("name").alias("term")).unionByName(some(5).select(F.col("display_name").alias("term")))
    terms = terms.unionByName(some(17).select(F.upper(F.substring("name", 2, 3)).alias("term"))).unionByName(fixed).distinct()
    return L.pathway_cascade(p, terms)


@query("SELECT c_custkey AS id, c_acctbal / 10000 AS confidence FROM customer WHERE c_acctbal / 10000 >= 0.5 AND c_mktsegment <> 'BUILDING'")
def confident_pathways(spark, sf_dir):
    pathways = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("confidence"), (F.col("c_mktsegment") == "BUILDING").alias("is_test"))
    return L.confident_pathways(pathways, 0.5).select("id", "confidence")


@query(f"""WITH {CALLS}, {FUNCTIONS}, i AS (SELECT dst AS id, count(*) AS n_callers, list_slice(list_sort(list(DISTINCT src)), 1, 5) AS callers FROM calls GROUP BY dst),
o AS (SELECT src AS id, count(*) AS n_callees, list_slice(list_sort(list(DISTINCT dst)), 1, 5) AS callees FROM calls GROUP BY src)
SELECT fn.id, fn.name, coalesce(n_callers, 0) AS n_callers, array_to_string(callers, ',') AS callers, coalesce(n_callees, 0) AS n_callees, array_to_string(callees, ',') AS callees FROM fn LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def node_details(spark, sf_dir):
    told = L.node_details(P.functions(spark, sf_dir), cut(P.calls(spark, sf_dir).select("src", "dst"), "calls"))
    few = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return told.select("id", "name", "n_callers", few("callers"), "n_callees", few("callees"))


@query(f"WITH {CALLS}, {FUNCTIONS} SELECT DISTINCT file_path FROM fn WHERE id IN (SELECT dst FROM calls)")
def files_with_called_methods(spark, sf_dir):
    return L.files_with_called_methods(P.functions(spark, sf_dir), P.calls(spark, sf_dir))


@query("""WITH u AS (SELECT lower(p_type) AS f, w AS name FROM part, unnest(string_split(p_type, ' ')) AS t(w)), c AS (SELECT DISTINCT lower(p_type) AS f, string_split(p_type, ' ')[1] AS name FROM part), k AS (SELECT f, name, f || ':' || name AS class_id FROM c),
n AS (SELECT k.class_id FROM u JOIN k ON u.f = k.f AND u.name = k.name), r AS (SELECT k.class_id FROM u JOIN k ON u.name = k.name WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.f = u.f AND x.name = u.name))
SELECT class_id, count(*) AS uses FROM (SELECT * FROM n UNION ALL SELECT * FROM r) GROUP BY class_id""")
def type_references(spark, sf_dir):
    part = P.table(spark, sf_dir, "part")
    classes = part.select(F.lower("p_type").alias("file_path"), F.split("p_type", " ")[0].alias("name")).distinct().withColumn("id", F.concat("file_path", F.lit(":"), "name"))
    return L.type_references(part.select(F.lower("p_type").alias("file_path"), F.split("p_type", " ").alias("names")), classes)


@query("""WITH s AS (SELECT l_partkey AS src, l_suppkey AS dst, l_linenumber AS line, l_orderkey AS site FROM lineitem), e AS (SELECT ps.src, ps.dst, max(line) AS line FROM s ps GROUP BY 1, 2 UNION ALL SELECT src, dst, 99 FROM s GROUP BY 1, 2)
SELECT e.src, e.dst, e.line, coalesce(x.site, o.site) AS site FROM e LEFT JOIN (SELECT src, dst, line, min(site) AS site FROM s GROUP BY 1, 2, 3) x ON x.src = e.src AND x.dst = e.dst AND x.line = e.line
LEFT JOIN (SELECT src, dst, min(site) AS site FROM s GROUP BY 1, 2 HAVING count(*) = 1) o ON o.src = e.src AND o.dst = e.dst""")
def call_site_match(spark, sf_dir):
    sites = P.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("site"))
    edges = sites.groupBy("src", "dst").agg(F.explode(F.array(F.max("line"), F.lit(99))).alias("line"))
    return L.call_sites(sites, edges).select("src", "dst", "line", "site")


@query(f"""WITH {FUNCTIONS}, a AS (SELECT class_name, lag(class_name) OVER (ORDER BY class_name) AS ancestor FROM (SELECT DISTINCT class_name FROM fn))
SELECT m.id, min(b.id) AS base_id FROM fn m JOIN a USING (class_name) JOIN fn b ON b.class_name = a.ancestor AND b.module = m.module GROUP BY m.id""")
def base_methods(spark, sf_dir):
    methods = P.functions(spark, sf_dir).select("id", "class_name", F.col("module").alias("name"))
    brands = methods.select("class_name").distinct()
    ancestors = brands.withColumn("ancestor", F.lag("class_name").over(Window.orderBy("class_name"))).where("ancestor IS NOT NULL")  # a row per brand
    return L.base_methods(methods, ancestors)


@query(f"""WITH {FUNCTIONS}, r AS (SELECT class_name, CASE WHEN count(*) % 3 = 0 THEN 'service' ELSE 'helper' END AS role FROM fn GROUP BY class_name HAVING count(*) % 2 = 0) SELECT id, coalesce(r.role, 'unknown') AS role FROM fn LEFT JOIN r USING (class_name)""")
def method_roles(spark, sf_dir):
    fn = P.functions(spark, sf_dir)
    roles = fn.groupBy("class_name").agg(F.count("*").alias("n")).where("n % 2 = 0").select("class_name", F.when(F.col("n") % 3 == 0, "service").otherwise("helper").alias("role"))
    return L.with_class_role(fn, roles).select("id", "role")


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS file_path, o_orderkey % 997 AS line_start, o_orderkey % 997 + o_custkey % 89 AS line_end FROM orders),
g AS (SELECT *, max(line_end) OVER (PARTITION BY file_path ORDER BY line_start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM f) SELECT id, file_path FROM g WHERE furthest IS NULL OR furthest < line_end""")
def script_globals(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 997
    return L.script_globals(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_path"), start.alias("line_start"), (start + F.col("o_custkey") % 89).alias("line_end"))).select("id", "file_path")


@query("SELECT o_orderkey AS commit, o_custkey AS path FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY")
def recent_commits(spark, sf_dir):
    changes = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("ts"))
    return L.recent_commits(changes).select("commit", "path")


@query("SELECT user_id AS run_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error') WHERE k <= 3")
def recent_errors(spark, sf_dir):
    errors = P.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("run_id"), "event_id", "ts")
    return L.tail(errors, ["run_id"], [F.desc("ts"), F.desc("event_id")], 3).select("run_id", "event_id")


@query("SELECT user_id AS run_id, count(*) AS records, count(*) FILTER (WHERE event_type = 'error') AS errors, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id")
def log_sessions(spark, sf_dir):
    return R.log_sessions(P.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", F.when(F.col("event_type") == "error", 40).otherwise(20).alias("level")))


# --- symbols and expressions


@query(f"""WITH {FILES}, s AS (SELECT id, path, CASE size % 7 WHEN 0 THEN '__init__' WHEN 1 THEN 'test_' || name WHEN 2 THEN 'build_plugin' ELSE name END AS name, size FROM files),
t AS (SELECT *, CASE size % 3 WHEN 0 THEN 'x/plugins/y/plugin.py' WHEN 1 THEN 'examples/' || path ELSE path END AS p FROM s)
SELECT id, size % 11 = 0 OR regexp_full_match(name, '__.+__') OR starts_with(name, 'test_') OR size % 3 = 1 OR (size % 3 = 0 AND name = 'build_plugin') OR size % 13 = 0 OR regexp_matches(lower(p), 'test_|_test|\\.test\\.|\\.spec\\.|tests/|test/|__tests__|/spec/|/specs/') AS exempt FROM t""")
def dead_code_exemptions(spark, sf_dir):
    f = files(spark, sf_dir)
    size = F.col("size")
    name = F.when(size % 7 == 0, "__init__").when(size % 7 == 1, F.concat(F.lit("test_"), "name")).when(size % 7 == 2, "build_plugin").otherwise(F.col("name"))
    path = F.when(size % 3 == 0, "x/plugins/y/plugin.py").when(size % 3 == 1, F.concat(F.lit("examples/"), "path")).otherwise(F.col("path"))
    return f.select("id", C.is_hard_exempt(name, path, size % 13 == 0, size % 11 == 0).alias("exempt"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'EventType.' || upper(event_type) WHEN 1 THEN 'Event(type=Kind.' || event_type || ', n=1)' WHEN 2 THEN event_type ELSE 'self.' || event_type END AS expr FROM events)
SELECT event_id, event_id % 4 < 2 AS is_event, CASE event_id % 4 WHEN 0 THEN split_part(expr, '.', 2) WHEN 1 THEN split_part(split_part(expr, 'Kind.', 2), ',', 1) WHEN 2 THEN expr ELSE split_part(expr, '.', 2) END AS event_type, CASE event_id % 4 WHEN 0 THEN 0.9 ELSE 0.7 END AS confidence FROM e""")
def event_topology(spark, sf_dir):
    e, k = F.col("event_type"), F.col("event_id") % 4
    expr = F.when(k == 0, F.concat(F.lit("EventType."), F.upper(e))).when(k == 1, F.concat(F.lit("Event(type=Kind."), e, F.lit(", n=1)"))).when(k == 2, e).otherwise(F.concat(F.lit("self."), e))
    return P.table(spark, sf_dir, "events").select("event_id", expr.alias("x")).select("event_id", C.is_event(F.col("x")).alias("is_event"), C.event_type(F.col("x")).alias("event_type"), C.event_confidence(F.col("x")).alias("confidence"))


@query("""SELECT event_id, event_type IN ('click', 'view') AS registers, CASE WHEN event_id % 2 = 0 THEN 'self.on_' || event_type || ',handler' ELSE 'handler' END AS refs FROM events""")
def callback_references(spark, sf_dir):
    e = F.col("event_type")
    callee = F.when(e == "click", "bus.subscribe").when(e == "view", "register").otherwise(F.concat(F.lit("bus."), e))
    first = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("self.on_"), e)).otherwise("'text'")
    arguments = F.array(first, F.lit("EventType.TICK"), F.lit("handler"), F.lit("3.14"), F.lit("f(x)"), F.lit(""), F.lit("None"))
    return P.table(spark, sf_dir, "events").select("event_id", C.is_registration(callee).alias("registers"), F.array_join(C.callback_refs(arguments), ",").alias("refs"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '/a/' || p_name WHEN 1 THEN '/b/' || p_name WHEN 2 THEN '/c' ELSE '' END AS url FROM part""")
def client_call_urls(spark, sf_dir):
    k, name = F.col("p_size") % 4, F.col("p_name")
    arguments = F.when(k == 0, F.array(F.lit("base"), F.concat(F.lit('f"/a/'), name, F.lit('"')))).otherwise(F.array(F.lit("base")))
    keywords = F.when(k == 1, F.create_map(F.lit("path"), F.concat(F.lit("'/b/"), name, F.lit("'")))).otherwise(F.create_map(F.lit("timeout"), F.lit("3")))
    callee = F.when(k == 2, 'client.get("/c", 1)').otherwise("client.get")
    return P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.call_url(arguments, keywords, callee).alias("url"))


@query("""SELECT p_partkey AS id, 'sqlalchemy.orm,os,' || lower(p_brand) || ',react' || CASE WHEN p_size % 2 = 0 THEN ',pg' ELSE '' END AS modules, true AS db FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 'os,' || lower(p_brand) || ',react' || CASE WHEN p_size % 2 = 0 THEN ',pg' ELSE '' END, p_size % 2 = 0 FROM part WHERE p_size % 3 > 0""")
def imported_modules(spark, sf_dir):
    size, brand = F.col("p_size"), F.lower("p_brand")
    plain = F.replace(brand, F.lit("#"), F.lit("_"))
    source = F.concat(F.when(size % 3 == 0, "from sqlalchemy.orm import x\n").otherwise(""), F.lit("from .near import y\nimport os, "), plain, F.lit("\nimport React from 'react'\nx = require('./here')\n"), F.when(size % 2 == 0, "y = require('pg')").otherwise(""))
    modules = F.replace(F.array_join(C.imported_modules(source), ","), plain, brand)
    return P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), modules.alias("modules"), C.is_database_bound(source).alias("db"))


@query("""SELECT p_partkey AS id, 'size:int,tags:Dict[str, List[int]],rest:' AS parameters, 'Dict,List,int,str' AS types FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'part:' || replace(p_brand, '#', ''), replace(p_brand, '#', '') FROM part WHERE p_size % 2 = 1""")
def constructor_parameters(spark, sf_dir):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    signature = F.when(F.col("p_size") % 2 == 0, "def __init__(self, size: int = 3, tags: Dict[str, List[int]] = None, **rest)").otherwise(F.concat(F.lit("def __init__(self, part: "), brand, F.lit(") -> None")))
    found = C.parameters(signature)
    types = C.type_names(F.array_join(F.transform(found, lambda p: p["type"]), " "))
    return P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(found, lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",").alias("parameters"), F.array_join(types, ",").alias("types"))


@query("SELECT n_regionkey, sha256(string_agg(n_name || '=' || n_nationkey, '|' ORDER BY n_name)) AS hash FROM nation GROUP BY n_regionkey")
def map_hashes(spark, sf_dir):
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string"))))
    return P.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(entries.alias("m")).select("n_regionkey", C.map_hash(F.col("m")).alias("hash"))


@query(f"""WITH {CALLS}, d AS (SELECT p_partkey AS id, coalesce(n, 0) AS n, p_size % 9 = 0 AS many FROM part LEFT JOIN (SELECT dst, count(*) AS n FROM calls GROUP BY dst) ON dst = p_partkey)
SELECT id, 'static_call_graph_only' || CASE WHEN many THEN ',ambiguous_symbol_multiple_matches_narrow_the_query' WHEN n = 0 THEN ',no_direct_static_callers_may_miss_dynamic_or_typed_edges' ELSE '' END AS warnings FROM d""")
def impact_warnings(spark, sf_dir):
    n = P.calls(spark, sf_dir).groupBy(F.col("dst").alias("p_partkey")).agg(F.count("*").alias("n"))
    part = P.table(spark, sf_dir, "part").join(n, "p_partkey", "left")
    return part.select(F.col("p_partkey").alias("id"), F.array_join(C.impact_warnings(F.coalesce("n", F.lit(0)), F.col("p_size") % 9 == 0), ",").alias("warnings"))


@query("""SELECT event_id, 'key' || (event_id % 50) AS key FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'PATHS' FROM events WHERE event_id % 3 = 1 AND event_id % 2 = 0""")
def config_keys_kept(spark, sf_dir):
    k = F.col("event_id")
    key = F.when(k % 3 == 0, F.concat(F.lit("key"), k % 50)).when(k % 3 == 1, F.when(k % 2 == 0, "PATHS").otherwise("PATH")).otherwise((k % 10).cast("string"))
    return P.table(spark, sf_dir, "events").select("event_id", key.alias("key")).where(~C.is_excluded_key(F.col("key")))


# --- imports


@query(f"""WITH {FILES}, p AS (SELECT DISTINCT regexp_replace(path, '/__init__\\.py$', '') AS package FROM files WHERE path LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\') SELECT split_part(package, '/', 1) AS root FROM p WHERE contains(package, '/') GROUP BY 1 HAVING count(*) >= 2""")
def package_roots(spark, sf_dir):
    return I.package_roots(files(spark, sf_dir))


@query(f"""WITH {FILES}, f AS (SELECT id, path, size, string_split(path, '/') AS parts FROM files), g AS (SELECT *, len(parts) - 1 - size % 3 AS keep FROM f)
SELECT id, CASE WHEN keep >= 0 THEN array_to_string(parts[1:keep], '/') || CASE WHEN size % 2 = 0 THEN '/a/b.py' ELSE '/__init__.py' END END AS resolved FROM g""")
def relative_imports(spark, sf_dir):
    size = F.col("size")
    module = F.concat(F.repeat(F.lit("."), (size % 3 + 1).cast("int")), F.when(size % 2 == 0, "a.b").otherwise(""))
    return files(spark, sf_dir).select("id", I.relative_target(module, F.col("path")).alias("resolved"))


@query(f"""WITH {FILES}, s AS (SELECT path, regexp_replace(path, '\\.[^./]+$', '') AS stem FROM files WHERE regexp_matches(path, '\\.(js|ts)$')),
i AS (SELECT stem, arg_min(path, rank || path) AS path FROM (SELECT stem, path, '0' AS rank FROM s UNION ALL SELECT regexp_replace(stem, '/index$', ''), path, '1' FROM s WHERE ends_with(stem, '/index')) GROUP BY stem)
SELECT f.id, i.path AS resolved FROM (SELECT id, regexp_replace(path, '(/index)?\\.(js|ts)$', '') AS folder FROM files WHERE regexp_matches(path, '\\.(js|ts)$')) f LEFT JOIN i ON i.stem = f.folder""")
def script_imports(spark, sf_dir):
    f = files(spark, sf_dir).where(F.col("path").rlike(r"\.(js|ts)$"))
    base = F.regexp_replace("path", r"(/index)?\.(js|ts)$", "")
    asked = f.select("id", F.concat(F.lit("pages/"), "name", F.lit(".js")).alias("importer"), F.concat(F.lit("../"), base).alias("module"))
    return I.resolve_scripts(asked, files(spark, sf_dir)).select("id", "resolved")


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS importer, l_partkey AS symbol, l_suppkey AS source FROM lineitem) SELECT DISTINCT k.importer, k.symbol, coalesce(o.source, k.source) AS source FROM k LEFT JOIN k o ON o.importer = k.source AND o.symbol = k.symbol""")
def reexported_symbols(spark, sf_dir):
    imports = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("importer"), F.col("l_suppkey").alias("resolved")).agg(F.collect_set("l_partkey").alias("names"))
    return I.through_reexports(imports)


@query(f"""WITH {FILES}, m AS (SELECT replace(regexp_replace(path, '(/__init__)?\\.py$', ''), '/', '.') AS module, min(path) AS path FROM files WHERE ends_with(path, '.py') GROUP BY 1), a AS (SELECT id, replace(regexp_replace(path, '(/__init__)?\\.py$', ''), '/', '.') || CASE WHEN size % 5 = 0 THEN '.deep.name' ELSE '' END AS module FROM files WHERE ends_with(path, '.py') OR size % 9 = 0)
SELECT a.id, arg_max(m.path, length(m.module)) AS resolved FROM a LEFT JOIN m ON a.module = m.module OR starts_with(a.module, m.module || '.') GROUP BY a.id""")
def dotted_imports(spark, sf_dir):
    f = files(spark, sf_dir)
    module = F.replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    known = f.where(F.col("path").endswith(".py")).groupBy(module.alias("module")).agg(F.min("path").alias("path"))
    asked = f.where(F.col("path").endswith(".py") | (F.col("size") % 9 == 0)).select("id", F.lit("x/y.py").alias("importer"), F.concat(module, F.when(F.col("size") % 5 == 0, ".deep.name").otherwise("")).alias("module"))
    return I.resolve_dotted(asked, known).select("id", "resolved")


@query("""WITH n AS (SELECT p_partkey AS id, lower(p_type) AS norm, CASE p_size % 2 WHEN 0 THEN 'python' ELSE 'javascript' END AS language FROM part), i AS (SELECT replace(norm, ' ', '_') AS norm, language, list_sort(list(DISTINCT id)) AS ids FROM n GROUP BY 1, 2)
SELECT a.norm, a.language, len(a.ids) AS own, array_to_string(b.ids, ',') AS candidates FROM i a JOIN i b ON a.norm = b.norm AND a.language <> b.language""")
def cross_language_names(spark, sf_dir):
    size = F.col("p_size") % 2
    name = F.when(size == 0, F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))).otherwise(F.replace(F.initcap(F.lower("p_type")), F.lit(" "), F.lit("")))
    names = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.when(size == 0, "python").otherwise("javascript").alias("language"))
    return I.cross_language(names).select("norm", "language", F.size("ids").alias("own"), F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query(f"""WITH {CALLS}, {FILES} SELECT c.src, c.dst, (ends_with(a.path, '.py') AND NOT ends_with(b.path, '.py')) OR (NOT ends_with(a.path, '.py') AND ends_with(b.path, '.py')) AS skipped FROM calls c JOIN files a ON a.id = c.src JOIN files b ON b.id = c.dst""")
def cross_language_steps(spark, sf_dir):
    f = files(spark, sf_dir)
    ends = P.calls(spark, sf_dir).select("src", "dst").join(f.select(F.col("id").alias("src"), F.col("path").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst")
    return ends.select("src", "dst", C.skips_language(F.col("a"), F.col("b")).alias("skipped"))


# --- integrity and reports


@query("""SELECT 'defines' AS rel, count(*) FILTER (WHERE s_suppkey IS NOT NULL AND p_partkey IS NOT NULL) AS typed, count(*) AS total FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 LEFT JOIN part ON p_partkey = l_partkey AND p_size > 3
UNION ALL SELECT 'imports', count(*) FILTER (WHERE s_suppkey IS NOT NULL), count(*) FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
UNION ALL SELECT 'member_of', count(*) FILTER (WHERE p_partkey IS NOT NULL), count(*) FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 3""")
def integrity_edge_kinds(spark, sf_dir):
    line = P.table(spark, sf_dir, "lineitem")
    file_ = P.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    function = P.table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").alias("id"))
    every = P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    edges = {
        "defines": line.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")),
        "member_of": line.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")),
    }
    first = Q.edge_kinds({"file": file_, "function": function, "community": every}, edges, (*Q.STRUCTURE, *Q.TOPOLOGY))
    near = line.select(F.col("l_suppkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return first.unionByName(Q.edge_kinds({"file": file_}, {"imports": near}, Q.IMPORTS))


@query("""SELECT 'Q1' AS "check", 'function ' || o_custkey AS detail FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)
UNION ALL SELECT 'Q5', src || ' -> ' || dst FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey NOT IN (SELECT o_custkey FROM orders) OR l_partkey NOT IN (SELECT o_custkey FROM orders))
UNION ALL SELECT 'Q6', 'function 3, counted ' || count(*) FROM orders""")
def integrity_violations(spark, sf_dir):
    nodes = {"function": P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))}
    calls = P.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    stats = spark.range(1).select(F.lit("function").alias("table"), F.lit(3).cast("long").alias("n"))
    return Q.run_checks(nodes, {"calls": calls}, stats)


@query("""WITH m AS (SELECT p_brand AS module, CASE WHEN min(p_size) % 2 = 0 THEN 'production' ELSE 'scripts' END AS category, count(*) AS function_count, count(DISTINCT p_type) AS class_count, count(*) FILTER (WHERE p_size <= 10) AS test_function_count, count(*) FILTER (WHERE p_size % 10 = 0) AS dead_code_count, count(*) FILTER (WHERE p_size % 25 = 0) AS duplicate_count FROM part GROUP BY p_brand)
SELECT module, dead_code_count + duplicate_count AS issue_count, function_count + 2 * class_count + test_function_count AS complexity FROM m ORDER BY 2 DESC, category <> 'production', 3 DESC, 1 LIMIT 5""")
def structural_hotspots(spark, sf_dir):
    size = F.col("p_size")
    modules = P.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("module")).agg(
        F.when(F.min(size) % 2 == 0, "production").otherwise("scripts").alias("category"), F.count("*").alias("function_count"), F.count_distinct("p_type").alias("class_count"),
        F.count_if(size <= 10).alias("test_function_count"), F.count_if(size % 10 == 0).alias("dead_code_count"), F.count_if(size % 25 == 0).alias("duplicate_count"),
    )
    return R.hotspots(modules).select("module", "issue_count", "complexity")


@query(f"""WITH {FUNCTIONS}, c AS (SELECT module, class_name, count(*) AS methods FROM fn GROUP BY 1, 2 HAVING count(*) >= 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY methods DESC, class_name) AS rank FROM c) WHERE rank <= 5""")
def key_classes(spark, sf_dir):
    return R.key_classes(P.functions(spark, sf_dir))


@query(r"""WITH p AS (SELECT url, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS part FROM pages),
n AS (SELECT url, part, lower(part[1]) AS top, array_to_string(list_transform(string_split(regexp_replace(replace(coalesce(part[2], part[1]), '_', ' '), '([^\p{L}])', '\1' || chr(1), 'g'), chr(1)), lambda w: upper(w[1]) || lower(w[2:])), '') AS title FROM p)
SELECT url, CASE WHEN len(part) = 0 THEN 'Unknown' WHEN top = 'tests' THEN CASE WHEN len(part) >= 3 THEN 'Tests · ' || title ELSE 'Tests' END WHEN top IN ('scripts', 'script') THEN CASE WHEN len(part) >= 3 THEN 'Scripts · ' || title ELSE 'Scripts' END ELSE title END AS label FROM n""")
def package_labels(spark, sf_dir):
    bare = F.regexp_replace("url", "^https?://", "")
    return P.table(spark, sf_dir, "pages").select("url", R.package_label(bare).alias("label"))


@query("""SELECT CASE p_size % 3 WHEN 0 THEN 'Utils' WHEN 1 THEN 'Shared' ELSE p_size::VARCHAR END AS label, count(*) AS members FROM part GROUP BY 1""")
def isolation_buckets(spark, sf_dir):
    size, brand = F.col("p_size"), F.lower("p_brand")
    path = F.when(size % 3 == 0, F.concat(F.lit("src/utils/"), brand, F.lit(".py"))).when(size % 3 == 1, F.concat(brand, F.lit("\\Shared\\x.py"))).otherwise(F.concat_ws("/", brand, size, F.lit("y.py")))
    return R.bucket_communities(P.table(spark, sf_dir, "part").select(path.alias("file_path")))


@query(f"""WITH {CALLS}, simple AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM calls WHERE confidence >= 0.5),
old AS (SELECT p_partkey AS id, CAST(p_partkey % 40 AS VARCHAR) AS community FROM part), new AS (SELECT p_partkey AS id, p_brand || p_size AS community FROM part),
vote AS (SELECT new.community, old.community AS name, count(*) AS n FROM new JOIN old USING (id) GROUP BY 1, 2),
voted AS (SELECT community, name FROM vote QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, name) = 1),
named AS (SELECT id, name AS community FROM new JOIN voted USING (community)),
a AS (SELECT community, CASE WHEN n = 1 THEN 1.0 ELSE coalesce(k, 0) / (n * (n - 1) / 2) END AS c FROM (SELECT community, count(*) AS n FROM old GROUP BY 1) LEFT JOIN (SELECT x.community, count(*) AS k FROM simple JOIN old x ON x.id = u JOIN old y ON y.id = v WHERE x.community = y.community GROUP BY 1) USING (community)),
b AS (SELECT community, CASE WHEN n = 1 THEN 1.0 ELSE coalesce(k, 0) / (n * (n - 1) / 2) END AS c FROM (SELECT community, count(*) AS n FROM named GROUP BY 1) LEFT JOIN (SELECT x.community, count(*) AS k FROM simple JOIN named x ON x.id = u JOIN named y ON y.id = v WHERE x.community = y.community GROUP BY 1) USING (community))
SELECT community, round(a.c, 6) AS "before", round(coalesce(b.c, 1.0), 6) AS "after", a.c > 0.1 AND coalesce(b.c, 1.0) < a.c * 0.8 AS dropped FROM a LEFT JOIN b USING (community)""")
def partial_communities(spark, sf_dir):
    """Communities before and after others were named after them by their members' votes, and what that costs in cohesion."""
    from graphloom.operators import modularity as M

    part = P.table(spark, sf_dir, "part")
    old = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).cast("string").alias("community"))
    new = part.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("community"))
    change = M.cohesion_change(old, M.named_by_votes(new, old), M.pairs(P.calls(spark, sf_dir)))
    return change.select("community", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "dropped")


@query("""SELECT event_id AS id, event_type AS kind, user_id % 5 AS pack, CASE WHEN user_id % 5 = 1 THEN 'high' ELSE 'low' END AS severity, CASE event_type WHEN 'error' THEN 'fault' WHEN 'click' THEN 'use' ELSE 'general' END AS category, CASE event_type WHEN 'error' THEN 9 WHEN 'click' THEN 2 ELSE 0 END AS score,
CASE WHEN event_id % 4 = 0 THEN 'fixed' ELSE 'open' END AS status, CASE WHEN event_id % 2 = 0 THEN 'seen' ELSE '' END AS note FROM events WHERE user_id % 5 <> 2""")
def annotated_findings(spark, sf_dir):
    e = P.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("pack"), F.lit("low").alias("severity"))
    one = spark.range(1)
    policy = one.select(F.inline(F.array(F.struct(F.lit("error").alias("kind"), F.lit("fault").alias("category"), F.lit(9).alias("score")), F.struct(F.lit("click").alias("kind"), F.lit("use").alias("category"), F.lit(2).alias("score")))))
    overrides = one.select(F.inline(F.array(F.struct(F.lit(1).cast("long").alias("pack"), F.lit("high").alias("severity"), F.lit(True).alias("enabled")), F.struct(F.lit(2).cast("long").alias("pack"), F.lit(None).cast("string").alias("severity"), F.lit(False).alias("enabled")))))
    statuses = e.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "fixed").otherwise("odd").alias("status"), F.lit("seen").alias("note"))
    return R.annotate_findings(e, policy, overrides, statuses)


@query("""WITH c AS (SELECT event_type AS kind, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'low' ELSE 'medium' END AS severity, count(*) FILTER (WHERE event_id % 3 = 0) AS n FROM events GROUP BY 1)
SELECT kind, severity, n, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, n DESC, kind) AS place FROM c WHERE n > 0""")
def major_risks(spark, sf_dir):
    e = F.col("event_type")
    counts = P.table(spark, sf_dir, "events").groupBy(e.alias("kind")).agg(F.count_if(F.col("event_id") % 3 == 0).alias("n"))
    return R.risks(counts.withColumn("severity", F.when(F.col("kind") == "error", "high").when(F.col("kind") == "click", "low").otherwise("medium"))).select("kind", "severity", "n", "place")


@query("""SELECT lower(p_type) AS module, p_brand AS path, row_number() OVER (PARTITION BY lower(p_type) ORDER BY count(*) DESC, count(DISTINCT p_name) DESC, sum(p_size) DESC, p_brand) AS rank FROM part GROUP BY 1, 2 QUALIFY rank <= 3""")
def summary_candidates(spark, sf_dir):
    f = P.table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("module"), F.col("p_brand").alias("path")).agg(F.count("*").alias("functions"), F.count_distinct("p_name").alias("classes"), F.sum("p_size").alias("lines"))
    return R.candidate_files(f, 3).select("module", "path", "rank")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'initial ' || c_name WHEN c_custkey % 3 = 0 THEN 'file doc' ELSE c_nationkey || ' functions, ' || c_custkey % 9 || ' classes' END AS summary FROM customer""")
def module_summaries(spark, sf_dir):
    k = F.col("c_custkey")
    return P.table(spark, sf_dir, "customer").select(k.alias("id"), R.module_summary(F.when(k % 4 == 0, F.concat(F.lit("initial "), "c_name")).otherwise(" "), F.when(k % 3 == 0, "file doc"), F.lit(""), F.col("c_nationkey"), k % 9).alias("summary"))
