"""Queries over groups: coupling, duplicates, dead code, coverage, modules, state, traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import edges as E
from graphloom.operators import groups as G
from graphloom.operators import overlay as O
from graphloom.operators import score as S
from graphloom.operators import state as U
from graphloom.plans.registry import CALLS, FUNCTIONS, Catalogue
from graphloom.plans.shared import cut
from graphloom.sources import projection as P
from graphloom.streaming import sessions

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS path FROM lineitem), solo AS (SELECT path, count(*) AS n FROM c GROUP BY path),
p AS (SELECT x.path AS a, y.path AS b, count(*) AS change_count FROM c x JOIN c y ON x.k = y.k AND x.path < y.path GROUP BY 1, 2)
SELECT a, b, change_count, round(change_count / greatest(s.n, t.n), 6) AS strength FROM p JOIN solo s ON s.path = a JOIN solo t ON t.path = b
WHERE change_count >= 2 AND change_count / greatest(s.n, t.n) >= 0.05""")
def file_coupling(spark, sf_dir):
    changes = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))
    return G.coupling(changes, least=2, strength=0.05)


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS k, p_brand AS path FROM lineitem JOIN part ON p_partkey = l_partkey), solo AS (SELECT path, count(*) AS n FROM c GROUP BY path),
p AS (SELECT x.path AS a, y.path AS b, count(*) AS change_count FROM c x JOIN c y ON x.k = y.k AND x.path < y.path GROUP BY 1, 2)
SELECT a, b, change_count, round(change_count / greatest(s.n, t.n), 6) AS strength FROM p JOIN solo s ON s.path = a JOIN solo t ON t.path = b
WHERE change_count >= 3 AND change_count / greatest(s.n, t.n) >= 0.1""")
def module_coupling(spark, sf_dir):
    brand = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
    changes = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(brand, "l_partkey").select(F.col("l_orderkey").alias("commit"), "path")
    return G.coupling(changes, strength=0.1)


# --- duplicates


@query(f"""WITH {FUNCTIONS} SELECT name, string_agg(DISTINCT file_path, ',' ORDER BY file_path) AS files,
  CASE WHEN count(DISTINCT name || '|' || module) = 1 THEN 'high' ELSE 'medium' END AS severity FROM fn GROUP BY name HAVING count(DISTINCT file_path) >= 2""")
def duplicate_high_medium(spark, sf_dir):
    return G.same_name(P.functions(spark, sf_dir), "name").select("name", F.array_join("files", ",").alias("files"), "severity")


@query(f"""WITH {FUNCTIONS} SELECT name, 'def ' || name || '(self, size)' AS signature, count(DISTINCT file_path) AS files, count(DISTINCT qualified_name) AS qualified
FROM fn GROUP BY name HAVING count(DISTINCT file_path) >= 2 AND count(DISTINCT qualified_name) > 1""")
def duplicate_signature(spark, sf_dir):
    return G.same_signature(P.functions(spark, sf_dir))


@query(f"WITH {FUNCTIONS} SELECT file_path, name, count(*) AS copies FROM fn GROUP BY file_path, name HAVING count(*) >= 3")
def duplicate_in_group(spark, sf_dir):
    return G.repeated_in_file(P.functions(spark, sf_dir))


@query("SELECT sha256(text) AS body, count(*) AS copies, min(doc_id) AS first_id, count(DISTINCT source) AS files FROM documents GROUP BY text HAVING count(*) >= 2")
def duplicate_bodies(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("body"))
    return docs.groupBy("body").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("files")).where("copies >= 2")


@query(f"""WITH {CALLS}, {FUNCTIONS}, called AS (SELECT DISTINCT dst FROM calls), s AS (
  SELECT id, name, file_path, CASE WHEN is_test THEN -5 ELSE 1 END + least(1, 4) + CASE WHEN id IN (FROM called) THEN 3 ELSE 0 END
    + CASE WHEN lower(class_name) = lower(name) THEN 2 ELSE 0 END AS score FROM fn)
SELECT name, id, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, file_path, id) AS k FROM s) WHERE k = 1""")
def duplicate_canonical(spark, sf_dir):
    copies = E.degrees(P.functions(spark, sf_dir), P.calls(spark, sf_dir)).withColumn("is_dead", F.col("is_test"))
    return G.canonical(copies, "name").where("is_canonical").select("name", "id", "score")


# --- coverage and dead code

_TESTED = f"{CALLS}, {FUNCTIONS}, tested AS (SELECT DISTINCT dst FROM calls WHERE src IN (SELECT id FROM fn WHERE is_test))"


@query(f"""WITH {_TESTED} SELECT module, count(*) AS total, count(*) FILTER (WHERE id IN (FROM tested)) AS tested,
  round(100.0 * count(*) FILTER (WHERE id IN (FROM tested)) / count(*), 1) AS pct FROM fn WHERE NOT is_test GROUP BY module""")
def test_coverage_map(spark, sf_dir):
    return G.tested_share(P.functions(spark, sf_dir), P.calls(spark, sf_dir), "module")


@query(f"""WITH {_TESTED} SELECT file_path, count(*) AS total, count(*) FILTER (WHERE id IN (FROM tested)) AS tested,
  round(100.0 * count(*) FILTER (WHERE id IN (FROM tested)) / count(*), 1) AS pct FROM fn WHERE NOT is_test GROUP BY file_path""")
def any_call_coverage_map(spark, sf_dir):
    return G.tested_share(P.functions(spark, sf_dir), P.calls(spark, sf_dir), "file_path")


_INFO = f"""{CALLS}, {FUNCTIONS}, info AS (
  SELECT fn.id, count(s.dst) AS total, count(*) FILTER (WHERE s.reason = 'fuzzy') AS fuzzy,
    count(*) FILTER (WHERE s.reason <> 'fuzzy' AND c.is_test) AS test,
    count(*) FILTER (WHERE s.reason <> 'fuzzy' AND NOT c.is_test AND c.line_count > 45) AS script,
    count(*) FILTER (WHERE s.reason <> 'fuzzy' AND NOT c.is_test AND c.line_count <= 45) AS prod
  FROM fn LEFT JOIN calls s ON s.dst = fn.id LEFT JOIN fn c ON c.id = s.src GROUP BY fn.id)"""


@query(f"""WITH {_INFO} SELECT id, total, fuzzy, test, script, prod,
  CASE WHEN total = 0 AND id IN (SELECT id FROM fn WHERE line_count > 45) THEN 'possibly_dead' WHEN total = 0 THEN 'definitely_dead'
    WHEN fuzzy = total THEN 'probably_dead' WHEN test > 0 AND test + fuzzy = total THEN 'probably_dead' WHEN script > 0 AND prod = 0 THEN 'probably_dead' ELSE 'possibly_dead' END AS tier,
  CASE WHEN total = 0 THEN 'dead_everywhere' WHEN total <= test + script THEN 'dead_in_production' ELSE 'dead_everywhere' END AS context FROM info""")
def dead_tiers(spark, sf_dir):
    functions = P.functions(spark, sf_dir).withColumn("is_script", F.col("line_count") > 45)
    info = G.caller_info(functions, P.calls(spark, sf_dir))
    tier = G.dead_tier(F.col("is_script"), F.lit(False))
    return info.select("id", "total", "fuzzy", "test", "script", "prod", tier.alias("tier"), G.dead_context().alias("context"))


@query("SELECT p_name AS name, count(DISTINCT lower(p_type) || '/' || p_brand) AS files FROM part GROUP BY p_name HAVING count(DISTINCT lower(p_type) || '/' || p_brand) >= 3")
def abc_polymorphic_names(spark, sf_dir):
    return P.functions(spark, sf_dir).groupBy("name").agg(F.count_distinct("file_path").alias("files")).where("files >= 3")


@query(f"""WITH {CALLS}, {FUNCTIONS}, n AS (SELECT fn.id, fn.name, fn.class_name, count(src) AS callers FROM fn LEFT JOIN calls ON dst = fn.id GROUP BY ALL),
base AS (SELECT name, max(callers) AS base_callers FROM n WHERE class_name = (SELECT min(class_name) FROM n) GROUP BY name)
SELECT id, callers + CASE WHEN class_name = (SELECT min(class_name) FROM n) THEN 0 ELSE coalesce(base_callers, 0) END AS callers FROM n LEFT JOIN base USING (name)""")
def override_rollup(spark, sf_dir):
    counted = E.degrees(P.functions(spark, sf_dir), P.calls(spark, sf_dir)).select("id", "name", "class_name", "callers")
    root = counted.agg(F.min("class_name").alias("root"))  # one row
    own = counted.join(root.withColumn("_is_base", F.lit(True)), F.col("class_name") == F.col("root"), "left")
    base = own.where("_is_base").groupBy("name").agg(F.max("callers").alias("base_callers"))
    return own.join(base, "name", "left").select("id", (F.col("callers") + F.when(F.col("_is_base"), 0).otherwise(F.coalesce("base_callers", F.lit(0)))).alias("callers"))


@query("SELECT n_name AS base, count(*) AS implementations, string_agg(c_name, ',' ORDER BY c_name) AS classes FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def interface_map(spark, sf_dir):
    owners = P.table(spark, sf_dir, "nation").join(P.table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return owners.groupBy(F.col("n_name").alias("base")).agg(F.count("*").alias("implementations"), F.array_join(F.array_sort(F.collect_list("c_name")), ",").alias("classes")).orderBy(F.desc("implementations"), "base")


# --- modules and communities


@query(f"""WITH {FUNCTIONS}, m AS (SELECT module, class_name, count(*) AS methods FROM fn GROUP BY 1, 2),
top5 AS (SELECT module, string_agg(class_name, ',' ORDER BY k) AS key_classes FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY methods DESC, class_name) AS k FROM m WHERE methods >= 2) WHERE k <= 5 GROUP BY module)
SELECT module, count(*) AS functions, count(DISTINCT file_path) AS files, count(*) FILTER (WHERE is_test) AS tests, any_value(key_classes) AS key_classes FROM fn LEFT JOIN top5 USING (module) GROUP BY module""")
def module_index(spark, sf_dir):
    fn = P.functions(spark, sf_dir)
    counted = fn.groupBy("module", "class_name").agg(F.count("*").alias("methods")).where("methods >= 2")
    order = Window.partitionBy("module").orderBy(F.desc("methods"), "class_name")
    best = counted.withColumn("k", F.row_number().over(order)).where("k <= 5").groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "class_name"))), lambda r: r["class_name"]), ",").alias("key_classes"))
    totals = fn.groupBy("module").agg(F.count("*").alias("functions"), F.count_distinct("file_path").alias("files"), F.count_if("is_test").alias("tests"))
    return totals.join(best, "module", "left")


@query("""WITH f AS (SELECT DISTINCT split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/', 1) AS a, split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/', 2) AS b, url FROM pages)
SELECT url, CASE WHEN count(*) OVER (PARTITION BY a) > 15 AND length(b) > 0 AND strpos(substr(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), length(a) + 2), '/') > 0 THEN a || '/' || b ELSE a END AS module FROM f""")
def module_expansion(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "")
    files = P.table(spark, sf_dir, "pages").select("url", bare.alias("path")).distinct()
    return G.modules(files, most=15, depth=2).select("url", "module")


@query(f"""WITH {CALLS}, {FUNCTIONS}, n AS (SELECT class_name AS community, count(*) AS members FROM fn GROUP BY 1),
i AS (SELECT a.class_name AS community, count(*) AS internal FROM calls JOIN fn a ON a.id = src JOIN fn b ON b.id = dst WHERE a.class_name = b.class_name GROUP BY 1)
SELECT community, members, coalesce(internal, 0) AS internal, round(coalesce(internal, 0) / greatest(members * (members - 1) / 2, 1), 6) AS cohesion FROM n LEFT JOIN i USING (community)""")
def community_cohesion(spark, sf_dir):
    return G.cohesion(P.functions(spark, sf_dir).select("id", F.col("class_name").alias("community")), P.calls(spark, sf_dir))


@query(f"""WITH {FUNCTIONS}, c AS (SELECT class_name AS community, module AS label, count(*) AS n FROM fn GROUP BY 1, 2)
SELECT community, label, n FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, label) AS k FROM c) WHERE k = 1""")
def community_label_mode(spark, sf_dir):
    return G.most_common(P.functions(spark, sf_dir).select(F.col("class_name").alias("community"), F.col("module").alias("label")), "community", "label")


@query(f"""WITH {CALLS}, {FUNCTIONS}, m AS (SELECT id, file_path AS community FROM fn), small AS (SELECT community FROM m GROUP BY 1 HAVING count(*) < 8),
both_ AS (SELECT src AS x, dst AS y FROM calls UNION SELECT dst, src FROM calls),
c AS (SELECT a.community, b.community AS target, count(*) AS links FROM both_ JOIN m a ON a.id = x JOIN m b ON b.id = y WHERE a.community IN (FROM small) AND a.community <> b.community GROUP BY 1, 2)
SELECT community, target, links FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY links DESC, target) AS k FROM c) WHERE k = 1""")
def micro_community_merge(spark, sf_dir):
    return G.merge_targets(P.functions(spark, sf_dir).select("id", F.col("file_path").alias("community")), P.calls(spark, sf_dir), 8)


@query(f"""WITH {FUNCTIONS} SELECT substr(sha256(string_agg(id || ':' || class_name, '|' ORDER BY id)), 1, 16) AS snapshot, count(*) AS functions FROM fn""")
def community_snapshot(spark, sf_dir):
    rows = P.functions(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("id", "class_name"))).alias("rows"))
    return rows.select(T.sha(F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["id"].cast("string"), r["class_name"])), "|"), 16).alias("snapshot"), F.size("rows").cast("long").alias("functions"))


# --- findings and signals


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority")))
def findings_grouping_sets(spark, sf_dir):
    return G.summaries(P.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderpriority AS severity, count(*) AS n, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 100 WHEN o_orderpriority = '2-HIGH' THEN 85 ELSE 25 END) AS BIGINT) AS score FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def severity_threshold_filter(spark, sf_dir):
    named = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("low")
    hit = G.at_least(P.table(spark, sf_dir, "orders").select("o_orderpriority"), "o_orderpriority", _PRIORITIES, "2-HIGH")
    return hit.groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"), F.sum(T.severity_score(named)).cast("long").alias("score"))


@query("""WITH v AS (SELECT p_brand AS class_name, w AS role, length(w) % 3 + 1 AS weight FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)),
s AS (SELECT class_name, role, sum(weight) AS score FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, lead(score, 1, 0) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY class_name ORDER BY score DESC, role))
SELECT class_name, role, CAST(score AS BIGINT) AS score, round(least(0.95, 0.45 + 0.08 * score + 0.03 * (score - nxt)), 3) AS confidence FROM r WHERE k = 1""")
def class_role_votes(spark, sf_dir):
    words = P.table(spark, sf_dir, "part").select(F.col("p_brand").alias("class_name"), F.explode(F.split("p_name", " ")).alias("role"))
    return S.votes(words.withColumn("weight", (F.length("role") % 3 + 1).cast("long")), ["class_name"], "role", "weight")


@query("""SELECT doc_id, CAST(CASE WHEN lines >= 8 THEN 2 ELSE 0 END + CASE WHEN n_chars >= 2500 THEN 2 ELSE 0 END + CASE WHEN words >= 600 THEN 1 ELSE 0 END AS INTEGER) AS score
FROM (SELECT doc_id, n_chars, len(string_split(text, chr(10))) AS lines, len(string_split(text, ' ')) AS words FROM documents)
WHERE lines >= 8 OR n_chars >= 2500 OR words >= 600""")
def decomposition_signals(spark, sf_dir):
    lines, words = F.size(F.split("text", "\n", -1)), F.size(F.split("text", " ", -1))
    score = F.when(lines >= 8, 2).otherwise(0) + F.when(F.col("n_chars") >= 2500, 2).otherwise(0) + F.when(words >= 600, 1).otherwise(0)
    return P.table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).where("score > 0")


@query("""SELECT c_mktsegment AS layer, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS covered, round(100.0 * count(*) FILTER (WHERE c_acctbal > 0) / count(*), 2) AS pct FROM customer GROUP BY 1
UNION ALL SELECT 'all', count(*), count(*) FILTER (WHERE c_acctbal > 0), round(100.0 * count(*) FILTER (WHERE c_acctbal > 0) / count(*), 2) FROM customer""")
def coverage_totals(spark, sf_dir):
    rows = P.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("layer"), (F.col("c_acctbal") > 0).alias("hit"))
    counted = rows.rollup("layer").agg(F.count("*").alias("total"), F.count_if("hit").alias("covered"), F.grouping("layer").alias("g"))
    return counted.select(F.when(F.col("g") == 1, "all").otherwise(F.col("layer")).alias("layer"), "total", "covered", F.round(100 * F.col("covered") / F.col("total"), 2).alias("pct"))


@query("""SELECT source AS layer, count(*) AS total, count(l.doc_id) AS covered, coalesce(round(avg(quality), 6), 0) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def coverage_by_layer(spark, sf_dir):
    labels = P.table(spark, sf_dir, "labels").withColumn("_l", F.lit(1))
    joined = P.table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return joined.groupBy(F.col("source").alias("layer")).agg(F.count("*").alias("total"), F.count("_l").alias("covered"), F.coalesce(F.round(F.avg("quality"), 6), F.lit(0.0)).alias("quality"))


@query("""WITH spans AS (SELECT o_orderkey AS id, o_custkey AS file, date_part('day', o_orderdate) AS a, least(date_part('day', o_orderdate) + 3, 31) AS b FROM orders),
ex AS (SELECT DISTINCT c_custkey AS file, CAST(abs(floor(c_acctbal)) AS BIGINT) % 31 + 1 AS line FROM customer)
SELECT id, coalesce(bool_or(line > a AND line <= b OR a = b AND line = a), false) AS is_covered FROM spans LEFT JOIN ex USING (file) GROUP BY id""")
def line_range_join(spark, sf_dir):
    day = F.dayofmonth("o_orderdate").cast("long")
    spans = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), day.alias("a"), F.least(day + 3, F.lit(31)).alias("b"))
    executed = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (F.abs(F.floor("c_acctbal")).cast("long") % 31 + 1).alias("line"))
    return G.covered_by_lines(spans, executed, "file", "a", "b", "line").select("id", "is_covered")


# --- traces

_TRACES = """tr AS (SELECT event_id, user_id, ts, event_type AS fn, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS caller, value FROM events)"""


@query(f"""WITH {_TRACES}, known AS (SELECT event_type AS name, count(*) AS id FROM events WHERE event_type NOT IN ('error') GROUP BY 1)
SELECT fn, CASE WHEN id IS NULL THEN NULL ELSE 'qualified_name' END AS via, count(*) AS n FROM tr LEFT JOIN known ON fn = name GROUP BY fn, via""")
def trace_resolution_coalesce(spark, sf_dir):
    return O.resolve_traces(P.traces(spark, sf_dir), _event_functions(spark, sf_dir)).groupBy("fn", "via").agg(F.count("*").alias("n"))


def _event_functions(spark, sf_dir):
    """The event types other than errors as the functions that the static graph knows."""
    kinds = P.table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("id"))
    return kinds.select("id", "name", F.col("name").alias("qualified_name"))


@query(f"""WITH {_TRACES}, static AS (SELECT DISTINCT caller, fn FROM tr WHERE caller < fn)
SELECT caller AS src, fn AS dst, count(*) AS n FROM tr WHERE caller IS NOT NULL AND (caller, fn) NOT IN (SELECT (caller, fn) FROM static WHERE caller IS NOT NULL) GROUP BY 1, 2""")
def dynamic_edges_anti(spark, sf_dir):
    seen = cut(P.traces(spark, sf_dir).where("caller IS NOT NULL").select(F.col("caller").alias("src"), F.col("fn").alias("dst")), "trace-pairs")
    return O.new_edges(seen, seen.where("src < dst").distinct()).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT event_type AS fn, count(*) AS calls FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def trace_top_calls(spark, sf_dir):
    return O.top_calls(P.traces(spark, sf_dir))


@query("SELECT count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS unresolved, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS share, count(*) FILTER (WHERE event_type = 'error') / count(*) >= 0.2 AND count(*) >= 100 AS is_finding FROM events")
def runtime_quality(spark, sf_dir):
    return O.quality(O.resolve_traces(P.traces(spark, sf_dir), _event_functions(spark, sf_dir)))


@query("""SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def debounce_sessions(spark, sf_dir):
    return sessions.debounce(P.table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours")


@query("SELECT event_id, event_type AS fn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k > 1900")
def trace_delta_offset(spark, sf_dir):
    return sessions.after_offset(P.traces(spark, sf_dir), "fn", ["ts", "event_id"], 1900).select("event_id", "fn")


# --- state


def _snapshots(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), "doc_id", F.sha2("text", 256).alias("source_hash"), "n_chars", "source")
    old = docs.where("n_chars < 6000").select("path", "source_hash", "source")
    new = docs.where("n_chars >= 300").select("path", F.when(F.col("n_chars") > 4000, F.sha2(F.concat("source_hash", F.lit("!")), 256)).otherwise(F.col("source_hash")).alias("source_hash"), "source")
    return old, new


_DIFF = """d AS (SELECT 'doc/' || doc_id AS path, source, CASE WHEN n_chars >= 6000 THEN 'added' WHEN n_chars < 300 THEN 'removed' WHEN n_chars > 4000 THEN 'changed' END AS change, n_chars FROM documents)"""


@query(f"WITH {_DIFF} SELECT path, change FROM d WHERE change IS NOT NULL")
def file_diff(spark, sf_dir):
    return U.diff(*_snapshots(spark, sf_dir))


@query(f"""WITH {_DIFF}, edge AS (SELECT path AS src, lead(path) OVER (PARTITION BY source ORDER BY path) AS dst FROM d), call AS (SELECT path AS src, lag(path) OVER (PARTITION BY source ORDER BY path) AS dst FROM d)
SELECT path FROM d WHERE n_chars >= 300 AND (change IN ('added', 'changed') OR path IN (SELECT src FROM edge JOIN d t ON t.path = dst WHERE t.change IS NOT NULL) OR path IN (SELECT src FROM call JOIN d t ON t.path = dst WHERE t.change IN ('changed', 'removed')))""")
def reparse_expansion(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    every = old.select("path", "source").unionByName(new.select("path", "source")).distinct()
    beside = lambda f: every.select(F.col("path").alias("src"), f("path").over(Window.partitionBy("source").orderBy("path")).alias("dst")).where("dst IS NOT NULL")
    return U.to_reparse(cut(U.diff(old, new), "changes"), beside(F.lag), beside(F.lead), new)


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS name, CAST(CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS INTEGER) AS version FROM part""")
def upsert_merge(spark, sf_dir):
    part = P.table(spark, sf_dir, "part")
    old = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(0).alias("version"))
    new = part.where("p_size > 40").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), F.lit(1).alias("version"))
    return U.upsert(old, new, ["id"])


@query("""SELECT l_partkey AS id, max(l_shipdate) AS seen_at, CAST(max_by(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice)) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1""")
def last_write_wins(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("seen_at"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("_at"))
    return U.last_write(rows, ["id"], "_at").select("id", "seen_at", "quantity")


@query(f"WITH {CALLS}, gone AS (SELECT p_partkey FROM part WHERE p_size > 25) SELECT src, dst, confidence FROM calls WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)")
def detach_delete(spark, sf_dir):
    functions = P.functions(spark, sf_dir)
    return U.detach_delete(functions, P.calls(spark, sf_dir), functions.where("line_count > 25"))[1].select("src", "dst", "confidence")


@query("""WITH old AS (SELECT p_partkey AS id, p_size AS size FROM part) SELECT id, CAST(CASE WHEN size > 40 THEN 99 ELSE size END AS BIGINT) AS size FROM old""")
def sparse_flags(spark, sf_dir):
    rows = P.functions(spark, sf_dir).select("id", F.col("line_count").alias("size"))
    return U.sparse_update(rows, rows.where("size > 40").select("id", F.lit(99).cast("long").alias("size")), "id")
