"""Queries over the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import edges as E
from graphloom.operators import score as S
from graphloom.operators import traversal as V
from graphloom.operators.components import connected_components
from graphloom.plans.registry import CALLS, DEGREES, FUNCTIONS, RAW_CALLS, Catalogue
from graphloom.plans.shared import cut
from graphloom.sources import projection as P

CATALOGUE = Catalogue()
query = CATALOGUE.query

#: The node from which traversals start; confidence of the edges that depth queries and communities follow.
ROOT, DEEP, LINKED = 1, 0.8, 0.5


def _calls(spark: SparkSession, sf_dir: str, least: float = 0) -> DataFrame:
    return cut(P.calls(spark, sf_dir).where(F.col("confidence") >= least).select("src", "dst", "confidence", "reason"), "calls")


def _one(spark: SparkSession, node: int = ROOT) -> DataFrame:
    return spark.range(node, node + 1).select("id")


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.degrees(P.functions(spark, sf_dir), P.calls(spark, sf_dir))


@query(f"""WITH {CALLS}, {FUNCTIONS}, {DEGREES}
SELECT id, name, callers, callees,
  round(round(callees / (ln(1 + callers) + 1) + 7 * ln(1 + callers), 4) * CASE WHEN callers = 0 THEN 2 ELSE 1 END, 4) AS score
FROM deg ORDER BY score DESC, id LIMIT 20""")
def entry_points_topk(spark, sf_dir):
    scored = _degrees(spark, sf_dir).withColumn("score", F.round(S.base_score(F.col("callers"), F.col("callees")) * F.when(F.col("callers") == 0, 2).otherwise(1), 4))
    return scored.orderBy(F.desc("score"), "id").limit(20).select("id", "name", "callers", "callees", "score")


@query(f"""WITH {CALLS}, {FUNCTIONS}, {DEGREES}, base AS (
  SELECT *, round(callees / (ln(1 + callers) + 1) + 7 * ln(1 + callers), 4) * CASE WHEN callers = 0 THEN 2 ELSE 1 END
    * CASE WHEN regexp_matches(lower(name), '^(handle|on_|controller|view|route)') THEN 1.5 ELSE 1 END AS s FROM deg)
SELECT id, round(CASE WHEN is_test OR s <= 0.5 THEN 0 ELSE s END, 4) AS entry_score FROM base""")
def entry_scores(spark, sf_dir):
    df = _degrees(spark, sf_dir)
    return df.select("id", F.round(S.entry_score(df), 4).alias("entry_score"))


@query(f"""WITH {CALLS}, lines AS (SELECT src, dst, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM (SELECT DISTINCT src, dst, line FROM raw) GROUP BY src, dst)
SELECT src, dst, confidence, reason, line, lines FROM calls JOIN lines USING (src, dst)""")
def call_edge_merge(spark, sf_dir):
    return P.calls(spark, sf_dir).select("src", "dst", "confidence", "reason", "line", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query(f"WITH {CALLS} SELECT reason, count(*) AS n, CAST(sum(sites) AS BIGINT) AS sites FROM calls GROUP BY reason")
def edges_by_reason(spark, sf_dir):
    return P.calls(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"), F.sum("sites").alias("sites"))


@query(f"WITH {CALLS} SELECT dst AS target, src AS id, p_name AS name, confidence FROM calls JOIN part ON src = p_partkey WHERE dst IN (SELECT p_partkey FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part))")
def direct_callers(spark, sf_dir):
    return E.callers_of(P.calls(spark, sf_dir), P.functions(spark, sf_dir), _dearest(spark, sf_dir))


@query(f"WITH {CALLS} SELECT src AS target, dst AS id, p_name AS name, confidence FROM calls JOIN part ON dst = p_partkey WHERE src IN (SELECT p_partkey FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part))")
def direct_callees(spark, sf_dir):
    return E.callees_of(P.calls(spark, sf_dir), P.functions(spark, sf_dir), _dearest(spark, sf_dir))


def _dearest(spark, sf_dir):
    part = P.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return part.join(part.agg(F.max("p_retailprice").alias("p_retailprice")), "p_retailprice").select(F.col("p_partkey").alias("target"))


@query("SELECT DISTINCT l_suppkey AS src FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1 AND p_brand = (SELECT min(p_brand) FROM part))")
def bulk_importers(spark, sf_dir):
    part = P.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    targets = part.join(part.agg(F.min("p_brand").alias("p_brand")), "p_brand").where("p_size = 1").select(F.col("p_partkey").alias("target"))
    return E.importers_of(P.imports(spark, sf_dir), targets)


@query(f"""WITH {RAW_CALLS}, ok AS (SELECT p_partkey FROM part WHERE p_size > 5)
SELECT reason, count(*) AS n FROM raw WHERE src IN (FROM ok) AND dst IN (FROM ok) GROUP BY reason""")
def missing_endpoint_filter(spark, sf_dir):
    known = P.functions(spark, sf_dir).where("line_count > 5")
    return E.with_known_ends(P.raw_calls(spark, sf_dir), known, known).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS}, ok AS (SELECT p_partkey FROM part WHERE p_size > 5)
SELECT src, dst FROM calls WHERE src NOT IN (FROM ok) OR dst NOT IN (FROM ok)""")
def integrity_q1(spark, sf_dir):
    return E.dangling(P.calls(spark, sf_dir), P.functions(spark, sf_dir).where("line_count > 5"))


@query("SELECT p_name AS id, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def integrity_q5(spark, sf_dir):
    return E.repeated_keys(P.functions(spark, sf_dir).select(F.col("name").alias("id")))


_COUNTED = ("part", "lineitem", "orders", "customer", "supplier", "nation", "region", "documents", "pages", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def graph_stats(spark, sf_dir):
    out = None
    for t in _COUNTED:
        one = P.table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {RAW_CALLS} SELECT reason, count(*) AS n FROM raw WHERE NOT (src = dst AND confidence < 0.9 AND reason IN ('fuzzy', 'method_call')) GROUP BY reason")
def call_self_loop_filter(spark, sf_dir):
    return E.drop_suspect_loops(P.raw_calls(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


def _hops(edge_from: str, edge_to: str, hops: int, source: str = "deep", seeds: str = f"SELECT CAST({ROOT} AS BIGINT) AS id") -> str:
    parts, seen = [f"h0 AS ({seeds})"], ["SELECT id FROM h0"]
    for i in range(1, hops + 1):
        parts.append(f"h{i} AS (SELECT DISTINCT {edge_to} AS id FROM {source} JOIN h{i - 1} ON {edge_from} = id WHERE {edge_to} NOT IN ({' UNION ALL '.join(seen)}))")
        seen.append(f"SELECT id FROM h{i}")
    parts.append("hops AS (" + " UNION ALL ".join(f"SELECT id, {i} AS hop FROM h{i}" for i in range(hops + 1)) + ")")
    return ", ".join(parts)


_DEEP = f"{CALLS}, deep AS (SELECT * FROM calls WHERE confidence >= {DEEP})"


@query(f"WITH {_DEEP}, {_hops('dst', 'src', 3)} SELECT id, CAST(hop AS INTEGER) AS hop FROM hops")
def dependents_by_depth(spark, sf_dir):
    return V.reach(_calls(spark, sf_dir, DEEP), _one(spark), 3, forward=False)


@query(f"WITH {_DEEP}, {_hops('src', 'dst', 3)} SELECT id, CAST(hop AS INTEGER) AS hop FROM hops")
def dependencies_by_depth(spark, sf_dir):
    return V.reach(_calls(spark, sf_dir, DEEP), _one(spark), 3)


@query(f"""WITH {_DEEP}, {_hops('dst', 'src', 3)}, {FUNCTIONS}, named AS (SELECT hop, file_path FROM hops JOIN fn USING (id) WHERE hop > 0)
SELECT CAST(hop AS INTEGER) AS hop, count(*) AS functions, count(DISTINCT file_path) AS files FROM named GROUP BY hop""")
def impact_by_file(spark, sf_dir):
    hit = V.reach(_calls(spark, sf_dir, DEEP), _one(spark), 3, forward=False).where("hop > 0").join(P.functions(spark, sf_dir), "id")
    return hit.groupBy("hop").agg(F.count("*").alias("functions"), F.count_distinct("file_path").alias("files"))


@query("""SELECT 'region:' || r_regionkey AS root, 'nation:' || n_nationkey AS id, 1 AS depth FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT 'region:' || r_regionkey, 'customer:' || c_custkey, 2 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT 'region:' || r_regionkey, 'order:' || o_orderkey, 3 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey""")
def hierarchy_varlen_1_3(spark, sf_dir):
    link = lambda t, p, a, c, b: P.table(spark, sf_dir, t).select(T.node_id(p, F.col(a)).alias("parent"), T.node_id(c, F.col(b)).alias("child"))
    return V.descendants([link("nation", "region", "n_regionkey", "nation", "n_nationkey"), link("customer", "nation", "c_nationkey", "customer", "c_custkey"), link("orders", "customer", "o_custkey", "order", "o_orderkey")])


def _impact_sql(hops: int) -> str:
    parts, seen = [f"i0 AS (SELECT id, 0.01 + ln(1 + id) / 1000 AS score FROM (SELECT CAST({ROOT} AS BIGINT) AS id))"], ["SELECT id FROM i0"]
    for k in range(1, hops + 1):
        parts.append(f"i{k} AS (SELECT src AS id, max(score * 0.7 * confidence) AS score FROM calls JOIN i{k - 1} ON dst = id WHERE src NOT IN ({' UNION ALL '.join(seen)}) GROUP BY src)")
        seen.append(f"SELECT id FROM i{k}")
    every = " UNION ALL ".join(f"SELECT id, {k} AS hop, score FROM i{k}" for k in range(hops + 1))
    return f"WITH {CALLS}, {', '.join(parts)} SELECT id, CAST(hop AS INTEGER) AS hop, round(score, 12) AS score FROM ({every})"


@query(_impact_sql(5))
def diff_impact(spark, sf_dir):
    seeds = _one(spark).select("id", (0.01 + F.log1p("id") / 1000).alias("score"))
    return V.spread(_calls(spark, sf_dir), seeds, 5).select("id", "hop", F.round("score", 12).alias("score"))


_TOP4 = f"{CALLS}, top4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS k FROM calls) WHERE k <= 4)"


@query(f"WITH {_TOP4} SELECT src, dst, confidence FROM top4")
def fanout_top4(spark, sf_dir):
    return E.top_fan_out(P.calls(spark, sf_dir), 4).select("src", "dst", "confidence")


@query(f"WITH {_TOP4}, {_hops('src', 'dst', 4, 'top4')} SELECT src, dst, confidence FROM top4 WHERE src IN (SELECT id FROM hops) AND dst IN (SELECT id FROM hops)")
def impact_graph_edges(spark, sf_dir):
    best = cut(E.top_fan_out(P.calls(spark, sf_dir).where("confidence >= 0.5"), 4).select("src", "dst", "confidence"), "fan-out")
    return V.impact_edges(best, _one(spark), 4)


@query()
def pathway_bfs_steps(spark, sf_dir):
    best = E.top_fan_out(P.calls(spark, sf_dir), 4)
    return V.pathways(best, entry_points_topk(spark, sf_dir).select("id"))


@query(f"""WITH {CALLS} SELECT src AS id, count(*) AS edges, round(exp(avg(ln(greatest(confidence, 0.0001)))), 6) AS confidence FROM calls GROUP BY src""")
def pathway_confidence(spark, sf_dir):
    return P.calls(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"), F.round(T.geometric_mean(F.col("confidence")), 6).alias("confidence"))


@query("""SELECT conv_id, count(*) AS steps, count(DISTINCT role) AS files, round(count(*) * count(DISTINCT role) * (max(turn) + 1) / 100.0, 4) AS importance FROM conversations GROUP BY conv_id""")
def pathway_importance(spark, sf_dir):
    return (
        P.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.count_distinct("role").alias("files"), F.max("turn").alias("_entry"))
        .select("conv_id", "steps", "files", S.importance(F.col("steps"), F.col("files"), F.col("_entry")).alias("importance"))
    )


# The smallest node of a component has no smaller neighbour, so it is enough to walk from such nodes.
_COMPONENTS = f"""WITH RECURSIVE {CALLS}, both_ AS (SELECT src AS u, dst AS v FROM calls UNION SELECT dst, src FROM calls),
low AS (SELECT u FROM both_ GROUP BY u HAVING u < min(v)), walk(id, root) AS (SELECT u, u FROM low UNION SELECT b.v, w.root FROM walk w JOIN both_ b ON w.id = b.u),
comp AS (SELECT id, min(root) AS component FROM walk GROUP BY id)"""


@query(f"{_COMPONENTS} SELECT id, component FROM comp")
def components(spark, sf_dir):
    return connected_components(P.calls(spark, sf_dir))


@query("""WITH steps AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, count(*) OVER (PARTITION BY conv_id) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN k = 1 OR k = n THEN 0 ELSE 1 END, chars DESC, turn) AS r FROM steps)
SELECT conv_id, turn, chars FROM ranked WHERE r <= greatest(2, floor((4 * 212 - 400) / 150.0))""")
def token_budget_trim(spark, sf_dir):
    steps = P.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    return V.trim_to_budget(steps, ["conv_id"], "turn", "chars", F.lit(212))


@query(f"""WITH {_TOP4}, named AS (SELECT src, dst, confidence, k, a.p_name AS x, b.p_name AS y FROM top4 JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst)
SELECT src, string_agg('    n' || src || '["' || x || '"] ' || CASE WHEN confidence >= 0.8 THEN '==>' ELSE '-->' END || ' n' || dst || '["' || y || '"]', chr(10) ORDER BY k) AS chart FROM named GROUP BY src""")
def mermaid_edges(spark, sf_dir):
    from graphloom.operators.render import mermaid

    names = P.functions(spark, sf_dir).select("id", "name")
    return mermaid(E.top_fan_out(P.calls(spark, sf_dir), 4), names)


@query(f"""WITH {_TOP4}
SELECT src, string_agg('  n' || src || ' -> n' || dst || ' [penwidth=' || greatest(1, CAST(floor(3 * confidence) AS INTEGER)) || '];', chr(10) ORDER BY k) AS chart FROM top4 GROUP BY src""")
def dot_edges(spark, sf_dir):
    from graphloom.operators.render import dot

    return dot(E.top_fan_out(P.calls(spark, sf_dir), 4))


# --- inheritance and communities

_EXTENDS = """ext AS (SELECT b AS src, nxt AS dst FROM (SELECT b, lead(b) OVER (ORDER BY b) AS nxt FROM (SELECT DISTINCT p_brand AS b FROM part)) WHERE nxt IS NOT NULL),
anc AS (SELECT src AS class, dst AS base, 1 AS depth FROM ext UNION ALL SELECT a.src, b.dst, 2 FROM ext a JOIN ext b ON a.dst = b.src UNION ALL SELECT a.src, c.dst, 3 FROM ext a JOIN ext b ON a.dst = b.src JOIN ext c ON b.dst = c.src)"""


def _brand_chain(spark, sf_dir):
    """Each brand extends the next one."""
    from pyspark.sql import Window

    brands = P.table(spark, sf_dir, "part").select(F.col("p_brand").alias("src")).distinct()  # a few dozen rows
    return brands.withColumn("dst", F.lead("src").over(Window.orderBy("src"))).where("dst IS NOT NULL")


@query(f"WITH {_EXTENDS} SELECT class, base, CAST(min(depth) AS INTEGER) AS depth FROM anc GROUP BY class, base")
def class_ancestors(spark, sf_dir):
    from graphloom.operators.heritage import ancestors

    return ancestors(_brand_chain(spark, sf_dir))


@query(f"""WITH {CALLS}, {FUNCTIONS}, {_EXTENDS}, up AS (SELECT DISTINCT m.id, b.id AS base_id FROM fn m JOIN anc ON anc.class = m.class_name JOIN fn b ON b.name = m.name AND b.class_name = anc.base)
SELECT up.id, src AS caller, round(max(confidence) * 0.9, 4) AS confidence FROM up JOIN calls ON dst = base_id GROUP BY up.id, src""")
def interface_callers(spark, sf_dir):
    from graphloom.operators import heritage

    return heritage.interface_callers(P.functions(spark, sf_dir).select("id", "name", "class_name"), _brand_chain(spark, sf_dir), _calls(spark, sf_dir))


@query(f"""WITH {FUNCTIONS}, {_EXTENDS} SELECT DISTINCT m.id FROM fn m JOIN anc ON anc.class = m.class_name JOIN fn b ON b.name = m.name AND b.class_name = anc.base""")
def superclass_reachable(spark, sf_dir):
    from graphloom.operators import heritage

    return heritage.reachable_through_base(P.functions(spark, sf_dir).select("id", "name", "class_name"), _brand_chain(spark, sf_dir))


_WORD = "the"
_SPOKEN = """v AS (SELECT DISTINCT conv_id, turn, role, conv_id || ':' || turn || ':' || name AS id, name FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM conversations))"""


def _spoken(spark, sf_dir):
    """The words of a turn as variables of it: conv_id, turn, role, id, name."""
    words = P.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("name"))
    return words.select("conv_id", "turn", "role", F.concat_ws(":", "conv_id", "turn", "name").alias("id"), "name").distinct()


@query(f"""WITH {_SPOKEN}, f AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.name = b.name),
o AS (SELECT id FROM v WHERE name = '{_WORD}' ORDER BY id LIMIT 50)
SELECT DISTINCT src, dst FROM f WHERE src IN (FROM o) OR dst IN (FROM o)""")
def variable_trace(spark, sf_dir):
    from graphloom.operators import flow

    words = _spoken(spark, sf_dir)
    later = words.select("conv_id", "name", (F.col("turn") - 1).alias("turn"), F.col("id").alias("dst"))
    flows = words.withColumnRenamed("id", "src").join(later, ["conv_id", "name", "turn"]).select("src", "dst")
    return flow.touching(flows, flow.occurrences(words, _WORD))


@query(f"""WITH RECURSIVE {_SPOKEN}, w AS (SELECT conv_id, turn, role, id FROM v WHERE name = '{_WORD}'), firsts AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY 1),
r AS (SELECT w.* FROM w JOIN firsts USING (conv_id, turn) UNION SELECT w.* FROM r JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn + 1)
SELECT id FROM r UNION SELECT 'assistant' FROM r WHERE role = 'user'""")
def matched_flow(spark, sf_dir):
    """What is said in a first turn, and who takes it up: a user's turn calls the assistant that all conversations share, the answer returns."""
    from graphloom.operators import flow

    words = cut(_spoken(spark, sf_dir).where(F.col("name") == _WORD), "spoken")
    site = F.xxhash64("conv_id", "turn")
    calls = words.where("role = 'user'").select(site.alias("site"), F.col("id").alias("src"), F.lit("assistant").alias("dst"))
    pairs = words.select("conv_id", "turn", F.col("id").alias("src"), F.col("role").alias("from")).join(words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("id").alias("dst"), "role"), ["conv_id", "turn"])
    answer = (F.col("from") == "user") & (F.col("role") == "assistant")
    returns = pairs.where(answer).select(site.alias("site"), F.lit("assistant").alias("src"), "dst")
    firsts = P.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("turn"))
    seeds = words.join(firsts, ["conv_id", "turn"]).select("id")
    return flow.trace(seeds, calls, returns, pairs.where(~answer).select("src", "dst"))


@query()
def modularity_communities(spark, sf_dir):
    from graphloom.operators import modularity

    # a pair is linked if its surest call is sure enough, that is if any is: its calls need not be merged
    return modularity.modularity_communities(P.raw_calls(spark, sf_dir).select("src", "dst", "confidence"), LINKED)


@query()
def label_propagation(spark, sf_dir):
    from graphloom.operators import communities

    # a link weighs what its surest call does: its calls need not be merged
    return communities.label_propagation(P.raw_calls(spark, sf_dir).select("src", "dst", "confidence"), LINKED)


@query(f"""{_COMPONENTS}, named AS (SELECT component, p_name AS name, count(*) AS n FROM comp JOIN part ON p_partkey = id GROUP BY 1, 2),
top AS (SELECT component, name, row_number() OVER (PARTITION BY component ORDER BY n DESC, name) AS k, sum(n) OVER (PARTITION BY component) AS members FROM named)
SELECT component AS thread, name, CAST(members AS INTEGER) AS members FROM top WHERE k = 1""")
def variable_threads(spark, sf_dir):
    from graphloom.operators import communities

    return communities.threads(P.calls(spark, sf_dir), P.functions(spark, sf_dir)).select("thread", "name", F.size("members").alias("members"))


@query(f"""WITH {CALLS} SELECT 'functions' AS measure, count(*) AS value FROM part UNION ALL SELECT 'calls_' || reason, count(*) FROM calls GROUP BY reason""")
def health_report(spark, sf_dir):
    from graphloom.sources import sinks

    return sinks.health(P.calls(spark, sf_dir), P.functions(spark, sf_dir))
