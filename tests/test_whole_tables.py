"""Queries over whole tables against plain versions."""

from __future__ import annotations

import collections
import math

import duckdb
import pytest

from graphloom.plans import catalogue
from graphloom.plans.registry import CALLS
from tests.conftest import SF


@pytest.fixture(scope="module")
def calls():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return con.execute(f"WITH {CALLS} SELECT src, dst, confidence, reason FROM calls").fetchall()


def plain_components(edges):
    links = collections.defaultdict(set)
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    found = {}
    for root in sorted(links):
        todo = [] if root in found else [root]
        while todo:
            if (x := todo.pop()) not in found:
                found[x] = root
                todo += links[x]
    return found


def test_components_of_all_calls(spark, calls):
    want = plain_components((a, b) for a, b, *_ in calls)
    assert {r.id: r.component for r in catalogue.QUERIES["components"](spark, SF).collect()} == want
    sizes = collections.Counter(want.values())
    assert {r.thread: r.members for r in catalogue.QUERIES["variable_threads"](spark, SF).collect()} == sizes


@pytest.fixture(scope="module")
def functions():
    """Test flag, line count, name, class, module and file of each function."""
    rows = duckdb.execute(f"SELECT p_partkey, p_size, p_name, p_brand, lower(p_type) FROM '{SF}/part.parquet'").fetchall()
    return {k: (size <= 10, size, name, brand, kind, f"{kind}/{brand}") for k, size, name, brand, kind in rows}


def test_all_callers_count(spark, calls, functions):
    callers = collections.defaultdict(list)
    for src, dst, _, reason in calls:
        callers[dst].append((src, reason))
    got = {r.id: r for r in catalogue.QUERIES["dead_tiers"](spark, SF).collect()}
    assert got.keys() == functions.keys()
    for i, r in got.items():
        sure = [s for s, reason in callers[i] if reason != "fuzzy"]
        test = sum(functions[s][0] for s in sure)
        script = sum(not functions[s][0] and functions[s][1] > 45 for s in sure)
        assert (r.total, r.fuzzy, r.test, r.script, r.prod) == (len(callers[i]), len(callers[i]) - len(sure), test, script, len(sure) - test - script)
        assert ("definitely" in r.tier) <= (not callers[i])
    tested = {dst for src, dst, *_ in calls if functions[src][0]}
    for query, at in (("test_coverage_map", 4), ("any_call_coverage_map", 5)):
        own = [(f[at], i in tested) for i, f in functions.items() if not f[0]]
        want = {k: (n, sum(t for by, t in own if by == k)) for k, n in collections.Counter(by for by, _ in own).items()}
        assert {r[0]: (r.total, r.tested) for r in catalogue.QUERIES[query](spark, SF).collect()} == want
    best = {}
    for i, (is_test, _, name, brand, _, path) in sorted(functions.items()):
        score = (-5 if is_test else 1) + 1 + 3 * bool(callers[i]) + 2 * (brand.lower() == name.lower())
        best[name] = min(best.get(name, (9, "", 0)), (-score, path, i))
    assert {r.name: (-r.score, r.id) for r in catalogue.QUERIES["duplicate_canonical"](spark, SF).collect()} == {n: (s, i) for n, (s, _, i) in best.items()}


def test_traversals_at_the_floors_of_the_survey(spark, calls, functions):
    def walk(edges, hops):
        """Hop and score of each node that ``edges`` lead to from node 1."""
        found = {1: (0, 0.01 + math.log(2) / 1000)}
        last = dict(found)
        for hop in range(1, hops + 1):
            fresh = {}
            for a, b, c in edges:
                if a in last and b not in found:
                    fresh[b] = max(fresh.get(b, (hop, 0)), (hop, last[a][1] * 0.7 * c))
            found |= fresh
            last = fresh
        return found

    run = lambda name: catalogue.QUERIES[name](spark, SF).collect()
    back, ahead = ([(r[a], r[b], r[2]) for r in calls] for a, b in ((1, 0), (0, 1)))
    deep = walk([e for e in back if e[2] >= 0.8], 3)
    assert {r.id: r.hop for r in run("dependents_by_depth")} == {i: h for i, (h, _) in deep.items()}
    assert {r.id: r.hop for r in run("dependencies_by_depth")} == {i: h for i, (h, _) in walk([e for e in ahead if e[2] >= 0.8], 3).items()}
    by_hop = collections.defaultdict(list)
    for i, (h, _) in deep.items():
        by_hop[h].append(functions[i][5])
    assert {r.hop: (r.functions, r.files) for r in run("impact_by_file")} == {h: (len(p), len(set(p))) for h, p in by_hop.items() if h}
    got = {r.id: (r.hop, r.score) for r in run("diff_impact")}
    want = walk(back, 5)
    assert got.keys() == want.keys() and all(got[i][0] == h and abs(got[i][1] - s) < 1e-11 for i, (h, s) in want.items())
    linked = {x for a, b, c, _ in calls if c >= 0.5 for x in (a, b)}
    assert {r.id for r in run("label_propagation")} == linked
    brands = sorted({f[3] for f in functions.values()})
    above = {b: brands[k + 1 : k + 4] for k, b in enumerate(brands)}
    bases = collections.defaultdict(list)
    for i, f in functions.items():
        bases[f[2], f[3]].append(i)
    into = collections.defaultdict(list)
    for a, b, c, _ in calls:
        into[b].append((a, c))
    want = {}
    for i, f in functions.items():
        for brand in above[f[3]]:
            for base in bases[f[2], brand]:
                for a, c in into[base]:
                    want[i, a] = max(want.get((i, a), 0), round(c * 0.9, 4))
    assert {(r.id, r.caller): r.confidence for r in run("interface_callers")} == want


def test_texts_and_events_are_read(spark, tmp_path):
    docs = [(1, "cfg['db.url'] and config.get('k')\nYou MUST NOT share cursors between workers."), (2, "cfg['db.url']"), (3, None), (4, "plain prose")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([('{"k": 1, "m": 2}',), ('{"k": 3}',), (None,), ("broken",)], "props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.key: (r.usage_count, r.files) for r in catalogue.QUERIES["config_registry"](spark, str(tmp_path)).collect()}
    assert got == {"db.url": (2, "documents"), "k": (3, "documents,events"), "m": (1, "events")}
    found = {r.doc_id: r.found for r in catalogue.QUERIES["invariant_extract"](spark, str(tmp_path)).collect()}
    assert found == {1: "constraint=MUST NOT share cursors between workers", 2: "", 3: "", 4: ""}
    assert catalogue.QUERIES["invariant_extract"](spark, SF).count() == duckdb.execute(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchone()[0]
