"""Value flow with matched calls and returns."""

from __future__ import annotations

import random

from graphloom.operators import flow


def edges(spark, rows):
    return spark.createDataFrame(rows, "site long, src string, dst string")


def inner(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def realizable(seeds, calls, returns, inside) -> set:
    """All reachable variables by naive closure of balanced pairs, then of exits, then of entries."""
    nodes = {x for _, a, b in calls + returns for x in (a, b)} | {x for e in inside for x in e} | set(seeds)
    balanced = {(x, x) for x in nodes} | set(inside)
    while True:
        more = {(a, d) for a, b in balanced for c, d in balanced if b == c}
        more |= {(a, t) for s, a, p in calls for s2, r, t in returns if s == s2 and (p, r) in balanced}
        if more <= balanced:
            break
        balanced |= more

    def closure(found, steps):
        while more := {d for a, d in balanced | steps if a in found} - found:
            found = found | more
        return found

    up = closure(set(seeds), {(a, b) for _, a, b in returns})
    return closure(up, {(a, b) for _, a, b in calls})


def traced(spark, seeds, calls, returns, inside) -> set:
    return {r.id for r in flow.trace(spark.createDataFrame([(s,) for s in seeds], "id string"), edges(spark, calls), edges(spark, returns), inner(spark, inside)).collect()}


def test_an_unmatched_return_does_not_flow(spark):
    # f gives its parameter back; it is called from a at site 1 and from b at site 2
    calls, returns = [(1, "a.x", "f.p"), (2, "b.y", "f.p")], [(1, "f.r", "a.z"), (2, "f.r", "b.w")]
    inside = [("f.p", "f.r")]
    assert traced(spark, ["a.x"], calls, returns, inside) == {"a.x", "f.p", "f.r", "a.z"}
    # who called is not known where the trace begins inside f: both may get it
    assert traced(spark, ["f.p"], calls, returns, inside) == {"f.p", "f.r", "a.z", "b.w"}


def test_recursion_and_depth_against_the_naive_closure(spark):
    rng = random.Random(4)
    functions = ["f", "g", "h", "k", "m"]
    variables = {f: [f"{f}.p", f"{f}.q", f"{f}.r", f"{f}.v"] for f in functions}
    inside = [(rng.choice(variables[f]), rng.choice(variables[f])) for f in functions for _ in range(2)]
    calls, returns = [], []
    for site in range(9):
        a, b = rng.choice(functions), rng.choice(functions)
        calls.append((site, rng.choice(variables[a]), f"{b}.p"))
        if rng.random() < 0.8:
            returns.append((site, f"{b}.r", rng.choice(variables[a])))
    for seed in ("f.p", "k.v"):
        assert traced(spark, [seed], calls, returns, inside) == realizable([seed], calls, returns, inside)
    assert traced(spark, ["z"], [], [], []) == {"z"}


def test_binding(spark):
    sites = spark.createDataFrame(
        [(1, "main", "f", ["a", "b + 1", "c"], {"z": "d"}, "out", 0.9), (2, "main", "g", ["a"], None, None, 0.5), (2, "main", "g", ["a"], None, None, 0.7)],
        "site long, caller string, callee string, arguments array<string>, keywords map<string,string>, target string, confidence double",
    )
    variables = spark.createDataFrame(
        [("main.a", "main", "a", None, False), ("main.c", "main", "c", None, False), ("main.d", "main", "d", None, False), ("main.out", "main", "out", None, False), ("f.x", "f", "x", 0, True), ("f.y", "f", "y", 1, False), ("f.z", "f", "z", 2, False), ("g.a", "g", "a", 0, False)],
        "id string, function string, name string, position int, is_return boolean",
    )
    got = {tuple(r) for r in flow.bind_arguments(sites, variables).collect()}
    assert got == {(1, "main.a", "f.x", 0.9), (1, "main.c", "f.z", 0.9), (1, "main.d", "f.z", 0.9), (2, "main.a", "g.a", 0.7)}
    assert [tuple(r) for r in flow.bind_returns(sites, variables).collect()] == [(1, "f.x", "main.out", 0.9)]
    flows = flow.bind_arguments(sites, variables)
    assert [r.id for r in flow.occurrences(variables, "a").collect()] == ["g.a", "main.a"]
    assert {tuple(r) for r in flow.touching(flows, flow.occurrences(variables, "a", 1)).collect()} == {("main.a", "g.a")}
