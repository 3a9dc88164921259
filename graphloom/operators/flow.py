"""How values flow through variables: arguments into parameters, returned values into what they are assigned to.

A flow enters a function at a call site and must leave it through the same one.
What a function does with a parameter is therefore summed up first, as flows
across its call sites, in a semi-naive fixpoint: each round joins only what the
round before found. A trace then climbs out of callers' calls, never back into
them, and after that goes down into callees, never out of them by another site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import cut

#: Occurrences that a trace of a name lists.
MOST_OCCURRENCES = 50


def bind_arguments(sites: DataFrame, variables: DataFrame) -> DataFrame:
    """(site, src, dst, confidence): variables given as arguments flow into the parameters they bind.

    ``sites``: site, caller, callee, arguments (array of texts), keywords (map of name to text), confidence.
    ``variables``: id, function, name, position (of parameters, from 0; null for others). The i-th argument binds
    the i-th parameter, a keyword the parameter of its name; texts that are not a variable of the caller bind nothing.
    """
    placed = sites.select("site", "caller", "callee", "confidence", F.posexplode("arguments").alias("position", "text"))
    named = sites.select("site", "caller", "callee", "confidence", F.explode("keywords").alias("name", "text"))
    parameters = variables.where("position IS NOT NULL").select(F.col("function").alias("callee"), F.col("position").cast("int").alias("position"), "name", F.col("id").alias("dst"))
    columns = ["site", "caller", "text", "dst", "confidence"]
    bound = placed.join(parameters.drop("name"), ["callee", "position"]).select(columns).unionByName(named.join(parameters.drop("position"), ["callee", "name"]).select(columns))
    given = variables.select(F.col("function").alias("caller"), F.col("name").alias("text"), F.col("id").alias("src"))
    return bound.join(given, ["caller", "text"]).groupBy("site", "src", "dst").agg(F.max("confidence").alias("confidence"))


def bind_returns(sites: DataFrame, variables: DataFrame) -> DataFrame:
    """(site, src, dst, confidence): returned variables of the callee flow into what the call is assigned to.

    ``sites`` as for arguments, with ``target``: the variable of the caller, or null. ``variables`` with ``is_return``.
    """
    back = variables.where("is_return").select(F.col("function").alias("callee"), F.col("id").alias("src"))
    into = variables.select(F.col("function").alias("caller"), F.col("name").alias("target"), F.col("id").alias("dst"))
    return sites.where("target IS NOT NULL").join(back, "callee").join(into, ["caller", "target"]).groupBy("site", "src", "dst").agg(F.max("confidence").alias("confidence"))


def summaries(calls: DataFrame, returns: DataFrame, inside: DataFrame, rounds: int = 1000) -> DataFrame:
    """(src, dst): flows across call sites, from an argument to what the call is assigned to, through any depth of calls.

    ``calls`` and ``returns`` (site, src, dst) bind arguments and returned values; ``inside`` (src, dst) are flows
    within a function. A round takes the pairs (parameter, variable it reaches) that are new, makes the crossings that
    they complete, and follows flows and crossings from the new pairs, and new crossings from all pairs.
    """
    inside = cut(inside.select("src", "dst").distinct(), "flow-inside")
    entries = cut(calls.select("site", F.col("src").alias("given"), F.col("dst").alias("p")).distinct(), "flow-entries")
    exits = cut(returns.select("site", F.col("src").alias("v"), F.col("dst").alias("target")).distinct(), "flow-exits")
    reached = cut(entries.select("p", F.col("p").alias("v")).distinct(), "flow-reached")  # all pairs
    new, crossings = reached, cut(inside.limit(0), "flow-crossings")
    for _ in range(rounds):
        completed = new.join(exits, "v").join(entries, ["p", "site"]).select(F.col("given").alias("src"), F.col("target").alias("dst")).distinct()
        crossed = cut(completed.join(crossings, ["src", "dst"], "left_anti"), "flow-crossed")
        every = cut(crossings.unionByName(crossed), "flow-crossings")
        ahead = new.join(inside.unionByName(every), F.col("v") == F.col("src")).select("p", F.col("dst").alias("v"))
        over = reached.join(crossed, F.col("v") == F.col("src")).select("p", F.col("dst").alias("v"))
        new = cut(ahead.unionByName(over).distinct().join(reached, ["p", "v"], "left_anti"), "flow-new")
        crossings = every
        if new.isEmpty():
            return crossings
        reached = cut(reached.unionByName(new), "flow-reached")
    raise RuntimeError(f"flows did not settle in {rounds} rounds")


def trace(seeds: DataFrame, calls: DataFrame, returns: DataFrame, inside: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id): all variables that a value of the ``seeds`` (id) may flow into; seeds included.

    A value may leave the function it starts in through any of its callers, for it is not known who called; once
    it has entered a function it leaves that only where it came from, which is what the crossings say.
    """
    level = cut(inside.select("src", "dst").unionByName(summaries(calls, returns, inside)).distinct(), "flow-level")
    out = cut(level.unionByName(returns.select("src", "dst")).distinct(), "flow-out")
    into = cut(level.unionByName(calls.select("src", "dst")).distinct(), "flow-into")
    return _closure(_closure(seeds.select("id").distinct(), out, rounds), into, rounds)


def _closure(seeds: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    found = new = cut(seeds, "flow-found")
    for _ in range(rounds):
        new = cut(edges.join(new, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti"), "flow-new")
        if new.isEmpty():
            return found
        found = cut(found.unionByName(new), "flow-found")
    raise RuntimeError(f"the trace did not settle in {rounds} rounds")


def occurrences(variables: DataFrame, name: str, most: int = MOST_OCCURRENCES) -> DataFrame:
    """The variables of a name, the first by id."""
    return variables.where(F.col("name") == name).orderBy("id").limit(most)


def touching(flows: DataFrame, found: DataFrame) -> DataFrame:
    """The flows of which an end is among ``found`` (id): few rows, so each side is a semi-join."""
    ends = found.select("id")
    hit = flows.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst")
    return hit.unionByName(flows.join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")).distinct()
