"""Work that has to grow with its input, and steps that have to end, on small tables that show when they do not."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import communities, heritage, lookup, modularity
from graphloom.operators import doc_warnings as D
from graphloom.plans import catalogue, shared
from graphloom.sources import projection as P
from tests.conftest import SF

MANY = 20_000


def methods(spark):
    """``MANY`` methods m of class A (even ids), as many of class B (odd ids)."""
    return spark.range(2 * MANY).select("id", F.lit("m").alias("name"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("class_name"))


def test_base_methods_of_one_name_meet_one_row(spark):
    began = time.monotonic()
    above = spark.createDataFrame([("A", "B")], "class_name string, ancestor string")
    many = methods(spark).unionByName(methods(spark).withColumn("id", F.col("id") + 2 * MANY))
    got = lookup.base_methods(many, above).agg(F.count("*").alias("n"), F.min("base_id").alias("low"), F.max("base_id").alias("high")).first()
    assert tuple(got) == (2 * MANY, 1, 1)
    assert time.monotonic() - began < 40  # 1,600,000,000 pairs of methods before


def test_interface_callers_of_one_name_are_found_once(spark):
    began = time.monotonic()
    extends = spark.createDataFrame([("A", "B")], "src string, dst string")
    calls = spark.range(MANY).select(F.lit(7).cast("long").alias("src"), (2 * F.col("id") + 1).alias("dst"), F.when(F.col("id") == 5, 0.8).otherwise(0.5).alias("confidence"))
    got = heritage.interface_callers(methods(spark), extends, calls).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("caller").alias("caller"), F.min("confidence").alias("confidence")).first()
    assert tuple(got) == (MANY, MANY, 7, 0.72)
    assert time.monotonic() - began < 40  # 400,000,000 pairs of methods before


def test_files_of_interface_callers_hold_little_more_than_the_callers(spark, tmp_path):
    extends = spark.createDataFrame([("A", "B")], "src string, dst string")
    few = methods(spark).where(F.col("id") < 400)  # 200 in each class
    calls = spark.range(20_000).select((F.col("id") * 7919 + 10**12).alias("src"), F.lit(1).cast("long").alias("dst"), F.lit(0.5).alias("confidence"))
    heritage.interface_callers(few, extends, calls).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4_000_000  # a byte a row; several before


def test_interface_callers_of_an_id_under_two_names(spark):
    twice = spark.createDataFrame([(1, "m", "A"), (1, "k", "A"), (2, "m", "B"), (3, "k", "B"), (4, None, "A")], "id long, name string, class_name string")
    extends = spark.createDataFrame([("A", "B")], "src string, dst string")
    calls = spark.createDataFrame([(9, 2, 0.5), (9, 3, 0.7), (8, 3, None)], "src long, dst long, confidence double")
    assert sorted(heritage.interface_callers(twice, extends, calls).collect(), key=str) == [(1, 8, None), (1, 9, 0.63)]


def test_labels_settle_where_neighbours_change_places(spark):
    links = [(2, 3, 1.0), (1, 2, 1.0), (1, 5, 0.75), (0, 2, 0.5), (4, 5, 1.0)]  # two halves in turn come back to the same labels every four turns
    labels = {r.id: r.community for r in communities.label_propagation(spark.createDataFrame(links, "src long, dst long, confidence double")).collect()}
    assert labels.keys() == set(range(6))
    for node, own in labels.items():
        weight = {own: 0.5}
        for u, v, w in links:
            if node in (u, v):
                near = labels[v if node == u else u]
                weight[near] = weight.get(near, 0) + w
        assert own == min(weight, key=lambda c: (-weight[c], c))


def test_labels_travel_in_blocks(spark, monkeypatch):
    links = spark.range(40_000).select((F.col("id") % 2_000).alias("src"), (F.col("id") * 7 % 1_999 + 3_000).alias("dst"), F.lit(1.0).alias("confidence"))
    run = lambda: {r.id: r.community for r in communities.label_propagation(links).collect()}
    whole, packed, made = run(), [], communities._packed
    monkeypatch.setattr(modularity, "ROWS", 5_000)
    monkeypatch.setattr(communities, "_packed", lambda *a: packed.append(made(*a)) or packed[-1])
    assert run() == whole and len(whole) == 3_999
    rows = [p.count() for p in packed]
    assert len(rows) == 2 and max(rows) <= modularity.buckets(links.unionByName(links)) ** 2 < 40_000 / 100  # each link was a row of its own in every turn before


def test_tasks_do_not_grow_with_the_tables(spark, monkeypatch):
    run = lambda: {name: sorted(map(tuple, catalogue.QUERIES[name](spark, SF).collect())) for name in ("file_coupling", "integrity_violations", "components", "variable_threads")}
    whole = run()
    monkeypatch.setattr(shared, "ROWS", 500)  # the smallest tables in many partitions
    rows = P.table(spark, SF, "lineitem").count()
    assert P.raw_calls(spark, SF).rdd.getNumPartitions() == -(-rows // 500) > 4
    assert run() == whole


def test_invariants_of_texts_without_their_words_cost_little(spark):
    said = [
        "INV-12: rows keep their order at all times", "invariant: sums never fall below zero", "Contract: callers close what they open", "the sum stays whole (INV-7) after each step", "ensures: the file is closed afterwards",
        "this is Thread-Safe by design", "not reentrant: no locks", "we Never drop a row of a table", "NEVER  drop rows anywhere", "MUST NOT be called twice", "DO\\tNOT call this twice".replace("\\t", "\t"), "ALWAYS close the session", "MUST close the session", "must be started before use",
    ]
    texts = spark.createDataFrame([(t,) for t in said] + [(None,), ("plain",)], "text string")
    plain = [F.regexp_extract_all("text", F.lit(p), F.lit(1)) for _, p in T.INVARIANTS]
    rows = texts.select("text", T.invariants(F.col("text")).alias("got"), F.concat(*plain).alias("want")).collect()
    for r in rows:
        assert (r.got is None) == (r.text is None)
        short = {w.strip()[:60].lower(): 1 for w in r.want or [] if 10 <= len(w.strip()) <= 200}
        assert [s.text[:60].lower() for s in r.got or []] == list(short)
        assert (r.text in (None, "plain")) == (not r.got)
    began = time.monotonic()
    long = spark.range(4).select(F.repeat(F.lit("plain prose of no statement at all "), 400_000).alias("text"))
    assert long.select(F.size(T.invariants(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == 0
    assert time.monotonic() - began < 40  # 56 MB; each pattern looked up to 180 characters ahead of each of them before


def test_states_of_a_long_document(spark):
    began = time.monotonic()
    long = spark.range(1).select(F.lit("d").alias("path"), F.concat(F.repeat(F.lit("x\n"), 100_000), F.lit("```\ny\n```\n")).alias("text"))
    got = D.lines_of(long).agg(F.count("*").alias("n"), F.count_if("fenced").alias("fenced"), F.count_if("example").alias("example")).first()
    assert tuple(got) == (100_004, 2, 0)  # the line between the fences and the one that closes
    assert time.monotonic() - began < 40  # 5,000,000,000 steps before
