"""Corpus operators that look at all rows together, against plain versions of the same."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import cotrain, jaccard_join, line_dedup, queries, shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(s, most, letters="abcdeé😀"):
    s = list(s)
    for _ in range(random.randint(0, most)):
        k, what = random.randrange(len(s) + 1), random.random()
        if what < 0.4 and k < len(s):
            s[k] = random.choice(letters)
        elif what < 0.7:
            s.insert(k, random.choice(letters))
        elif k < len(s):
            del s[k]
    return "".join(s)


# --- shards


def test_shards_are_contiguous_and_even(spark, tmp_path):
    random.seed(2)
    rows = [(i, "é" * random.randint(0, 400)) for i in range(500)] + [(7, "twin"), (7, "twin"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(9)).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    loads, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest, share = max(r.size for r in got), sum(loads.values()) / 8
    assert all(abs(v - share) <= 2 * largest for v in loads.values())
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id or -1 for r in order] == sorted(r.doc_id or -1 for r in order)


def test_shards_of_odd_tables(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)], "k long, size long")
    assert collections.Counter(r.shard for r in shards.assign_shards(df, 5, "size", ["k"]).collect()) == {i: 2 for i in range(5)}
    assert shards.assign_shards(df.limit(0), 3, "size", ["k"]).count() == 0


# --- lines


@pytest.mark.parametrize("threshold", [1, 2, 3, 7, 30])
def test_banded_distance(spark, threshold):
    random.seed(5)
    base = ["".join(random.choice("abcdeé 😀") for _ in range(random.randint(5, 70))) for _ in range(120)]
    pairs = [p for a in base for _ in range(3) for p in [sorted((a, mutated(a, threshold + 2)), key=len, reverse=True)] if len(p[1]) > threshold]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.codes(F.col("a")).alias("x"), line_dedup.codes(F.col("b")).alias("y"))
    df = df.withColumn("most", F.lit(threshold))
    for cut in (df, line_dedup.trimmed(df, "x", "y", F.col("most"))):
        for r in cut.select("a", "b", line_dedup.edit_distance(F.col("x"), F.col("y"), F.lit(threshold)).alias("d")).collect():
            assert min(r.d, threshold + 1) == min(distance(r.a, r.b), threshold + 1)


def test_line_dedup_equals_brute_force(spark):
    random.seed(6)
    lines = [mutated(b, 4, "abcdefgh") for b in ("".join(random.choice("abcdefgh ") for _ in range(random.choice([10, 25, 62, 63, 80]))) for _ in range(60)) for _ in range(random.randint(1, 5))]
    docs = [(i, "\n".join(random.choice(lines) for _ in range(random.randint(1, 6)))) for i in range(80)] + [(None, "x" * 30), (None, None), (500, ""), (501, "  \n\n"), (3, "y" * 40), (3, "y" * 40)]
    df = spark.createDataFrame([(i, t, t) for i, t in docs], "doc_id long, text string, was string").withColumns({c: F.lit("clash") for c in ("line", "gone", "_gone", "_word", "r1", "in", "row")})
    hashes = {(r.doc_id, r.text): r.r1 for r in df.select("doc_id", "text", *line_dedup._row_hash("doc_id", "text")).collect()}
    seen = sorted({((-1 if d is None else d), hashes[(d, t)], k, line, d, t) for d, t in docs if t is not None for k, line in enumerate(t.split("\n")) if line.strip()}, key=lambda o: o[:3])
    first = {}
    for o in seen:
        first.setdefault(o[3], o[:3])
    names, near = list(first), set()
    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= 10 and distance(a, b) <= line_dedup.edits(max(len(a), len(b))):
                near.add(a if first[b] < first[a] else b)
    gone = collections.defaultdict(list)
    for o in seen:
        if o[3] in near or o[:3] != first[o[3]]:
            gone[o[4:]].append(o[2])
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(docs) and near
    for r in got:
        lost = gone.get((r.doc_id, r.was))
        assert r._gone == lost
        assert r.text == (r.was if r.was is None else "\n".join(x for k, x in enumerate(r.was.split("\n")) if not lost or k not in lost))
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# --- n-gram join


def brute_classes(docs):
    sets = {}
    for key, text in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(5, len(w))
        sets[key] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    parent = {k: k for k in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = collections.defaultdict(list)
    for i in sorted(sets):
        for j, o in collections.Counter(j for t in sets[i] for j in where[t]).items():
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for t in sets[i]:
            where[t].append(i)
    return {k: (len(sets[k]), find(k)) for k in sets}


def family_docs():
    random.seed(2)
    vocabulary, docs = [f"w{i}" for i in range(300)], []
    for _ in range(24):
        base = [random.choice(vocabulary) for _ in range(random.choice([3, 6, 9, 12, 40, 80, 200]))]
        for _ in range(random.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(random.randint(0, 4)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            docs.append((len(docs) * 7, " ".join(words)))
    return docs + [(99991, None), (99992, ""), (99993, "a"), (99994, "A")]


@pytest.mark.parametrize("block", [1_000_000, 400])
def test_jaccard_join_equals_brute_force(spark, block):
    docs = family_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("token", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, block=block).collect()}
    want = brute_classes(docs)
    assert got == want and sum(v[1] != k for k, v in want.items()) > 20


def test_jaccard_join_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.component_id) for r in jaccard_join.join(df).collect()) == [(0, None), (1, 1), (1, 1), (2, 1)]
    assert jaccard_join.join(df.limit(0)).count() == 0
    named = df.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text").unionByName(spark.createDataFrame([("x", "long " * 200_000), ("y", "long " * 200_001), ("z", "")], "doc_id string, text string"))
    assert sorted((r.doc_id or "", r.component_id) for r in jaccard_join.join(named).collect()) == [("", None), ("d1", "d1"), ("d1", "d1"), ("d2", "d1"), ("x", "x"), ("y", "x"), ("z", "z")]


def test_jaccard_join_does_not_compare_all_that_quote_one_passage(spark, monkeypatch):
    quote = " ".join(f"q{i}" for i in range(60))
    docs = [(k, f"{quote} " + " ".join(f"own{k}_{i}" for i in range(60))) for k in range(60)]
    docs += [(100 + k, f"{docs[k][1]} end") for k in range(3)]
    sent, classes = [], jaccard_join._classes
    monkeypatch.setattr(jaccard_join, "_classes", lambda docs, key, text, blocks, *a: sent.append(blocks.count()) or classes(docs, key, text, blocks, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string"), block=400).collect()}
    assert got == brute_classes(docs)
    assert sum(sent) < 100  # each set stood beside all others before


def test_jaccard_join_of_repeated_rows_that_link(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, f"{text} x")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(df).collect())) == [(1, 56, 1), (1, 56, 1), (2, 57, 1)]


def test_trie_join_equals_brute_force():
    random.seed(9)
    for _ in range(200):
        base = [np.array(random.sample(range(40), random.randint(1, 14)), np.uint64) for _ in range(4)]
        sets = []
        for b in base:
            for _ in range(random.randint(1, 6)):
                keep = [x for x in b if random.random() < 0.9] + random.sample(range(50, 90), random.randint(0, 2))
                if keep and not any(set(keep) == set(s) for s in sets):
                    sets.append(np.unique(np.array(keep, np.uint64)))
        roots, parent = jaccard_join.trie_join(sets), list(range(len(sets)))
        for _ in sets:
            for i in range(len(sets)):
                for j in range(i):
                    o = len(set(sets[i]) & set(sets[j]))
                    if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                        parent[i] = parent[j] = min(parent[i], parent[j])
        assert roots == parent


# --- classifier


def test_classifier_on_held_out_labels(spark, sf_dir):
    import pandas as pd

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has too few labels
    d = pd.read_parquet(f"{sf_dir}/documents.parquet").merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    y = ((d.quality == 1) & (d.toxic != 1)).to_numpy().astype(float)
    texts, metas = [cotrain.text_view(t) for t in d.text], [cotrain.meta_view(*m) for m in zip(d.lang, d.source, d.n_chars)]
    hidden = np.arange(len(y)) % 4 == 0
    model = cotrain.co_train(cotrain.Rows.of(texts), cotrain.Rows.of(metas), np.where(hidden, np.nan, y))
    score = lambda views, w: np.array([w[a] @ v for a, v in views])
    kept = model.combine(score(texts, model.text), score(metas, model.meta)) >= model.threshold
    assert (kept == (y > 0.5))[hidden].mean() > 0.9


def test_classifier_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "x", "en", "s", 1), (None, "y", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1)], "doc_id long, quality int, toxic int")
    model = cotrain.fit(docs, labels)
    assert model is None and [r.kept for r in cotrain.score(docs, model).collect()] == [True] * 3
    both = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert cotrain.score(docs, cotrain.fit(docs, both)).count() == 3 and cotrain.score(docs.limit(0), None).count() == 0


# --- pipeline


def test_pipeline_on_a_small_corpus(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    last = P.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == counts[-1]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(texts.values())) == len(texts)
