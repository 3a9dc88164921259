"""Line dedup by thresholds that grow with the line, against brute force."""

from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F

from graphloom.llm import line_dedup, queries
from tests.llm.test_corpus_ops import distance, mutated


most = line_dedup.edits


def brute_force(docs):
    """Numbers of the lines that go, by document; ``docs`` has (id, text), ids ascending."""
    seen = [(d, k, x) for d, t in docs for k, x in enumerate(t.split("\n")) if x.strip()]
    first = {}
    for d, k, x in seen:
        first.setdefault(x, (d, k))
    names, near = sorted(first, key=first.get), set()
    for i, b in enumerate(names):
        for a in names[:i]:
            n = max(len(a), len(b))
            if min(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= most(n) and distance(a, b) <= most(n):
                near.add(b)
                break
    gone = collections.defaultdict(list)
    for d, k, x in seen:
        if x in near or first[x] != (d, k):
            gone[d].append(k)
    return dict(gone), near


def made(lengths, letters="abcdefghijklmnop "):
    random.seed(11)
    base = ["".join(random.choice(letters) for _ in range(n)) for n in lengths]
    lines = [mutated(b, most(len(b)) + 1, letters) for b in base for _ in range(3)]
    random.shuffle(lines)
    return [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4)]


def agrees(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, near = brute_force(docs)
    got = {r.doc_id: r._gone for r in line_dedup.dedup_lines(df).collect() if r._gone}
    assert near and got == want
    return near


def test_thresholds_grow_with_the_line(spark):
    near = agrees(spark, made([60, 63, 64, 65, 99, 140, 144, 147, 200, 256, 259, 320, 400, 403, 576, 580, 790] * 3))
    assert any(len(x) > 150 for x in near)


def test_every_length_that_starts_a_class(spark):
    docs = made([n + d for n in line_dedup._CLASSES[:9] for d in (-2, -1, 0, 1)], "abc ")
    agrees(spark, docs)


def test_lines_beyond_the_last_class(spark):
    random.seed(3)
    long = "".join(random.choice("abcdef ") for _ in range(40_000))
    spots = random.sample(range(1, 40_000, 97), 40)
    changed = lambda at, new: "".join(new if i in at else c for i, c in enumerate(long))
    df = spark.createDataFrame([(1, long), (2, "x" + changed({*spots[:29]}, "#")), (3, changed({*spots[9:]}, "%"))], "doc_id long, text string")
    assert {r.doc_id: r._gone for r in line_dedup.dedup_lines(df).collect()} == {1: None, 2: [0], 3: None}


def test_short_lines_count(spark):
    docs = made([3, 5, 9, 10, 12, 19, 20, 23, 35, 36, 40, 58, 61] * 2) + [(900, "Les.\n\nLes.\n \nThe."), (901, "The.\nLes.")]
    near = agrees(spark, docs)
    assert any(10 <= len(x) < 20 for x in near) and any(20 <= len(x) < 60 for x in near)


def test_query_takes_out_a_line_with_one_word_changed(spark, tmp_path):
    line = " ".join(f"word{i} stands here" for i in range(40))
    docs = [(1, line), (2, line.replace("word7 ", "another "))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_gone for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_sketches_bound_the_distance(spark):
    """Pairs turn four bits an edit at most and counts two: also at both ends, and for lines too long to be counted."""
    random.seed(5)
    letters = "abcdefghijklmnop éE"
    base = ["".join(random.choice(letters) for _ in range(n)) for n in (10, 40, 300)]
    texts = [(x, y) for x in base for y in (x[1:], x[:-1], x + "a", "a" + x, x[:-1] + "#", "#" + x[1:], x[:5] + x[6:], mutated(x, 3, letters))]
    long = "ab" * 17_000
    texts.append((long, long + "c"))
    rows = [(2 * i + side, t) for i, pair in enumerate(texts) for side, t in enumerate(pair)]
    got = {r.h: r for r in line_dedup._sketches(spark.createDataFrame(rows, "h long, line string")).collect()}
    bits = lambda a, b, names: sum(bin((a[c] ^ b[c]) & (1 << 64) - 1).count("1") for c in names)
    for i, (x, y) in enumerate(texts[:-1]):
        d = distance(x, y)
        pairs, counts = (bits(got[2 * i], got[2 * i + 1], names) for names in (("s0", "s1", "s2", "s3"), ("l0", "l1")))
        assert pairs <= 4 * d and counts <= 2 * d and (pairs or counts or not d)
    assert all(got[2 * len(texts) - k].l0 is None and got[2 * len(texts) - k].s0 is not None for k in (1, 2))


def test_keys_whose_lines_have_all_met_are_not_looked_up_again(spark, monkeypatch):
    """Rounds after the first read only keys with more rows than have met."""
    seen, met = [], line_dedup._meeting
    monkeypatch.setattr(line_dedup, "_meeting", lambda later, earlier: (seen.append(later.count()), met(later, earlier))[1])
    agrees(spark, made([60, 145, 300, 420] * 2))
    assert seen[0] > 0 and seen[-1] == 0


def test_many_lines_of_one_key(spark):
    """More lines than the earliest ones that begin alike: the last round holds all against all."""
    random.seed(9)
    rest = lambda n: "".join(random.choice("abcdefghijklmnop ") for _ in range(n))
    head = rest(24)
    lines = [head + rest(46) for _ in range(14)]
    lines += [mutated(x, 2, "abcdefghijklmnop ") for x in lines[9:]]
    agrees(spark, [(i, x) for i, x in enumerate(lines)])


def test_what_counts_is_seen_from_the_left(spark):
    rows = [(x, bool(x.strip(" \t\x0b\f\r"))) for x in ("", " ", "\t \x0b\f\r", "  a", "a  ", " a ", "\u00a0", "\r\u2003", "é\t")]
    df = spark.createDataFrame(rows, "line string, want boolean")
    assert df.where(line_dedup._counts(F.col("line")) != F.col("want")).count() == 0
