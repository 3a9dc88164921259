"""Phrase mining against SQL and a plain version."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from graphloom.llm import phrases
from graphloom.llm.queries import ORACLE_SQL, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_mine(docs: list[tuple]) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= 30}
        longest = Counter()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        rows = []
        for p, a in frequent.items():
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if 100 * longest[p] < 80 * a:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:2000], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, rows: list[tuple], schema: str = "text string, lang string") -> list[tuple]:
    return sorted(tuple(r) for r in phrases.mine(spark.createDataFrame(rows, schema).repartition(3)).select(COLUMNS).collect())


def test_agrees_with_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    told = con.execute(ORACLE_SQL["op13_collocations"])
    assert [d[0] for d in told.description] == COLUMNS
    assert sorted(tuple(r) for r in QUERIES["op13_collocations"](spark, sf_dir).select(COLUMNS).collect()) == sorted(told.fetchall())


ODD = [
    ("New York City is big, new york CITY", "en"),
    (" \t new  york\tcity! new york city; new york\x0bcity\x0cis big\r\n", "en"),
    ("a a a a a a", "en"),  # occurrences overlap
    ("ÄÖ äö É é Ä ö", "de"),  # only A to Z are lowered
    ("é x é x é x", None),  # a no-break space is a letter here
    (None, "en"),
    ("", None),
    ("...!?", "fr"),
    ("one", "fr"),
]


def test_odd_texts_against_the_plain_version(spark):
    rows = [r for r in ODD for _ in range(31)] + [("a b c d e " * 4000, "en"), ("new york", "en"), ("york new", "en")]
    assert mined(spark, rows) == plain_mine(rows)
    wide = [(*r, "x", i) for i, r in enumerate(rows)]
    assert mined(spark, wide, "text string, lang string, phrase string, f long") == plain_mine(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(None, None)]) == []


def test_collisions_change_nothing(spark):
    """With few buckets nearly all of them are full: more is counted, the result is the same."""
    rows = [(f"w{i % 40} w{i % 7} w{i % 3} w{i * i % 1100} w{i % 11}. w{i % 40} w{i % 7} x{i}", "en") for i in range(9000)]
    got = sorted(tuple(r) for r in phrases.mine(spark.createDataFrame(rows, "text string, lang string"), bits=16).select(COLUMNS).collect())
    assert got == plain_mine(rows)


def test_a_scan_counts_words_and_buckets_of_pairs():
    batch = pa.RecordBatch.from_arrays([pa.array(["x y z", "x y"]), pa.array(["en", "en"])], names=["text", "lang"])
    found = pa.Table.from_batches(phrases._scan(1, None, None, 20)(iter([batch]))).to_pylist()
    assert sorted((r["phrase"], r["f"]) for r in found if r["phrase"]) == [("x", 2), ("y", 2), ("z", 1)]
    assert sum(len(r["counts"]) // 3 for r in found if r["counts"]) == 2  # two pairs of words
