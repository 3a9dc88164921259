"""Toxicity by nearest examples: the index against all cosines, held-out accuracy, odd input."""

from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphloom.llm import toxicity
from graphloom.llm.queries import QUERIES
from tests.conftest import SF


def all_cosines(index: toxicity.Index, place, value, but: int = -1) -> tuple[list, list]:
    q = np.zeros(len(index.terms))
    q[place] = value
    dense = np.zeros((len(index.keys), len(index.terms)))
    dense[index.example, np.repeat(np.arange(len(index.terms)), np.diff(index.starts))] = index.weight
    cosine = np.round(dense @ q, 12)
    order = [i for i in np.lexsort((np.arange(len(cosine)), -cosine)) if cosine[i] > 0 and i != but][: toxicity.NEAREST]
    return order, cosine[order].tolist()


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_what_all_cosines_give(seed):
    rng = np.random.default_rng(seed)
    terms = [(toxicity.ANY, 500), *((f"t{i}", int(k)) for i, k in enumerate(rng.integers(1, 400, 30)))]
    draw = lambda: {toxicity.ANY: 40, **{f"t{i}": int(rng.integers(1, 4)) for i in rng.integers(0, 30, rng.integers(0, 4))}}
    index = toxicity.make_index(terms, [(k, int(rng.random() < 0.2), draw()) for k in range(500)])
    for k in range(150):
        place, value = index.vector(draw() if k else {})
        but = k if k % 2 else -1
        found, cosine = index.nearest(place, value, but=but)
        order, near = all_cosines(index, place, value, but)
        assert np.allclose(cosine, near, atol=1e-11)
        assert found.tolist() == order


def test_few_blocks_are_opened():
    terms = [("x", 10), ("y", 10), ("z", 900)]
    index = toxicity.make_index(terms, [(k, int(k < 20), {"x" if k < 10 else "y" if k < 20 else "z": 1}) for k in range(2000)])
    opened = []
    block = index.example // toxicity.BLOCK
    index.weight = type("Watched", (), {"__getitem__": lambda _, s, w=index.weight: opened.append(block[s.start]) or w[s]})()
    found, _ = index.nearest(*index.vector({"x": 2}))
    assert len(found) == 10 and len(opened) == 1


def test_held_out_labels():
    large = Path(SF).parent / "sf0.1"
    if not large.exists():
        pytest.skip("the larger tables are not there")
    texts = dict(zip(*pq.read_table(large / "documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    rows = [(r["doc_id"], r["toxic"], zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in pq.read_table(large / "labels.parquet").to_pylist() if r["doc_id"] in texts and r["toxic"] is not None]
    first = {}
    for k, y, out in sorted(rows):
        if not out:
            key = first.setdefault(toxicity.signature(texts[k] or ""), [k, 0])
            key[1] = max(key[1], y)
    met = [Counter(), Counter()]
    for k, y in first.values():
        met[y].update(set(toxicity.terms_of(texts[k])) - {toxicity.ANY})
    toxic = sum(y for _, y in first.values())
    terms = toxicity.telling_terms([(w, met[1][w], met[0][w]) for w in met[0] | met[1]], toxic, len(first) - toxic)
    index = toxicity.make_index(terms, [(k, y, toxicity.terms_of(texts[k])) for k, y in first.values()])
    held = [(y, index.scores(np.array([index.vote(*index.nearest(*index.of(texts[k])))]))[0]) for k, y, out in rows if out]
    hit = sum(y and s >= toxicity.TOXIC for y, s in held)
    assert hit / sum(y for y, _ in held) > 0.9 and hit / sum(s >= toxicity.TOXIC for _, s in held) > 0.9
    assert sum((s - y) ** 2 for y, s in held) / len(held) < 0.02  # the scores are shares


def test_query_scores_every_document(spark, sf_dir):
    got = QUERIES["op12_toxicity"](spark, sf_dir).toPandas()
    ids = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id"]).column("doc_id").to_pylist()
    assert sorted(got.doc_id) == sorted(ids)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id] == got.held_out.tolist()
    assert not any(zlib.crc32(str(k).encode()) % 4 == 2 for near in got.nearest for k in near)  # held-out rows are no examples


def test_odd_rows(spark):
    bad, good = "what a vile and nasty thing to say here", "the weather in the north is mild and dry"
    rows = [(i, f"{bad if i % 3 == 0 else good} {i}", "x", "y") for i in range(240)] + [(500, None, "x", None), (501, "", None, None), (None, bad, None, None), (502, bad + " word" * 50000, "x", "y"), (502, bad + " word" * 50000, "x", "y"), (503, "...", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, _text string").repartition(3)
    marks = [(i, int(i % 3 == 0)) for i in range(240)] + [(0, 0), (3, None), (None, 1), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["doc_id", "text", "_text", "held_out", "score", "predicted", "evidence"]
    by = {k: s for k, s in zip(got.doc_id.fillna(-1), got.score)}
    assert min(by[i] for i in range(0, 240, 3)) > 0.6 > 0.2 > max(by[i] for i in range(240) if i % 3)
    assert by[-1] > 0.6 and 0 <= by[500] == by[501] == by[503] < 0.5
    assert got[got.doc_id == 502].score.nunique() == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0
    one = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 1")), keep=["doc_id"]).toPandas()
    assert (one.score == 1.0).all() and (one.predicted == 1).all()
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)), keep=["doc_id"]).toPandas()
    assert (none.score == 0.0).all() and none.evidence.map(len).eq(0).all()
