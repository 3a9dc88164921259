"""Toxicity by the nearest labelled examples.

Examples and documents are TF-IDF vectors of the terms that tell the labels of
the examples apart, words and beginnings of words, beside one term that stands
for every word: it keeps the share that telling terms have of a text. The examples nearest to a document by the exact cosine are
found in an inverted index whose postings come in blocks of examples, with the
largest weight of each term in each block: blocks are opened in the order of
what they could hold at best, until none can hold anything nearer. The
neighbours vote with weights that fall with their distance, the vote is
calibrated on the examples themselves, each without its own vote, and the
neighbours are the evidence.

The examples are a bounded sample: the ``EXAMPLES`` labelled rows whose hashed
key is smallest, of which texts with the same least shingle, that is copies and
most near copies, count once; at most ``TERMS`` terms span the vectors. Every row is scored, from its whole text.

Defined results: a null text is the empty text; a document without any
word has no neighbours and gets the calibrated score of no vote; labels
without toxicity or key are left out, contradicting labels of one document or
of copies count as toxic; without examples of both kinds every document gets the
share of toxic ones (0 without any); equally near examples are taken in
the order of the index, which the examples alone give; repeated rows are scored alike; an empty table gives an empty
result; columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import give_back, hash_sample, slices

#: Labelled rows of the sample, terms of the vectors, the least log-likelihood ratio of a term against the labels: at
#: 30, one of some ten million terms that tell nothing gets there by chance.
EXAMPLES, TERMS, TELLING = 6000, 4096, 30.0
#: Neighbours that vote, examples of a block.
NEAREST, BLOCK = 15, 64
#: From this score on a document is called toxic.
TOXIC = 0.3
_WORD = re.compile(r"[^\W\d_]+")


#: The term of every word; lengths of the beginnings that are terms.
ANY, STEMS = "", range(4, 9)


def _keys(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in STEMS if k < len(word))]


class Among(dict):
    """Some terms and their places; what a word has to begin with to hold any of them."""

    def __init__(self, terms) -> None:
        super().__init__(terms)
        self.heads = frozenset(t[: STEMS[0]] for t in self if t != ANY)


def terms_of(text: str | None, among: Among | None = None) -> Counter:
    """The terms of a text, all or those ``among`` some, and how often each stands there."""
    words = Counter(_WORD.findall((text or "").lower()))
    out: Counter = Counter()
    if words:
        out[ANY] = words.total()
    if among is None:
        for word, k in words.items():
            for key in _keys(word):
                out[key] += k
    else:
        for word in [w for w in words if w[: STEMS[0]] in among.heads]:
            for key in _keys(word):
                if key in among:
                    out[key] += words[word]
    return out


@dataclass
class Index:
    """Examples as an inverted index with block maxima, and what calibrates their votes."""

    terms: Among
    idf: np.ndarray
    keys: list = field(default_factory=list)
    toxic: np.ndarray = field(default=None)
    # postings of all terms, one after another, each in the order of the examples
    starts: np.ndarray = field(default=None)
    example: np.ndarray = field(default=None)
    weight: np.ndarray = field(default=None)
    # for each term its blocks: where their postings begin, and the largest weight there
    block_starts: np.ndarray = field(default=None)
    block: np.ndarray = field(default=None)
    begin: np.ndarray = field(default=None)
    most: np.ndarray = field(default=None)
    slope: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.vector(terms_of(text, self.terms))

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's terms, of length 1 in all."""
        at = sorted((self.terms[w], k) for w, k in counts.items() if w in self.terms)
        if not at:
            return np.zeros(0, np.int64), np.zeros(0)
        place = np.array([p for p, _ in at], np.int64)
        value = (1 + np.log(np.array([k for _, k in at], float))) * self.idf[place]
        return place, value / np.sqrt(value @ value)

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        rows = np.repeat(np.arange(len(vectors)), [len(p) for p, _ in vectors])
        place = np.concatenate([p for p, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        value = np.concatenate([v for _, v in vectors] or [np.zeros(0)])
        order = np.lexsort((rows, place))
        place, self.example, self.weight = place[order], rows[order], value[order]
        self.starts = np.searchsorted(place, np.arange(len(self.terms) + 1))
        blocks = self.example // BLOCK
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (blocks[1:] != blocks[:-1])
        self.begin = np.append(np.flatnonzero(new), len(place))
        self.block = blocks[self.begin[:-1]]
        self.most = np.maximum.reduceat(self.weight, self.begin[:-1]) if len(place) else np.zeros(0)
        self.block_starts = np.searchsorted(self.begin[:-1], self.starts)

    def nearest(self, place: np.ndarray, value: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``NEAREST`` examples by cosine, nearest first, equal ones in their order; only such as share a term."""
        spans = [np.arange(self.block_starts[p], self.block_starts[p + 1]) for p in place]
        if not spans or not sum(map(len, spans)):
            return np.zeros(0, np.int64), np.zeros(0)
        entries, held = np.concatenate(spans), np.repeat(value, [len(s) for s in spans])
        best = np.bincount(self.block[entries], held * self.most[entries])
        by_block = entries[np.argsort(self.block[entries], kind="stable")]
        cut = np.searchsorted(self.block[by_block], np.arange(len(best) + 1))
        weight_of = dict(zip(entries.tolist(), held.tolist()))
        found, cosine, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-np.round(best, 11), kind="stable").tolist():
            if best[b] <= 0 or len(found) >= NEAREST and (best[b] < least - 1e-10 or best[b] < least + 1e-10 and found[-1] < b * BLOCK):
                break  # none is nearer; one as near has the smaller place only if it stands in a block before the last found
            mine = by_block[cut[b] : cut[b + 1]]
            sums = np.zeros(BLOCK)
            for e in mine.tolist():
                lo, hi = self.begin[e], self.begin[e + 1]
                sums[self.example[lo:hi] - b * BLOCK] += weight_of[e] * self.weight[lo:hi]
            sums = np.round(sums, 12)  # sums of equal vectors are equal, whatever the order of their terms
            at = np.flatnonzero(sums > 0)
            at = at[at + b * BLOCK != but]
            found, cosine = np.concatenate([found, at + b * BLOCK]), np.concatenate([cosine, sums[at]])
            keep = np.lexsort((found, -cosine))[:NEAREST]
            found, cosine = found[keep], cosine[keep]
            least = cosine[-1] if len(cosine) else 0.0
        return found, cosine

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> tuple[float, float]:
        """The share of toxic neighbours, weighted by nearness, and how near they are."""
        if not len(found):
            return 0.0, 0.0
        weight = 1 / (1.05 - np.minimum(cosine, 1))
        return float(weight @ self.toxic[found] / weight.sum()), float(cosine.mean())

    def calibrate(self, votes: np.ndarray) -> None:
        """Logistic regression of the labels on votes, nearness and both together, by Newton's method."""
        x = _columns(votes)
        for _ in range(60):
            p = _sigmoid(x @ self.slope)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (self.toxic - p) - 0.05 * self.slope)
            self.slope = self.slope + step
            if np.abs(step).max() < 1e-9:
                break
        self.slope[1] = max(self.slope[1], 0.0)

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return _sigmoid(_columns(votes) @ self.slope)


def _columns(votes: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(votes)), votes[:, 0], votes[:, 1], votes[:, 0] * votes[:, 1]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(key: str | Column) -> Column:
    """Rows whose label is never learnt from: a remainder of their key's checksum."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def signature(text: str) -> int:
    """The least hash of a text's five-word shingles, shared by copies and most near copies."""
    split = text.split()
    shingles = {" ".join(split[i : i + 5]) for i in range(max(1, len(split) - 4))}
    return min(int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in shingles)


def telling_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, int]]:
    """Terms (word, toxic examples, clean examples) by their log-likelihood ratio against the labels, with the examples that have them."""
    n, out = toxic + clean, []
    for word, a, b in counts:
        cells = ((a, (a + b) * toxic / n), (b, (a + b) * clean / n), (toxic - a, (n - a - b) * toxic / n), (clean - b, (n - a - b) * clean / n))
        ratio = 2 * sum(seen * math.log(seen / due) for seen, due in cells if seen)
        if ratio >= TELLING:
            out.append((-ratio, word, a + b))
    return [(ANY, n), *((w, df) for _, w, df in sorted(out)[: TERMS - 1])]


def make_index(terms: list[tuple[str, int]], examples: list[tuple]) -> Index:
    """The index of examples (key, toxic, counts of their terms), calibrated on their own votes.

    Examples stand in the order of their heaviest terms, so blocks hold like ones and their maxima are sharp.
    """
    n = len(examples)
    index = Index(Among((w, i) for i, (w, _) in enumerate(terms)), np.array([np.log((1 + n) / (1 + df)) + 1 for _, df in terms]))
    rows = []
    for k, (key, y, counts) in enumerate(examples):
        place, value = index.vector(counts)
        rows.append((sorted(zip((-np.round(value, 12)).tolist(), place.tolist())), k, key, y, (place, value)))
    rows.sort(key=lambda r: ([p for _, p in r[0][:2]], r[0][:1], r[1]))
    index.keys, index.toxic = [r[2] for r in rows], np.array([r[3] for r in rows], float)
    vectors = [r[4] for r in rows]
    index.build(vectors)
    index.calibrate(np.array([index.vote(*index.nearest(p, v, but=i)) for i, (p, v) in enumerate(vectors)]).reshape(-1, 2))
    return index


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", examples: int = EXAMPLES) -> Index | float:
    """The index of the sample, or the share of toxic rows where there are not both kinds.

    Only terms and the counts of at most ``TERMS`` of them per example come to the driver.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_k")).agg(F.max("toxic").cast("int").alias("_y"))
    chosen = hash_sample(marked, "_k", examples)
    rows = docs.join(F.broadcast(chosen), F.col(key) == F.col("_k")).select("_k", "_y", F.coalesce("text", F.lit("")).alias("_text"))
    # of copies the one with the smallest key stays, and it is toxic if any of them is
    signed = rows.mapInArrow(_signed, f"_k {docs.schema[key].dataType.simpleString()}, _y int, _text string, _h long")
    once = signed.groupBy("_h").agg(F.max("_y").alias("_y"), F.min(F.struct("_k", "_text")).alias("_first")).select("_first._k", "_y", "_first._text").persist()
    try:
        sizes = {r._y: r["count"] for r in once.groupBy("_y").count().collect()}
        toxic, clean = sum(n for y, n in sizes.items() if y > 0), sum(n for y, n in sizes.items() if y <= 0)
        if not toxic or not clean:
            return toxic / max(1, toxic + clean)
        met = once.select("_y", "_text").mapInArrow(_terms_of, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        # terms that cannot tell enough stay where they are counted
        n, a, b = float(toxic + clean), F.col("a").cast("double"), F.col("b").cast("double")
        part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
        ratio = 2 * (part(a, (a + b) * toxic / n) + part(b, (a + b) * clean / n) + part(toxic - a, (n - a - b) * toxic / n) + part(clean - b, (n - a - b) * clean / n))
        found = met.where(ratio >= TELLING * 0.999).orderBy(ratio.desc(), "word").limit(2 * TERMS).collect()
        terms = telling_terms([(r.word, r.a, r.b) for r in found], toxic, clean)
        kept = Among(terms)

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "_text"):
                found = [list(terms_of(t, kept).items()) for t in part.column("_text").to_pylist()]
                kind = pa.list_(pa.struct([("w", pa.string()), ("k", pa.int64())]))
                yield pa.record_batch([part.column("_k"), part.column("_y"), pa.array([[{"w": w, "k": k} for w, k in f] for f in found], kind)], ["k", "y", "counts"])

        kind = docs.schema[key].dataType.simpleString()
        got = once.select("_k", F.col("_y").cast("long").alias("_y"), "_text").mapInArrow(counts, f"k {kind}, y long, counts array<struct<w: string, k: bigint>>").orderBy("k").collect()
        return make_index(terms, [(r.k, int(r.y > 0), {c.w: c.k for c in r.counts}) for r in got])
    finally:
        once.unpersist()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        yield pa.record_batch([*(part.column(c) for c in ("_k", "_y", "_text")), pa.array([signature(t) for t in part.column("_text").to_pylist()], pa.int64())], ["_k", "_y", "_text", "_h"])


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        for y, text in zip(part.column("_y").to_pylist(), part.column("_text").to_pylist(), strict=True):
            own = [w for w in terms_of(text) if w != ANY]
            yield pa.record_batch([pa.array(own, pa.string()), pa.array([int(y > 0)] * len(own), pa.int32())], ["word", "toxic"])


def score(docs: DataFrame, index: Index | float, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with ``held_out``, ``score``, ``predicted`` and the neighbours that voted, for every row."""
    added = ("held_out", "score", "predicted", "evidence")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    example = docs.schema[key].dataType.simpleString()
    out = f"array<struct<example: {example}, cosine: double, toxic: int>>"
    if not isinstance(index, Index):
        return docs.select(*keep, held_out(key).alias("held_out"), F.lit(float(index)).alias("score"), F.lit(int(index >= TOXIC)).alias("predicted"), F.array().cast(out).alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most EXAMPLES times TERMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in slices(batches, "_text"):
            found = [index.nearest(*index.of(t)) for t in part.column("_text").to_pylist()]
            scores = index.scores(np.array([index.vote(*f) for f in found]).reshape(-1, 2))
            evidence = [[{"example": index.keys[i], "cosine": c, "toxic": int(index.toxic[i])} for i, c in zip(*(x.tolist() for x in f), strict=True)] for f in found]
            carried = pa.RecordBatch.from_arrays([part.column("_kept")], names=["_kept"])
            yield pa.record_batch([*carried.columns, pa.array(scores), pa.array([int(s >= TOXIC) for s in scores], pa.int32()), pa.array(evidence, _arrow(part.schema.field("_key").type))], ["_kept", "score", "predicted", "evidence"])
        give_back()

    struct = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep), held_out(key).alias("held_out")).alias("_kept"), F.col(key).alias("_key"), F.col("text").cast("string").alias("_text"))
    done = struct.mapInArrow(run, f"_kept {struct.schema['_kept'].dataType.simpleString()}, score double, predicted int, evidence {out}")
    return done.select("_kept.*", "score", "predicted", "evidence")


def _arrow(key: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("example", key), ("cosine", pa.float64()), ("toxic", pa.int32())]))
