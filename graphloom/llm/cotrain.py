"""A quality classifier by co-training of two views.

One logistic regression reads the text (hashed words, endings of words, shape
ratios), the other the metadata (language, source, length). Both learn from the
labelled rows; in each round each labels the unlabelled pool, and what it is
sure of joins the other's training set. On labelled rows kept aside both are
calibrated and combined, and the threshold is set; then every document is scored.

A document counts as good if its quality is 1 and it is not toxic.

The training set is a bounded sample: ``LABELLED`` labelled and ``POOL``
unlabelled rows at most, those whose hashed key is smallest. Every row is
scored from its whole text.

Defined results: a null text is the empty text; null metadata is a value of its
own; labels without quality are left out, contradicting labels of one document
count as bad, a null toxicity as none; without labels of both kinds every
document gets 0.5 and is kept; an empty table gives an empty result; columns
named like the added ones are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import give_back, hash_sample, slices

#: Rows of the training sample, rounds of exchange, pseudo-labels that a view may give in one.
LABELLED, POOL, ROUNDS, GIVES = 6000, 3000, 3, 300
#: How sure a view has to be of a pseudo-label.
SURE = 0.97
#: Of the good documents kept aside, the share that the threshold has to keep.
KEEPS = 0.995
#: Rows of the training set that a feature has to stand in; sizes of the hashed spaces.
SEEN = 3
_WORDS, _META = 1 << 20, 1 << 12
_SHAPES = ("bias", "upper", "symbols", "same_words", "word_length", "log_words", "marks", "digits", "line_words")
_EDGE = ".,;:!?()[]{}<>\"'`*#$%&|+-=_/\\~@^…«»„“”’"
_UPPER, _SYMBOLS, _MARKS, _DIGITS = bytes(range(0x41, 0x5B)), b"#*$%&|<>", b"!?", b"0123456789"


def _place(key: str, size: int) -> int:
    return zlib.crc32(key.encode()) % size


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; the shape ratios come first."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    data = text.encode()
    n, size = max(1, len(words)), max(1, len(data))
    gone = lambda chars: len(data) - len(data.translate(None, chars))
    shapes = [
        1.0,
        4 * gone(_UPPER) / size,
        10 * gone(_SYMBOLS) / size,
        1 - len(counts) / n,
        len(text) / n / 10,
        float(np.log1p(len(words))) / 5,
        10 * gone(_MARKS) / size,
        4 * gone(_DIGITS) / size,
        float(np.log1p(n / (text.count("\n") + 1))) / 5,
    ]
    bag: Counter = Counter()
    for word, k in counts.items():
        core = word.strip(_EDGE)
        bag[core.lower()] += k
        if not word[-1].isalnum():
            bag["~" + word[len(word.rstrip(_EDGE)) :][-3:]] += k
    merged: dict[int, float] = {}
    for word, k in bag.items():
        p = len(_SHAPES) + zlib.crc32(word.encode()) % _WORDS
        merged[p] = merged.get(p, 0.0) + k
    scale = max(1, len(bag)) ** -0.25
    values = np.minimum(np.log1p(np.fromiter(merged.values(), float, len(merged))), 2.0) * scale
    return np.concatenate([np.arange(len(_SHAPES)), np.fromiter(merged.keys(), np.int64, len(merged))]).astype(np.int32), np.concatenate([shapes, values]).astype(np.float32)


def meta_view(lang: str | None, source: str | None, chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    long = float(np.log1p(max(0, chars or 0)))
    keys = [f"lang={lang}", f"source={source}", f"both={lang}/{source}", f"size={int(long)}"]
    return np.array([0, 1, *(2 + _place(k, _META) for k in keys)], np.int32), np.array([1, long / 10, 1, 1, 1, 1], np.float32)


@dataclass
class Rows:
    """Sparse rows, one after another."""

    at: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        ends = np.cumsum([len(a) for a, _ in rows])
        return cls(np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), ends)

    def pick(self, rows: np.ndarray) -> Rows:
        starts = np.concatenate([[0], self.ends])[:-1]
        spans = [np.arange(starts[i], self.ends[i]) for i in rows]
        flat = np.concatenate(spans) if spans else np.zeros(0, int)
        return Rows(self.at[flat], self.value[flat], np.cumsum([len(s) for s in spans]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(w[self.at] * self.value)])
        return sums[self.ends] - sums[np.concatenate([[0], self.ends])[:-1].astype(int)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(x: Rows, y: np.ndarray, size: int, hold: float, dense: int, steps: int = 150) -> np.ndarray:
    """Logistic regression over features scaled by their log-count ratio between the classes.

    Features in fewer than ``SEEN`` rows get no weight, the first ``dense`` ones are neither
    dropped nor scaled. Classes are balanced; Adam over all rows, so equal input gives equal weights.
    """
    lengths = np.diff(np.concatenate([[0], x.ends]))
    good = np.repeat(y > 0.5, lengths)
    seen_good, seen_bad = np.bincount(x.at[good], minlength=size), np.bincount(x.at[~good], minlength=size)
    used = np.flatnonzero((seen_good + seen_bad >= SEEN) | (np.arange(size) < dense))
    n_good, n_bad = max(1, (y > 0.5).sum()), max(1, (y <= 0.5).sum())
    ratio = np.log((seen_good[used] + 1) / (n_good + 2)) - np.log((seen_bad[used] + 1) / (n_bad + 2))
    ratio[used < dense] = 1.0
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    inside = place[x.at] >= 0
    at = place[x.at[inside]]
    value = x.value[inside] * ratio[at]
    ends = np.concatenate([[0], np.cumsum(inside)])[x.ends]
    z = Rows(at, value, ends)
    each = np.diff(np.concatenate([[0], ends]))
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    weight = np.where(y > 0.5, 0.5 / n_good, 0.5 / n_bad)
    for t in range(1, steps + 1):
        error = (_sigmoid(z.dot(w)) - y) * weight
        g = np.bincount(at, np.repeat(error, each) * value, len(used)) + hold * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    out = np.zeros(size, np.float32)
    out[used] = w * ratio
    return out


def _calibrate(scores: np.ndarray, y: np.ndarray, hold: float = 1e-2) -> np.ndarray:
    """Newton's method for a logistic regression over a few dense columns and a bias."""
    x = np.column_stack([scores, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), x.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    platt: np.ndarray  # a slope and a bias per view
    blend: np.ndarray  # weights of the calibrated views and a bias
    threshold: float
    exchanged: tuple[int, int] = (0, 0)

    def combine(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        calibrated = np.column_stack([text * self.platt[0, 0] + self.platt[0, 1], meta * self.platt[1, 0] + self.platt[1, 1]])
        return _sigmoid(calibrated @ self.blend[:2] + self.blend[2])


def co_train(text: Rows, meta: Rows, y: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """``y`` holds 1, 0 or nan for the pool; None without labels of both kinds."""
    known = np.flatnonzero(~np.isnan(y))
    pool = np.flatnonzero(np.isnan(y))
    if len(np.unique(y[known])) < 2:
        return None
    aside, own = known[np.arange(len(known)) % 4 == 0], known[np.arange(len(known)) % 4 != 0]
    if min(len(np.unique(y[aside])), len(np.unique(y[own]))) < 2:
        aside = own = known
    views = ((text, len(_SHAPES) + _WORDS, 3e-4, len(_SHAPES)), (meta, 2 + _META, 1e-3, 2))
    sets = [(own, y[own]), (own, y[own])]
    given = [set(), set()]  # pool rows that a view has got from the other
    for turn in range(rounds + 1):
        weights = [train(v.pick(rows), labels, size, hold, dense) for (v, size, hold, dense), (rows, labels) in zip(views, sets)]
        if turn == rounds or not len(pool):
            break
        for giver, taker in ((0, 1), (1, 0)):
            p = _sigmoid(views[giver][0].pick(pool).dot(weights[giver]))
            order = np.argsort(-np.abs(p - 0.5), kind="stable")
            chosen = [i for i in order if max(p[i], 1 - p[i]) >= SURE and int(pool[i]) not in given[taker]][:GIVES]
            given[taker].update(int(pool[i]) for i in chosen)
            rows, labels = sets[taker]
            sets[taker] = (np.concatenate([rows, pool[chosen]]), np.concatenate([labels, (p[chosen] > 0.5).astype(float)]))
    scores = [v.pick(aside).dot(w) for (v, *_), w in zip(views, weights)]
    platt = np.array([_calibrate(s[:, None], y[aside]) for s in scores])
    platt[:, 0] = np.maximum(platt[:, 0], 0)  # a view that ranks the wrong way round says nothing
    blend = _calibrate(np.column_stack([s * a + b for s, (a, b) in zip(scores, platt)]), y[aside])
    model = Model(*weights, platt, blend, 0.5, (len(given[0]), len(given[1])))
    p, truth = model.combine(*scores), y[aside] > 0.5
    # the fewest errors, but nearly all good documents stay
    cuts = np.unique(np.concatenate([p, [0.5]]))
    most = np.quantile(p[truth], 1 - KEEPS, method="lower")
    errors = [((p >= c) != truth).sum() for c in cuts if c <= max(most, cuts[0])]
    best = int(np.flatnonzero(errors == np.min(errors))[-1])
    below = p[p < cuts[best]]
    model.threshold = float((cuts[best] + below.max()) / 2 if len(below) else cuts[best] / 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """Collects the features of the bounded sample and co-trains on them."""
    good = F.when(F.max(F.coalesce(F.col("toxic"), F.lit(0))) > 0, 0.0).otherwise(F.min("quality").cast("double"))
    marked = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(good.alias("_y"))
    chosen = hash_sample(marked, "_k", labelled).unionByName(hash_sample(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(None).cast("double").alias("_y")), "_k", pool))
    # at most labelled + pool rows, whatever the size of the corpus; a document in both counts as labelled
    ids = chosen.groupBy("_k").agg(F.max("_y").alias("_y"))
    rows = docs.join(F.broadcast(ids), F.col(key) == F.col("_k")).select("_k", "_y", *_inputs(docs))

    def features(batches):
        for part in slices(batches, "_text"):
            texts = [text_view(t) for t in part.column("_text").to_pylist()]
            metas = [meta_view(*m) for m in zip(*(part.column(c).to_pylist() for c in ("_lang", "_source", "_chars")))]
            pack = lambda vs, i, t: pa.array([v[i].astype(t).tobytes() for v in vs], pa.binary())
            yield pa.record_batch([part.column("_k"), part.column("_y"), pack(texts, 0, "<i4"), pack(texts, 1, "<f4"), pack(metas, 0, "<i4"), pack(metas, 1, "<f4")], ["k", "y", "ta", "tv", "ma", "mv"])

    kind = docs.schema[key].dataType.simpleString()
    got = rows.mapInArrow(features, f"k {kind}, y double, ta binary, tv binary, ma binary, mv binary").dropDuplicates(["k"]).orderBy(F.xxhash64("k"), "k").toArrow().to_pydict()
    if not got["k"]:
        return None
    rows_of = lambda a, v: Rows.of([(np.frombuffer(x, "<i4"), np.frombuffer(z, "<f4")) for x, z in zip(got[a], got[v])])
    text, meta, y = rows_of("ta", "tv"), rows_of("ma", "mv"), np.array([np.nan if v is None else v for v in got["y"]])
    del got
    model = co_train(text, meta, y)
    del text, meta
    give_back()
    return model


def _inputs(docs: DataFrame) -> list:
    there = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    return [F.col("text").cast("string").alias("_text"), there("lang", "string").alias("_lang"), there("source", "string").alias("_source"), there("n_chars", "long").alias("_chars")]


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with ``p_good`` and ``kept`` for every row of ``docs``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("p_good", "kept")]
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("p_good"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of the hashed spaces, whatever the corpus

    def run(batches):
        m = shared.value
        for part in slices(batches, "_text"):
            text = np.array([m.text[a] @ v for a, v in map(text_view, part.column("_text").to_pylist())])
            meta = np.array([m.meta[a] @ v for a, v in (meta_view(*x) for x in zip(*(part.column(c).to_pylist() for c in ("_lang", "_source", "_chars"))))])
            p = m.combine(text, meta)
            yield pa.record_batch([*(part.column(c) for c in keep), pa.array(p), pa.array(p >= m.threshold)], [*keep, "p_good", "kept"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select(*keep, *_inputs(docs)).mapInArrow(run, ", ".join([*fields, "p_good double, kept boolean"]))
