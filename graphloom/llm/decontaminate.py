"""Benchmark decontamination by suffix arrays of the training text.

Each shard (a bounded slice of training rows) gets a sorted array of its
suffixes, by as many words as a window has; every distinct window of the
benchmark is looked up in it by binary search, which gives all places where the
window occurs. Each place is then extended to the longest verbatim match with
any item, by narrowing a range of the benchmark's own suffix array word by word.
Suffixes that can match no window are left out of the shard's array beforehand:
a place stays only while the pairs of neighbouring words from it on all occur in
the benchmark, for as many words as the shortest window that starts with its
word. That test is exact.

Windows are numbered once however many items share them, and windows of the same
items share one list of them, so what is found in a text grows with the text and
not with the pairs of places and items.

The benchmark is the stated query set: it is read in blocks of bounded size, each
sent to the tasks for itself; the training rows pass one block after another,
each in a Python worker of its own, and after every ``CHAIN`` blocks are written
to the shared folder. They are only mapped, never shuffled.

Defined results: a null text has no words; an item without words or with a null
id has no windows; items may repeat and may share windows; an empty training
table gives an empty result, an empty benchmark marks nothing; carried columns
named like the added ones are replaced, others kept, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import cut, slices

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in one block, and of training text in one shard.
BENCH_BLOCK, SHARD = 4 << 20, 4 << 20
#: Blocks that rows pass between two writings.
CHAIN = 4
#: Bytes to lower case, everything that is no word to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters folded; a word is a run of ASCII letters, digits and anything beyond ASCII."""
    return text.encode().translate(_FOLD).split() if text else []


@dataclass
class Bench:
    """A block of items: one stream of word numbers, 0 between items."""

    ids: list[str]
    vocabulary: dict[bytes, int]
    stream: np.ndarray
    item_of: np.ndarray  # item of each place of the stream
    item_start: np.ndarray
    suffixes: np.ndarray  # all places of the stream, in the order of what follows them
    sizes: np.ndarray  # words of each distinct window
    low: np.ndarray  # its words as bytes, for the binary search
    high: np.ndarray
    owners: np.ndarray  # the number of its set of items
    sets: list[np.ndarray]  # items of each set
    pairs: np.ndarray  # sorted pairs of neighbouring words
    shortest: np.ndarray  # by word number: words of the shortest window that starts with it


def build(items: list[tuple[str, str]], window: int = WINDOW) -> Bench:
    vocabulary: dict[bytes, int] = defaultdict(count(1).__next__)
    stream, item_of, item_start, starts, sizes = [], [], [], [], []
    for k, (_, text) in enumerate(items):
        words = [vocabulary[w] for w in words_of(text)]
        item_start.append(len(stream))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            starts.append(len(stream) + i)
            sizes.append(size)
        item_of += [k] * (len(words) + 1)
        stream += [*words, 0]
    s, at, n, item_of = np.array(stream, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64), np.array(item_of, np.int64)
    keys = _keys(s, at, window)
    inside = np.arange(window) < n[:, None]
    low = _bytes(np.where(inside, keys, 0).astype(">u4"))
    shortest = np.full(len(vocabulary) + 1, np.iinfo(np.int64).max)
    np.minimum.at(shortest, s[at], n)
    # words are numbered from 1, so a shorter window differs from all longer ones by its zeros
    low, first, number = np.unique(low, return_index=True, return_inverse=True)
    high = _bytes(np.where(inside[first], keys[first], 0xFFFFFFFF).astype(">u4"))
    sets: dict[bytes, int] = {}
    owned = np.unique(np.stack([number.ravel(), item_of[at]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
    ends = np.searchsorted(owned[0], np.arange(len(first)), "right")
    owners = np.array([sets.setdefault(x.tobytes(), len(sets)) for x in np.split(owned[1], ends[:-1])] if len(first) else [], np.int64)
    pair = s[:-1] * (len(vocabulary) + 1) + s[1:] if len(s) else s
    pairs = np.unique(pair[(s[:-1] > 0) & (s[1:] > 0)]) if len(s) else s
    return Bench([str(i) for i, _ in items], dict(vocabulary), s, item_of, np.array(item_start, np.int64), _suffix_array(s), n[first], low, high, owners, [np.frombuffer(x, np.int64) for x in sets], pairs, shortest)


def _suffix_array(stream: np.ndarray) -> np.ndarray:
    """Places in the order of what follows them up to the end of their item, by doubling; ties by place."""
    n, width = len(stream), 1
    rank = np.unique(stream, return_inverse=True)[1].ravel() + 1
    rank[stream == 0] = 0
    while True:
        # what follows an item's end does not count
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:]
        ahead[rank == 0] = 0
        ahead[_crosses(stream, width)] = 0
        both = rank * (n + 2) + ahead
        new = np.unique(both, return_inverse=True)[1].ravel() + 1
        new[stream == 0] = 0
        width *= 2
        if width >= n or new.max(initial=0) == rank.max(initial=0):
            return np.lexsort((np.arange(n), new))
        rank = new


def _crosses(stream: np.ndarray, width: int) -> np.ndarray:
    """Whether an item ends within the ``width`` words from each place on."""
    ends = np.concatenate([[0], np.cumsum(stream == 0)])
    return ends[np.minimum(np.arange(len(stream)) + width, len(stream))] > ends[: len(stream)]


def _keys(stream: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The words from each place on, zeros beyond the end of the stream."""
    padded = np.concatenate([stream, np.zeros(window, stream.dtype)])
    return padded[at[:, None] + np.arange(window)]


def _bytes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(f"S{4 * keys.shape[1]}").ravel() if keys.size else np.zeros(0, "S4")


def _runs(stream: np.ndarray, bench: Bench) -> np.ndarray:
    """How many words from each place on are known and joined by known pairs."""
    if not len(stream) or not len(bench.vocabulary):
        return np.zeros(len(stream), np.int64)
    pair = stream[:-1] * (len(bench.vocabulary) + 1) + stream[1:]
    linked = (stream[:-1] > 0) & (stream[1:] > 0)
    if len(bench.pairs):
        there = np.flatnonzero(linked)
        found = np.minimum(np.searchsorted(bench.pairs, pair[there]), len(bench.pairs) - 1)
        linked[there] = bench.pairs[found] == pair[there]
    else:
        linked[:] = False
    breaks = np.append(np.flatnonzero(~linked), len(stream) - 1)
    end = breaks[np.searchsorted(breaks, np.arange(len(stream)))]
    return np.where(stream > 0, end - np.arange(len(stream)) + 1, 0)


def search(stream: np.ndarray, bench: Bench, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of the block's distinct windows, place and window: binary search in the sorted suffixes of the shard."""
    none = np.zeros(0, np.int64)
    runs = _runs(stream, bench)
    at = np.flatnonzero(runs >= bench.shortest[stream]) if len(runs) else none
    if not len(at) or not len(bench.low):
        return none, none
    keys = _keys(stream, at, window)
    keys = np.where(np.arange(window) < runs[at][:, None], keys, 0)
    suffixes = _bytes(keys.astype(">u4"))
    order = np.argsort(suffixes, kind="stable")
    suffixes = suffixes[order]
    a, b = np.searchsorted(suffixes, bench.low, "left"), np.searchsorted(suffixes, bench.high, "right")
    n = np.maximum(b - a, 0)
    rank = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return at[order[rank]], np.repeat(np.arange(len(n)), n)


def longest(stream: np.ndarray, bench: Bench, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the shard the words of its longest match with an item, and a place in the block where that stands.

    All places walk down the block's suffix array together: a range of it shrinks to the suffixes that share one word more.
    """
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(bench.suffixes))
    length, live = np.zeros(len(places), np.int64), np.arange(len(places))
    padded = np.append(bench.stream, 0)
    while len(live):
        ahead = places[live] + length[live]
        word = np.where(ahead < len(stream), stream[np.minimum(ahead, len(stream) - 1)], 0)
        live, word = live[word > 0], word[word > 0]
        bounds = []
        for above in (0, 1):  # the first suffix whose next word is not less, and the first whose next word is more
            x, y = low[live].copy(), high[live].copy()
            while (open_ := x < y).any():
                middle = (x + y) // 2
                there = padded[np.minimum(bench.suffixes[np.minimum(middle, len(bench.suffixes) - 1)] + length[live], len(bench.stream))]
                less = there < word + above
                x, y = np.where(open_ & less, middle + 1, x), np.where(open_ & ~less, middle, y)
            bounds.append(x)
        more = bounds[0] < bounds[1]
        live = live[more]
        low[live], high[live] = bounds[0][more], bounds[1][more]
        length[live] += 1
    return length, bench.suffixes[np.minimum(low, len(bench.suffixes) - 1)]


def _blocks(bench: DataFrame, key: str, text: str, window: int) -> Iterator[Bench]:
    held, size = [], 0
    for row in bench.select(F.col(key).cast("string"), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= BENCH_BLOCK:
            yield build(held, window)
            held, size = [], 0
    if held:
        yield build(held, window)


ADDED = ("n_words", "n_hit", "items", "matches")
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("text_word", pa.int64()), ("words", pa.int64())])
_STATE = {"n_words": pa.int64(), "n_hit": pa.int64(), "hits": pa.list_(pa.int64()), "items": pa.list_(pa.string()), "matches": pa.list_(_MATCH)}
_SCHEMA = "n_words long, n_hit long, hits array<long>, items array<string>, matches array<struct<item: string, item_word: long, text_word: long, words: long>>"


def _scan_shard(texts: list[list[bytes]], b: Bench, before: list[tuple], window: int) -> list[tuple]:
    """The state of each text after a block: words, hit words, where runs of those start and end, items, matches."""
    lengths = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    total = int((lengths + 1).sum())
    stream = np.fromiter((i for x in texts for i in (*map(b.vocabulary.get, x, repeat(0)), 0)), np.int64, total)
    place, found = search(stream, b, window)
    out = [(int(n), *(old[1:] if old else (0, [], [], []))) for n, old in zip(lengths, before)]
    if not len(place):
        return out
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + b.sizes[found], -1)
    doc_of = lambda p: np.searchsorted(starts, p, "right") - 1
    sets = np.unique(np.stack([doc_of(place), b.owners[found]]), axis=1)
    at = np.unique(place)
    words, there = longest(stream, b, at)
    # a match that starts one word earlier in the text holds this one
    whole = np.ones(len(at), bool)
    whole[1:] = (at[1:] != at[:-1] + 1) | (words[1:] >= words[:-1])
    for d in np.unique(sets[0]):
        n, s = int(lengths[d]), int(starts[d])
        covered = np.cumsum(edge[s : s + n]) > 0
        _, _, hits, items, matches = out[d]
        for x, y in zip(hits[::2], hits[1::2]):
            covered[x:y] = True
        turns = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]))).tolist()
        held = np.unique(np.concatenate([b.sets[k] for k in sets[1][sets[0] == d]]))
        lo, hi = np.searchsorted(at, (s, s + n))
        new = [{"item": b.ids[i], "item_word": int(t - b.item_start[i]), "text_word": int(p - s), "words": int(w)} for p, w, t, ok in zip(at[lo:hi], words[lo:hi], there[lo:hi], whole[lo:hi]) if ok for i in [int(b.item_of[t])]]
        out[d] = (n, int(covered.sum()), turns, sorted({*items, *(b.ids[i] for i in held)}), sorted([*matches, *new], key=lambda m: (m["text_word"], m["item"], m["item_word"])))
    return out


def scan(docs: DataFrame, bench: DataFrame, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_words``, ``n_hit``, ``items`` and ``matches``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists the items with
    occurring windows as sorted strings, ``matches`` the longest verbatim match from each place on
    that no earlier one holds, with its location in one item that has it (item, first word in the
    item, first word in the text, words).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    context = docs.sparkSession.sparkContext
    row = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    # the kept columns stand in a struct, so that no name of theirs meets another
    passed = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    kind = passed.schema["row"].dataType.simpleString()

    def through(block, last):
        def run(batches):
            b = block.value
            for part in slices(batches, "text", SHARD):
                old = list(zip(*(part.column(c).to_pylist() for c in _STATE))) if "hits" in part.schema.names else [None] * part.num_rows
                got = list(zip(*_scan_shard([words_of(x) for x in part.column("text").to_pylist()], b, old, window)))
                on = ["row"] if last else ["row", "text"]
                yield pa.record_batch([*(part.column(c) for c in on), *(pa.array(x, t) for x, t in zip(got, _STATE.values()))], [*on, *_STATE])

        return run

    blocks, number = _blocks(bench, item, item_text, window), 0
    block = next(blocks, None) or build([], window)
    while block:
        ahead, number = next(blocks, None), number + 1
        passed = passed.mapInArrow(through(context.broadcast(block), ahead is None), f"row {kind}, {'' if ahead is None else 'text string, '}{_SCHEMA}")  # BENCH_BLOCK bounds a block
        if ahead and number % CHAIN == 0:
            passed = cut(passed, "benchmark-scan")
        block = ahead
    return passed.select(*(F.col("row").getField(c).alias(c) for c in keep), *ADDED)


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, their columns unchanged."""
    # the row stands in a struct, so that no name of its columns meets an added one
    marked = scan(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), bench, "text", keep=["row"], **options)
    return marked.where("n_hit = 0").select("row.*")
