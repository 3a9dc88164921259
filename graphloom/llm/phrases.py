"""Phrases of two to four words that stand together more often than their parts.

The method of direct hashing: while n-grams of one length are counted exactly,
all n-grams of the next length are counted in ``2**BITS`` hash buckets in the
same scan. Of the buckets and of the n-grams that are frequent enough only
bitmaps of ``2**BITS`` bits go to the tasks of the next scan: an n-gram is
counted there only if its bucket is frequent and both of its parts may be. A
collision costs a count of something rare and never a result; the sizes of the
bitmaps do not follow the data.

Defined results: a null text is empty, a null language is ``und``; texts are
taken whole, in slices that end between documents; repeated rows count each
time; a table without words gives no phrases; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import cut, give_back, slices

#: Least occurrences of a phrase, its most words, phrases of a language, share of occurrences (in hundredths) inside a longer one.
LEAST, WORDS, FIRST, INSIDE = 30, 4, 2000, 80
#: Buckets and bits of a bitmap are 2**BITS, if not told otherwise; they travel in chunks of 2**CHUNK.
BITS, CHUNK = 24, 16
#: Bytes of text that are looked at together.
SLICE = 8 << 20

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)], _KIND[list(_BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts of one language: distinct ones, each place's number among them, its hash and its piece."""

    def __init__(self, texts: pa.Array, lang: str) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        starts = starts[:-1] - starts[0]
        kind = _KIND[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = starts[starts < len(data)]
        first[heads] = inside[heads]
        places = np.flatnonzero(first)
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[places] - 1, np.count_nonzero(inside)).astype(np.int32)
        letters = _LOWER[data[inside]]
        words = pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        self.distinct = words.dictionary
        self.code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # both grow along the places, so two words have the same sum only in the same piece of the same text
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[places] + np.searchsorted(starts, places, side="right")
        self.hash = _hashes(self.distinct)[self.code] if len(places) else np.zeros(0, np.uint64)
        self.seed = _hashes(pa.array([lang]))[0]

    def grams(self, n: int) -> np.ndarray:
        """A hash for the ``n`` words from each place on, as far as there are so many."""
        count = max(len(self.code) - n + 1, 0)
        h = np.full(count, self.seed, np.uint64)
        for j in range(n):
            h = _joined(h, self.hash[j : j + count])
        return h

    def whole(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from a place on are of one piece."""
        count = max(len(self.code) - n + 1, 0)
        return self.piece[:count] == self.piece[n - 1 : n - 1 + count]

    def counted(self, n: int, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases of ``n`` words at some places, and how often each stands there."""
        ids = self.code[at]
        for j in range(1, n):
            ids = np.unique(ids * len(self.distinct) + self.code[at + j], return_inverse=True)[1]
        _, one, counts = np.unique(ids, return_index=True, return_counts=True)
        parts = [self.distinct.take(pa.array(self.code[at[one] + j])) for j in range(n)]
        return (pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]), counts


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _MIX
    return h ^ (h >> np.uint64(29))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bucket(h, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column("lang").dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.column("text").filter(pa.array(code == k))


_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
_FOUND_SQL = "lang string, phrase string, f long, chunk int, counts binary"


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)


def _packed(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bucket counts up to ``LEAST`` by chunk, each as it is or, where few are set, as places and counts."""
    for chunk, part in enumerate(counts.reshape(-1, 1 << CHUNK)):
        at = np.flatnonzero(part)
        if len(at):
            sparse = at.astype(np.uint16).tobytes() + part[at].tobytes()
            yield _rows(chunk=pa.array([chunk]), counts=pa.array([min(sparse, part.tobytes(), key=len)], pa.binary()))


def _scan(n: int, buckets, parts, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One scan: exact counts of the ``n``-grams that may be frequent, bucket counts of those one word longer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8) if n < WORDS else None
        for batch in slices(batches, "text", SLICE):
            for lang, texts in _by_language(batch):
                words = Words(texts, lang)
                may = words.whole(n)
                if n > 1:
                    part = _has(parts.value, words.grams(n - 1))
                    may &= part[:-1][: len(may)] & part[1:][: len(may)] & _has(buckets.value, words.grams(n))
                at = np.flatnonzero(may)
                if len(at):
                    phrases, f = words.counted(n, at)
                    yield _rows(lang=pa.array([lang] * len(f)), phrase=phrases, f=pa.array(f))
                if counts is not None:
                    longer = words.grams(n + 1)[words.whole(n + 1) & may[:-1] & may[1:]]
                    to, met = np.unique(_bucket(longer, bits), return_counts=True)
                    counts[to] = np.minimum(counts[to] + met, LEAST)  # sums of counts cut off there reach it as the counts do
        if counts is not None:
            yield from _packed(counts)
        give_back()

    return scan


def _full(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Frequent phrases of one length as full buckets, in the form of ``_packed``."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            h = _hashes(batch.column("lang"))
            for words in zip(*(p.split(" ") for p in batch.column("phrase").to_pylist()), strict=True):
                h = _joined(h, _hashes(pa.array(words)))
            counts[_bucket(h, bits)] = LEAST
        yield from _packed(counts)

    return full


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up chunks of bucket counts as they come and keeps a bit for each full bucket."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums = held.setdefault(chunk, np.zeros(1 << CHUNK, np.uint8))
            if len(packed) == 1 << CHUNK:
                sums[:] = np.minimum(sums.astype(np.int16) + np.frombuffer(packed, np.uint8), LEAST)
            else:
                k = len(packed) // 3
                at = np.frombuffer(packed, np.uint16, k)
                sums[at] = np.minimum(sums[at].astype(np.int16) + np.frombuffer(packed, np.uint8, k, 2 * k), LEAST)
    for chunk, sums in held.items():
        bits = np.packbits(sums >= LEAST, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits], pa.binary())], names=["chunk", "bits"])


def _bitmap(chunks: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of full buckets: ``2**bits`` bits come to the driver, whatever the data."""
    merged = chunks.select("chunk", "counts").repartition("chunk").mapInArrow(_merged, "chunk int, bits binary")
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for row in merged.collect():
        bitmap[row.chunk << CHUNK - 3 : (row.chunk + 1) << CHUNK - 3] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def counts_by_length(docs: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """For one word, two words and so on: the frequent phrases (lang, phrase, f); the first has all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    out: list[DataFrame] = []
    buckets = parts = None
    for n in range(1, WORDS + 1):
        found = cut(texts.mapInArrow(_scan(n, buckets, parts, bits), _FOUND_SQL), f"phrases-{n}")
        f = found.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        out.append(cut(f if n == 1 else f.where(F.col("f") >= LEAST), f"phrase-counts-{n}"))
        for old in (buckets, parts):
            if old is not None:
                old.destroy()
        if n < WORDS:
            buckets = spark.sparkContext.broadcast(_bitmap(found.where("chunk IS NOT NULL"), bits))
            frequent = out[-1].where(F.col("f") >= LEAST)
            parts = spark.sparkContext.broadcast(_bitmap(frequent.mapInArrow(_full(bits), _FOUND_SQL), bits))
    return out


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def mine(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score. ``bits`` (16 at least) is no part of the result."""
    counts = counts_by_length(docs, bits)
    totals = counts[0].groupBy("lang").agg(F.sum("f").alias("n"))
    split = F.split("phrase", " ")
    phrases = counts[1].withColumn("words", split)
    for longer in counts[2:]:
        phrases = phrases.unionByName(longer.withColumn("words", split))
    phrases = phrases.withColumnRenamed("f", "a")
    parts = counts[0].where(F.col("f") >= LEAST)  # a part of a frequent phrase is frequent
    for longer in counts[1:-1]:
        parts = parts.unionByName(longer)

    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"), F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("right")
    )
    sides = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    least = sides.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    # every run of words inside a longer phrase, with the most frequent phrase that holds it
    runs = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    inside = phrases.where(F.size("words") > 2).select("lang", F.explode(runs).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = least.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * INSIDE))

    # first within a share of each language, then among what is left of the shares
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", share.alias("share"))
    near = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= FIRST)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= FIRST)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
