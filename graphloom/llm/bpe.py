"""Byte-level BPE through a table of distinct words.

A text is cut into words before every space that a non-space follows; no merge
of a byte-level BPE crosses such a cut. Each block of rows lists its distinct
words by hash bucket, a bucket of the whole corpus encodes each of its distinct
words once, and the ids go back to the blocks and are placed by position. What
is shuffled is one copy of a word per block and a compressed word number per
occurrence, never the texts.

Decoding looks each id up in the id-to-piece table, which is as large as the
vocabulary and no larger, joins the bytes and reads them as UTF-8.

Defined results: a null text is the empty text, without tokens; a null list of
ids decodes to the empty text; unknown ids fail; ids may repeat over rows and
may be null; special tokens' strings in a text become their ids, as the
tokenizer's own default has it; an empty table gives an empty result.

``docs`` must read the same rows in the same order each time it is evaluated (a
table does); a block that changes between its two readings is refused.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import give_back, slices

#: Bytes of text in one block.
BLOCK = 6 << 20
_CUT = re.compile(r"(?= \S)")
_ODD = re.compile(r" (?:\s|\Z)")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def _specials(path: str) -> re.Pattern | None:
    names = sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def split_words(text: str, specials: re.Pattern | None = None) -> list[str]:
    """Words whose encodings, joined, are the encoding of the text."""
    if specials and specials.search(text):
        return [w for part in specials.split(text) if part for w in split_words(part)]
    if _ODD.search(text):
        return [w for w in _CUT.split(text) if w]
    first, *rest = text.split(" ")
    words = [f" {w}" for w in rest]
    return [first, *words] if first else words


def _blocks(batches: Iterator[pa.RecordBatch], path: str, buckets: int):
    """Per block: its number, the slice, words, their buckets, words per text and the word number of each occurrence."""
    specials = _specials(path)
    base = TaskContext.get().partitionId() << 32
    for k, part in enumerate(slices(batches, "text", BLOCK)):
        numbers: dict[str, int] = defaultdict(count().__next__)
        counts, occurrences = [], []
        for text in part.column("text").to_pylist():
            words = split_words(text or "", specials)
            counts.append(len(words))
            occurrences.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
        found = [w.encode() for w in numbers]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in found), np.int32, len(found))
        yield base + k, part, found, bucket, np.array(counts, np.int32), np.concatenate(occurrences or [np.zeros(0, np.uint32)])


def _pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 3)


def _unpack(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _digest(words: list[bytes]) -> int:
    """Of the words of a block in their order."""
    digest = xxhash.xxh3_64()
    for i in range(0, len(words), 1 << 16):
        digest.update(_pack_words(words[i : i + (1 << 16)]))
    return digest.intdigest() >> 1


def _pack_words(data: list[bytes]) -> bytes:
    return zstandard.compress(np.fromiter(map(len, data), np.uint32, len(data)).tobytes() + b"".join(data), 3) + len(data).to_bytes(4, "little")


def _unpack_words(packed: bytes) -> list[bytes]:
    n, data = int.from_bytes(packed[-4:], "little"), zstandard.decompress(packed[:-4])
    ends = np.cumsum(np.frombuffer(data[: 4 * n], np.uint32)) + 4 * n
    return [data[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(``key``, ``ids``): the token ids of each whole text, as the tokenizer in the file ``path`` gives them.

    ``buckets`` follows the number of partitions, so that a bucket holds about
    as many words as half a partition does, at any size of the corpus.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    buckets = buckets or max(64, 2 * rows.rdd.getNumPartitions())

    def words(batches):
        for block, _, found, bucket, _, _ in _blocks(batches, path, buckets):
            order = np.argsort(bucket, kind="stable")
            there, sizes = np.unique(bucket, return_counts=True)
            lists = np.split(order, np.cumsum(sizes)[:-1])
            yield pa.record_batch({
                "block": pa.array([block] * len(there), pa.int64()),
                "bucket": pa.array(there, pa.int32()),
                "words": pa.array([_pack_words([found[i] for i in x]) for x in lists], pa.binary()),
                "digest": pa.array([_digest(found)] * len(there), pa.int64()),
            })

    def encode_bucket(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        lists = [np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)) for found in map(_unpack_words, table.column("words").to_pylist())]
        distinct, flats, each = list(numbers), [], []
        for i in range(0, len(distinct), 4096):
            ids = [e.ids for e in _tokenizer(path).encode_batch([w.decode() for w in distinct[i : i + 4096]], add_special_tokens=False)]
            each.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flats.append(np.fromiter((i for x in ids for i in x), np.int32))
        flat, lengths = np.concatenate(flats), np.concatenate(each)
        give_back()
        return pa.table({
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "digest": table.column("digest"),
            "lengths": pa.array([_pack(lengths[x]) for x in lists], pa.binary()),
            "ids": pa.array([_pack(_gather(flat, lengths, x)) for x in lists], pa.binary()),
        })

    def places(batches):
        for block, part, found, bucket, counts, numbers in _blocks(batches, path, buckets):
            yield pa.record_batch({
                "block": pa.array([block], pa.int64()),
                "keys": _lists(part.column("key"), np.array([part.num_rows])),
                "counts": _lists(pa.array(counts), np.array([part.num_rows])),
                "digest": pa.array([_digest(found)], pa.int64()),
                "buckets": pa.array([_pack(bucket)], pa.binary()),
                "numbers": pa.array([_pack(numbers)], pa.binary()),
            })

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        pieces = [(_unpack(a.as_py(), np.int32), _unpack(b.as_py(), np.int32)) for a, b in zip(right.column("lengths"), right.column("ids"))]
        lengths = np.concatenate([np.zeros(0, np.int32), *(a for a, _ in pieces)])
        ids = np.concatenate([np.zeros(0, np.int32), *(b for _, b in pieces)])
        bucket = _unpack(left.column("buckets")[0].as_py(), np.int32)
        if left.num_rows != 1 or len(bucket) != len(lengths) or set(right.column("digest").to_pylist()) - set(left.column("digest").to_pylist()):
            raise ValueError("a block of texts changed between its two readings")
        at = np.empty(len(bucket), np.int64)
        at[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))  # word number to place in bucket order
        places_ = at[_unpack(left.column("numbers")[0].as_py(), np.uint32)]
        counts = left.column("counts").combine_chunks().flatten().to_numpy()
        give_back()
        tokens = np.concatenate([[0], np.cumsum(lengths[places_])])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.table({"key": left.column("keys").combine_chunks().flatten(), "ids": _lists(pa.array(_gather(ids, lengths, places_)), np.diff(tokens))})

    coded = rows.select("text").mapInArrow(words, "block long, bucket int, words binary, digest long").groupBy("bucket").applyInArrow(encode_bucket, "block long, bucket int, digest long, lengths binary, ids binary")
    placed = rows.mapInArrow(places, f"block long, keys array<{kind}>, counts array<int>, digest long, buckets binary, numbers binary")
    return placed.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def _gather(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of a flat array of runs, one after another."""
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[:-1]
    each = lengths[at].astype(np.int64)
    shift = starts[at] - (np.cumsum(each) - each)
    return flat[np.repeat(shift, each) + np.arange(each.sum())]


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _pieces(path: str) -> pa.Array:
    tokenizer, alphabet = _tokenizer.__wrapped__(path), _byte_alphabet()  # read anew: only its names stay
    names = (tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True)))
    return pa.array([bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode() for name in names], pa.binary())


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each row's ``ids`` by joining them with the id-to-piece table of the vocabulary."""
    names = [c for c in df.columns if c != out]

    def join(batches):
        pieces = _pieces(path)
        for batch in batches:
            lists = batch.column(ids)
            lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            for a, b, part in _cuts(lengths, batch):
                got = pieces.take(flat.slice(a, b - a))
                sizes = np.concatenate([[0], np.cumsum(pc.binary_length(got).to_numpy(zero_copy_only=False))])
                ends = sizes[np.concatenate([[0], np.cumsum(lengths[part])])]
                data = b"" if not len(got) else got.buffers()[2].to_pybytes()[: int(sizes[-1])]
                texts = [data[i:j].decode("utf-8", "replace") for i, j in zip(ends, ends[1:])]
                yield pa.record_batch([*(batch.column(c).slice(part.start, len(texts)) for c in names), pa.array(texts, pa.string())], [*names, out])
                give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names).mapInArrow(join, f"{fields}, `{out}` string")


def _cuts(lengths: np.ndarray, batch: pa.RecordBatch, limit: int = 1 << 20):
    """Slices of a batch with about ``limit`` ids: first and last id, and the rows."""
    start, a, held = 0, 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield a, a + held, slice(start, i)
            start, a, held = i, a + held, 0
        held += int(n)
    if start < batch.num_rows:
        yield a, a + held, slice(start, batch.num_rows)
