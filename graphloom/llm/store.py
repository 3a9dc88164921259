"""Bounded Arrow slices and shared working tables for the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import cut, shared_dir  # noqa: F401


@cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: workers are kept between stages, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into slices whose ``column`` holds about ``limit`` bytes.

    A slice has at least one row, so a text longer than the limit is a slice of its own.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
                give_back()
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` whose hash of ``key`` is smallest, equal keys taken once.

    All but about four times as many are left out where they are read, by the size of their hash,
    so what a task sends on does not grow with the number of tasks. Where keys repeat so often that
    fewer are left, the cutoff is widened until there are enough or it lets all through.
    """
    names = [c for c in df.columns if c != key]
    h = F.shiftrightunsigned(F.xxhash64(key), 1)
    share = 4 * rows / max(df.count(), 1)
    while share < 1 and df.where(h < int(share * (1 << 63))).select(key).distinct().limit(rows).count() < rows:
        share *= 4
    near = df if share >= 1 else df.where(h < int(share * (1 << 63)))
    once = near.groupBy(key).agg(*(F.first(c).alias(c) for c in names)) if names else near.distinct()
    return once.orderBy(h, key).limit(rows)
