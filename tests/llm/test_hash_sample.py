"""The sample is full where rows are mostly copies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.llm.store import hash_sample


@pytest.mark.parametrize("distinct", [5, 40, 900])
def test_sample_of_copies(spark, distinct):
    df = spark.range(4000).select((F.col("id") % distinct).alias("k"), F.lit(1).alias("v"))
    want = [r.k for r in df.select("k").distinct().orderBy(F.shiftrightunsigned(F.xxhash64("k"), 1), "k").limit(20).collect()]
    assert [r.k for r in hash_sample(df, "k", 20).collect()] == want and len(want) == min(distinct, 20)
    assert hash_sample(df.limit(0), "k", 20).count() == 0
