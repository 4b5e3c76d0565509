"""Random graphs without a pair twice, against all draws sorted."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import edges as E


@pytest.mark.parametrize("n, m", [(40, 100), (9, 36), (9, 35), (300, 5000), (2, 1)])
def test_first_different_pairs(spark, monkeypatch, n, m):
    monkeypatch.setattr(E, "STRETCHES", 16)
    name = lambda number: 3 * number + 1
    draws = spark.range(10 * m).select("id", F.pmod(F.xxhash64("id", F.lit(42)), F.lit(n)).alias("i"), F.pmod(F.xxhash64("id", F.lit(43)), F.lit(n - 1)).alias("j")).orderBy("id").collect()
    want = {}
    for _, i, j in draws:
        j += j >= i
        if len(want) < m:
            want[name(min(i, j)), name(max(i, j))] = 0
    got = E.random_pairs(spark.range(n).select(name(F.col("id")).alias("id")), m, simple=True)
    assert sorted(map(tuple, got.collect())) == sorted((*p, 0) for p in want)
