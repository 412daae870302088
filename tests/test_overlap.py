"""Overlaps of intervals of any length."""

import random

import pytest
from pyspark.sql import functions as F

from cuesmith.operators import intervals

C, S = "media_id long, chunk_index long, start double, `end` double", "media_id long, seg_no long, start double, `end` double"


def some(seed, n, longest):
    x = random.Random(seed)
    out = []
    for k in range(n):
        start = x.choice([x.uniform(-50, 500), float(x.randint(0, 50) * 10)])
        out.append((x.choice([1, 2]), k, start, start + x.choice([0.0, 10.0, x.expovariate(1 / longest)])))
    return out


@pytest.mark.parametrize("width", [0.5, 60.0])
@pytest.mark.parametrize("longest", [1.0, 3000.0])
def test_overlaps_are_all_pairs_that_overlap(spark, width, longest):
    chunks, segments = some(1, 120, longest), some(2, 150, longest)
    chunks += [(1, 900, 0.0, float("inf")), (1, 901, float("-inf"), 5.0), (1, 902, 3.0, None), (3, 903, 0.0, 1.0)]
    segments += [(1, 900, 1e9, 1e12), (1, 901, None, 1.0)]
    whole = [r for r in chunks if None not in r], [r for r in segments if None not in r]
    want = sorted((m, c, s, max(c0, s0), min(c1, s1)) for m, c, c0, c1 in whole[0] for n, s, s0, s1 in whole[1] if m == n and s1 > c0 and s0 < c1)
    got = intervals.overlap(spark.createDataFrame(chunks, C), spark.createDataFrame(segments, S).repartition(3), width).collect()
    assert sorted(map(tuple, got)) == want


def test_what_is_shuffled_does_not_grow_with_lengths(spark):
    def copies(length):
        rows = spark.createDataFrame([(1, k, k * length, (k + 1) * length) for k in range(100)], C).withColumn("fit", intervals.fitting(60.0))
        return intervals.placed(rows, [0, 3], 60.0).count()

    assert copies(50.0) <= 4 * 100 and copies(3e6) <= 2 * 100 and copies(1e12) <= 2 * 100


def test_no_intervals(spark):
    none = spark.createDataFrame([], C)
    one = spark.createDataFrame([(1, 0, 0.0, 1.0)], S)
    assert intervals.overlap(none, one).collect() == []
    assert intervals.overlap(spark.createDataFrame([(1, 0, 0.0, 1.0)], C), one.where(F.lit(False))).collect() == []
