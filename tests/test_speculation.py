"""Segmentation by speculation equals the plain pass, block by block."""

import random

import pytest
from pyspark.sql import functions as F

from cuesmith.operators import segment


def talk(seed, n, odd=False):
    x = random.Random(seed)
    rows, at = [], 0.0
    words = ["a", "word", "longer", "sentence.", "stop!", "half,", "?", "  ", "", "漢字", "再见。"] + (["b"] * 20 if odd else [])
    for k in range(n):
        text = x.choice(words)
        start = at
        at += 0.0 if odd and x.random() < 0.9 else x.choice([0.1, 0.3, 0.5, 6.0])
        rows.append((k, text, start, at))
        at += x.choice([0.0, 0.0, 0.1, 0.7])
    return rows


def frame(spark, groups):
    return spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "media_id long, pos long, text string, start double, `end` double")


def plain(rows, profile):
    cues = segment.merge_short_cues(segment.cut_tokens(*(list(c) for c in zip(*[r[1:] for r in rows], strict=True)), profile), profile) if rows else []
    return [(k, *c) for k, c in enumerate(cues)]


@pytest.mark.parametrize("size", [1, 3, 40])
def test_blocks_are_the_plain_pass(spark, size):
    long_word = [(k, "w", k * 0.001, k * 0.001) for k in range(90)]  # held open through many blocks
    blank_end = [*talk(9, 20), *[(20 + k, " ", 99.0 + k, 99.5 + k) for k in range(10)]]
    groups = {1: talk(1, 150), 2: talk(2, 60, odd=True), 3: long_word, 4: blank_end, 5: [(0, "one", 0.0, 0.1)], None: talk(3, 30)}
    got = {}
    for r in segment.segment_blocks(frame(spark, groups).repartition(3), segment.LEGACY, size=size).collect():
        got.setdefault(r["media_id"], []).append((r["sub_no"], r["start"], r["end"], r["text"]))
    want = {g: plain(rows, segment.LEGACY) for g, rows in groups.items() if g is not None}
    assert {g: sorted(v) for g, v in got.items() if g is not None} == want


def test_blocks_of_the_main_profile_and_of_nothing(spark):
    groups = {1: talk(5, 120)}
    got = sorted(tuple(r)[1:] for r in segment.segment_blocks(frame(spark, groups), segment.Profile(repair=False), size=25).collect())
    assert got == plain(groups[1], segment.Profile(repair=False))
    assert segment.segment_blocks(frame(spark, groups).where("false")).collect() == []


def test_a_chain_stops_where_it_meets_a_known_cut():
    tokens = [(w, float(k), k + 0.9, k + 1.0) for k, w in enumerate(["one", "two!", "three", "four!", "five"])]
    p = segment.Profile(min_duration=0.0)
    cues, held = segment.cut_chain(tokens, [], p, set(), False)
    assert [c[0] for c in cues] == [1, 3] and held == [("five", 4.0, 4.9)]
    again, rest = segment.cut_chain(tokens, [("zero", -1.0, -0.1)], p, {1, 3}, False)
    assert rest is None and again == [(1, -1.0, 1.9, "zero one two!")]


def test_tasks_get_blocks(spark):
    """The rule sees at most a block of a recording that holds all rows."""
    seen = spark.sparkContext.accumulator(0)
    real = segment.cut_chain

    def counted(tokens, *more):
        if len(tokens) > 50:
            seen.add(1)
        return real(tokens, *more)

    segment.cut_chain = counted
    try:
        n = segment.segment_blocks(frame(spark, {1: talk(6, 500)}), segment.LEGACY, size=50).agg(F.count(F.lit(1))).first()[0]
    finally:
        segment.cut_chain = real
    assert n > 10 and seen.value == 0
