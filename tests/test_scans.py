"""Prefix scans by blocks, and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from cuesmith.operators import intervals, merge, plan
from cuesmith.operators import runs as r


def rows_of(seed, n=300):
    x = random.Random(seed)
    return [(x.choice([1, 2, None]), k, x.choice([None, x.randint(0, 99)]), x.random()) for k in range(n)]


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("own", [False, True])
def test_scans_are_loops(spark, width, own):
    data = rows_of(width)
    df = spark.createDataFrame(data, "k int, at long, v long, x double").repartition(3)
    wanted = {
        "top": r.Scan("max", F.col("v"), own), "run": r.Scan("sum", F.col("v"), own), "before": r.Scan("last", F.col("v"), own), "after": r.Scan("next", F.col("v"), own),
        "shift": r.Scan("last", F.struct("v")), "all": r.Scan("total", F.col("v")),
    }
    got = {row["at"]: row for row in r.scans(df, ["k"], ["at"], r.by_blocks("at", width), wanted).collect()}
    assert len(got) == len(data)
    for key in (1, 2, None):
        group = [d for d in data if d[0] == key]
        for i, (_, at, _v, _x) in enumerate(group):
            past = [d[2] for d in group[: i + own] if d[2] is not None]
            future = [d[2] for d in group[i + (not own) :] if d[2] is not None]
            g = got[at]
            assert g["top"] == max(past, default=None) and g["run"] == sum(past)
            assert g["before"] == (past[-1] if past else None) and g["after"] == (future[0] if future else None)
            assert (g["shift"]["v"] if g["shift"] else None) == (group[i - 1][2] if i else None)
            assert g["all"] == sum(d[2] for d in group if d[2] is not None)


def windows_over_whole_groups(df):
    """Windows of the plan whose partitions are recordings."""
    plan_text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan_text.splitlines() if "Window" in line and "media_id" in line and "_block" not in line and "_k0" not in line]


def test_no_window_holds_a_recording(spark):
    frames = spark.createDataFrame([(1, k, k * 0.032, 0.9) for k in range(5)], "media_id long, frame_no long, t double, prob double")
    spans = spark.createDataFrame([(1, k, float(k), k + 0.5) for k in range(5)], "media_id long, sub_no long, start double, `end` double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (plan.speech_from_frames(frames), merge.monotonic(spans), intervals.clip_to_speech(spans.withColumnRenamed("sub_no", "pos").withColumn("text", F.lit("x")), spans)):
            assert windows_over_whole_groups(df) == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def clipped(tokens, regions):
    out = []
    for pos, s, e in tokens:
        if regions:
            ahead = [a for a, b in regions if b >= s]
            behind = [b for a, b in regions if a <= e]
            if not ahead or not behind:
                continue
            s, e = max(s, ahead[0]), min(e, behind[-1])
            if e <= s:
                continue
        out.append((pos, s, e))
    return out


@pytest.mark.parametrize("hour", [5.0, 3600.0])
def test_long_recordings_are_what_loops_give(spark, monkeypatch, hour):
    for module in (plan, merge, intervals):
        monkeypatch.setattr(module, "STRETCH", hour)
    for module in (plan, merge):
        monkeypatch.setattr(module, "POSITIONS", 17)
    x = random.Random(4)
    regions, at = [], 0.0
    for _ in range(200):
        at += x.choice([0.25, 0.5, 3.0])
        regions.append((at, at + x.choice([0.5, 1.0, 40.0])))
        at = regions[-1][1] + 0.25
    tokens = [(k, s, s + x.choice([0.25, 1.0, 30.0])) for k, s in enumerate(sorted(x.choice([0.0, 0.25]) + x.randint(0, int(at)) for _ in range(400)))]
    tok = spark.createDataFrame([(1, p, "w", s, e) for p, s, e in tokens] + [(2, p, "w", s, e) for p, s, e in tokens[:5]], "media_id long, pos long, text string, start double, `end` double")
    reg = spark.createDataFrame([(1, s, e) for s, e in regions], "media_id long, start double, `end` double")
    got = intervals.clip_to_speech(tok.repartition(3), reg).collect()
    assert sorted((g["pos"], g["start"], g["end"]) for g in got if g["media_id"] == 1) == clipped(tokens, regions)
    assert sorted((g["pos"], g["start"], g["end"]) for g in got if g["media_id"] == 2) == tokens[:5]

    subs = [(1, k, s, e) for k, s, e in tokens]
    moved, last = [], 0.0
    for _, k, s, e in subs:
        s = max(s, last)
        last = max(e, s + 0.05)
        moved.append((k, s, last))
    got = merge.monotonic(spark.createDataFrame(subs, "media_id long, sub_no long, start double, `end` double")).collect()
    assert sorted((g["sub_no"], round(g["start"], 6), round(g["end"], 6)) for g in got) == [(k, round(s, 6), round(e, 6)) for k, s, e in moved]

    on, frame = [x.random() < 0.9 and (k // 23) % 3 > 0 for k in range(2000)], 0.032
    frames = spark.createDataFrame([(1, k, k * frame, 0.9 if v else 0.1) for k, v in enumerate(on)], "media_id long, frame_no long, t double, prob double")
    spans = []
    for k, v in enumerate(on):
        if v and spans and k * frame - (spans[-1][1] + frame) < 0.3:
            spans[-1][1] = k * frame
        elif v:
            spans.append([k * frame, k * frame])
    spans = [(s, e + frame) for s, e in spans if e + frame - s >= 0.25]
    want = []
    for k, (s, e) in enumerate(spans):
        start, end = max(0.0, s - 0.3), e + 0.3
        if k:
            start = max(start, (spans[k - 1][1] + s) / 2)
        if k + 1 < len(spans):
            end = min(end, (e + spans[k + 1][0]) / 2)
        want.append((k, start, end))
    assert sorted((g["seg_no"], g["start"], g["end"]) for g in plan.speech_from_frames(frames).collect()) == want
