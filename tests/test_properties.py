"""Properties that hold whatever the tokens."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.functions import text as t
from cuesmith.jobs import fixtures as fx
from cuesmith.jobs import resume
from cuesmith.operators import backlog, engine, merge, plan, runs, segment, tokens
from cuesmith.sources import files

SMALL = "/root/testdata/sf0.001"
WORDS = st.lists(st.tuples(st.sampled_from(["a", "bb,", "ccc!", "你", "好。", " ", "Hello", "w.", "¿", "…", "longer-word"]), st.integers(0, 900), st.integers(20, 5200)), max_size=60)


def timed(words):
    at, out = 0, []
    for w, gap, length in words:
        at += gap
        out.append((w, at / 1000, (at + length) / 1000))
        at += length
    return [list(x) for x in zip(*out, strict=True)] or [[], [], []]


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_cues_keep_all_text_in_order(words):
    texts, starts, ends = timed(words)
    want = re.sub(r"\s", "", "".join(texts))
    for p in (segment.MAIN, segment.LEGACY):
        cut = segment.cut_tokens(texts, starts, ends, p)
        for cues in (cut, segment.merge_short_cues(cut, p)):
            assert re.sub(r"\s", "", "".join(c[2] for c in cues)) == want
            assert all(a[1] <= b[0] for a, b in zip(cues, cues[1:], strict=False))
    keep = [k for k, w in enumerate(texts) if w.strip()]
    units = [[x[k] for k in keep] for x in (texts, starts, ends)]
    gap = segment.monotonic_cues(segment.merge_fragments(segment.cut_units(*units, segment.GAP), segment.GAP))
    assert re.sub(r"\s", "", "".join(c[2] for c in gap)) == want
    assert all(a[1] <= b[0] and a[1] >= a[0] + 0.05 - 1e-9 for a, b in zip(gap, gap[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(WORDS, st.text("a b,.!?你好。 ", max_size=80))
def test_punctuation_only_adds_marks(words, said):
    texts = [w for w, _, _ in words]
    got = tokens.punctuate(texts, said)
    assert len(got) == len(texts)
    assert all(g.startswith(w) and t.py_punctuation(g[len(w) :]) == g[len(w) :] for g, w in zip(got, texts, strict=True))


def test_result_does_not_depend_on_partitions(spark):
    df = fx.tokens(spark, SMALL)
    one = sorted(map(tuple, segment.segment(df.repartition(1)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(tuple, segment.segment(df.repartition(13)).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_small_arrow_batches_split_groups(spark):
    df = fx.tokens(spark, SMALL)
    whole = sorted(map(tuple, segment.segment(df).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, segment.segment(df).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_islands_are_the_whole(spark):
    rng = random.Random(5)
    rows = []
    for media in range(6):
        at = 0
        for pos in range(rng.choice([0, 1, 40, 300])):
            at += rng.choice([10, 50, 700, 1200])
            rows.append((media, pos, rng.choice(["a", "bb!", "word", "x;", " ", "好", "long-word,"]), at / 1000, (at + rng.choice([50, 300, 4500])) / 1000))
            at = int(rows[-1][4] * 1000)
    df = spark.createDataFrame(rows, "media_id long, pos long, text string, start double, `end` double")
    whole = segment.segment(df, segment.MAIN, ("media_id",))
    assert sorted(map(tuple, segment.segment_long(df).collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(ValueError):
        segment.segment_long(df, segment.LEGACY)


def test_srt_round_trip_is_the_identity_at_milliseconds(spark):
    subs = merge.through_file(segment.segment(fx.tokens(spark, SMALL)))
    entries = merge.numbered(subs)
    back = files.parse_srt(merge.srt_body(entries), ("media_id",))
    want = entries.select("media_id", (F.col("entry_no") - 1).alias("sub_no"), "start", "end", "text")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_written_files_are_read_again(spark, tmp_path):
    df = fx.bare_tokens(spark, SMALL)
    bodies = files.token_json(df)
    for r in bodies.collect():
        folder = tmp_path / str(r.media_id)
        folder.mkdir(exist_ok=True)
        (folder / f"chunk_{r.chunk_index:04d}.tokens.json").write_text(r.body)
    manifest = files.read_manifest(spark, str(tmp_path))
    assert {(r.media_id, r.chunk_index, r.kind) for r in manifest.collect()} == {(str(r.media_id), r.chunk_index, "tokens") for r in bodies.collect()}
    back = files.tokens_of(files.parse_token_json(files.whole_files(spark, str(tmp_path))))
    got = sorted((int(r.media_id), r.chunk_index, r.pos2, r.text, r.start, r["end"]) for r in back.withColumnRenamed("pos", "pos2").collect())
    want = {}
    for r in df.orderBy("media_id", "chunk_index", "pos").collect():
        want.setdefault((r.media_id, r.chunk_index), []).append((r.text, r.start, r["end"]))
    assert got == sorted((m, c, k, *x) for (m, c), rows in want.items() for k, x in enumerate(rows))


def a_store(tmp_path):
    """Real files of every kind, of two recordings."""
    for media in ("talk.v1", "ABC-1"):
        work = tmp_path / "store" / f"{media}.srt_work"
        work.mkdir(parents=True)
        for k in (0, 12345):
            for end in (".wav", ".txt", ".tokens.json", ".srt"):
                (work / f"chunk_{k:04d}{end}").write_text("x" * 2000)
        for name in ("part_0000_0009.srt", "all.tokens.json", "vad_segments.json", "notes.md"):
            (work / name).write_text("xyz")
        for end in ("_16k_mono.wav", ".srt", ".txt", ".mp4"):
            (tmp_path / "store" / f"{media}{end}").write_text("xyz")
    return str(tmp_path / "store")


CHUNKED = {"wav", "txt", "tokens", "srt"}
ONCE = {"part_srt", "all_tokens", "vad", "full_wav", "final", "final_txt"}


def test_every_artifact_has_its_kind(spark, tmp_path):
    got = files.read_manifest(spark, a_store(tmp_path)).collect()
    want = {(m, k, c) for m in ("talk.v1", "ABC-1") for k in CHUNKED for c in (0, 12345)} | {(m, k, 0 if k == "part_srt" else None) for m in ("talk.v1", "ABC-1") for k in ONCE}
    assert {(r.media_id, r.kind, r.chunk_index) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(
    ("flag", "gone"),
    [("force_wav", {"full_wav"}), ("force_chunks", {"wav", "vad"}), ("force_srt", {"srt", "part_srt"}), ("force_parts", {"srt", "part_srt"}), ("force_asr", {"txt", "tokens", "srt", "all_tokens", "part_srt", "vad"})],
)
def test_each_flag_drops_its_files(spark, tmp_path, flag, gone):
    manifest = files.read_manifest(spark, a_store(tmp_path))
    left = {r.kind for r in backlog.after_force(manifest, [flag]).select("kind").distinct().collect()}
    assert left == (CHUNKED | ONCE) - gone


def test_files_to_final_files_and_only_what_is_left(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    bodies = {(r.media_id, r.chunk_index): r.body for r in files.token_json(fx.bare_tokens(spark, SMALL)).collect()}
    said = {(r.media_id, r.chunk_index): r.transcript for r in fx.transcripts(spark, SMALL).collect()}
    media = sorted({m for m, _ in bodies})[:6]

    def put(m):
        work = root / f"{m}.srt_work"
        work.mkdir(parents=True)
        for (i, k), body in bodies.items():
            if i == m:
                (work / f"chunk_{k:04d}.tokens.json").write_text(body)
                (work / f"chunk_{k:04d}.txt").write_text(said[(i, k)])

    def finals():
        return {p.stem: (p.read_text(), p.stat().st_mtime_ns) for p in out.glob("*.srt")}

    for m in media[:4]:
        put(m)
    resume.write_final_files(spark, str(root), str(out))
    first = finals()
    subs = segment.segment(tokens.restore_punctuation(fx.bare_tokens(spark, SMALL), fx.transcripts(spark, SMALL)), segment.MAIN)
    want = {str(r.media_id): r.body for r in merge.srt_body(merge.final_entries(subs, 0.5)).collect()}
    assert {k: v for k, (v, _) in first.items()} == {str(m): want[str(m)] for m in media[:4]}
    for m in media[4:]:
        put(m)
    assert {r.media_id for r in resume.left(spark, str(root), str(out)).collect()} == {str(m) for m in media[4:]}
    resume.write_final_files(spark, str(root), str(out))
    second = finals()
    assert set(second) == {str(m) for m in media} and all(second[k] == v for k, v in first.items())
    resume.write_final_files(spark, str(root), str(out), again=[str(media[0])])
    third = finals()
    assert {k for k in third if third[k] != second[k]} == {str(media[0])} and third[str(media[0])][0] == second[str(media[0])][0]


def test_bodies_resume(spark, tmp_path):
    out = str(tmp_path / "srt")
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "c\n")], "media_id long, body string")
    files.write_bodies(df, out)
    files.write_bodies(df.where("media_id = 1").withColumn("body", F.lit("new\n")), out)
    got = {p.parent.name: p.read_text() for p in (tmp_path / "srt").glob("media_id=*/part-*")}
    assert got == {"media_id=1": "new\n", "media_id=2": "c\n"}


def test_engine_keeps_order_and_counts(spark):
    pending = spark.createDataFrame([(1, k, k * 10.0) for k in range(11)], "media_id long, chunk_index long, padded_start double")
    load = lambda: lambda rows: [(f"c{r['chunk_index']}", [("w", 0.5, 1.0)]) for r in rows]
    got = engine.run_engine(pending, load).orderBy("chunk_index").collect()
    assert [(r.transcript, r.tokens[0].start) for r in got] == [(f"c{k}", k * 10 + 0.5) for k in range(11)]
    with pytest.raises(Exception, match="the engine returned"):
        engine.run_engine(pending, lambda: lambda rows: []).collect()


def test_long_groups_go_to_the_rules_in_islands(spark, monkeypatch):
    """No group of the rules is a whole recording where a state-free cut parts it."""
    seen = []

    def spy(df, keys, *rest, **named):
        seen.append(tuple(keys))
        return runs.over_runs(df, keys, *rest, **named)

    monkeypatch.setattr(plan, "over_runs", spy)
    monkeypatch.setattr(segment, "over_runs", spy)
    r = random.Random(8)
    at, rows = 0.0, []
    for k in range(400):
        at += r.choice([0.0, 0.1, 0.6, 0.9, 4.0])
        rows.append((1, k, at, at + r.choice([0.2, 1.0, 7.0]), r.choice(["a", "bcd.", "e,", "fgh ijk"])))
        at = rows[-1][3] if r.random() < 0.7 else at
    df = spark.createDataFrame(rows, "media_id long, pos long, start double, `end` double, text string").repartition(4)
    rows.sort(key=lambda x: (x[2], x[3], x[1]))
    starts, ends, texts = [x[2] for x in rows], [x[3] for x in rows], [x[4] for x in rows]
    got = [(x.start, x.end) for x in plan.speech_chunks(df, 6.0).orderBy("chunk_index").collect()]
    assert got == plan.join_segments(starts, ends, 6.0)
    cues = segment.cut_units(texts, starts, ends, segment.GAP)
    for post, want in ((False, cues), (True, segment.monotonic_cues(segment.merge_fragments(cues, segment.GAP)))):
        out = segment.gap_segment(df, post=post).orderBy("sub_no").collect()
        assert [(x.sub_no, x.start, x.end, x.text) for x in out] == [(k, *c) for k, c in enumerate(want)]
    assert seen == [("media_id", "island")] * 3  # what a recording's cues go through then holds one of them


def test_equal_segments_stay_in_order(spark):
    """Of two equal segments the first one cuts, whichever way the rows come."""
    rows = [(1, 0.0, 2.0), *[(1, 10.0 * k, 10.0 * k + 7.0) for k in range(1, 40) for _ in range(3)]]
    want = plan.join_segments([x[1] for x in rows], [x[2] for x in rows], 8.0)
    for seed in range(4):
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "media_id long, start double, `end` double").repartition(3)
        assert [(x.start, x.end) for x in plan.speech_chunks(df, 8.0).orderBy("chunk_index").collect()] == want


def test_legacy_rule_holds_no_group(spark):
    """A cue comes out after a few tokens of an endless group, and long groups are cut as short ones."""
    read = []

    def endless():
        for k in range(10_000):
            read.append(k)
            yield "word", k * 1.0, k + 0.9

    cues = segment.merge_stream(segment.cut_stream(endless(), segment.LEGACY), segment.LEGACY)
    assert next(cues)[0] == 0.0 and len(read) < 50
    r = random.Random(9)
    rows, want = [], []
    for m in range(3):
        at = 0.0
        for k in range((1, 12_000, 30)[m]):
            at += r.choice([0.0, 0.1, 0.7])
            rows.append((m, k, at, at + r.choice([0.1, 0.3, 2.0]), r.choice(["a", "bcd.", " ", "e,", "fgh ijk", "好。"])))
            at = rows[-1][3]
        own = [list(x) for x in zip(*(x[2:] for x in rows if x[0] == m), strict=True)]
        want += [(m, k, *c) for k, c in enumerate(segment.merge_short_cues(segment.cut_tokens(own[2], own[0], own[1], segment.LEGACY), segment.LEGACY))]
    df = spark.createDataFrame(rows, "media_id long, pos long, start double, `end` double, text string").repartition(4)
    for f in (segment.segment, segment.segment_stream):
        assert sorted(map(tuple, f(df, segment.LEGACY, ("media_id",)).collect())) == want


def test_blocks_do_not_change_sums_and_neighbours(spark):
    """Groups that reach over many blocks, ties at their edges, null and NaN starts."""
    r = random.Random(3)
    rows = [(m, k, r.choice([None, float("nan"), *[x / 4 for x in range(60)]]), r.randint(0, 3)) for m in range(4) for k in range(200)]
    df = spark.createDataFrame(rows, "m long, k long, s double, v long").repartition(5)
    w = Window.partitionBy("m").orderBy("s", "k")
    want = df.withColumns({"p": F.lag("v").over(w), "t": F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    block = runs.by_blocks("s", 1.0)
    got = runs.sum_before(runs.row_before(df, ["m"], ["s", "k"], block, "v", "p"), ["m"], ["s", "k"], block, F.col("v"), "t")
    assert sorted((x.m, x.k, x.p, x.t) for x in got.collect()) == sorted((x.m, x.k, x.p, x.t) for x in want.collect())
