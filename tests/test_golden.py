"""Cases worked out by hand from the rules, CJK included."""

import pytest
from pyspark.sql import functions as F

from cuesmith.functions import text as t
from cuesmith.operators import backlog, intervals, merge, plan, segment, tokens, units
from cuesmith.sources import files


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r.v for r in df.select("k", column(F.col("x")).alias("v")).orderBy("k").collect()]


def tok(spark, rows, media=1, chunk=0):
    return spark.createDataFrame([(media, chunk, k, *r) for k, r in enumerate(rows)], "media_id long, chunk_index long, pos long, text string, start double, `end` double")


def cues(df):
    return [(r.text, round(r.start, 6), round(r["end"], 6)) for r in df.orderBy(*[c for c in ("media_id", "chunk_index", "sub_no") if c in df.columns]).collect()]


def test_times(spark):
    assert values(spark, t.srt_time, [-1.0, 3661.5, 0.0005, 0.0015, 360000.0], "double") == ["00:00:00,000", "01:01:01,500", "00:00:00,000", "00:00:00,002", "100:00:00,000"]
    assert values(spark, t.vtt_time, [3661.5], "double") == ["01:01:01.500"]
    assert values(spark, t.parse_srt_time, ["01:01:01,500", "100:00:00,000", "x"]) == [3661.5, None, None]


def test_fixed_decimals_are_the_exact_values(spark):
    rows = [0.00375, 0.5, 2.5, 0.0005, 1e9 + 0.0625, -0.00375, 0.0, 123.45650000000001, 0.015, 1.0005]
    assert values(spark, lambda c: t.fixed(c, 4), rows, "double") == [f"{x:.4f}" for x in rows]
    assert values(spark, lambda c: t.fixed(c, 3), rows, "double") == [f"{x:.3f}" for x in rows]


def test_effective(spark):
    rows = ["", "。", "...", "！？", " 「」 ", "a。", "“”", None]
    assert values(spark, t.is_effective, rows) == [False] * 5 + [True, True, False]
    assert values(spark, lambda c: t.is_effective(c, legacy=True), rows)[6] is False


def test_extract_text(spark):
    assert values(spark, t.extract_text, ['{"text": " a　 b "}', '"plain \\u4f60"', '{"other": 1}', "[1]", None, '{"text": ""}']) == ["a b", "plain 你", "", "", "", ""]


def test_join_and_combine(spark):
    join = lambda c: t.join_words(F.split(c, r"\|"))
    assert values(spark, join, ["Hello|,|world", "¿|Que", "你|OK |好", ""]) == ["Hello, world", "¿Que", "你OK好", ""]
    for words in (["Hello", ",", "world"], ["¿", "Que"], ["你", "OK ", "好"], ["a　", "b ."]):
        assert t.py_join(words) == values(spark, join, ["|".join(words)])[0]
    df = spark.createDataFrame([("", "b"), ("a", ""), ("你", "b"), ("a", "b")], "a string, b string")
    assert [r.v for r in df.select(t.combine(F.col("a"), F.col("b")).alias("v")).collect()] == ["b", "a", "你b", "a b"]


def test_clean(spark):
    assert values(spark, t.clean_subtitle, ["你 好 ， a", "か な", "a\nb  .", "　x　"]) == ["你好， a", "か な", "a b.", "x"]
    assert [t.py_clean(x) for x in ["你 好 ， a", "か な", "a\nb  .", "　x　"]] == ["你好， a", "か な", "a b.", "x"]


def test_sentence_and_soft(spark):
    rows = ["a.", "a．", "a!", "a；  ", "a…", "b, ", "b、", None]
    assert values(spark, t.ends_sentence, rows) == [False, False, True, True, True, False, False, None]
    assert values(spark, t.has_soft_punctuation, rows) == [False] * 5 + [True, True, None]


def test_align_items(spark):
    rows = ['{"word":" hi ","start":"1","end":2}', '{"text":null,"word":"x","start":0,"end":1}', '{"text":"a","start":2,"end":2}', '{"text":"a","start":"q","end":2}', '{"text":"a","start_time":1,"start":9,"end":2}', "{}", '{"text":"n","start":"NaN","end":"Infinity"}']
    df = spark.createDataFrame([(k, r, 60.0) for k, r in enumerate(rows)], "pos int, item string, offset double")
    assert [(r.pos, r.text, r.start, r["end"]) for r in tokens.normalize_items(df).orderBy("pos").collect()] == [(0, "hi", 61.0, 62.0), (4, "a", 61.0, 62.0)]


def test_builtin_tokens(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 0.5, 10.0), ("b", 1.0, 1.0, 0.5, 10.0)], "text string, start double, `end` double, duration double, offset double")
    assert [tuple(r) for r in tokens.builtin_tokens(df).collect()] == [("a", 11.0, 11.5)]


def test_repair(spark):
    df = tok(spark, [("啊", 0.0, 5.0), ("ab", 0.0, 5.0), ("abc", 0.0, 5.0), ("ab", 0.0, 4.0)])
    assert [r.start for r in tokens.repair_durations(df).orderBy("pos").collect()] == [4.5, 4.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("words", "said", "want"),
    [(["你好", "世界"], "你好，世界。", ["你好，", "世界"]), (["a", "zz", "b"], "a, b.", ["a", "zz", "b"]), (["a", "b"], "a,  b", ["a,", "b"]), (["a,", "b"], "a, b", ["a,", "b"]), (["a", " ", "b"], "a, b", ["a", " ", "b"])],
)
def test_punctuation(spark, words, said, want):
    df = tok(spark, [(w, float(k), k + 0.5) for k, w in enumerate(words)])
    said_df = spark.createDataFrame([(1, 0, said)], "media_id long, chunk_index long, transcript string")
    assert [r.text for r in tokens.restore_punctuation(df, said_df).orderBy("pos").collect()] == want
    assert [r.text for r in tokens.restore_punctuation(df, said_df.where("false")).orderBy("pos").collect()] == words


def test_clip(spark):
    regions = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0)], "media_id long, start double, `end` double")
    spans = [(0.5, 1.5), (1.5, 3.5), (1.8, 2.5), (2.2, 3.5), (2.2, 2.8), (4.5, 5.0), (0.0, 0.5)]
    df = tok(spark, [("x", *x) for x in spans]).drop("chunk_index")
    got = {r.pos: (r.start, r["end"]) for r in intervals.clip_to_speech(df, regions).collect()}
    assert got == {0: (1.0, 1.5), 1: (1.5, 3.5), 2: (1.8, 2.0), 3: (3.0, 3.5)}
    assert intervals.clip_to_speech(df, regions.where("false")).count() == len(spans)


@pytest.mark.parametrize(("rows", "want"), [([(0, 5), (6, 9), (20, 25)], [(0, 9), (20, 25)]), ([(0, 50)], [(0, 50)]), ([(0, 5), (6, 10)], [(0, 10)]), ([], [])])
def test_speech_chunks(spark, rows, want):
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "media_id long, start double, `end` double")
    assert [(r.start, r["end"]) for r in plan.speech_chunks(df, 10.0).orderBy("chunk_index").collect()] == want


def test_padding_and_overlap(spark):
    chunks = spark.createDataFrame([(1, 0, 0.0, 9.0), (1, 1, 20.0, 25.0)], "media_id long, chunk_index long, start double, `end` double")
    media = spark.createDataFrame([(1, 25.5)], "media_id long, duration double")
    assert [(r.padded_start, r.padded_end) for r in plan.padded(chunks, media, 1.0).orderBy("chunk_index").collect()] == [(0.0, 10.0), (19.0, 25.5)]
    one = spark.createDataFrame([(1, 0, 5.0, 10.0)], chunks.schema)
    segs = spark.createDataFrame([(1, 0, 4.0, 6.0), (1, 1, 9.0, 12.0), (1, 2, 1.0, 5.0), (1, 3, 10.0, 11.0), (1, 4, 0.0, 99.0)], "media_id long, seg_no long, start double, `end` double")
    for width in (60.0, 2.0):
        assert sorted((r.seg_no, r.start, r["end"]) for r in intervals.overlap(one, segs, width).collect()) == [(0, 5.0, 6.0), (1, 9.0, 10.0), (4, 5.0, 10.0)]


def test_chunk_plans(spark):
    media = spark.createDataFrame([(1, 125.0, 35_000), (2, 120.0, 100), (3, 0.0, 0)], "media_id long, duration double, samples long")
    starts = {}
    for r in plan.fixed_chunks(media, 60.0).orderBy("media_id", "chunk_index").collect():
        starts.setdefault(r.media_id, []).append(r.start)
    assert starts == {1: [0.0, 60.0, 120.0], 2: [0.0, 60.0]}
    assert [(r.first, r.last) for r in plan.sample_chunks(media, 1.0, 16_000).where("media_id = 1").orderBy("first").collect()] == [(0, 16_000), (16_000, 32_000)]
    assert plan.sample_chunks(media, 0.0, 16_000).count() == 3


SEGMENTED = [
    ([("Hello", 0, 0.4), ("world!", 0.5, 0.9), ("Next", 1, 1.3), ("line", 1.4, 1.9)], [("Hello world!", 0, 0.9), ("Next line", 1, 1.9)], None),
    ([("Hello", 0, 0.4), ("world.", 0.5, 0.9), ("Next", 1, 1.3), ("line", 1.4, 1.9)], [("Hello world. Next line", 0, 1.9)], None),
    ([("Hi!", 0, 0.3), ("There", 0.4, 1.2)], [("Hi!", 0, 0.3), ("There", 0.4, 1.2)], [("Hi! There", 0, 1.2)]),
    ([("aaaaaaaa", 0, 0.5), ("b", 1.5, 1.9)], [("aaaaaaaa b", 0, 1.9)], None),
    ([("aaaaaaaa", 0, 0.8), ("bbbbb", 1.5, 2.5)], [("aaaaaaaa", 0, 0.8), ("bbbbb", 1.5, 2.5)], None),
    ([("aaaaaaaa", 0, 0.8), (" ", 0.9, 1), ("bbbbb", 2, 3)], [("aaaaaaaa bbbbb", 0, 3)], None),
]


@pytest.mark.parametrize(("rows", "main", "legacy"), SEGMENTED)
def test_segmentation(spark, rows, main, legacy):
    df = tok(spark, [(w, float(a), float(b)) for w, a, b in rows])
    assert cues(segment.segment(df, segment.MAIN, merge=False)) == main
    assert cues(segment.segment(df, segment.LEGACY, merge=False)) == (legacy or main)


def subs(spark, rows):
    return spark.createDataFrame([(1, 0, k, float(a), float(b), w) for k, (w, a, b) in enumerate(rows)], "media_id long, chunk_index long, sub_no long, start double, `end` double, text string")


def test_short_merge(spark):
    near, far = [("A long line", 0, 2), ("ok", 2.5, 3.5)], [("A long line", 0, 2), ("ok", 3.5, 4.5)]
    assert cues(segment.merge_short(subs(spark, near), segment.MAIN)) == [("A long line ok", 0, 3.5)]
    assert cues(segment.merge_short(subs(spark, far), segment.MAIN)) == [(w, a, b) for w, a, b in far]
    assert cues(segment.merge_short(subs(spark, far), segment.LEGACY)) == [("A long line ok", 0, 4.5)]
    assert len(cues(segment.merge_short(subs(spark, [("ok", 0, 1), ("A long line", 1, 3)]), segment.MAIN))) == 2


def test_display_delay(spark):
    df = subs(spark, [("a", 0, 1), ("b", 1.2, 2), ("c", 1.5, 3)])
    assert [x[1:] for x in cues(merge.display_delay(df, 0.5))] == [(0, 1.2), (1.2, 1.5), (1.5, 3.5)]
    assert [x[1:] for x in cues(merge.display_delay(df, 0))] == [(0, 1), (1.2, 2), (1.5, 3)]


def test_srt_files(spark):
    body = "1\r\n00:00:00,000 --> 00:00:01,500 x\r\ntwo\r\nlines\r\n\r\n2\r\n00:00:02,000 --> 00:00:03,000\r\n\r\n3\n100:00:00,000 --> 100:00:01,000\nlate\n\n4\n00:00:04,000-->00:00:05,000\nend\n"
    df = spark.createDataFrame([(1, 0, body), (1, 1, "")], "media_id long, chunk_index long, body string")
    got = files.parse_srt(df)
    assert cues(got) == [("two\nlines", 0, 1.5), ("end", 4, 5)]
    out = merge.srt_body(merge.numbered(got.withColumn("chunk_index", F.lit(0))))
    assert out.first().body == "1\n00:00:00,000 --> 00:00:01,500\ntwo\nlines\n\n2\n00:00:04,000 --> 00:00:05,000\nend\n"


def test_token_files(spark):
    rows = ['[{"text":"a","start":1,"end":"2.5"}]', '{"text":"a"}', '[{"text":null,"start":1,"end":2}]', '[{"text":"a","start":"x","end":2}]', "[]", "nonsense", '[{"text":"a","start":1}]']
    df = spark.createDataFrame([(1, k, r) for k, r in enumerate(rows)], "media_id long, chunk_index long, body string")
    got = files.parse_token_json(df)
    assert {r.chunk_index: r.n for r in got.select("chunk_index", F.size("items").alias("n")).where("items is not null").collect()} == {0: 1, 4: 0}
    assert [(r.text, r.start, r["end"]) for r in files.tokens_of(got).collect()] == [("a", 1.0, 2.5)]


@pytest.mark.parametrize(("said", "want"), [("Hi, you!", [("Hi", "hi", ","), ("you", "you", "!")]), ("café", [("caf", "caf", "é")]), (", a", [("a", "a", "")]), ("a 12 b", [("a", "a", "12"), ("b", "b", "")]), ("", [])])
def test_alignment_units(spark, said, want):
    df = spark.createDataFrame([(1, 0, said)], "media_id long, chunk_index long, transcript string")
    assert [(r.display, r.norm, r.suffix) for r in units.alignment_units(df).orderBy("unit_no").collect()] == want


def test_alignment_units_of_cjk(spark):
    df = spark.createDataFrame([(1, 0, "你好，OK")], "media_id long, chunk_index long, transcript string")
    roman = spark.createDataFrame([("你", "ni"), ("好", "hao")], "char string, roman string")
    assert [(r.display, r.norm, r.suffix) for r in units.alignment_units(df, roman).orderBy("unit_no").collect()] == [("你", "ni", ""), ("好", "hao", "，"), ("OK", "ok", "")]


def test_span_to_unit(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 2, 0.5, 0.02, 10.0), (1, 0, 1, 5, 5, 1.0, 0.02, 10.0)], "media_id long, unit_no long, span_no long, start long, `end` long, score double, ratio double, offset double")
    r = units.timed_units(df).first()
    assert (r.start, r["end"], round(r.score, 9)) == (10.0, 10.1, round(2 / 3, 9))


def test_gap_profile(spark):
    df = tok(spark, [("hello", 0.0, 0.4), ("world.", 0.5, 0.9), ("next", 1.0, 1.4)])
    assert cues(segment.gap_segment(df, post=False)) == [("hello world.", 0, 0.9), ("next", 1, 1.4)]
    assert segment.merge_fragments([(0.0, 0.3, "ok"), (0.5, 1.0, "then")], segment.GAP) == [(0.0, 1.0, "okthen")]
    assert cues(segment.gap_segment(tok(spark, [("你", 0.0, 0.4), ("好", 0.5, 0.9), ("，", 0.9, 1.0)]), post=False)) == [("你好，", 0, 1)]


def test_monotonic(spark):
    df = subs(spark, [("a", 0, 1), ("b", 0.5, 0.8), ("c", 0.9, 2)])
    assert [x[1:] for x in cues(merge.monotonic(df))] == [(0, 1), (1, 1.05), (1.05, 2)]
    assert segment.monotonic_cues([(0, 1, "a"), (0.5, 0.8, "b"), (0.9, 2, "c")]) == [(0, 1, "a"), (1, 1.05, "b"), (1.05, 2, "c")]


def test_catalog(spark, monkeypatch):
    catalog = spark.createDataFrame([("ABC-123 x", "v.mp4"), ("ABC-123 y", "w.mp4"), ("two", "a.mkv"), ("two", "b.MP4"), ("none", "a.txt"), ("sub", "X-C.mp4")], "folder string, file string")
    asked = spark.createDataFrame([("abc123",), ("TWO",), ("none",), (" sub ",), ("zzz",), (" ",), ("ab-c",)], "code string")
    want = {"abc123": "ok", "TWO": "multiple", "none": "no_video", " sub ": "has_subtitles", "zzz": "not_found", " ": "invalid", "ab-c": "ok"}
    assert {r.code: r.status for r in backlog.match_catalog(asked, catalog).collect()} == want
    monkeypatch.setattr(backlog, "MOST_CODES", 1)
    assert {r.code: r.status for r in backlog.match_catalog(asked, catalog).collect()} == want


def test_progress(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(["a [1/3]", "a [2/3]", "b", "a [3/3]"], 1)], "session_id long, seq long, stage string")
    assert [r.seq for r in backlog.collapse_progress(df).orderBy("seq").collect()] == [1, 3, 4]


def test_parts(spark):
    chunks = spark.range(23).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("chunk_index"))
    got = backlog.ready_parts(chunks, chunks.where("chunk_index <> 11"), 10).orderBy("part").collect()
    assert [(r.first_chunk, r.last_chunk, r.ready) for r in got] == [(0, 9, True), (10, 19, False), (20, 22, True)]


def test_one_chunk(spark):
    chunks = spark.range(3).select(F.lit(1).alias("media_id"), F.col("id").alias("chunk_index"))
    assert [r.chunk_index for r in backlog.one_chunk(chunks, 2).collect()] == [1]
    assert backlog.first_chunks(chunks, 0).count() == 3
    with pytest.raises(ValueError):
        backlog.one_chunk(chunks, 0)
