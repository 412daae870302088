"""Token tables: no exchange of tokens over them, and compaction of chunk files into them."""

import json
import uuid

import pytest

from cuesmith.jobs import fixtures as fx
from cuesmith.operators import segment, tokens
from cuesmith.sources import files, token_table

SMALL = "/root/testdata/sf0.001"
BUCKETS = 7


@pytest.fixture
def name():
    return f"tokens_{uuid.uuid4().hex}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange roundrobin") + plan(df).count("Exchange range")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_no_exchange_of_tokens(spark, tmp_path, name, no_broadcast, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        bare, said = fx.bare_tokens(spark, SMALL), fx.transcripts(spark, SMALL)
        table = token_table.write_tokens(bare, name, BUCKETS, str(tmp_path / "t"))
        cut = segment.segment(table.tokens(), segment.MAIN, parts=table.buckets)
        stream = segment.segment_stream(table.tokens(), segment.LEGACY, tokens.CHUNK, parts=table.buckets)
        marks = tokens.restore_punctuation(table.tokens(), said, parts=table.buckets)
        both = segment.segment_said(table.tokens(), said, segment.MAIN, parts=table.buckets)
        for df, moved in [(cut, 0), (stream, 0), (marks, 1), (both, 1)]:  # the transcripts move, and nothing else
            assert exchanges(df) == moved, plan(df)
            assert f"SelectedBucketsCount: {BUCKETS} out of {BUCKETS}" in plan(df)
        for df, want in [(cut, segment.segment(bare, segment.MAIN)), (stream, segment.segment(bare, segment.LEGACY)), (marks, tokens.restore_punctuation(bare, said)), (both, segment.segment_said(bare, said))]:
            assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def put(root, media, chunk, body):
    work = root / f"{media}.srt_work"
    work.mkdir(parents=True, exist_ok=True)
    (work / f"chunk_{chunk:04d}.tokens.json").write_text(body if isinstance(body, str) else json.dumps([{"text": w, "start": k / 2, "end": k / 2 + 0.4} for k, w in enumerate(body)]))


def test_compaction_follows_the_files(spark, tmp_path, name):
    root, other = tmp_path / "in", f"{name}_tidy"
    for m in ("my film", "a#1", "影片"):
        for k in range(4):
            put(root, m, k, [m, "one", str(k)])
    put(root, "none", 0, [])
    run = lambda: token_table.compact(spark, str(root), name, BUCKETS, str(tmp_path / "t"))
    rows = lambda df: sorted(map(tuple, df.select("media_id", "chunk_index", "pos", "text", "start", "end").collect()))
    want = lambda: rows(files.tokens_of(files.parse_token_json(files.whole_files(spark, str(root), "*.tokens.json"))))
    on_disk = lambda: sorted(p.name for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    try:
        table = run()
        assert rows(table.tokens()) == want() and len(want()) == 36
        first = on_disk()
        run()
        assert on_disk() == first
        put(root, "my film", 1, ["corrected", "and", "longer", "now"])
        put(root, "a#1", 2, "{not json")
        put(root, "late", 0, ["late"])
        put(root, "影片", 3, [])
        (root / "a#1.srt_work" / "chunk_0000.tokens.json").unlink()
        table = run()
        assert table.buckets == BUCKETS and rows(table.tokens()) == want() and len(want()) == 36 - 3 + 4 - 3 + 1 - 3 - 3
        added = [p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet" and p.name not in first]
        states = spark.read.parquet(*map(str, added))
        assert {(r.media_id, r.chunk_index) for r in states.collect()} == {("my film", 1), ("a#1", 2), ("late", 0), ("影片", 3), ("a#1", 0)}
        second = on_disk()
        run()
        assert on_disk() == second
        put(root, "a#1", 0, ["back"])
        table = run()
        assert rows(table.tokens()) == want()
        tidy = token_table.tidied(table, other, str(tmp_path / "tidy"))
        assert rows(tidy.tokens()) == want() and rows(token_table.opened(spark, other).tokens()) == want()
        assert len(list((tmp_path / "tidy").glob("*.parquet"))) <= BUCKETS and tidy.states().groupBy("media_id", "chunk_index").agg({"version": "min"}).count() == tidy.states().select("media_id", "chunk_index", "version").distinct().count()
        assert exchanges(segment.segment(tidy.tokens(), segment.MAIN, parts=tidy.buckets)) == 0
    finally:
        for t in (name, other):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_buckets_by_bytes_and_an_empty_folder(spark, tmp_path, name, monkeypatch):
    (tmp_path / "in").mkdir()
    try:
        table = token_table.compact(spark, str(tmp_path / "in"), name, path=str(tmp_path / "t"))
        assert table.buckets == 1 and table.tokens().collect() == []
        spark.sql(f"DROP TABLE {name}")
        put(tmp_path / "in", "a", 0, ["x"] * 50)
        monkeypatch.setattr(token_table, "BUCKET_BYTES", 1000)
        assert token_table.compact(spark, str(tmp_path / "in"), name, path=str(tmp_path / "u")).buckets == 3
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
