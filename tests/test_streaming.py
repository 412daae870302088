"""Streams give what the batch gives."""

import time

from pyspark.sql import functions as F

from cuesmith.jobs import fixtures as fx
from cuesmith.operators import segment
from cuesmith.streaming import keyed, stream
from cuesmith.streaming.tables import delivered, run_out

SMALL = "/root/testdata/sf0.001"


def finish(query):
    deadline = time.time() + 120
    while query.isActive and time.time() < deadline:
        time.sleep(0.2)
    if query.exception():
        raise query.exception()
    assert not query.isActive


def chunk_rows(spark):
    items = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text", "start", "end"))), lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")))
    return fx.tokens(spark, SMALL).groupBy("media_id", "chunk_index").agg(items.alias("tokens"))


def test_subtitles_of_a_stream(spark, tmp_path):
    rows = chunk_rows(spark)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    rows.limit(5).write.mode("append").parquet(str(tmp_path / "in"))  # repeats
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    finish(stream.write_subtitles(source, str(tmp_path / "out"), str(tmp_path / "state")))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = segment.segment(fx.tokens(spark, SMALL))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_parts_complete_once(spark, tmp_path):
    schema = "media_id long, chunk_index long, chunk_count long"
    for k, chunks in enumerate([[0, 2, 1], [1, 4], [3, 3], [0, 4]]):
        spark.createDataFrame([(1, c, 5) for c in chunks], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_out(stream.complete_parts(source, 3))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, True), (1, 1, 2, True)]


def events(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "user_id long, s double").select("user_id", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(spark, df, name, tmp_path):
    finish(df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    return spark.table(name)


def test_pause_of_exactly_the_threshold_cuts(spark, tmp_path):
    rows = [(1, 0.0), (1, 0.5), (1, 1.15), (1, 1.79), (1, 9999.0)]
    got = run(spark, stream.pause_sessions(events(spark, tmp_path, rows), 0.65), "sessions", tmp_path)
    assert sorted(r.n for r in got.collect()) == [2, 2]


def test_fixed_windows(spark, tmp_path):
    rows = [(1, 0.0), (1, 59.9), (1, 60.0), (2, 61.0), (1, 99999.0)]
    got = run(spark, stream.fixed_windows(events(spark, tmp_path, rows)), "windows", tmp_path)
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_token_sessions_end_by_the_pause_after_the_last_end(spark):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    token = lambda u, k, a, b: spark.range(1).select(F.lit(u).cast("long").alias("user_id"), F.lit(k).cast("long").alias("id"), at(a).alias("start"), at(b).alias("stop"))
    # 1 and 2 are one session though their starts are far apart; 4 starts a pause after 2's end
    one = token(1, 1, 0, 100).union(token(1, 4, 120, 121)).union(token(2, 1, 0, 1))
    two = token(1, 2, 105, 110).union(token(3, 1, 1000, 1001))
    late = token(1, 3, 50, 300).union(token(3, 2, 5000, 5001))
    got = delivered(spark, [one, two, late], lambda s: keyed.token_sessions(s, 10.0, "60 seconds"), clock=False, settings=keyed.STORE).collect()
    base = 1_700_000_000
    assert sorted((r.user_id, int(r["first"].timestamp()) - base, int(r["last"].timestamp()) - base, r.n) for r in got) == [(1, 0, 110, 2), (1, 120, 121, 1), (2, 0, 1, 1), (3, 1000, 1001, 1)]


def test_typed_parts_are_told_once(spark):
    rows = lambda *x: spark.createDataFrame([(m, c, n) for m, c, n in x], "media_id long, chunk_index long, chunk_count long")
    steps = [rows((1, 0, 3), (1, 2, 3)), rows((1, 1, 3), (1, 0, 3)), rows((1, 1, 3), (2, 0, 1))]
    got = delivered(spark, steps, lambda s: keyed.complete_parts(s, 2), settings=keyed.STORE).collect()
    assert sorted((r.media_id, r.part, r.chunks, r.complete) for r in got) == [(1, 0, 2, True), (1, 1, 1, True), (2, 0, 1, True)]
