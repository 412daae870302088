"""The tables of recordings, derived from the given tables.

Times are counted in whole milliseconds and divided once, so every engine gets
the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ms: Column) -> Column:
    return ms.cast("double") / 1000.0


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("chunk_index"), F.col("text").alias("transcript"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts(spark, sf_dir).select("media_id", "chunk_index", F.posexplode(F.split("transcript", "[ \n\t\r]+")).alias("pos", "word"))
    rows = rows.withColumn("pos", F.col("pos").cast("long"))
    start = F.col("chunk_index") * 120_000 + F.col("pos") * 400 + F.floor(F.col("pos") / 7) * 900
    long_one = F.when(F.col("pos") % 53 == 17, 5000).otherwise(0)
    return rows.withColumns({"start_ms": start, "end_ms": start + 250 + F.length("word") % 8 * 20 + long_one})


def bare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).withColumn("text", F.regexp_replace("word", "[.,!?;:…]", "")).where("text <> ''")
    return rows.select("media_id", "chunk_index", "pos", "text", _seconds(F.col("start_ms")).alias("start"), _seconds(F.col("end_ms")).alias("end"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with punctuation; every third word's full stop becomes an exclamation."""
    text = F.when(F.col("pos") % 3 == 0, F.regexp_replace("word", r"\.$", "!")).otherwise(F.col("word"))
    return _words(spark, sf_dir).select("media_id", "chunk_index", "pos", text.alias("text"), _seconds(F.col("start_ms")).alias("start"), _seconds(F.col("end_ms")).alias("end"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), "ts", F.col("event_id").cast("long").alias("event_id"), "event_type", "value", "props")
    return rows.withColumn("rn", F.row_number().over(w).cast("long"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("rn") * 3000 + F.col("event_id") % 1000
    return _ranked(spark, sf_dir).select(F.col("user_id").alias("media_id"), (F.col("rn") - 1).alias("seg_no"), _seconds(start).alias("start"), _seconds(start + 500 + F.col("event_id") * 7 % 1500).alias("end"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("media_id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("media_id", _seconds((F.col("n") + 2) * 3000).alias("duration"), ((F.col("n") + 2) * 48_000 + F.col("media_id") % 16_000).alias("samples"))


def clip_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("rn") * 3000 + F.col("event_id") * 13 % 3000
    return _ranked(spark, sf_dir).select(F.col("user_id").alias("media_id"), (F.col("rn") - 1).alias("pos"), F.col("event_type").alias("text"), _seconds(start).alias("start"), _seconds(start + 200 + F.col("event_id") * 17 % 2500).alias("end"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("rn") - 1
    on = F.floor(no / (F.col("user_id") % 7 + 5)) % 2 == 0
    return _ranked(spark, sf_dir).select(F.col("user_id").alias("media_id"), no.alias("frame_no"), _seconds(no * 32).alias("t"), F.when(on, 0.9).otherwise(0.1).alias("prob"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("rn") - 1
    return _ranked(spark, sf_dir).select(
        F.col("user_id").alias("media_id"), F.floor(no / 3).alias("unit_no"), (no % 3).alias("span_no"), (F.col("rn") * 4).alias("start"), (F.col("rn") * 4 + F.col("event_id") % 4).alias("end"),
        F.col("value").cast("double").alias("score"), F.lit(0.02).alias("ratio"), F.col("user_id").cast("double").alias("offset"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts(spark, sf_dir)
    both = F.col("media_id") + F.col("chunk_index")
    one = rows.where(both % 7 != 0).select("media_id", F.lit("tokens").alias("kind"), "chunk_index", F.length("transcript").cast("long").alias("size"))
    return one.unionByName(rows.where(both % 5 != 0).select("media_id", F.lit("srt").alias("kind"), "chunk_index", F.lit(0).cast("long").alias("size")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("media_id", "chunk_index")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".mp4", ".MKV", ".txt", "-C.mp4"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = F.explode(F.sequence(F.lit(1), F.when(F.col("p_size") % 5 == 0, 2).otherwise(1))).alias("i")
    rows = _table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_size", files)
    return rows.select(F.concat("p_brand", F.lit("-"), "p_partkey").alias("folder"), F.concat("p_name", F.lit("-"), "i", ext).alias("file"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.concat(F.lit(" brand#"), "n_nationkey", F.lit("-"), F.col("n_nationkey") % 10).alias("code"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return _ranked(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("rn").alias("seq"), F.concat("event_type", F.lit(" ["), "rn", F.lit("/"), count, F.lit("]")).alias("stage"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("user_id", "ts", F.concat(F.upper("event_type"), F.lit("-"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("code"))


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length) of a store that holds every kind of artifact of every recording."""
    rows = transcripts(spark, sf_dir)
    at = F.format_string("%04d", "chunk_index")
    work = F.concat(F.lit("/store/"), "media_id", F.lit("/v"), "media_id", F.lit(".srt_work/"))
    size = F.length("transcript").cast("long")
    chunk = [F.concat(work, F.lit("chunk_"), at, F.lit(end)) for end in (".wav", ".txt", ".tokens.json", ".srt")]
    chunk.append(F.concat(work, F.lit("part_"), at, F.lit("_"), at, F.lit(".srt")))
    some = rows.select(size.alias("length"), F.explode(F.array(*chunk)).alias("path"))
    beside = F.concat(F.lit("/store/"), "media_id", F.lit("/v"), "media_id")
    media = [F.concat(work, F.lit("all.tokens.json")), F.concat(work, F.lit("vad_segments.json")), F.concat(work, F.lit("notes.md")), *[F.concat(beside, F.lit(end)) for end in ("_16k_mono.wav", ".srt", ".txt", ".mp4")]]
    return some.unionByName(rows.groupBy("media_id").agg(F.sum(size).alias("length")).select("length", F.explode(F.array(*media)).alias("path")))
