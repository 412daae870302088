"""Streams over the given tables, run to their end into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.sources.scratch import shared_folder
from cuesmith.streaming import keyed, stream


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files, a file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parque[t]")


def run_out(df: DataFrame, complete: bool = False, root: str | None = None, clock: bool = True, settings: dict[str, str] | None = None) -> DataFrame:
    """All that a stream gives for what is there now. A batch that runs again
    replaces what it wrote; in complete mode the last batch is the result. A run with
    the ``root`` of an earlier one goes on where that stopped. ``clock`` is for
    states that time out by the clock; ``settings`` hold while the stream runs."""
    spark, root = df.sparkSession, root or shared_folder(df.sparkSession)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out" if complete else f"{root}/out/batch={number}")

    # a timeout by the clock would ask for batches without data for ever
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "false" if clock else "true"} | (settings or {})
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = df.writeStream.outputMode("complete" if complete else "append").foreachBatch(batch).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(f"{root}/out").select(*df.columns)


def delivered(spark: SparkSession, deliveries: list[DataFrame], job, clock: bool = True, settings: dict[str, str] | None = None) -> DataFrame:
    """What ``job`` (stream -> stream) gives when the tables come one after another,
    the stream stopped and started again between them."""
    root = shared_folder(spark)
    for k, rows in enumerate(deliveries):
        rows.write.parquet(f"{root}/in/delivery={k}")
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        out = run_out(job(source), root=f"{root}/job", clock=clock, settings=settings)
    return out


def chunk_tokens(conversations: DataFrame, *more: str) -> DataFrame:
    """(media_id, chunk_index, tokens): each turn as a chunk with its tokens in the row; ``more`` columns stay."""
    words = F.split("text", "[ \n\t\r]+")

    def token(w, i):
        start = F.col("turn") * 120_000 + i * 400 + F.floor(i / 7) * 900
        end = start + 250 + F.length(w) % 8 * 20 + F.when(i % 53 == 17, 5000).otherwise(0)
        text = F.when(i % 3 == 0, F.regexp_replace(w, r"\.$", "!")).otherwise(w)
        return F.struct(text.alias("text"), (start.cast("double") / 1000.0).alias("start"), (end.cast("double") / 1000.0).alias("end"))

    return conversations.select(F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("chunk_index"), F.transform(words, token).alias("tokens"), *more)


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark)
    rows = table_stream(spark, sf_dir, "conversations").select("*", F.col("_metadata.file_modification_time").alias("ts"))
    chunks = chunk_tokens(rows, "ts")
    stream.write_subtitles(chunks, f"{root}/out", f"{root}/state", delay="7 days").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def parts(spark: SparkSession, sf_dir: str, size: int = 2) -> DataFrame:
    rows = table_stream(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("chunk_index"))
    counts = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").cast("long").alias("media_id")).agg((F.max("turn") + 1).cast("long").alias("chunk_count"))
    return run_out(stream.complete_parts(rows.join(counts, "media_id"), size))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_out(stream.fixed_windows(_events(spark, sf_dir), 3600), complete=True)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_out(stream.pause_sessions(_events(spark, sf_dir), 6 * 3600.0), complete=True)


def first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is delivered, and later all of them again with another text: the first counts."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("chunk_index"), "text")
    again = turns.withColumn("text", F.concat(F.lit("again: "), "text"))
    return delivered(spark, [turns, again.union(turns)], stream.first_results)


def late_parts(spark: SparkSession, sf_dir: str, size: int = 2, typed: bool = False) -> DataFrame:
    """Even turns come first and odd ones later; each conversation's last turn never
    comes, so that its part times out once a batch runs after its time. ``typed`` takes the form on typed state."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("chunk_index"))
    last = turns.groupBy("media_id").agg(F.max("chunk_index").alias("last"))
    rows = turns.join(last, "media_id").where("chunk_index < last").select("media_id", "chunk_index", (F.col("last") + 1).alias("chunk_count"))
    tick = spark.range(1).select(F.lit(-1).cast("long").alias("media_id"), F.lit(0).cast("long").alias("chunk_index"), F.lit(1).cast("long").alias("chunk_count"))
    steps = [rows.where("chunk_index % 2 = 0"), rows.where("chunk_index % 2 = 1"), tick]
    if typed:
        return delivered(spark, steps, lambda s: keyed.complete_parts(s, size, timeout_ms=1), settings=keyed.STORE).where("media_id >= 0")
    return delivered(spark, steps, lambda s: stream.complete_parts(s, size, timeout_ms=1)).where("media_id >= 0")


def _late(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All events, then those again that are older than any open window or session: they are too late."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("ts").alias("last"))
    return [events, events.join(F.broadcast(last), F.col("ts") < F.col("last") - F.expr("INTERVAL 2 DAYS")).drop("last")]


def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered(spark, _late(spark, sf_dir), lambda s: stream.fixed_windows(s, 3600), clock=False)


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered(spark, _late(spark, sf_dir), lambda s: stream.pause_sessions(s, 6 * 3600.0), clock=False)


def token_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tokens of up to two hours, delivered by spans of eight days, those with
    odd numbers one delivery later; at the end those again that are older than any open session: they are too late."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = F.col("ts").cast("timestamp")
    tokens = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("id"), start.alias("start"), F.timestamp_micros(F.unix_micros(start) + F.col("event_id") % 7200 * 1_000_000).alias("stop"))
    ends = F.broadcast(tokens.agg(F.min("start").alias("begin"), F.max("start").alias("end")))
    turn = F.floor((F.unix_micros("start") - F.unix_micros("begin")) / (8 * 86_400_000_000)) + F.col("id") % 2
    dealt = tokens.join(ends, F.lit(True)).withColumn("turn", F.least(turn, F.lit(4)))
    late = dealt.where(F.col("start") < F.col("end") - F.expr("INTERVAL 20 DAYS")).withColumn("id", -F.col("id"))
    steps = [rows.select(*tokens.columns) for rows in [*[dealt.where(F.col("turn") == k) for k in range(5)], late]]
    return delivered(spark, steps, lambda s: keyed.token_sessions(s, 6 * 3600.0, "10 days"), clock=False, settings=keyed.STORE)
