"""Chunks that arrive in any order, once or again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuesmith.operators.segment import MAIN, Profile, segment


def first_results(chunks: DataFrame, delay: str | None = None, event_time: str = "ts") -> DataFrame:
    """The first result of each chunk; repeats are ignored. With ``delay`` the
    memory of what was seen is given up that long after the watermark."""
    key = ["media_id", "chunk_index"]
    if delay:
        return chunks.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
    return chunks.dropDuplicates(key)


def write_subtitles(chunks: DataFrame, path: str, checkpoint: str, profile: Profile = MAIN, delay: str | None = None, event_time: str = "ts") -> StreamingQuery:
    """Subtitles of arriving chunks, appended to a table by recording.

    With ``delay`` a repeat is known as one until that long after the watermark of ``event_time``, and the memory of
    it is bounded; without, every chunk is remembered. A row is a chunk with its ``tokens`` array, so a batch holds whole chunks and
    the batch rule applies as it is.
    """

    def batch(rows: DataFrame, number: int) -> None:
        tokens = rows.select("media_id", "chunk_index", F.posexplode("tokens").alias("pos", "t")).select("media_id", "chunk_index", F.col("pos").cast("long").alias("pos"), "t.*")
        # a batch that is run again replaces what it wrote
        segment(tokens, profile).withColumn("batch", F.lit(number)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return first_results(chunks, delay, event_time).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PART_SCHEMA = "media_id long, part long, chunks long, complete boolean"


def complete_parts(chunks: DataFrame, size: int = 10, timeout_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """(media_id, part, chunks, complete): one row when all ``expected`` chunks of a
    part (its last one may have fewer) are in, or an incomplete one when none
    came for ``timeout_ms``. ``chunks`` has media_id, chunk_index and the
    recording's chunk_count. State is dropped with the row, but for a mark that
    keeps late repeats quiet until the timeout."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        media, part = key
        seen, expected, told = state.get if state.exists else ("", 0, False)
        have = {int(x) for x in seen.split(",") if x}
        if state.hasTimedOut:
            state.remove()
            if not told:
                yield pd.DataFrame({"media_id": [media], "part": [part], "chunks": [len(have)], "complete": [False]})
            return
        for rows in batches:
            have |= {int(x) for x in rows["chunk_index"]}
            expected = min(size, int(rows["chunk_count"].iloc[0]) - int(part) * size)
        if not told and len(have) >= expected:
            told = True
            yield pd.DataFrame({"media_id": [media], "part": [part], "chunks": [len(have)], "complete": [True]})
        state.update((",".join(map(str, sorted(have))) if not told else "", expected, told))
        state.setTimeoutDuration(timeout_ms)

    keyed = chunks.withColumn("part", F.floor(F.col("chunk_index") / size))
    return keyed.groupBy("media_id", "part").applyInPandasWithState(step, PART_SCHEMA, "seen string, expected long, told boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fixed_windows(events: DataFrame, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """Events a window of fixed length; later than ``late`` they are dropped."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def pause_sessions(events: DataFrame, pause_seconds: float, late: str = "5 minutes") -> DataFrame:
    """Sessions cut where the pause is ``pause_seconds`` or more. Spark joins events
    whose distance equals the gap, so the gap is a microsecond less."""
    gap = f"{round(pause_seconds * 1_000_000) - 1} microseconds"
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return rows.select("user_id", "first", "last", "n")
