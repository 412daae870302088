"""From chunk subtitles to a final file: order, display delay, numbers, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.functions import text as t
from cuesmith.operators.runs import POSITIONS, STRETCH, Scan, by_blocks, scans

ORDER = ("start", "end", "chunk_index", "sub_no")


def through_file(subtitles: DataFrame) -> DataFrame:
    """Subtitles as they come back from SRT text: whole milliseconds, and without
    the entries that its reader loses (100 hours or more, no text)."""
    rows = subtitles.withColumns({"start": t.through_srt(F.col("start")), "end": t.through_srt(F.col("end"))})
    return rows.where((F.col("start") < 360_000) & (F.col("end") < 360_000) & (t.strip(F.col("text")) != ""))


def display_delay(subtitles: DataFrame, delay: float, keys: tuple[str, ...] = ("media_id",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Each subtitle stays ``delay`` longer, up to the next one's start; the last is free."""
    if delay <= 0:
        return subtitles
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy(*order))
    return subtitles.withColumn("end", F.least(F.col("end") + delay, following))


def numbered(subtitles: DataFrame, keys: tuple[str, ...] = ("media_id",), order: tuple[str, ...] = ORDER, start_index: int = 1, column: str = "entry_no") -> DataFrame:
    return subtitles.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") + (start_index - 1))


def final_entries(subtitles: DataFrame, delay: float = 0.0) -> DataFrame:
    """(media_id, entry_no, start, end, text) of the final file of each recording.
    The delay and the numbers share one order, and so one shuffle."""
    rows = numbered(through_file(subtitles))
    return display_delay(rows, delay, order=ORDER).select("media_id", "entry_no", "start", "end", "text")


def monotonic(subtitles: DataFrame, keys: tuple[str, ...] = ("media_id",), order: tuple[str, ...] = ("sub_no",), least: float = 0.05) -> DataFrame:
    """Starts not before the last end, ends at least ``least`` after starts.

    The recurrence end(i) = max(end, start + least, end(i-1) + least) is a running
    maximum once ``least * i`` is taken off. Positions and the maximum are scans by
    blocks of the first order column, a number, so no task holds a long group.
    """
    block = by_blocks(order[0], POSITIONS if order[0].endswith(("_no", "pos")) else STRETCH)
    rows = scans(subtitles, keys, order, block, {"_n": Scan("sum", F.lit(1).cast("long"), own=True)})
    value = F.greatest("end", F.col("start") + least) - F.col("_n") * least
    rows = scans(rows, keys, order, block, {"_peak": Scan("max", value, own=True), "_before": Scan("max", value)})
    end = lambda peak, n: F.greatest(F.lit(0.0), F.col(peak)) + n * least
    start = F.greatest("start", F.when(F.col("_n") > 1, end("_before", F.col("_n") - 1)).otherwise(F.lit(0.0)))
    return rows.withColumns({"start": start, "end": end("_peak", F.col("_n"))}).select(*subtitles.columns)


def srt_body(entries: DataFrame, keys: tuple[str, ...] = ("media_id",), number: str = "entry_no") -> DataFrame:
    """(keys, body): numbered blocks in order; one line end at the end."""
    block = F.concat(F.col(number).cast("string"), F.lit("\n"), t.srt_time(F.col("start")), F.lit(" --> "), t.srt_time(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _in_order(entries, keys, number, block, "\n")


def vtt_body(entries: DataFrame, keys: tuple[str, ...] = ("media_id",), number: str = "entry_no") -> DataFrame:
    """WebVTT bodies: a header, no numbers, entries without text left out."""
    block = F.concat(t.vtt_time(F.col("start")), F.lit(" --> "), t.vtt_time(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _in_order(entries.where(t.strip(F.col("text")) != ""), keys, number, block, "\n").withColumn("body", F.concat(F.lit("WEBVTT\n\n"), "body"))


def debug_body(entries: DataFrame, keys: tuple[str, ...] = ("media_id",), number: str = "entry_no") -> DataFrame:
    block = F.concat(F.lit("["), t.fixed(F.col("start"), 3), F.lit(" - "), t.fixed(F.col("end"), 3), F.lit("]\n"), F.col("text"), F.lit("\n"))
    return _in_order(entries, keys, number, block, "\n")


def transcript_body(transcripts: DataFrame) -> DataFrame:
    """(media_id, body): stripped chunk texts in order, one a line, empty ones left out."""
    said = transcripts.withColumn("_said", t.strip(F.col("transcript"))).where(F.col("_said") != "")
    return _in_order(said, ("media_id",), "chunk_index", F.col("_said"), "\n")


def _in_order(rows: DataFrame, keys: tuple[str, ...], number: str, block, sep: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), block.alias("b"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["b"]), sep).alias("body"))


def merge_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("media_id").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("chunk_index").alias("chunks"))
