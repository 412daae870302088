"""Planning: speech from frames, chunks of a recording, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.operators.runs import POSITIONS, STRETCH, Scan, by_blocks, cut_islands, over_runs, renumbered, row_before, scans
from cuesmith.sources.scratch import written


def chunk_counts(media: DataFrame, seconds: float) -> DataFrame:
    return media.withColumn("chunks", F.ceil(F.col("duration") / seconds).cast("long"))


def fixed_chunks(media: DataFrame, seconds: float) -> DataFrame:
    """(media_id, chunk_index, start, end): equal chunks, the last as long as what is left."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("duration") / seconds).cast("long") - 1, F.lit(0)))).alias("chunk_index")
    rows = media.select("media_id", "duration", at).withColumn("start", F.col("chunk_index") * F.lit(float(seconds)))
    return rows.where(F.col("start") < F.col("duration")).select("media_id", "chunk_index", "start", F.least(F.col("start") + seconds, "duration").alias("end"))


def sample_chunks(media: DataFrame, seconds: float, rate: int, least: float = 0.25) -> DataFrame:
    """(media_id, chunk_index, first, last) in samples of ``samples``; a rest under
    ``least`` seconds is dropped; no chunk length is one whole chunk."""
    size = int(seconds * rate)
    if size <= 0:
        return media.select("media_id", F.lit(0).cast("long").alias("chunk_index"), F.lit(0).cast("long").alias("first"), F.col("samples").alias("last"))
    count = F.ceil(F.col("samples") / size).cast("long")
    rows = media.where("samples > 0").select("media_id", "samples", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk_index"))
    rows = rows.select("media_id", "chunk_index", (F.col("chunk_index") * size).alias("first"), F.least((F.col("chunk_index") + 1) * size, "samples").alias("last"))
    return rows.where(F.col("last") - F.col("first") >= int(least * rate))


def padded(chunks: DataFrame, media: DataFrame, pad: float) -> DataFrame:
    """Chunks with padded_start and padded_end, inside the recording."""
    total = media.select("media_id", F.col("duration").alias("_total"))
    rows = chunks.join(total, "media_id")
    return rows.withColumns({"padded_start": F.greatest(F.lit(0.0), F.col("start") - pad), "padded_end": F.least(F.col("_total"), F.col("end") + pad)}).drop("_total")


def join_segments(starts: list[float], ends: list[float], longest: float) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for s, e in zip(starts, ends, strict=True):
        if out and e - out[-1][0] <= longest:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def speech_chunks(segments: DataFrame, longest: float) -> DataFrame:
    """(media_id, chunk_index, start, end): runs of whole segments of at most ``longest`` seconds.

    No run reaches over a segment that ends more than ``longest`` after the one
    before it starts, so the islands between such places are joined apart.
    """
    keys, order = ("media_id",), ("start", "end")

    def rule(g: dict[str, list]) -> dict[str, list]:
        chunks = join_segments(g["start"], g["end"], longest)
        return {"chunk_index": list(range(len(chunks))), "start": [c[0] for c in chunks], "end": [c[1] for c in chunks]}

    block = by_blocks("start", STRETCH)
    rows = row_before(segments.select(*keys, *order), keys, order, block, "start", "_before")
    # of equal segments the first has the lesser start before it, and may be the one that cuts
    rows = cut_islands(rows, keys, (*order, "_before"), block, F.col("end") - F.col("_before") > longest).drop("_before")
    parts = written(over_runs(rows, (*keys, "island"), order, rule, "chunk_index long, start double, `end` double"), "chunks")
    return renumbered(parts, keys, "chunk_index").select("media_id", "chunk_index", "start", "end")


def speech_from_frames(frames: DataFrame, threshold: float = 0.5, least_speech: float = 0.25, least_silence: float = 0.3, pad: float = 0.3, frame: float = 0.032) -> DataFrame:
    """Speech segments (media_id, seg_no, start, end) of frame probabilities.

    Frames at the threshold or over are speech; silence shorter than
    ``least_silence`` joins; speech shorter than ``least_speech`` goes; the rest
    is padded, neighbours meeting half-way where the pads would overlap. Frames are looked
    at by blocks of positions and segments by hour: no task holds a recording. Frames
    without a recording are left out.
    """
    keys, place = ["media_id"], by_blocks("frame_no", POSITIONS)
    on = scans(frames.where(F.col("prob") >= threshold), keys, ["frame_no"], place, {"_before": Scan("last", F.struct("t"))})
    gap = F.col("t") - (F.col("_before.t") + frame)
    runs = cut_islands(on, keys, ["frame_no"], place, F.coalesce(gap >= least_silence, F.lit(True)))
    spans = runs.groupBy("media_id", "island").agg(F.min("t").alias("s"), (F.max("t") + frame).alias("e")).where(F.col("e") - F.col("s") >= least_speech)
    near = {"_e": Scan("last", F.struct("e")), "_s": Scan("next", F.struct("s")), "seg_no": Scan("sum", F.lit(1).cast("long"))}
    spans = scans(spans, keys, ["s"], by_blocks("s", STRETCH), near)
    start, end = F.greatest(F.lit(0.0), F.col("s") - pad, (F.col("_e.e") + F.col("s")) / 2), F.least(F.col("e") + pad, (F.col("e") + F.col("_s.s")) / 2)
    return spans.select("media_id", "seg_no", start.alias("start"), end.alias("end"))
