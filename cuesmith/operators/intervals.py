"""Interval joins: overlap of chunks and speech, and clipping tokens to speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.operators.runs import STRETCH, Scan, by_blocks, scans


#: Times beyond count as this when intervals are placed.
FAR = float(1 << 52)


def fitting(bin_seconds: float) -> Column:
    """Doublings of ``bin_seconds`` after which a bin is as long as the interval."""
    length = F.abs(_near("end") - _near("start"))
    return F.greatest(F.lit(0), F.ceil(F.log2(length / bin_seconds))).cast("int")


def _near(c: str) -> Column:
    return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col(c)))


def placed(intervals: DataFrame, others: list[int], bin_seconds: float) -> DataFrame:
    """``intervals``, which have ``fit``, once or twice in bins (``doublings``, ``bin``) of the width
    that fits them (``own``) and of each greater width among ``others``."""
    widths = F.explode(F.array_union(F.array("fit"), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("fit"))))
    rows = intervals.withColumn("doublings", widths).withColumn("own", F.col("doublings") == F.col("fit"))
    at = lambda c: F.floor(_near(c) / (F.lit(bin_seconds) * F.pow(F.lit(2.0), F.col("doublings"))))
    return rows.withColumn("bin", F.explode(F.array_distinct(F.array(at("start"), at("end")))))


def overlap(chunks: DataFrame, segments: DataFrame, bin_seconds: float = 60.0) -> DataFrame:
    """Parts of segments inside chunks (media_id, chunk_index, seg_no, start, end).

    A pair meets in bins of the width that fits the longer of the two, which each of
    them crosses at most twice: an interval is there twice for its own width and for each
    greater one that the other side has, so what is shuffled does not grow with
    lengths. Widths double, so there are few. A long recording is many keys; a pair counts
    in the bin where the later of the two begins. Touching is not overlapping; intervals
    without a time are left out.
    """
    c = chunks.select("media_id", "chunk_index", "start", "end").where("start is not null and end is not null").withColumn("fit", fitting(bin_seconds))
    s = segments.select("media_id", "seg_no", "start", "end").where("start is not null and end is not null").withColumn("fit", fitting(bin_seconds))
    fits = lambda df: sorted(r[0] for r in df.select("fit").distinct().collect())
    left = placed(c, fits(s), bin_seconds).select("media_id", "chunk_index", F.col("start").alias("c0"), F.col("end").alias("c1"), F.col("own").alias("c_own"), "doublings", "bin")
    right = placed(s, fits(c), bin_seconds).select("media_id", "seg_no", F.col("start").alias("s0"), F.col("end").alias("s1"), F.col("own").alias("s_own"), "doublings", "bin")
    width = F.lit(bin_seconds) * F.pow(F.lit(2.0), F.col("doublings"))
    later = F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.greatest("c0", "s0"))) / width)
    both = left.join(right, ["media_id", "doublings", "bin"]).where((F.col("c_own") | F.col("s_own")) & (F.col("s1") > F.col("c0")) & (F.col("s0") < F.col("c1")) & (F.col("bin") == later))
    return both.select("media_id", "chunk_index", "seg_no", F.greatest("s0", "c0").alias("start"), F.least("s1", "c1").alias("end"))


def clip_to_speech(tokens: DataFrame, regions: DataFrame, keys: tuple[str, ...] = ("media_id",), order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Tokens moved into the speech regions of their group, sorted and disjoint.

    A start in silence goes to the next region's start, an end in silence to the
    previous region's end; what has no length then is dropped. Without regions
    tokens pass. Two as-of looks: tokens and regions in one order of time, each token
    taking the region after its start, and the one before its end. Both are scans
    by hours, so a recording of any length is many tasks.
    """
    has = F.lit(None)
    columns = [c for c in tokens.columns if c not in keys]
    rows = tokens.select(*keys, F.struct(*columns).alias("_token"), F.col("start").alias("_fwd"), F.col("end").alias("_back"), has.cast("double").alias("_r0"), has.cast("double").alias("_r1"))
    marks = regions.select(*keys, F.lit(None).cast(rows.schema["_token"].dataType).alias("_token"), F.col("end").alias("_fwd"), F.col("start").alias("_back"), F.col("start").alias("_r0"), F.col("end").alias("_r1"))
    # at one time a token stands before a region's end and behind its start, so touching is inside
    both = rows.unionByName(marks).withColumns({"_late": F.col("_token").isNull(), "_soon": F.col("_token").isNotNull()})
    both = scans(both, keys, ("_fwd", "_late"), by_blocks("_fwd", STRETCH), {"_next": Scan("next", F.col("_r0"), own=True), "_any": Scan("total", F.col("_r0").isNotNull().cast("long"))})
    both = scans(both, keys, ("_back", "_soon"), by_blocks("_back", STRETCH), {"_prev": Scan("last", F.col("_r1"), own=True)})
    start, end = F.greatest(F.col("_token.start"), F.col("_next")), F.least(F.col("_token.end"), F.col("_prev"))
    inside = both.where("_token is not null").withColumns({"_s": F.when(F.col("_any") == 0, F.col("_token.start")).otherwise(start), "_e": F.when(F.col("_any") == 0, F.col("_token.end")).otherwise(end)})
    fits = (F.col("_any") == 0) | (F.col("_next").isNotNull() & F.col("_prev").isNotNull() & (F.col("_e") > F.col("_s")))
    return inside.where(fits).select(*keys, *[F.col("_s").alias(c) if c == "start" else F.col("_e").alias(c) if c == "end" else F.col(f"_token.{c}") for c in columns])
