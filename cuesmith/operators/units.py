"""Alignment units of transcripts and times of aligned units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.functions import text as t

PIECE = f"[A-Za-z0-9']+|{t.NOT_SPACE}"


def alignment_units(transcripts: DataFrame, roman: DataFrame | None = None, keys: tuple[str, ...] = ("media_id", "chunk_index")) -> DataFrame:
    """(keys, unit_no, display, norm, suffix) of each transcript.

    A run of Latin letters, digits and apostrophes, or one CJK character, is a
    unit if its romanized form has a letter; anything else hangs on the unit
    before it, or is lost where there is none. ``roman`` (char, roman) romanizes
    characters and must be a bounded table; without it they stand for themselves.
    """
    pieces = transcripts.select(*keys, F.posexplode(F.regexp_extract_all(t.strip(F.col("transcript")), F.lit(f"({PIECE})"), F.lit(1))).alias("piece_no", "piece"))
    word = F.col("piece").rlike("^[A-Za-z0-9']+$")
    said: Column = F.col("piece")
    if roman is not None:
        pieces = pieces.join(F.broadcast(roman.select(F.col("char").alias("piece"), "roman")), "piece", "left")
        said = F.coalesce("roman", "piece")
    norm = F.when(word | t.is_cjk(F.col("piece")), t.normalize_romanized(said)).otherwise(F.lit(""))
    pieces = pieces.withColumn("norm", norm)
    order = Window.partitionBy(*keys).orderBy("piece_no")
    pieces = pieces.withColumn("unit_no", F.sum((F.col("norm") != "").cast("long")).over(order)).where("unit_no > 0")
    parts = F.sort_array(F.collect_list(F.struct("piece_no", "piece", "norm")))
    units = pieces.groupBy(*keys, "unit_no").agg(parts.alias("p"))
    rest = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x["piece"])
    return units.select(*keys, (F.col("unit_no") - 1).alias("unit_no"), F.col("p")[0]["piece"].alias("display"), F.col("p")[0]["norm"].alias("norm"), F.array_join(rest, "").alias("suffix"))


def timed_units(spans: DataFrame, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """(keys, unit_no, start, end, score): first start to last end in seconds, and
    the mean score weighted by frames, at least one a span."""
    weight = F.greatest(F.lit(1), F.col("end") - F.col("start")).cast("double")
    got = spans.groupBy(*keys, "unit_no").agg(
        F.min_by(F.col("start") * F.col("ratio") + F.col("offset"), "span_no").alias("start"),
        F.max_by(F.col("end") * F.col("ratio") + F.col("offset"), "span_no").alias("end"),
        (F.sum(F.col("score") * weight) / F.sum(weight)).alias("score"),
    )
    return got


def units_tsv(units: DataFrame) -> DataFrame:
    """(media_id, pos, line): start, end, score, text by tabs."""
    return units.select("media_id", "pos", F.concat_ws("\t", t.fixed(F.col("start"), 3), t.fixed(F.col("end"), 3), t.fixed(F.col("score"), 4), "text").alias("line"))
