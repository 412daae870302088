"""Readers and writers of the artifacts of a recording."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.functions import text as t

CHUNK_FILE = r"([^/]+?)(?:\.srt_work)?/[^/]*chunk_([0-9]+)[^/]*$"


#: What each artifact of a recording is called (fixed values). The first pattern that fits
#: names the kind; its group, where it has one, is the chunk, or a part's first.
ARTIFACTS = [
    ("wav", r"chunk_([0-9]+)\.wav$"),
    ("tokens", r"chunk_([0-9]+)\.tokens\.json$"),
    ("srt", r"chunk_([0-9]+)\.srt$"),
    ("txt", r"chunk_([0-9]+)\.txt$"),
    ("part_srt", r"^part_([0-9]+)_[0-9]+\.srt$"),
    ("all_tokens", r"^all\.tokens\.json$"),
    ("vad", r"^vad_segments\.json$|\.vad\.json$"),
    ("full_wav", r"_16k_mono\.wav$"),
    ("final", r"\.srt$"),
    ("final_txt", r"\.txt$"),
]
#: The folder of a recording's pieces is its name and this ending; beside it lie the
#: whole audio and the final files, named by the recording.
WORK = ".srt_work"


def artifacts(listed: DataFrame, *more: str) -> DataFrame:
    """(media_id, kind, chunk_index, size) of listed files (path, length); files of
    no known kind are left out. A work folder's files belong to the recording it is named after,
    the full audio and final files to the one they are named after, and pieces in
    any other folder to that folder's. ``more`` columns of the list stay."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    kind = index = F.lit(None)
    for k, pattern in reversed(ARTIFACTS):
        kind = F.when(name.rlike(pattern), F.lit(k)).otherwise(kind)
        index = F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1) if "(" in pattern else F.lit("")).otherwise(index)
    rows = listed.select(kind.cast("string").alias("kind"), index.try_cast("long").alias("chunk_index"), F.col("length").cast("long").alias("size"), name.alias("_name"), folder.alias("_folder"), *more).where("kind is not null")
    own = F.regexp_replace("_name", r"_16k_mono\.wav$|\.srt$|\.txt$", "")
    media = F.when(F.col("kind").isin("full_wav", "final", "final_txt"), own).when(F.endswith("_folder", F.lit(WORK)), F.regexp_replace("_folder", re.escape(WORK) + "$", "")).otherwise(F.col("_folder"))
    return rows.select(media.alias("media_id"), "kind", "chunk_index", "size", *more)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``artifacts`` of all files below ``root``; only names and sizes are read."""
    return artifacts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"))


def file_path() -> Column:
    """The path of a text file as it is written; Spark gives it encoded for a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def whole_files(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(media_id, chunk_index, body) of text files of chunks whose names fit ``names``."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names).select(file_path().alias("path"), F.col("value").alias("body"))
    return rows.select(F.regexp_extract("path", CHUNK_FILE, 1).alias("media_id"), F.regexp_extract("path", CHUNK_FILE, 2).try_cast("long").alias("chunk_index"), "body")


def parse_token_json(files: DataFrame, body: str = "body", fields: tuple[str, ...] = ("text", "start", "end")) -> DataFrame:
    """``files`` with ``items`` (array of structs, times as doubles) or null where the
    file is invalid: not an array, or any element without all fields or with a
    time that is no finite number."""
    kind = "array<struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">>"
    raw = F.when(F.col(body).rlike(rf"^{t.SPACE}*\["), F.from_json(F.col(body), kind))
    number = lambda c: c.try_cast("double")

    def good(x: Column) -> Column:
        ok = F.lit(True)
        for f in fields:
            ok = ok & (x[f].isNotNull() if f == "text" else number(x[f]).isNotNull() & ~F.isnan(number(x[f])) & (F.abs(number(x[f])) != float("inf")))
        return ok

    typed = F.transform(raw, lambda x: F.struct(*[(x[f] if f == "text" else number(x[f])).alias(f) for f in fields]))
    return files.withColumn("items", F.when(F.forall(raw, good), typed)).drop(body)


def tokens_of(files: DataFrame) -> DataFrame:
    """Token rows of valid files, ``pos`` from 0."""
    return files.where("items is not null").select("media_id", "chunk_index", F.posexplode("items").alias("pos", "t")).select("media_id", "chunk_index", F.col("pos").cast("long").alias("pos"), "t.*")


def token_json(tokens: DataFrame, keys: tuple[str, ...] = ("media_id", "chunk_index")) -> DataFrame:
    """(keys, body): the tokens of each group as a JSON array."""
    items = F.sort_array(F.collect_list(F.struct("pos", "text", "start", "end")))
    return tokens.groupBy(*keys).agg(F.to_json(F.transform(items, lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")))).alias("body"))


def segments_of(files: DataFrame, body: str = "body") -> DataFrame:
    """Speech segments of ``[{start, end}]`` files; an invalid file gives none, so
    that the recording is done again."""
    rows = parse_token_json(files, body, ("start", "end")).where("items is not null")
    return rows.select("media_id", F.posexplode("items").alias("seg_no", "t")).select("media_id", F.col("seg_no").cast("long").alias("seg_no"), "t.*")


def segment_json(segments: DataFrame) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("seg_no", "start", "end")))
    return segments.groupBy("media_id").agg(F.to_json(F.transform(items, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).alias("body"))


TIMES = rf"^{t.SPACE}*([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}},[0-9]{{3}}){t.SPACE}*-->{t.SPACE}*([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}},[0-9]{{3}})"


def parse_srt(files: DataFrame, keys: tuple[str, ...] = ("media_id", "chunk_index"), body: str = "body") -> DataFrame:
    """(keys, sub_no, start, end, text): blocks between blank lines whose second
    line has times; shorter blocks and others are dropped, further lines are text."""
    plain = t.strip(F.regexp_replace(F.col(body), "\r\n?", "\n"))
    blocks = files.select(*keys, F.posexplode(F.split(plain, rf"\n{t.SPACE}*\n")).alias("block_no", "block"))
    lines = blocks.withColumn("lines", F.split(t.strip(F.col("block")), "\n", -1)).where((F.size("lines") >= 3) & F.col("lines")[1].rlike(TIMES))
    at = lambda k: t.parse_srt_time(F.regexp_extract(F.col("lines")[1], TIMES, k))
    text = t.strip(F.array_join(F.slice("lines", F.lit(3), F.size("lines")), "\n"))
    return lines.select(*keys, F.col("block_no").cast("long").alias("sub_no"), at(1).alias("start"), at(2).alias("end"), text.alias("text")).where("text <> ''")


def write_bodies(bodies: DataFrame, path: str, key: str = "media_id") -> None:
    """One text file a key under ``path``; the sink adds the last line end itself."""
    rows = bodies.select(key, F.regexp_replace("body", "\n$", "").alias("value"))
    rows.repartition(key).write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def write_table(rows: DataFrame, path: str, key: str = "media_id") -> None:
    """Parquet by key; only the keys at hand are replaced, so work resumes where it stood."""
    rows.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
