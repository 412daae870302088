"""What is done, what is left, and what was asked for."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.functions import text as t

#: Least size in bytes of a valid artifact, by kind (fixed values).
LEAST_SIZE = {"wav": 1024, "tokens": 2, "srt": 0, "part_srt": 1, "txt": 0, "all_tokens": 2, "vad": 2, "final": 1, "final_txt": 0, "full_wav": 1024}
#: What a force flag drops before work resumes (fixed values).
FORCED = {
    "force_asr": ("txt", "tokens", "srt", "all_tokens", "part_srt", "vad"),
    "force_srt": ("srt", "part_srt"),
    "force_parts": ("srt", "part_srt"),
    "force_chunks": ("wav", "vad"),
    "force_wav": ("full_wav",),
}
VIDEO = (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".ts", ".m2ts", ".webm")
#: Requested codes, at most, for which the catalog is searched by broadcast, and bytes of
#: the codes of one automaton.
MOST_CODES, MOST_BYTES = 300, 32 << 20


def valid() -> Column:
    """Whether an artifact has the least size of its kind."""
    least = F.create_map(*[F.lit(x) for k, v in LEAST_SIZE.items() for x in (k, v)])
    return F.col("size") >= F.coalesce(least[F.col("kind")], F.lit(0))


def after_force(manifest: DataFrame, flags: Sequence[str]) -> DataFrame:
    """The artifacts that stay when the named kinds are to be made again."""
    gone = sorted({k for f in flags for k in FORCED[f]})
    return manifest.where(~F.col("kind").isin(gone)) if gone else manifest


def pending_chunks(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned chunks without both a valid SRT and a valid token file."""
    ok = manifest.where(valid() & F.col("kind").isin("srt", "tokens")).groupBy("media_id", "chunk_index").agg(F.count_distinct("kind").alias("n")).where("n = 2")
    return chunks.join(ok, ["media_id", "chunk_index"], "left_anti")


def media_done(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    left = pending_chunks(chunks, manifest).groupBy("media_id").count()
    return chunks.select("media_id").distinct().join(left, "media_id", "left").select("media_id", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("pending"), F.col("count").isNull().alias("all_done"))


def missing_artifacts(chunks: DataFrame, manifest: DataFrame, kinds: Sequence[str] = ("tokens", "srt")) -> DataFrame:
    wanted = chunks.select("media_id", "chunk_index", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return wanted.join(manifest.where(valid()), ["media_id", "chunk_index", "kind"], "left_anti")


def stale_tokens(transcripts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Chunks whose transcript says something though they have no token (older profile)."""
    return transcripts.where(t.is_effective(F.col("transcript"), legacy=True)).select("media_id", "chunk_index").join(tokens.select("media_id", "chunk_index").distinct(), ["media_id", "chunk_index"], "left_anti")


def ready_parts(chunks: DataFrame, done: DataFrame, size: int = 10) -> DataFrame:
    """(media_id, part, first_chunk, last_chunk, done, ready) of groups of ``size`` chunks."""
    count = chunks.groupBy("media_id").agg(F.max("chunk_index").alias("_last"))
    marks = chunks.join(done.select("media_id", "chunk_index").distinct().withColumn("_done", F.lit(True)), ["media_id", "chunk_index"], "left")
    parts = marks.groupBy("media_id", F.floor(F.col("chunk_index") / size).alias("part")).agg(F.count_distinct("chunk_index").alias("_n"), F.count_distinct(F.when(F.col("_done"), F.col("chunk_index"))).alias("done"))
    rows = parts.join(count, "media_id").withColumns({"first_chunk": F.col("part") * size, "last_chunk": F.least(F.col("part") * size + size - 1, "_last")})
    return rows.withColumn("ready", F.col("done") == F.col("last_chunk") - F.col("first_chunk") + 1).select("media_id", "part", "first_chunk", "last_chunk", "done", "ready")


def progress_percent(chunks: DataFrame, done: DataFrame) -> DataFrame:
    marks = chunks.join(done.select("media_id", "chunk_index").distinct().withColumn("_done", F.lit(1)), ["media_id", "chunk_index"], "left")
    return marks.groupBy("media_id").agg((F.lit(20.0) + F.lit(75.0) * F.count("_done") / F.count(F.lit(1))).alias("percent"))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.upper(t.strip(c)), "-", "")


def automaton(key: str, codes: list[str]) -> ahocorasick.Automaton:
    """The automaton of a search, made once a worker; only the last is kept."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for c in codes:
            made.add_word(c, c)
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _first_folders(folders: DataFrame, codes: list[str]) -> DataFrame:
    """(_code, folder) of codes found in folders' names, each task's first folder of each."""
    key = uuid.uuid4().hex
    sent = folders.sparkSession.sparkContext.broadcast(codes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, str] = {}
        for batch in batches:
            for folder, name in zip(batch.column("folder").to_pylist(), batch.column("_folder").to_pylist(), strict=True):
                for code in {c for _, c in automaton(key, sent.value).iter(name)} if sent.value else ():
                    if code not in first or folder.encode() < first[code].encode():
                        first[code] = folder
        rows = list(first.items())
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + 10_000]], pa.string()) for c in (0, 1)], ["_code", "folder"])

    return folders.mapInArrow(scan, "_code string, folder string")


def match_catalog(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(code, folder, file, status) of each distinct code: its first folder by name
    that contains it, and whether that has exactly one video without subtitles.

    How many codes there are is counted first. Up to ``MOST_CODES`` stand beside the
    folders in each task. More are made into automata of at most ``MOST_BYTES`` of codes each:
    a folder's name is read once by each and all codes in it are found, whatever prefix they
    share; a task keeps the first folder of a code, so what moves is a row a code and task.
    """
    codes = requests.select("code").distinct().withColumn("_code", _plain(F.coalesce("code", F.lit(""))))
    asked = codes.where(F.col("_code") != "")
    folders = catalog.select("folder").where("folder is not null").distinct().withColumn("_folder", F.regexp_replace(F.upper("folder"), "-", ""))
    if asked.limit(MOST_CODES + 1).count() <= MOST_CODES:
        pairs = folders.join(F.broadcast(asked), F.col("_folder").contains(F.col("_code")))
    else:
        spelled = asked.select("_code").distinct()
        parts = 1 + (spelled.agg(F.sum(F.octet_length("_code") + 64)).first()[0] or 0) // MOST_BYTES
        dealt = spelled.withColumn("_part", F.pmod(F.xxhash64("_code"), F.lit(parts)))
        found = [_first_folders(folders, [r[0] for r in dealt.where(F.col("_part") == k).select("_code").collect()]) for k in range(parts)]
        pairs = reduce(DataFrame.unionByName, found).join(asked, "_code")
    first = pairs.groupBy("code").agg(F.min("folder").alias("folder"))
    name = F.element_at(F.split("file", "/"), -1)
    videos = catalog.where(F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*VIDEO)).groupBy("folder").agg(F.count(F.lit(1)).alias("_n"), F.min("file").alias("file"))
    rows = codes.join(first, "code", "left").join(videos, "folder", "left")
    status = (
        F.when(F.col("_code") == "", "invalid").when(F.col("folder").isNull(), "not_found").when(F.col("_n").isNull(), "no_video").when(F.col("_n") > 1, "multiple").when(F.col("file").contains("-C."), "has_subtitles").otherwise("ok")
    )
    return rows.select("code", "folder", F.when(status == "ok", F.col("file")).alias("file"), status.alias("status"))


def recent_codes(uses: DataFrame, most: int = 20) -> DataFrame:
    """(user_id, rank, code, ts): the codes a user used last, each once. The limit
    is the feature."""
    last = uses.groupBy("user_id", "code").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "code")
    return last.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).select("user_id", "rank", "code", "ts")


def collapse_progress(events: DataFrame) -> DataFrame:
    """Events whose stage, counters aside, differs from the one before."""
    key = F.regexp_replace("stage", rf"{t.SPACE}*\[[0-9]+/[0-9]+\]", "")
    before = F.lag("_key").over(Window.partitionBy("session_id").orderBy("seq"))
    return events.withColumn("_key", key).withColumn("_before", before).where(~F.col("_key").eqNullSafe(F.col("_before"))).drop("_key", "_before")


def first_chunks(chunks: DataFrame, most: int = 0) -> DataFrame:
    """The first ``most`` chunks of each recording; 0 is all."""
    return chunks.where(F.col("chunk_index") < most) if most > 0 else chunks


def one_chunk(chunks: DataFrame, number: int) -> DataFrame:
    """The chunk of a 1-based number; its index stays what it is."""
    if number < 1:
        raise ValueError("chunks are numbered from 1")
    return chunks.where(F.col("chunk_index") == number - 1)
