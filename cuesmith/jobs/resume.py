"""From a folder of artifacts to subtitle files, doing only what is left or has changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.operators import backlog, merge, segment
from cuesmith.sources import files
from cuesmith.sources.subtitle_files import write_named, write_subtitles

CHUNK = ["media_id", "chunk_index"]
#: Changes whenever the rules that make subtitles do, so that all are made again.
RULES = "1"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def written(spark: SparkSession, out: str) -> DataFrame:
    """(media_id, kind, chunk_index, size) of the files under ``out``; none where there is no such folder."""
    if not _there(spark, out):
        return _none(spark, "media_id string, kind string, chunk_index long, size long")
    return files.read_manifest(spark, out)


def stamped(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(media_id, chunk_index, stamp) of the chunks with a valid token file: the stamp
    tells sizes and times of its token file and transcript, and the rules' version.
    With ``content`` it tells their SHA-256 in place of times, so that a copied or
    touched file counts as the same; all of these files are read then."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{.tokens.json,.txt}").load(root)
    state = F.sha2("content", 256) if content else F.unix_micros("modificationTime").cast("string")
    rows = files.artifacts(listed.select("path", "length", state.alias("state")), "state")
    rows = rows.where(backlog.valid() & F.col("kind").isin("tokens", "txt") & F.col("chunk_index").isNotNull())
    told = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", "size", "state"))), ",")
    chunks = rows.groupBy(*CHUNK).agg(told.alias("told"), F.max(F.col("kind") == "tokens").alias("has"))
    return chunks.where("has").select(*CHUNK, F.concat(F.lit(RULES + "|"), "told").alias("stamp"))


def made_before(spark: SparkSession, out: str) -> DataFrame:
    """(media_id, chunk_index, stamp, made) of the chunks as of the last run that had
    them; ``made`` is whether there was anything to write."""
    if not _there(spark, f"{out}/_ledger"):
        return _none(spark, "media_id string, chunk_index long, stamp string, made boolean")
    rows = spark.read.schema("media_id string, chunk_index long, stamp string, made boolean, run long").parquet(f"{out}/_ledger")
    last = rows.groupBy(*CHUNK).agg(F.max_by(F.struct("stamp", "made"), "run").alias("last")).select(*CHUNK, "last.*")
    return last.where("stamp is not null")


def left(spark: SparkSession, root: str, out: str, again: Sequence[str] = (), flags: Sequence[str] = (), content: bool = False) -> DataFrame:
    """(media_id, chunk_index, stamp, fresh) of all chunks with tokens of the recordings that
    need work. ``fresh`` chunks have no subtitle file yet or their inputs changed; a
    recording needs work where a chunk is fresh or gone, its final file is not there,
    or ``again`` names it. ``flags`` first drop kinds of files, as when work is forced."""
    have = backlog.after_force(written(spark, out), flags).where(backlog.valid())
    now, before = stamped(spark, root, content), made_before(spark, out)
    forced = any("srt" in backlog.FORCED[f] for f in flags)
    known = before.join(have.where("kind = 'srt'").select(*CHUNK, F.lit(True).alias("file")), CHUNK, "left").where(F.lit(not forced) & (F.col("file") | ~F.col("made")))
    named = F.col("media_id").isin(*again) if again else F.lit(False)
    chunks = now.join(known.select(*CHUNK, F.col("stamp").alias("old")), CHUNK, "left").withColumn("fresh", named | ~F.col("stamp").eqNullSafe(F.col("old"))).drop("old")
    final = have.where("kind = 'final'").select("media_id")
    gone = before.join(now.select(*CHUNK), CHUNK, "left_anti").select("media_id")
    work = chunks.where("fresh").select("media_id").union(gone).union(before.where("made").select("media_id").join(final, "media_id", "left_anti")).distinct()
    return chunks.join(work, "media_id", "left_semi")


def _named(pattern: str, *values: Column | str) -> Column:
    return F.concat("media_id", F.lit(f"{files.WORK}/"), F.format_string(pattern, *values))


def write_final_files(spark: SparkSession, root: str, out: str, delay: float = 0.5, again: Sequence[str] = (), flags: Sequence[str] = (), part: int = 10, content: bool = False) -> DataFrame:
    """Read the chunks' token files and transcripts below ``root``, restore punctuation, cut subtitles and
    write under ``out``, by the names that ``read_manifest`` knows, each fresh chunk's file, each complete
    part of ``part`` chunks with a fresh one, and each recording's final file, tokens and transcript.

    What nothing has changed for is left alone; ``content`` is whether changes are told by what the inputs
    hold (see ``stamped``), and after it is switched all is made again once. A changed, added or removed chunk makes its own file, its part
    and its recording's final files again and nothing else; the file of a removed one stays. Returns what is missing, (media_id, chunk_index, kind): chunks with any
    artifact whose token file is not there or not valid; they are left out of the files.
    """
    todo = left(spark, root, out, again, flags, content).persist()
    parsed = subs = todo
    try:
        chunks = files.read_manifest(spark, root).where(F.col("kind").isin("wav", "txt", "tokens") & F.col("chunk_index").isNotNull()).select(*CHUNK).distinct()
        said = files.whole_files(spark, root, "*.txt").where("chunk_index is not null").withColumnRenamed("body", "transcript").join(todo.select(*CHUNK), CHUNK, "left_semi")
        parsed = files.parse_token_json(files.whole_files(spark, root, "*.tokens.json").where("chunk_index is not null").join(todo.select(*CHUNK), CHUNK, "left_semi")).persist()
        good, made = parsed.where("items is not null").select(*CHUNK), files.tokens_of(parsed)
        subs = merge.through_file(segment.segment_said(made, said, segment.MAIN)).persist()

        fresh = todo.where("fresh").select(*CHUNK)
        write_subtitles(subs.join(fresh, CHUNK, "left_semi").withColumn("file", _named("chunk_%04d", "chunk_index")), out)
        have = backlog.after_force(written(spark, out), flags).where("kind = 'part_srt'").select("media_id", F.floor(F.col("chunk_index") / part).alias("part"), F.lit(True).alias("there"))
        touched = fresh.select("media_id", F.floor(F.col("chunk_index") / part).alias("part"), F.lit(True).alias("touched")).distinct()
        mine = chunks.join(todo.select("media_id").distinct(), "media_id", "left_semi")
        ready = backlog.ready_parts(mine, good, part).where("ready").join(touched, ["media_id", "part"], "left").join(have, ["media_id", "part"], "left")
        ready = ready.where("touched or there is null").select("media_id", "part", "first_chunk", "last_chunk")
        rows = subs.withColumn("part", F.floor(F.col("chunk_index") / part)).join(ready, ["media_id", "part"])
        write_subtitles(rows.withColumn("file", _named("part_%04d_%04d", "first_chunk", "last_chunk")).withColumn("sub_no", F.col("chunk_index") * 1_000_000 + F.col("sub_no")), out)

        finals = merge.final_entries(subs, delay)
        write_subtitles(finals.withColumn("file", F.col("media_id")).withColumnRenamed("entry_no", "sub_no"), out)
        ordered = made.withColumn("pos", F.struct("start", "end", "chunk_index", "pos"))
        write_named(files.token_json(ordered, ("media_id",)).select(F.concat("media_id", F.lit(f"{files.WORK}/all.tokens.json")).alias("file"), "body"), out)
        write_named(merge.transcript_body(said).select(F.concat("media_id", F.lit(".txt")).alias("file"), "body"), out)

        # last: what stopped before is done again
        run = F.lit(spark.sql("SELECT unix_micros(now())").first()[0])
        done = todo.where("fresh").join(subs.select(*CHUNK, F.lit(True).alias("made")).distinct(), CHUNK, "left").select(*CHUNK, "stamp", F.coalesce("made", F.lit(False)).alias("made"))
        gone = made_before(spark, out).join(stamped(spark, root), CHUNK, "left_anti").select(*CHUNK, F.lit(None).cast("string").alias("stamp"), F.lit(False).alias("made"))
        done.unionByName(gone).withColumn("run", run).write.mode("append").parquet(f"{out}/_ledger")
        bad = todo.select(*CHUNK).join(good, CHUNK, "left_anti")
        missing = chunks.join(stamped(spark, root), CHUNK, "left_anti").select(*CHUNK).union(bad).distinct().withColumn("kind", F.lit("tokens"))
        missing.write.mode("overwrite").parquet(f"{out}/_missing")
        return spark.read.schema("media_id string, chunk_index long, kind string").parquet(f"{out}/_missing")
    finally:
        for held in (todo, parsed, subs):
            held.unpersist()
