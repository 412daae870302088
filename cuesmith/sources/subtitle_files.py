"""Subtitle files as Spark data sources: ``spark.read.format("srt")`` and ``df.write.format("srt")`` or ``"vtt"``.

A row is an entry of a file: ``file`` is the file's path below the folder, without
its ending, so a recording's final file has the recording's name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cuesmith.sources.store import filesystem

SCHEMA = "file string, sub_no long, start double, `end` double, text string"
#: Bytes and files that one task reads.
PART_BYTES, PART_FILES = 32 << 20, 1_000
#: Folder of a job's unfinished files; readers pass it by.
STAGING = "_subtitles-"

_STAMP = r"([0-9]{2}):([0-9]{2}):([0-9]{2}),([0-9]{3})"
_TIMES = re.compile(rf"\s*{_STAMP}\s*-->\s*{_STAMP}")


def parse_body(body: str) -> Iterator[tuple[int, float, float, str]]:
    """(number of the block, start, end, text) of an SRT text, by the rules of ``files.parse_srt``."""
    plain = re.sub("\r\n?", "\n", body).strip()
    for k, block in enumerate(re.split(r"\n\s*\n", plain)):
        lines = block.strip().split("\n")
        m = _TIMES.match(lines[1]) if len(lines) >= 3 else None
        text = "\n".join(lines[2:]).strip()
        if m and text:
            at = [float(int(h) * 3600 + int(mi) * 60 + int(s)) + int(ms) / 1000.0 for h, mi, s, ms in (m.groups()[:4], m.groups()[4:])]
            yield k, at[0], at[1], text


def stamp(seconds: float, point: str) -> str:
    ms = round(max(seconds, 0.0) * 1000)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}{point}{ms % 1000:03d}"


@dataclass
class Files(InputPartition):
    paths: list[str]


class SubtitleReader(DataSourceReader):
    def __init__(self, root: str, ending: str):
        self.root, self.ending = root, ending

    def partitions(self) -> list[Files]:
        store, root = filesystem(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(self.ending) and f"/{STAGING}" not in f.path)
        parts: list[Files] = []
        held = PART_BYTES
        for path, size in found:
            if held + size > PART_BYTES or len(parts[-1].paths) >= PART_FILES:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(path)
            held += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, root = filesystem(self.root)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                body = f.read().decode("utf-8", "replace")
            name = path[len(root.rstrip("/")) + 1 : -len(self.ending)]
            for entry in parse_body(body):
                yield (name, *entry)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class StagedWriter(DataSourceWriter):
    """Each task writes whole files to a folder of its own; they take their places
    when all tasks are done, and what a lost or aborted task wrote goes with the
    job's folder. The rows of a file must reach one task, one after another."""

    def __init__(self, root: str, ending: str, overwrite: bool):
        self.root, self.ending, self.overwrite = root, ending, overwrite
        self.job = f"{STAGING}{uuid.uuid4().hex}"
        # made here and never by a task, so that one that outlives the job can't bring it back
        store, at = filesystem(root)
        store.create_dir(f"{at.rstrip('/')}/{self.job}", recursive=True)

    def pieces(self, rows: Iterator[Row]) -> Iterator[str]:
        """The text of one file, of its rows."""
        raise NotImplementedError

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = filesystem(self.root)
        folder = f"{root.rstrip('/')}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=False)
        done: dict[str, None] = {}
        for name, own in groupby(rows, key=lambda row: row["file"]):
            if name in done:
                raise ValueError(f"the rows of {name!r} came apart")
            if not name or "\0" in name or any(p in ("", ".", "..") for p in name.split("/")):
                raise ValueError(f"{name!r} can be no file's name")
            done[name] = None
            for k in (k for k, c in enumerate(name) if c == "/"):
                store.create_dir(f"{folder}/{name[:k]}", recursive=False)
            with store.open_output_stream(f"{folder}/{name}{self.ending}") as out:
                for piece in self.pieces(own):
                    out.write(piece.encode())
        return Written(folder, list(done))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.root)
        root = root.rstrip("/")
        names: set[str] = set()
        try:
            for name in (n for m in messages if m for n in m.files):
                if name in names:
                    raise ValueError(f"the entries of {name!r} came in several tasks: deal them by file, as write_subtitles does")
                names.add(name)
            if not self.overwrite:
                for name in names:
                    if store.get_file_info(f"{root}/{name}{self.ending}").type != fs.FileType.NotFound:
                        raise FileExistsError(f"{root}/{name}{self.ending}")
            for m in messages:
                for name in m.files if m else ():
                    if "/" in name:
                        store.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
                    store.move(f"{m.folder}/{name}{self.ending}", f"{root}/{name}{self.ending}")
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = filesystem(self.root)
        staging = f"{root.rstrip('/')}/{self.job}"
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class SubtitleWriter(StagedWriter):
    """Entries in order of their starts, as blocks between blank lines."""

    def pieces(self, rows: Iterator[Row]) -> Iterator[str]:
        srt = self.ending == ".srt"
        point = "," if srt else "."
        number, last = 0, float("-inf")
        if not srt:
            yield "WEBVTT\n\n"
        for row in rows:
            start, end, text = row["start"], row["end"], row["text"] or ""
            if start is None or end is None or not start >= last or end != end:
                raise ValueError(f"{row['file']!r} has an entry without times, or its entries are not in order")
            last = start
            if srt or text.strip():
                number += 1
                head = f"{number}\n" if srt else ""
                yield f"{'' if number == 1 else chr(10)}{head}{stamp(start, point)} --> {stamp(end, point)}\n{text}\n"


class BodyWriter(StagedWriter):
    """One row a file, its text as it is."""

    def pieces(self, rows: Iterator[Row]) -> Iterator[str]:
        bodies = [row["body"] or "" for row in rows]
        if len(bodies) > 1:
            raise ValueError("a file has one body")
        return iter(bodies)


class SrtSource(DataSource):
    """Mode ``append`` adds files and fails where one is there; ``overwrite`` replaces
    the files at hand and leaves the others."""

    ending = ".srt"

    @classmethod
    def name(cls) -> str:
        return cls.ending[1:]

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SubtitleReader:
        if self.ending != ".srt":
            raise ValueError("WebVTT files are only written")
        return SubtitleReader(self.options["path"], self.ending)

    def writer(self, schema: StructType, overwrite: bool) -> SubtitleWriter:
        if {"file", "sub_no", "start", "end", "text"} - set(schema.names):
            raise ValueError(f"subtitles have the columns {SCHEMA}")
        return SubtitleWriter(self.options["path"], self.ending, overwrite)


class VttSource(SrtSource):
    ending = ".vtt"


class BodySource(DataSource):
    """(file, body) as one file a row; ``file`` has its ending."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "file string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> BodyWriter:
        return BodyWriter(self.options["path"], "", overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats ``srt``, ``vtt`` and ``named_text`` known to a session."""
    for source in (SrtSource, VttSource, BodySource):
        spark.dataSource.register(source)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("srt").load(path)


def write_subtitles(entries: DataFrame, path: str, style: str = "srt", mode: str = "overwrite") -> None:
    """(file, sub_no, start, end, text) as one file a ``file``, in order of (start, end, sub_no)."""
    register(entries.sparkSession)
    rows = entries.select(F.col("file").cast("string").alias("file"), F.col("sub_no").cast("long").alias("sub_no"), "start", "end", "text")
    rows.repartition("file").sortWithinPartitions("file", "start", "end", "sub_no").write.format(style).mode(mode).save(path)


def write_named(bodies: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(file, body) as text files under ``path``, each by its own name."""
    register(bodies.sparkSession)
    bodies.select("file", "body").repartition("file").write.format("named_text").mode(mode).save(path)
