"""Web archives in ZIP packages: WARC records, compressed one by one, and a CDXJ
index, both as stored members, so that a record is read by one ranged read.

The reader finds the central directory from the end of the file, ZIP64 or not,
takes the places of the members from it, reads the index and then only the bytes
of each record. Nothing is extracted. Archives and indexes are known by the ends of
their names, so packages of other makers are read too.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored
from .files import filesystem

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: How the names of archives and of indexes end, in any folder of a package.
ARCHIVES, INDEXES = (".warc.gz", ".warc"), (".cdxj", ".cdx", ".cdx.gz", ".cdxj.gz")
TIME = "19700101000000"
#: A payload of fewer bytes is always written in full.
LEAST_SHARED = 100
ARCHIVE_BYTES = 64 << 20
MOST_TASKS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def _zip64(extra: bytes, wanted: list[tuple[str, int, int]]) -> dict[str, int]:
    """Values of a directory entry; those at their limit come from the ZIP64 field, in order."""
    out, at = {}, 0
    fields = b""
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            fields = extra[at + 4 : at + 4 + size]
        at += 4 + size
    at = 0
    for name, value, limit in wanted:
        if value == limit:
            width = 4 if limit == 0xFFFF else 8
            value = int.from_bytes(fields[at : at + width], "little")
            at += width
        out[name] = value
    return out


def members(read, size: int) -> list[Member]:
    """Members of a ZIP of ``size`` bytes; ``read(at, n)`` gives a range of it."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and len(tail) - end >= 22 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark can occur in a comment
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if tail_at + end >= 20 and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        mark, _, at64, _ = struct.unpack("<4sIQI", read(tail_at + end - 20, 20))
        if mark == b"PK\x06\x07":
            record = read(at64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, out = read(start, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        _, method = struct.unpack_from("<HH", directory, at + 8)
        packed, whole, name_n, extra_n, comment_n, disk, _, _, header_at = struct.unpack_from("<IIHHHHHII", directory, at + 20)
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        big = _zip64(extra, [("whole", whole, 0xFFFFFFFF), ("packed", packed, 0xFFFFFFFF), ("header", header_at, 0xFFFFFFFF), ("disk", disk, 0xFFFF)])
        out.append(Member(name, method, big["packed"], big["header"]))
        at += 46 + name_n + extra_n + comment_n
    return out


def stored_at(read, member: Member) -> int:
    """Where a stored member's bytes start."""
    if member.method:
        raise ValueError(f"{member.name} is compressed: only stored members can be read by range")
    head = read(member.header_at, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


def record(page: str, url: str | None, html: bytes, digest: str, first: str | None) -> bytes:
    """One WARC record; with ``first`` a revisit of that page, without its payload.
    The HTTP headers, which a revisit has too, give the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + (b"" if first else html)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~._-')}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"] if first else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, length of the full payload); the block must be as its digest says,
    where that is a SHA-256. A record of another kind than an HTTP one has its block as payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(named["content-length"])]
    if _differs(block, named.get("warc-block-digest")):
        raise ValueError("the record's block is damaged")
    if not block.startswith(b"HTTP/"):
        return named, block, len(block)
    http, _, payload = block.partition(b"\r\n\r\n")
    full = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return named, payload, full


def _differs(raw: bytes, digest: str | None) -> bool:
    """Whether ``raw`` is not what a SHA-256 in hex says; other digests are not looked into."""
    name, _, value = (digest or "").partition(":")
    return name == "sha256" and len(value) == 64 and hashlib.sha256(raw).hexdigest() != value.lower()


def url_key(url: str | None) -> str:
    """The sort key of a url: its host's labels from the last on, then port, path and query in
    small letters, as ``com,example)/path?query``; ``-`` where there is none."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = port = None
    if not host:
        return quote(url, safe="!$&'()*+,-./:;=?@_~%").lower() or "-"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))), safe=",:[]") + (f":{port}" if port else "") + ")" + quote(tail, safe="!$&'()*+,-./:;=?@_~%").lower()


def index_line(page: str | None, url: str | None, digest: str, first: str | None, at: int, length: int) -> str:
    """One line of a CDXJ index: key, time and a JSON object."""
    told = {"url": url or "", "mime": "warc/revisit" if first else "text/html", "status": "200", "digest": f"sha256:{digest}", "length": str(length), "offset": str(at), "filename": RECORDS.rsplit("/", 1)[1]}
    told |= {"page": int(page)} if page is not None else {}
    return f"{url_key(url)} {TIME} {json.dumps(told)}\n"


def parse_index(raw: bytes) -> Iterator[dict]:
    """The JSON objects of a CDXJ index; lines that start with ``!`` and empty ones are passed by."""
    for line in raw.decode().splitlines():
        at = line.find("{")
        if at >= 0 and not line.startswith("!"):
            yield json.loads(line[at:])


def inflated(raw: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while raw:
        z = zlib.decompressobj(31)
        out.append(z.decompress(raw) + z.flush())
        raw = z.unused_data
    return b"".join(out)


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _page(value) -> str | None:
    return None if value is None else str(value)


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(pages: DataFrame, path: str | None = None, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page to an archive under ``path``; returns the manifest.

    Pages with equal payloads of ``least`` bytes or more are one response, the
    page of the smallest id (of several such rows, each), and revisits of it. A
    null html is empty. A page without id is a response unless others share its
    payload. Payload groups are first reduced to one row each; each task then
    streams its pages into archives of about ``archive_bytes``. Archives of
    tasks that were run again are not in the manifest.
    """
    path = path or new_path(pages.sparkSession, "archives")
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    shared = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    judged = rows.join(shared, "digest", "left").withColumn("first", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        store.create_dir(root, recursive=True)
        name = out = package = member = None
        index: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal name
            member.close()
            with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
                f.write("".join(sorted(index)).encode())
            package.close()
            out.close()
            row = pa.RecordBatch.from_pylist([{"path": f"{path}/{name}", "records": len(index), "bytes": size}], MANIFEST)
            name = None
            return row

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for page in batch.slice(k, 64).to_pylist():
                    if name is None:
                        name, index, size = f"{uuid.uuid4().hex}.wacz", [], 0
                        out = store.open_output_stream(f"{root}/{name}")
                        package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                        member = package.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
                    packed = _gzip(record(str(page["id"]), page["url"], page["html"], page["digest"], _page(page["first"])))
                    member.write(packed)
                    index.append(index_line(_page(page["id"]), page["url"], page["digest"], _page(page["first"]), size, len(packed)))
                    size += len(packed)
                    if size >= archive_bytes:
                        yield close()
        if name is not None:
            yield close()

    return stored(judged.select("id", "url", "html", "digest", "first").mapInArrow(run, "path string, records long, bytes long"), "archive-manifest")


class Ranged:
    """Ranged reads of the archive opened last."""

    def __init__(self):
        self.path, self.file = None, None

    def open(self, path: str):
        if path != self.path:
            if self.file is not None:
                self.file.close()
            store, at = filesystem(path)
            self.path, self.file = path, store.open_input_file(at)
        return self.read

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def size(self) -> int:
        return self.file.size()


def spans(places: list[tuple[str, int, int]], gap: int = 1 << 16, most: int = 8 << 20) -> list[tuple[int, int]]:
    """(first, after the last) of runs of records (path, at, length) that one read covers: one
    archive, in order, no more than ``gap`` bytes apart and ``most`` together."""
    cuts = [0]
    for k in range(1, len(places)):
        (path, at, length), (last, before, size), first = places[k], places[k - 1], places[cuts[-1]][1]
        if path != last or not before + size <= at <= before + size + gap or at + length - first > most:
            cuts.append(k)
    return list(zip(cuts, [*cuts[1:], len(places)], strict=True)) if places else []


def _tasks(archives: DataFrame, per_task: int) -> int:
    """Tasks for reading the archives. Their rows here are small and what they stand
    for is not, so the number is given and not left to the size of the rows."""
    return min(MOST_TASKS, max(1, -(-(archives.agg(F.sum("bytes")).first()[0] or 0) // per_task)))


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the packages below a folder, as ``read_records`` takes them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wacz").load(folder)
    return rows.select("path", F.col("length").alias("bytes"))


def places_in(read, size: int) -> list[tuple[int | None, int, int]]:
    """(page, at, length) of every record that a package's indexes list, in order of place.
    A line without a file's name is of the only archive there is; one of a file that is not in the package is an error."""
    all_ = members(read, size)
    starts = {m.name.rsplit("/", 1)[-1]: stored_at(read, m) for m in all_ if m.name.endswith(ARCHIVES)}
    out = set()
    for m in all_:
        if m.name.endswith(INDEXES):
            raw = read(stored_at(read, m), m.size)
            for x in parse_index(inflated(raw) if m.name.endswith(".gz") else raw):
                name = x["filename"].rsplit("/", 1)[-1] if "filename" in x else next(iter(starts), None) if len(starts) == 1 else None
                if name not in starts:
                    raise ValueError(f"the index names {name}, which is not in the package")
                out.add((x.get("page"), starts[name] + int(x["offset"]), int(x["length"])))
    return sorted(out, key=lambda r: r[1:])


def index_of(archives: DataFrame) -> DataFrame:
    """(path, page, at, length) of every record, from the archives' own indexes; ``page``
    is null where the index tells none. Several lines of one record are one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = Ranged()
        for batch in batches:
            for path in batch["path"]:
                read = source.open(path)
                found = places_in(read, source.size())
                yield pd.DataFrame({"path": path, "page": pd.array([p for p, _, _ in found], "Int64"), "at": [at for _, at, _ in found], "length": [n for _, _, n in found]})

    return archives.select("path").repartition(_tasks(archives, ARCHIVE_BYTES), "path").mapInPandas(run, "path string, page long, at long, length long")


def read_records(archives: DataFrame, chunk: int = 8 << 20, payload: bool = False) -> DataFrame:
    """Every record of the archives: id, url, payload_bytes, payload_digest,
    record_type, refers_to, and with ``payload`` the payload of responses.

    A task reads about ``chunk`` bytes of an archive; records that lie beside each
    other come with one ranged read and are cut from it.
    A response's length and digest are taken from the bytes read. Of records that others
    wrote, ids and references that name no page are null.
    """
    schema = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Ranged()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = []
                places = [(x["path"], x["at"], x["length"]) for x in batch.slice(k, 64).to_pylist()]
                held: list[bytes] = []
                for a, b in spans(places):
                    start, (_, last, size) = places[a][1], places[b - 1]
                    raw = source.open(places[a][0])(start, last + size - start)
                    held += [raw[at - start : at - start + n] for _, at, n in places[a:b]]
                for raw in held:
                    named, body, full = parse_record(inflated(raw) if raw[:2] == b"\x1f\x8b" else raw)
                    kind = named["warc-type"]
                    told = named.get("warc-payload-digest")
                    digest = told.removeprefix("sha256:") if kind == "revisit" and told else hashlib.sha256(body).hexdigest()
                    if kind != "revisit" and _differs(body, told):
                        raise ValueError("the record's payload is damaged")
                    page = lambda v: int(v[10:-1]) if v and re.fullmatch(r"<urn:page:-?[0-9]+>", v) else None
                    row = (page(named["warc-record-id"]), named.get("warc-target-uri"), full if kind == "revisit" else len(body), digest, kind, page(named.get("warc-refers-to")))
                    rows.append(row + (body,) * payload)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload])

    places = index_of(archives).withColumn("part", F.floor(F.col("at") / chunk))
    return places.repartition(_tasks(archives, chunk), "path", "part").sortWithinPartitions("path", "at").mapInArrow(run, schema)
