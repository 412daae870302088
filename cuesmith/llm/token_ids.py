"""Token ids in files of byte-aligned variable-length codes.

Texts are encoded where they lie; the ids are kept once, counted over the whole
corpus and ranked by frequency, so that the 256 most frequent take one byte in
every file. Then the ids, not the texts, are brought into document order and
written. A file holds documents in ascending id: a header, the documents' ids and
lengths, then the control bytes of all codes (two bits each: bytes less one) apart
from the data bytes. The rank table is one small file beside them. Four codes are
decoded at a time by looking their control byte up in a table of byte places.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, new_path, stored
from .files import filesystem

MAGIC, RANKS = b"VLCIDS02", b"VLCRNK01"
HEAD = struct.Struct("<8sQQQ")  # magic, documents, ids, data bytes
#: Words whose ids a worker keeps at a time, and the longest kept, in bytes.
KNOWN_WORDS, KNOWN_LENGTH = 600_000, 64
#: Marks that are cut off a word's end: behind one of A-Z or a-z they make a token
#: run of their own. Those of contractions and of special tokens are not among them.
MARKS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: How a tokenizer must prepare a text for its words to be encoded apart (fixed values).
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
FILE_IDS = 4_000_000
MOST_TASKS = 50_000


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    control, data = [], []
    for k in range(0, len(ranks), 1 << 20):  # a multiple of four
        r = np.ascontiguousarray(ranks[k : k + (1 << 20)], "<u4")
        extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
        data.append(r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes())
        codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
        codes[: len(r)] = extra
        codes = codes.reshape(-1, 4)
        control.append((codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes())
    return b"".join(control), b"".join(data)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By control byte: bytes of its four codes, and where each of their 16 bytes
    lies in them; 16 stands for a zero byte."""
    sizes = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
    first = np.cumsum(sizes, 1) - sizes
    byte = np.arange(4)
    return sizes.sum(1), np.where(byte < sizes[:, :, None], first[:, :, None] + byte, 16).reshape(256, 16)


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    total, places = tables()
    codes, out, at = np.frombuffer(control, np.uint8), [], 0
    raw = np.frombuffer(data + bytes(17), np.uint8)
    for k in range(0, len(codes), 1 << 18):
        c = codes[k : k + (1 << 18)]
        ends = np.cumsum(total[c])
        where = places[c]
        got = raw[np.minimum((at + ends - total[c])[:, None] + where, len(raw) - 1)]
        got[where == 16] = 0
        out.append(got.view("<u4").ravel())
        at += int(ends[-1])
    # the last control byte may stand for fewer than four
    return np.concatenate(out)[:n] if out else np.empty(0, "<u4")


def by_words(path: str) -> bool:
    """Whether a tokenizer file drops white space before it cuts pieces, so that a
    text's ids are those of its words one after another."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] and t["content"].split() == [t["content"]] for t in spec.get("added_tokens") or [])
    parts = lambda name, inner: (spec.get(name) or {}).get(inner)
    return added and parts("normalizer", "normalizers") == NORMAL and parts("pre_tokenizer", "pretokenizers") == PIECES and not any(spec.get(k) for k in ("post_processor", "truncation", "padding")) and not spec["model"].get("dropout")


class WordIds(dict):
    """Ids by word, 32 bits each, found out when a word is first looked up.

    Words are encoded by the library. Only one of A-Z and a-z alone goes straight to its
    merges: it is one piece and lower-cases letter by letter. Marks are cut off only
    behind one of these letters, where a piece ends, and never in a word with an added token in it. A tokenizer that does not
    cut at white space is given whole texts.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.apart = Tokenizer.from_file(path), by_words(path)
        self.merges = self.tokenizer.model.tokenize
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "<u4")

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word)
        if len(word) <= KNOWN_LENGTH:
            self[word] = ids
        return ids

    def encode(self, word: bytes) -> bytes:
        if self.added and self.added.search(word):  # is cut out before anything else
            return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if word.isalpha():  # A-Z and a-z
            return array("I", [t.id for t in self.merges(word.lower().decode())]).tobytes()
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem[-1:].isalpha():
            return self[stem] + self[word[len(stem) :]]
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        if not self.apart:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self) > KNOWN_WORDS:
            self.clear()
        return [b"".join(map(self.__getitem__, (t or "").encode().split())) for t in texts]


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """The worker's own, kept from task to task."""
    return WordIds(path)


def ranked(ids: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(id by rank, rank of each): most frequent first, then the smaller id.
    ``counts`` by id are those of ``ids`` themselves if not given."""
    if counts is None:
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    by_rank = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())].astype(np.uint32)
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    return by_rank, rank_of[ids]


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode(ranks)
    named = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data)), named.tobytes(), ids.tobytes(), lengths.astype("<u8").tobytes(), control, data])


def parse_file(raw: bytes, by_rank: np.ndarray | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, token ids) of a file; ranks for ids without the table."""
    magic, docs, n, size = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    named, ids, lengths = take("u1", docs), take("<i8", docs), take("<u8", docs)
    control = take("u1", -(-n // 4)).tobytes()
    tokens = decode(control, raw[at : at + size], n)
    if by_rank is not None and n:
        tokens = by_rank[tokens]
    return [int(i) if k else None for i, k in zip(ids, named, strict=True)], lengths.astype(np.int64), tokens


def _save(uri: str, raw: bytes) -> None:
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(raw)


def _load(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return f.read()


def load_ranks(uri: str) -> np.ndarray:
    raw = _load(uri)
    if raw[:8] != RANKS:
        raise ValueError("not a rank table")
    return np.frombuffer(raw, "<u4", offset=8)


def encoded(docs: DataFrame, tokenizer: str, end: int = 1, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, wide, ids) of each row: its ids, 16 bits each or 32 where ``wide``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        kind = np.dtype("<u4") if end > 0xFFFF else words.kind
        last = np.array([end], kind).tobytes()
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                ids = [np.frombuffer(raw, np.uint32).astype(kind).tobytes() + last for raw in words.of(batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([kind.itemsize == 4] * len(ids), pa.bool_()), pa.array(ids, pa.binary())], ["id", "wide", "ids"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, wide boolean, ids binary")


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    wide = batch.column("wide")[0].as_py() if batch.num_rows else False
    return [np.frombuffer(x, "<u4" if wide else "<u2") for x in batch.column("ids").to_pylist()]


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often ``encoded`` rows have each id, by id: no more numbers than the
    tokenizer has ids. Tasks add up before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                got = np.bincount(np.concatenate(_numbers(batch.slice(k, 512))))
                if len(got) > len(total):
                    total, got = got, total
                total[: len(got)] += got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["token", "n"])

    got = rows.select("wide", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(int(got.column("token").to_numpy().max(initial=-1)) + 1, np.int64)
    counts[got.column("token").to_numpy()] = got.column("n").to_numpy()
    return counts


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = 1, text: str = "text", id: str = "doc_id", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` into files under ``path``; returns their manifest (part, file,
    path, ranks, docs, ids), in ascending document id by (part, file).

    Ids are those of the tokenizers library for the whole text, with any of its
    files. A null text is an empty one: its end id alone. Null ids come first; rows of
    one id stand next to each other. A file ends after the document that fills
    it, and a document is never cut. Files of tasks that were run again are not
    in the manifest.
    """
    path = path or new_path(docs.sparkSession, "token-files")
    rows = stored(encoded(docs, tokenizer, end, text, id), "encoded", compression="zstd")
    counts = id_counts(rows)
    by_rank, rank_of = ranked(np.arange(len(counts)), counts)
    table = f"{path}/{uuid.uuid4().hex}.ranks"
    _save(table, RANKS + by_rank.astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, names, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, names, parts, held
            name = f"{path}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
            _save(name, file_bytes(names, np.array([len(x) for x in parts]), rank_of[np.concatenate(parts)]))
            row = pa.RecordBatch.from_pylist([{"part": part, "file": number, "path": name, "ranks": table, "docs": len(names), "ids": held}], MANIFEST)
            number, names, parts, held = number + 1, [], [], 0
            return row

        for batch in batches:
            for doc, ids in zip(batch.column("id").to_pylist(), _numbers(batch), strict=True):
                names.append(doc)
                parts.append(ids)
                held += len(ids)
                if held >= file_ids:
                    yield flush()
        if names:
            yield flush()

    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("ids"), "ids")
    manifest = stored(ordered.mapInArrow(run, "part long, file long, path string, ranks string, docs long, ids long"), "manifest")
    discard(rows)
    return manifest


MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("ranks", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def read_ids(spark: SparkSession, manifest: DataFrame, tokens: bool = False) -> DataFrame:
    """The documents of the files: id, start (ids of all documents before it),
    n_tokens, ids_crc32, and with ``tokens`` the ids themselves.

    Each file is decoded on its own; where it starts in the whole comes from the
    manifest's sums, one row a file.
    """
    before = manifest.withColumn("before", F.sum("ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<int>" * tokens

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables_: dict[str, np.ndarray] = {}
        for batch in batches:
            for path, ranks, start in zip(batch["path"], batch["ranks"], batch["before"], strict=True):
                if ranks not in tables_:
                    tables_ = {ranks: load_ranks(ranks)}
                ids, lengths, all_ids = parse_file(_load(path), tables_[ranks])
                first = np.cumsum(lengths) - lengths
                parts = [all_ids[a : a + n] for a, n in zip(first, lengths, strict=True)]
                out = pd.DataFrame({"id": pd.array(ids, "Int64"), "start": first + start, "n_tokens": lengths, "ids_crc32": [zlib.crc32(np.ascontiguousarray(p, "<u4").tobytes()) for p in parts]})
                yield out.assign(tokens=[p.astype(np.int32) for p in parts]) if tokens else out

    # a row here stands for a whole file: tasks by files, not by the size of their rows
    return before.repartition(min(MOST_TASKS, max(1, manifest.count())), "path").mapInPandas(run, schema)


def encode_corpus(docs: DataFrame, tokenizer: str, id: str = "doc_id", **options) -> DataFrame:
    """Write ``docs`` to token-id files and read them back: one row per input row."""
    return read_ids(docs.sparkSession, write_ids(docs, tokenizer, id=id, **options)).withColumnRenamed("id", id)
