"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles gives REGISTERS values: for each register the
minimum of an exponential variate over the set, put on an exponential scale and
truncated, ``clip(floor(1 - log_b(x)), 0, q + 1)``. Registers of a union are the
maxima of the registers, so sketches merge; two sets agree in a register the
more often the more they have in common. Documents meet when they agree on all
registers of a band. Of two that meet, the number of registers that are larger,
smaller and equal gives the likelihood of their Jaccard similarity; only pairs
whose most likely similarity is within four standard errors of the threshold are
compared, on their full sets. Registers and sizes are compared before any text
moves: texts are joined only to what is left.

Rows of one text and id are one document, known by its id and the hash of its
text, so an id that repeats with other texts is told apart. Rows whose sets look
equal make a class and are confirmed on their sets against the class's first.

With 32 bands of 5, two sets at similarity 0.8 meet in no band with probability
3e-6. Nothing caps a bucket: one that holds documents of several components is
compared in blocks, all across its components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, single_rows, stored, without
from .graph import components

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Documents of a bucket that are one block at most, and of a hub's members in a block.
BLOCK, STAR = 512, 4096
#: Distinct words whose hashes a worker keeps at a time.
KNOWN_WORDS = 500_000


@dataclass(frozen=True)
class Sketch:
    """``words`` to a shingle, ``percent`` similarity to link, the bands, and the
    scale's base and rate."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    base: float = 1.02
    rate: float = 20.0

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> float:
        """Least estimate that is compared: four standard errors below the threshold."""
        j = self.percent / 100
        return max(0.01, j - 4 * math.sqrt(j * (1 - j) / self.registers))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int) -> frozenset:
    """The set itself; fewer words than ``size`` are one shingle, none are none."""
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[k:] for k in range(size)), strict=False))


def shingle_hashes(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of each distinct shingle. Shingles are told apart by their
    words and not by the hashes, so there are as many as the set has members."""
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    for w in place:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    each = np.fromiter(map(known.__getitem__, place), np.uint64, len(place))[ids]
    size, distinct = min(size, len(words)), len(place)
    m = len(words) - size + 1
    h, key, kinds = mixed(each[:m] + np.uint64(size)), ids[:m], distinct
    for k in range(1, size):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + each[k : m + k])
        if kinds * distinct >= 2**62:
            seen, key = np.unique(key, return_inverse=True)
            kinds = len(seen)
        key, kinds = key * distinct + ids[k : m + k], kinds * distinct
    return h[np.unique(key, return_index=True)[1]]


def registers(hashes: np.ndarray, sketch: Sketch, seeds: np.ndarray) -> np.ndarray:
    least = np.full(sketch.registers, M64)
    for k in range(0, len(hashes), 256):
        x = (hashes[k : k + 256, None] ^ seeds) * np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=0), out=least)
    u = (least.astype(np.float64) + 1) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / sketch.rate
    return np.clip(np.floor(1 - np.log(x) / math.log(sketch.base)), 0, 65_535).astype(np.uint16)


def seeds_of(sketch: Sketch) -> np.ndarray:
    return mixed(np.arange(1, sketch.registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_hash(text: str) -> Column:
    """With the id, what tells a row's text from others; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketched(docs: DataFrame, sketch: Sketch, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, th, n, print, registers) of each row: its text's hash, size of its set,
    128 bits that stand for the set (null for the empty one), and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        seeds = seeds_of(sketch)
        for batch in batches:
            n, prints, regs = [], [], []
            for t in batch.column("text").to_pylist():
                h = shingle_hashes(words_of(t), sketch.words, known)
                n.append(len(h))
                prints.append(mixed(h).sum(dtype=np.uint64).tobytes() + mixed(~h).sum(dtype=np.uint64).tobytes() if len(h) else None)
                regs.append(registers(h, sketch, seeds).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())], ["id", "th", "n", "print", "registers"])

    rows = docs.select(F.col(id).cast("long").alias("id"), text_hash(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, th long, n long, print binary, registers binary")


def banded(classes: DataFrame, sketch: Sketch) -> DataFrame:
    """(node, band, key) for each band of each class's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if rows:
                r = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(rows, sketch.bands, sketch.rows)
                key = np.broadcast_to(np.arange(sketch.bands, dtype=np.uint64), (rows, sketch.bands))
                for k in range(sketch.rows):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k] + np.uint64(1))
                ids = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), sketch.bands)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.tile(np.arange(sketch.bands, dtype=np.int32), rows)), pa.array(key.ravel().view(np.int64))], ["node", "band", "key"])

    return classes.select("node", "registers").mapInArrow(run, "node long, band int, key long")


def likely(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float, base: float) -> np.ndarray:
    """Whether the similarity of greatest likelihood is at least ``at``.

    The log-likelihood of the three counts given the set sizes is concave in the
    similarity, so the sign of its slope at ``at`` tells.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    c, log_b = (base - 1) / base, math.log(base)
    x, y = np.maximum(u - v * at, 1e-12), np.maximum(v - u * at, 1e-12)
    p, q = -np.log1p(-x * c) / log_b, -np.log1p(-y * c) / log_b
    dp, dq = c / (log_b * (1 - x * c)), c / (log_b * (1 - y * c))
    slope = -larger * v * dp / p - smaller * u * dq / q + equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12)
    return slope >= 0


def similar(a: frozenset, b: frozenset, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def likely_pairs(pairs: DataFrame, classes: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs (a, b) that sizes and registers leave; no text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in ("ra", "rb"))
                na, nb = (batch.column(k).to_numpy().astype(float) for k in ("na", "nb"))
                ok = likely((ra > rb).sum(1), (ra < rb).sum(1), (ra == rb).sum(1), na, nb, sketch.floor, sketch.base)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    one = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    # a hub's sizes and registers are repeated for its members, 330 bytes each; its text is not
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= sketch.percent * F.greatest("na", "nb"))
    return both.mapInArrow(run, "a long, b long")


def _stars(rows: DataFrame, texts: DataFrame, sketch: Sketch) -> DataFrame:
    """``rows`` (hub, kind, key, node) with ``ok``: whether the text of ``key`` is
    linked with the hub's (kind 1), or has the very set of it (kind 0).

    ``texts`` has (key, node, first, text). Members go to blocks of about STAR, so
    no task holds a hub's members, and the hub's text travels once a block.
    """
    blocks = rows.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("blocks"))
    members = rows.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    members = members.join(texts.select("key", "text"), "key").select("hub", "block", "kind", "key", "node", "text")
    hubs = blocks.join(texts.where("first").select(F.col("node").alias("hub"), "text"), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("key"), F.col("hub").alias("node"), "text")
    order = ["hub", "block", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, hub = None, frozenset()
        for batch in batches:
            out = []
            for at, kind, key, node, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "kind", "key", "node", "text")), strict=True):
                if kind < 0:
                    body, hub = text, shingles(words_of(text), sketch.words)
                elif kind == 0:
                    out.append((at, kind, key, node, text == body or shingles(words_of(text), sketch.words) == hub))
                else:
                    out.append((at, kind, key, node, similar(shingles(words_of(text), sketch.words), hub, sketch.percent)))
            yield pa.RecordBatch.from_pylist([dict(zip(("hub", "kind", "key", "node", "ok"), r, strict=True)) for r in out], CHECKED)

    every = hubs.unionByName(members).repartition("hub", "block").sortWithinPartitions(*order)
    return every.mapInArrow(run, "hub long, kind int, key string, node long, ok boolean")


CHECKED = pa.schema([("hub", pa.int64()), ("kind", pa.int32()), ("key", pa.string()), ("node", pa.int64()), ("ok", pa.bool_())])


def block_links(rows: pd.DataFrame, sketch: Sketch) -> list[tuple[int, int]]:
    """Links across the components of one block pair, enough to join them; from rows
    without texts, one (node, node) for each that has a likely partner.

    A pair is looked at in the first band that it shares, also where the buckets of a
    hub are one group (band -1). Ends that links of
    this block already join are passed over: they are in one component.
    """
    ids, comps, n = rows["node"].to_numpy(), rows["component"].to_numpy(), rows["n"].to_numpy().astype(float)
    regs = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(len(rows), -1)
    texts, outside = rows["text"].to_numpy() if "text" in rows else None, rows["outside"].to_numpy()
    band = int(rows["band"].iloc[0])
    bits = rows["bands"].to_numpy() if band < 0 else None
    wanted = np.zeros(len(rows), bool)
    hashes: dict[int, np.ndarray] = {}
    known: dict[bytes, int] = {}
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while c in top:
            c = top[c]
        return c

    def hashes_of(k: int) -> np.ndarray:
        if k not in hashes:
            hashes[k] = np.unique(shingle_hashes(words_of(texts[k]), sketch.words, known))
        return hashes[k]

    def linked(i: int, j: int) -> bool:
        """By full sets; their hashes, which take less memory, first tell where that is in vain."""
        a, b = hashes_of(i), hashes_of(j)
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both < sketch.percent * (len(a) + len(b) - both):
            return False
        return similar(shingles(words_of(texts[i]), sketch.words), shingles(words_of(texts[j]), sketch.words), sketch.percent)

    found = []
    inner = np.flatnonzero(~outside)
    crossed = bool(len(inner))  # outsiders against the main component; else outsiders against each other
    for i in np.flatnonzero(outside):
        others = inner if crossed else np.flatnonzero((comps != comps[i]) & (ids > ids[i]))
        others = others[100 * np.minimum(n[others], n[i]) >= sketch.percent * np.maximum(n[others], n[i])]
        if not len(others):
            continue
        same = regs[others] == regs[i]
        if bits is not None:
            met = same.reshape(len(others), sketch.bands, sketch.rows).all(2)
            here = met.any(1) & ((bits[i] >> (met.argmax(1) % BITS)) & 1 == 1)
            others, same = others[here], same[here]
        elif band:
            others, same = (x[~same[:, : band * sketch.rows].reshape(len(others), band, sketch.rows).all(2).any(1)] for x in (others, same))
        if not len(others):
            continue
        larger, equal = (regs[i] > regs[others]).sum(1), same.sum(1)
        ok = likely(larger, sketch.registers - larger - equal, equal, n[i], n[others], sketch.floor, sketch.base)
        if texts is None:
            wanted[others[ok]] = True
            wanted[i] |= ok.any()
            continue
        for k in sorted(np.flatnonzero(ok), key=lambda k: -equal[k]):
            j = others[k]
            ci, cj = root(comps[i]), root(comps[j])
            if ci != cj and linked(i, j):
                top[max(ci, cj)] = min(ci, cj)
                found.append((int(ids[i]), int(ids[j])))
    return found if texts is not None else [(int(x), int(x)) for x in ids[wanted]]


PAIR = ["key", "band", "kind", "i", "j"]
#: Bands that a LONG tells apart; those a multiple of it apart share a bit, which compares some pairs twice.
BITS = 63


def bucket_blocks(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(PAIR, node, component, bands, outside): where documents whose components meet
    in a bucket are to be compared, written.

    A bucket with one component is settled, and of buckets with the same members
    the first band's stands for all. A group of near copies meets in most bands with
    nearly the same members, so the buckets of one hub are one group (band -1, the
    hub as key) where that makes fewer rows; ``bands`` has a bit for each band of a
    row there. In any bucket or group the largest component
    is the main one and the rest are outsiders: each block of outsiders meets
    each block of the main component and each block of outsiders. There are as many
    blocks as the root of a bucket's size over BLOCK, so no task holds a large bucket, and
    the rows made grow with the power 1.5 of its size; only the pairs of registers looked
    at, within tasks, grow with its square.
    """
    named = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("count"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"))
    mixed_ = sizes.groupBy("band", "key").agg(F.max(F.struct("count", F.col("component").alias("main"))).alias("top"), F.sum("count").alias("all"), F.count(F.lit(1)).alias("parts"), F.sum("members").alias("members")).where("parts > 1")
    mixed_ = mixed_.groupBy("members", "all", "parts", "top").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key")
    unsettled = stored(named.join(mixed_, ["band", "key"]).select("hub", "band", "key", "node", "component"), "unsettled")
    parts = lambda n: F.ceil(F.sqrt(n / BLOCK))
    made = F.col("count") * parts(F.col("count"))
    buckets = unsettled.groupBy("hub", "band", "key").count()
    apart = buckets.groupBy("hub").agg(F.sum(made).alias("apart"), F.count(F.lit(1)).alias("buckets")).where("buckets > 1")
    once = unsettled.select("hub", "node").distinct().groupBy("hub").count().select("hub", made.alias("once"))
    one = apart.join(once, "hub").where("once < apart").select("hub", F.lit(True).alias("one"))
    # joined by bucket, as a hub's rows would be one hot key
    rows = unsettled.join(buckets.join(one, "hub").select("band", "key", "one"), ["band", "key"], "left").withColumn("bit", F.expr(f"shiftleft(1L, band % {BITS})"))
    rows = rows.withColumn("key", F.when(F.col("one"), F.col("hub")).otherwise(F.col("key"))).withColumn("band", F.when(F.col("one"), -1).otherwise(F.col("band")))
    rows = rows.groupBy("band", "key", "node").agg(F.first("component").alias("component"), F.bit_or("bit").alias("bands"))
    tops = rows.groupBy("band", "key", "component").count().groupBy("band", "key").agg(F.max(F.struct("count", F.col("component").alias("main"))).alias("top"), F.sum("count").alias("all"))
    tops = tops.select("band", "key", "top.main", parts(F.col("top.count")).alias("n_in"), parts(F.col("all") - F.col("top.count")).alias("n_out"))
    rows = rows.join(tops, ["band", "key"]).withColumn("outside", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("n_out")).otherwise(F.col("n_in")))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    outsider = F.concat(F.transform(numbers(F.col("n_in")), lambda j: pair("main", F.col("own"), j)), F.transform(numbers(F.col("n_out")), lambda k: pair("out", F.least("own", k), F.greatest("own", k))))
    member = F.transform(numbers(F.col("n_out")), lambda i: pair("main", i, F.col("own")))
    blocks = rows.withColumn("own", own).select("band", "key", "node", "component", "bands", "outside", F.explode(F.when(F.col("outside"), outsider).otherwise(member)).alias("at"))
    blocks = stored(blocks.select("band", "key", "at.*", "node", "component", "bands", "outside"), "blocks")
    discard(unsettled)
    return blocks


def _by_block(blocks: DataFrame, sketch: Sketch) -> DataFrame:
    """``block_links`` of each block pair with more than one component, as (PAIR, a, b)."""

    def made(groups: list[pd.DataFrame]) -> pd.DataFrame:
        out = []
        for g in groups:
            comps = g["component"].to_numpy()
            if (comps != comps[0]).any():
                at = tuple(g[c].iloc[0] for c in PAIR)
                out += [(*at, a, b) for a, b in block_links(g, sketch)]
        return pd.DataFrame(out, columns=[*PAIR, "a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: pd.DataFrame | None = None
        for batch in batches:
            if open_ is not None:
                batch = pd.concat([open_, batch], ignore_index=True)
            if len(batch):
                new = np.zeros(len(batch), bool)
                for c in PAIR:
                    x = batch[c].to_numpy()
                    new[1:] |= x[1:] != x[:-1]
                cuts = [0, *np.flatnonzero(new).tolist()]
                open_ = batch.iloc[cuts[-1] :]
                yield made([batch.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        if open_ is not None:
            yield made([open_])

    return blocks.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInPandas(run, "key long, band int, kind string, i long, j long, a long, b long")


def wanted_blocks(blocks: DataFrame, classes: DataFrame, sketch: Sketch) -> DataFrame:
    """The rows of ``blocks`` that sizes and registers leave a likely partner in
    their block pair: those alone need their texts."""
    some = _by_block(blocks.join(classes.select("node", "n", "registers"), "node"), sketch)
    return blocks.join(some.select(*PAIR, F.col("a").alias("node")), [*PAIR, "node"], "left_semi")


def _classes(every: DataFrame) -> DataFrame:
    """One row per set: print, alt, node, rows, first (the row that stands for it), n,
    registers. Nodes are numbered in the order of their ids: in a group of near copies
    the first is most likely the one that the others were made of, which makes
    it the best hub."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("first")
    sets = every.where("n > 0").groupBy("print", "alt").agg(F.count(F.lit(1)).alias("rows"), first, F.first("n").alias("n"), F.first("registers").alias("registers"))
    return stored(sets.orderBy("first", "print").withColumn("node", F.monotonically_increasing_id()), "classes")


def _key(id: str = "id", th: str = "th") -> Column:
    """A row's id and text hash as one string."""
    return F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.lit("-")), F.hex(th))


def _linked(docs: DataFrame, every: DataFrame, sketch: Sketch, text: str, id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, component of each linked class, rows whose set is not their class's)."""
    classes = _classes(every)
    bands = banded(classes, sketch)
    hubs = bands.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = stored(bands.join(hubs, ["band", "key"]), "shared")
    # first each class against the smallest it meets, then what is still apart
    pairs = shared.groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("b")).where("b < a")
    pairs = stored(likely_pairs(pairs, classes, sketch), "pairs")
    some = classes.where("rows > 1").select("print", "alt", F.col("node").alias("hub"), F.col("first").alias("_first"))
    rows_ = every.where("n > 0").select("id", "th", "print", "alt").join(some, ["print", "alt"]).where(~((F.col("id").eqNullSafe(F.col("_first.id"))) & (F.col("th") == F.col("_first.th"))))
    copies = rows_.select("hub", F.lit(0).alias("kind"), _key().alias("key"), F.col("hub").alias("node")).distinct()
    firsts = classes.select("node", _key("first.id", "first.th").alias("key"))
    near = pairs.select(F.col("b").alias("hub"), F.lit(1).alias("kind"), F.col("a").alias("node")).join(firsts, "node").select("hub", "kind", "key", "node")
    star = stored(copies.unionByName(near), "stars")

    bodies = docs.select(_key_of(id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not every.groupBy("id", "th").count().where("count > 1").isEmpty():
        bodies = bodies.dropDuplicates(["key"])  # before the join, so that a row that is there many times is no hot key
    need = star.select("key", "node", (F.col("kind") == 1).alias("first")).union(star.select(F.col("hub").alias("node")).distinct().join(firsts, "node").select("key", "node", F.lit(True))).distinct()
    texts = stored(bodies.join(need, "key"), "texts")
    checked = stored(_stars(star, texts, sketch), "checked")
    links = checked.where("ok and kind = 1").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    wrong = checked.where("not ok and kind = 0").select("key")
    labels = components(links)
    blocks = bucket_blocks(shared, labels)
    if not blocks.isEmpty():
        wanted = stored(wanted_blocks(blocks, classes, sketch), "wanted")
        bodies = stored(bodies.join(wanted.select("node").distinct().join(firsts, "node"), "key").select("node", "text"), "texts")
        more = stored(_by_block(wanted.join(classes.select("node", "n", "registers"), "node").join(bodies, "node"), sketch).select("a", "b"), "cross-links")
        if not more.isEmpty():
            labels, old = components(links.union(more)), labels
            discard(old)
        discard(wanted, bodies, more)
    discard(shared, pairs, star, texts, blocks)
    return classes, labels, wrong


def _key_of(id: str, text: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(id).cast("long").cast("string"), F.lit("-")), F.hex(text_hash(text)))


def _verdicts(docs: DataFrame, sketch: Sketch, text: str, id: str) -> DataFrame:
    """(id, th, n, component, key) of each row; ``component`` is its smallest id and
    ``key`` the row that stands for it."""
    sketches = stored(sketched(docs, sketch, text, id), "sketches")
    every = sketches.withColumn("alt", F.lit(0).cast("long"))
    classes, labels, wrong = _linked(docs, every, sketch, text, id)
    if not wrong.isEmpty():  # equal prints of different sets: those rows become classes of their own
        other = wrong.withColumnRenamed("key", "_key").distinct()
        every = stored(every.join(other, _key() == F.col("_key"), "left").withColumn("alt", F.when(F.col("_key").isNotNull(), F.col("th")).otherwise(F.lit(0).cast("long"))).drop("_key"), "apart")
        discard(classes, labels)
        classes, labels, _ = _linked(docs, every, sketch, text, id)
    named = classes.select("print", "alt", "node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    names = named.groupBy("label").agg(F.min("first").alias("least"))
    named = named.join(names, "label").select("print", "alt", "least")
    full = every.where("n > 0").drop("registers").join(named, ["print", "alt"]).select("id", "th", "n", F.col("least.id").alias("component"), _key("least.id", "least.th").alias("key"))
    rest = every.where("n = 0").select("id", "th", "n", F.col("id").alias("component"), _key().alias("key"))
    out = stored(full.union(rest), "verdicts")
    discard(sketches, classes, labels)
    return out


def near_groups(docs: DataFrame, sketch: Sketch = Sketch(), text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A-Z count as a-z. A component is all documents that links of at least
    ``percent`` similarity reach; it is named by its smallest id, the one kept.
    Null, empty and wordless texts have empty sets, link with nothing and are
    kept. Documents with equal sets are one class and are compared once. Rows of
    one id and text share a verdict; rows of one id with other texts are documents
    of their own. A row without id links like any other, is named by the smallest
    id it reaches, if any, and is kept only where it reaches none. Other columns of
    the input play no part.
    """
    rows = _verdicts(docs, sketch, text, id)
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, sketch: Sketch = Sketch(), text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those whose group
    keeps another: of each group one row is left, that of the smallest id, and of
    rows with that id or of groups without any id that of the smallest text hash.
    Rows with empty sets all stay."""
    rows = _verdicts(docs, sketch, text, id)
    mine = _key_of(id, text)
    lost = rows.where(_key() != F.col("key")).select(_key().alias("key"))
    again = rows.where((F.col("n") > 0) & (_key() == F.col("key"))).groupBy("key").count().where("count > 1").select("key")
    return single_rows(without(docs, lost, mine), again, mine)
