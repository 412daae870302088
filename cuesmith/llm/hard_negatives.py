"""Hard negatives by distributed radix selection.

The rows lie in blocks, packed matrices of a bounded size, and every pass multiplies
blocks of anchors with blocks of rows; scores are worked out again in each pass and
never kept. A pass counts, for each window of scores that is looked at, the integer
scores by one digit; the digit that holds the k-th row is refined by the next pass,
through the digits of the score and then, where many rows tie, of the id. Only when
few rows are left at or above it are rows themselves gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored

#: Rows of a block, bytes of its matrix and anchors of a block; a block may be twice as large.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_ANCHORS = 32_768, 1 << 24, 1_024
#: Rows and queries that are looked at together.
SLICE_ROWS, SLICE_QUERIES = 4_096, 512
#: Bits of a digit; rows at or above a digit with which it needs no refining.
DIGIT, FEW = 8, 64
#: Scores beyond count as this, so that differences stay in 64 bits.
FAR = 1 << 60
#: Blocks whose numbers (16 bytes each) are sent to every task; beyond, they are joined.
MOST_SENT = 1 << 20
BLOCK = "dim int, rows int, ids binary, labels binary, matrix binary, wide boolean, norm double, least_id long, most_id long"
PAYLOAD = ["dim", "ids", "labels", "matrix", "wide"]
QUERY = ["anchors", "at", "turn"]


@dataclass(frozen=True)
class Mining:
    """``positives`` rows of an anchor's label are each given ``negatives`` rows of
    another label that score ``low`` to ``high`` percent of it; components are counted
    in whole ``scale``-ths."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows of (id, label, vector) that take part."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    return vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)


def packed(rows: DataFrame, scale: int, most: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` as BLOCKs of one length of vectors, each made where its rows lie."""

    def made(dim: int, ids: list, labels: list, parts: list) -> dict:
        i, n, m = np.concatenate(ids), np.concatenate(labels), np.concatenate(parts)
        wide = bool(m.size and np.abs(m).max() > 32_767)
        return {"dim": dim, "rows": len(i), "ids": i.tobytes(), "labels": n.tobytes(), "matrix": m.tobytes() if wide else m.astype(np.int16).tobytes(), "wide": wide,
                "norm": float(np.sqrt(np.minimum((m * m).sum(1), 1e300)).max()), "least_id": int(i.min()), "most_id": int(i.max())}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        count: dict[int, int] = {}

        def out(dim: int) -> pa.RecordBatch:
            del count[dim]
            return pa.RecordBatch.from_pylist([made(dim, *held.pop(dim))], shape)

        shape = pa.schema([("dim", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary()), ("wide", pa.bool_()), ("norm", pa.float64()), ("least_id", pa.int64()), ("most_id", pa.int64())])
        for batch in batches:
            vectors = batch.column("vector")
            dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            starts = np.concatenate([[0], np.cumsum(dims)])
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for dim in map(int, np.unique(dims)):
                own = np.flatnonzero(dims == dim)
                limit = max(1, min(most, BLOCK_BYTES // (8 * max(dim, 1))))
                for k in range(0, len(own), limit):
                    some = own[k : k + limit]
                    matrix = flat[starts[some][:, None] + np.arange(dim)[None, :]].reshape(len(some), dim)
                    for kept, new in zip(held.setdefault(dim, ([], [], [])), (ids[some], labels[some], matrix), strict=True):
                        kept.append(new)
                    count[dim] = count.get(dim, 0) + len(some)
                    if count[dim] >= limit:
                        yield out(dim)
            while sum(n * (dim + 2) * 8 for dim, n in count.items()) > 2 * BLOCK_BYTES:  # many lengths at once
                yield out(max(count, key=lambda dim: count[dim] * (dim + 2)))
        for dim in list(count):
            yield out(dim)

    return rows.select("id", F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(pack, BLOCK)


class Block:
    """A block's numpy arrays."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        kind = np.float64 if row["wide"] else np.int16
        self.matrix = np.frombuffer(row["matrix"], kind).astype(np.float64).reshape(len(self.ids), row["dim"])
        self.most = float(np.abs(self.matrix).max()) if self.matrix.size else 0.0


def inner(a: Block, some: np.ndarray, b: Block, lo: int, hi: int) -> np.ndarray:
    """Exact inner products of anchors ``some`` and rows ``lo`` to ``hi`` as LONGs.

    Doubles are exact while no sum can reach 2^53; larger components are counted
    in whole numbers of any size, and sums beyond FAR count as FAR.
    """
    left, right = a.matrix[some], b.matrix[lo:hi]
    if a.most * b.most * max(1, left.shape[1]) < 2.0**53:
        return (left @ right.T).astype(np.int64)
    whole = lambda m: np.frompyfunc(int, 1, 1)(m)
    sums = whole(left) @ whole(right).T
    return np.clip(sums, -FAR, FAR).astype(np.int64)


#: A query's window and where its search stands: the best score, how far below it the window
#: reaches, and the digits found so far, of the distance (first, log2 of the width) and of the id.
STATE = "array<struct<at: int, turn: int, best: bigint, reach: bigint, d0: bigint, dm: int, e0: bigint, em: int>>"


class Queries:
    def __init__(self, asked: pa.StructArray):
        of = lambda name, kind: asked.field(name).to_numpy(zero_copy_only=False).astype(kind)
        self.at, self.turn = of("at", np.int64), of("turn", np.int64)
        self.best, self.reach, self.d0 = (of(c, np.int64)[:, None] for c in ("best", "reach", "d0"))
        self.dm, self.em = of("dm", np.int64)[:, None], of("em", np.int64)[:, None]
        self.e0 = of("e0", np.int64).view(np.uint64)[:, None]


def windows(a: Block, q: Queries, b: Block, same: bool) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray]]:
    """Slices of queries and rows: (queries, first row, distance below the best score,
    whether the row is in the window)."""
    for lo in range(0, len(b.ids), SLICE_ROWS):
        hi = min(lo + SLICE_ROWS, len(b.ids))
        for k in range(0, len(q.at), SLICE_QUERIES):
            part = slice(k, k + SLICE_QUERIES)
            anchors, back = np.unique(q.at[part], return_inverse=True)
            score = inner(a, anchors, b, lo, hi)[back]
            below = q.best[part] - score
            label = b.labels[None, lo:hi] == a.labels[q.at[part]][:, None]
            fits = label & (b.ids[None, lo:hi] != a.ids[q.at[part]][:, None]) if same else ~label
            yield part, lo, below, fits & (below >= 0) & (below <= q.reach[part])


def count_digits(a: Block, q: Queries, b: Block, same: bool, least_id: int) -> np.ndarray:
    """How many rows of the block each query has in each part of its open interval."""
    found = np.zeros((len(q.at), 1 << DIGIT), np.int64)
    for part, lo, below, fits in windows(a, q, b, same):
        d0, dm, em = q.d0[part], q.dm[part], q.em[part]
        by_score = dm > 0
        digit = np.where(by_score, (below - d0) >> np.maximum(dm - DIGIT, 0), 0)
        inside = fits & (below >= d0) & np.where(by_score, digit < 1 << DIGIT, below == d0)
        if not by_score.all():
            e = b.ids[lo : lo + below.shape[1]].view(np.uint64) - np.uint64(least_id % (1 << 64))
            past = (e[None, :] - q.e0[part]) >> np.maximum(em - DIGIT, 0).astype(np.uint64)
            ok = (e[None, :] >= q.e0[part]) & (past < 1 << DIGIT)
            inside &= by_score | ok
            digit = np.where(by_score, digit, np.where(ok, past, 0).astype(np.int64))
        rows, cols = np.nonzero(inside)
        width = below.shape[0] << DIGIT
        found[part] += np.bincount((rows << DIGIT) + digit[rows, cols], minlength=width).reshape(-1, 1 << DIGIT)
    return found


def qualifying(a: Block, q: Queries, b: Block, same: bool, least_id: int, most: int) -> tuple[np.ndarray, ...]:
    """(query, score, id) of the block's rows at or above each query's interval, of
    each query its ``most`` first."""
    got = []
    for part, lo, below, fits in windows(a, q, b, same):
        d0, dm = q.d0[part], q.dm[part]
        e = b.ids[lo : lo + below.shape[1]].view(np.uint64) - np.uint64(least_id % (1 << 64))
        within = (e[None, :] <= q.e0[part]) | (((e[None, :] - q.e0[part]) >> (q.em[part].astype(np.uint64) >> np.uint64(1)) >> (q.em[part].astype(np.uint64) - (q.em[part].astype(np.uint64) >> np.uint64(1)))) == 0)
        last = d0 + (np.int64(1) << dm) - 1
        rows, cols = np.nonzero(fits & ((below < d0) | np.where(dm > 0, below <= last, (below == d0) & within)))
        got.append((rows + part.start, q.best[part][rows, 0] - below[rows, cols], b.ids[lo + cols]))
    query, score, ids = (np.concatenate(c) for c in zip(*got, strict=True))
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    new = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(new, np.diff(np.r_[new, len(query)]))
    keep = place < most
    return query[keep], score[keep], ids[keep]


def _over_pairs(blocks: DataFrame, anchors: DataFrame, state: DataFrame, sent: int, run, schema: str) -> DataFrame:
    """``run`` over each block of anchors that has queries and each block of rows of its
    length: a block of rows is dealt to one task and held there, the anchors' blocks
    pass by it. ``run`` gives columns of the result."""
    asked = state.groupBy("anchors").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "best", "reach", "d0", "dm", "e0", "em"))).alias("asked"))
    numbers = blocks.select("dim", F.col("block").alias("deal"))
    numbers = F.broadcast(numbers) if sent <= MOST_SENT else numbers
    moving = anchors.join(asked, "anchors").join(numbers, "dim").select("deal", F.lit(1).alias("kind"), F.col("anchors").alias("number"), *PAYLOAD, "asked")
    still = blocks.select(F.col("block").alias("deal"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("number"), *PAYLOAD, F.lit(None).cast(STATE).alias("asked"))
    names = [f.name for f in blocks.sparkSession.createDataFrame([], schema).schema]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block | None = None
        at = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ["deal", "kind", "number", *PAYLOAD]}
                if row["kind"] == 0:
                    held, at = Block(row), row["deal"]
                elif at == row["deal"]:
                    got = run(row["number"], Block(row), Queries(batch.column("asked")[k].values), held)
                    if len(got[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names)

    rows = still.unionByName(moving)
    return rows.repartition(max(1, min(sent, 20_000)), "deal").sortWithinPartitions("deal", "kind", "number").mapInArrow(stream, schema)


def select(blocks: DataFrame, anchors: DataFrame, state: DataFrame, most: int, same: bool) -> DataFrame:
    """(anchors, at, turn, anchor_id, id, score, rank): the first ``most`` rows of each
    query's window, of the anchor's label or of others, in order of falling score and rising id."""
    sent = blocks.count()
    ends = blocks.agg(F.min("least_id"), F.max("most_id")).first()
    least_id = ends[0] or 0
    id_bits = int((ends[1] or 0) - least_id).bit_length()

    def count(number, a, q, b):
        found = count_digits(a, q, b, same, least_id)
        rows, digits = np.nonzero(found)
        return np.full(len(rows), number), q.at[rows].astype(np.int32), q.turn[rows].astype(np.int32), digits.astype(np.int32), found[rows, digits]

    def gather(number, a, q, b):
        rows, score, ids = qualifying(a, q, b, same, least_id, most)
        return np.full(len(rows), number), q.at[rows].astype(np.int32), q.turn[rows].astype(np.int32), a.ids[q.at[rows]], ids, score

    state = state.withColumns({"d0": F.lit(0).cast("long"), "e0": F.lit(0).cast("long"), "em": F.lit(id_bits), "above": F.lit(0).cast("long")})
    settled = []
    while True:
        found = _over_pairs(blocks, anchors, state, sent, count, "anchors long, at int, turn int, digit int, n long").groupBy(*QUERY, "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*QUERY).orderBy("digit"))
        found = found.withColumn("upto", upto).join(state.select(*QUERY, "above"), QUERY).where(F.col("above") + F.col("upto") >= most)
        hit = found.groupBy(*QUERY).agg(F.min(F.struct("digit", "n", "upto")).alias("hit"))
        by_score = F.col("dm") > 0
        shift = lambda c: F.greatest(F.col(c) - DIGIT, F.lit(0))
        step = lambda c: F.call_function("shiftleft", F.col("hit.digit").cast("long"), shift(c))
        there = F.col("hit").isNotNull()
        after = state.join(hit, QUERY, "left").select(
            *QUERY, "best", "reach",
            F.when(there & by_score, F.col("d0") + step("dm")).otherwise(F.col("d0")).alias("d0"), F.when(there & by_score, shift("dm")).otherwise(F.col("dm")).alias("dm"),
            F.when(there & ~by_score, F.col("e0") + step("em")).otherwise(F.col("e0")).alias("e0"), F.when(there & ~by_score, shift("em")).otherwise(F.col("em")).alias("em"),
            F.when(there, F.col("above") + F.col("hit.upto") - F.col("hit.n")).otherwise(F.col("above")).alias("above"), F.coalesce(F.col("hit.n"), F.lit(0)).alias("n"),
        )
        state = stored(after.withColumn("done", (F.col("above") + F.col("n") <= FEW) | (F.col("dm") + F.col("em") == 0)).drop("n"), "digits")
        settled.append(state)
        state = state.where(~F.col("done")).drop("done")
        if state.isEmpty():
            break
    final = reduce(DataFrame.unionByName, [s.where("done") for s in settled])
    rows = _over_pairs(blocks, anchors, final, sent, gather, "anchors long, at int, turn int, anchor_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy(*QUERY).orderBy(F.desc("score"), "id"))
    chosen = stored(rows.withColumn("rank", place).where(F.col("rank") <= most), "chosen")
    discard(*settled)
    return chosen


def bits(reach: Column) -> Column:
    """Digits of base two that a distance up to ``reach`` takes."""
    return F.when(reach <= 0, 0).otherwise(F.length(F.bin(reach))).cast("int")


def mine(vectors: DataFrame, is_anchor: Column, spec: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has (id, label, vector); ``is_anchor`` tells anchors by these. A row
    with a null id, label, vector or component, or a component that is no finite
    number, takes no part; vectors of different lengths are not compared, those
    without components score 0. Rows with the anchor's id are no positives of it.
    A row that repeats counts as often as it is there, as anchor, positive and
    negative; equal scores are ordered by id. A positive with an empty window has
    no rows, nor has an anchor without positives, nor an empty table.
    """
    rows = usable(vectors.select("id", "label", "vector"), spec.scale)
    blocks = stored(packed(rows, spec.scale).withColumn("block", F.monotonically_increasing_id()), "blocks")
    anchors = stored(packed(rows.where(is_anchor).repartition("id"), spec.scale, BLOCK_ANCHORS).withColumn("anchors", F.monotonically_increasing_id()), "anchors")

    longest = blocks.groupBy("dim").agg(F.max("norm").alias("longest"))
    best = F.ceil(F.least(F.col("norm") * F.col("longest") * (1 + 1e-9) + 1, F.lit(float(FAR)))).cast("long")
    each = anchors.join(longest, "dim").select("anchors", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("at"), best.alias("best"))
    state = each.select("anchors", "at", F.lit(0).alias("turn"), "best", (F.col("best") * 2).alias("reach")).withColumn("dm", bits(F.col("reach")))
    positives = select(blocks, anchors, state, spec.positives, True)

    whole = lambda percent: F.col("score").cast("decimal(20,0)") * percent / 100
    state = positives.select("anchors", "at", F.col("rank").alias("turn"), F.floor(whole(spec.high)).cast("long").alias("best"), F.ceil(whole(spec.low)).cast("long").alias("worst"))
    state = state.withColumn("reach", F.col("best") - F.col("worst")).where(F.col("reach") >= 0).drop("worst").withColumn("dm", bits(F.col("reach")))
    negatives = select(blocks, anchors, state, spec.negatives, False)

    of = positives.select("anchors", "at", F.col("rank").alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.join(of, QUERY).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    result = stored(found, "negatives")
    discard(blocks, anchors, positives, negatives)
    return result
