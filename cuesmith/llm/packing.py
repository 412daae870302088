"""Packing of documents into training sequences by variable-capacity best fit.

Texts are cut into pieces no longer than the largest sequence where they lie,
pieces are dealt to packing groups of bounded size by a hash of the row, and
each group is packed on its own: pieces in falling length go to the open bin
with the least room that takes them. Where none does, the bin that opens is the
permitted size of least expected cost for this piece and what is still to come;
at the end each bin shrinks to the smallest permitted size that holds it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_path, stored, words_in

SIZES = (512, 1024, 2048, 4096, 8192)
#: Padding-equivalent tokens that one more sequence costs.
PER_BIN = 16
#: Rows of one id and text from which on its copies are dealt to several groups.
HOT = 256
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def opening_size(length: int, left: int, shorter: int, sizes: Sequence[int], per_bin: int = PER_BIN) -> int:
    """Permitted size with the least expected cost a token for a new bin.

    ``left`` tokens in ``shorter`` pieces, none longer than ``length``, are still to be placed. A bin
    of size s is expected to fill up to half a mean remaining piece, or not
    beyond what is left; the cost is padding plus ``per_bin`` over the tokens it
    is expected to hold.
    """
    mean = left / shorter if shorter else 0
    best, best_cost = sizes[-1], float("inf")
    for s in sizes:
        if s < length:
            continue
        held = length + min(left, max(0.0, s - length - mean / 2) if mean <= s - length else 0.0)
        fitting = next(x for x in sizes if x >= held)  # it will be downsized
        cost = (fitting - held + per_bin) / held
        if cost < best_cost - 1e-12:
            best, best_cost = s, cost
    return best


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each length, in falling order given, and the bins' sizes."""
    sizes = sorted(sizes)
    left, bins, offsets = sum(lengths), [], []
    room: list[tuple[int, int]] = []  # (free, bin) in order
    used: list[int] = []
    for k, n in enumerate(lengths):
        left -= n
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, free = len(used), opening_size(n, left, len(lengths) - k - 1, sizes)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, [next(s for s in sizes if s >= u) for u in used]


def cost(capacity: Sequence[int], held: int, per_bin: int = PER_BIN) -> int:
    """Padding of a packing that holds ``held`` tokens, and ``per_bin`` a sequence."""
    return sum(capacity) - held + per_bin * len(capacity)


def pieces(text: Column, tokens: Column, largest: int) -> Column:
    """A text cut before every word whose place is a multiple of ``largest``; joined, the
    pieces are the text. The end token alone may need a last, empty piece."""
    run = rf"(?:^{SPACE}*+)?(?:{WORD}++{SPACE}*+){{1,{largest}}}+"
    cut = F.when(tokens > largest, F.regexp_extract_all(text, F.lit(run), F.lit(0))).otherwise(F.array(text))
    return F.when(F.size(cut) * largest < tokens, F.concat(cut, F.array(F.lit("")))).otherwise(cut)


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", sizes: Sequence[int] = SIZES, group_rows: int = 2048, group_tokens: int = 1 << 21) -> DataFrame:
    """Pieces of every document with their content: id, copy, piece, start, length,
    bin, offset, capacity, body; the pieces of a sequence stand together in order.
    Groups are samples of all rows, and the sequences of a group stand in an order of
    chance that reruns repeat.

    A document is its words and one end token. One longer than the largest size
    is cut into full sequences and a rest. A piece covers tokens ``start`` to
    ``start + length`` of its document, with its text as ``body``, and lies at ``offset`` of sequence
    ``bin``, which is ``capacity`` long; the end token follows the last piece's words. ``copy`` tells repeated rows of an id
    apart. A null or empty text is its end token alone; a null id is an id like
    any other. Other columns of the input play no part.

    ``group_rows`` and ``group_tokens`` bound what one task packs at a time, on average,
    whatever the size of the corpus; texts move once. Rows that are there more than HOT
    times are dealt to as many groups as they fill.
    """
    largest = max(sizes)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("id"), body.alias("body"), F.xxhash64(body).alias("th"), (words_in(F.col(text)) + 1).alias("tokens"))
    total = rows.agg(F.sum(F.ceil(F.col("tokens") / largest)).alias("rows"), F.sum("tokens").alias("tokens")).first()
    groups = max(1, -(-(total.rows or 0) // group_rows), -(-(total.tokens or 0) // group_tokens))
    # few keys can be hot: each has HOT rows or more; their copies are dealt by place, all others by value
    hot = rows.groupBy("id", "th").count().where(F.col("count") > HOT).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.ceil(F.col("count") / HOT).alias("deals"))
    hot = stored(hot, "hot")  # its size is known then, and texts do not move for it
    if hot.isEmpty():
        discard(hot)
        rows = rows.withColumn("deals", F.lit(None).cast("long"))
    else:
        rows = rows.join(hot, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    deal = F.when(F.col("deals").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("deals"))).cast("long")
    rows = rows.select("id", "th", "tokens", F.coalesce("deals", F.lit(1)).cast("long").alias("deals"), deal.alias("deal"), F.posexplode(pieces(F.col("body"), F.col("tokens"), largest)).alias("piece", "body"))
    rows = rows.withColumn("length", F.least(F.lit(largest).cast("long"), F.col("tokens") - F.col("piece") * largest))
    # the pieces of a row go to groups of their own: a row of millions of words is no group's burden
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("id", "th", "deal", "piece"), F.lit(groups)))

    def packed(table: pa.Table) -> pa.Table:
        th, deals, deal, piece, length = (table.column(c).to_numpy() for c in ("th", "deals", "deal", "piece", "length"))
        no_id, id_ = table.column("id").is_null().to_numpy(), table.column("id").fill_null(0).to_numpy()
        order = np.lexsort((deal, piece, th, id_, no_id, -length))
        key = np.stack([no_id, id_, th, piece, deal])[:, order]
        same = np.concatenate([[False], (key[:, 1:] == key[:, :-1]).all(0)]) if len(order) else np.zeros(0, bool)
        at = np.arange(len(order))
        again = at - np.maximum.accumulate(np.where(same, 0, at))  # the how manieth of its kind in the group
        bins, offsets, capacity = best_fit(length[order].tolist(), sizes)
        bins, offsets = np.array(bins, np.int64), np.array(offsets, np.int64)
        g = int(table.column("grp")[0].as_py())
        # pieces came in falling length, so bins did: they are turned into an order of chance
        turn = np.random.default_rng([len(capacity), g]).permutation(len(capacity))
        out = np.lexsort((offsets, turn[bins]))
        place = order[out]
        columns = {
            "id": table.column("id").take(pa.array(place)), "copy": pa.array((again * deals[order] + deal[order])[out]), "piece": pa.array(piece[place].astype(np.int64)),
            "start": pa.array(piece[place].astype(np.int64) * largest), "length": pa.array(length[place]), "bin": pa.array([f"{g}-{b}" for b in bins[out]], pa.string()),
            "offset": pa.array(offsets[out]), "capacity": pa.array(np.asarray(capacity, np.int64)[bins[out]]), "body": table.column("body").take(pa.array(place)),
        }
        return pa.table(columns)

    out = rows.groupBy("grp").applyInArrow(packed, "id long, copy long, piece long, start long, length long, bin string, offset long, capacity long, body string")
    return out.withColumnRenamed("id", id)


def write_sequences(packed: DataFrame, path: str | None = None) -> str:
    """Write ``pack``'s rows as training sequences, one row each, and say where: bin,
    capacity, used, and ``parts`` in order of offset, each with its body."""
    path = path or new_path(packed.sparkSession, "sequences")
    last = [c for c in packed.columns if c not in ("bin", "capacity", "offset")]
    rows = packed.groupBy("bin", "capacity").agg(F.sum("length").alias("used"), F.sort_array(F.collect_list(F.struct("offset", *last))).alias("parts"))
    rows.write.parquet(path)
    return path


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of written sequences, as ``pack`` gave them."""
    rows = spark.read.parquet(path)
    return rows.select("bin", "capacity", F.explode("parts").alias("p")).select("bin", "capacity", "p.*")


def texts_of(packed: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, copy, text, tokens) of every packed document, put together again. A
    document's pieces are brought together: its text fits a task."""
    whole = packed.groupBy(id, "copy").agg(F.sort_array(F.collect_list(F.struct("start", "body"))).alias("parts"), F.sum("length").alias("tokens"))
    return whole.select(id, "copy", F.concat_ws("", F.transform("parts", lambda p: p["body"])).alias("text"), "tokens")
