"""Mixing of sources to target weights by a multivariate-hypergeometric tree.

Every source is permuted by a hash and cut into blocks. How many blocks the mix
takes of each source is exact; a tree over the output shards splits these
quotas: a node hands its left half a multivariate-hypergeometric draw from its
own quotas and the rest to its right half, so that every shard is a random
sample without replacement and the shards together are the quotas. A shard finds
its own quotas by walking down from the root, with a random state for each node,
so shards are planned in parallel and alike on every rerun. Shards own disjoint
runs of each source's permuted blocks and are shuffled on their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored, words_in

#: Blocks of all sources together, about, as long as a shard still has several; twice as
#: many, at most, are broadcast, and more are joined.
MAX_BLOCKS = 16_384
#: Sources, at most: their weights are a configuration.
MAX_SOURCES = 100_000
#: Words to a shard, about; one task shuffles and writes it.
SHARD_WORDS = 8_000_000
PASSES = 2
TAKE = ("_pass", "_shard", "_place")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight, none above
    ``most`` times its own size; what is cut off goes to the others by weight."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if unit * weights[k] > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


def shard_quotas(quotas: Sequence[int], shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of each stratum's permuted blocks that a shard owns."""
    here, first = np.asarray(quotas, np.int64), np.zeros(len(quotas), np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        n = int(here.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(here, n, method="marginals")
        if shard < middle:
            here, high = left, middle
        else:
            here, first, low = here - left, first + left, middle
    return first, here


@dataclass(frozen=True)
class Mix:
    """A plan: ``sources`` has a row per source (source, source_no, blocks,
    source_size, target), ``blocks`` a row per source and block with its shard in
    each pass that takes it and, in a block taken in part, the last row taken."""

    sources: DataFrame
    blocks: DataFrame
    seed: int
    shards: int
    sent: bool


def row_key(id: Column, text: Column) -> Column:
    """What a row is known by: its id and its text, so rows without id, or of one id, are
    placed apart where their texts differ."""
    return F.xxhash64(id, text)


def _place(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def _order(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def plan_mix(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, shards: int | None = None, block_words: int = 50_000, seed: int = 5, max_blocks: int = MAX_BLOCKS) -> Mix:
    """Plan over ``sized`` (id, source, size and, where ids repeat, key), which is read several times.

    Sources in code-point order, null last, take the weights in turn. Whole
    documents are taken; the last block of a source's last pass is taken up to
    the document nearest to the target. Without ``shards`` there are as many as
    the mix has SHARD_WORDS, but no more than blocks taken. Blocks grow beyond
    ``block_words`` to hold their number, up to an eighth of a shard.
    """
    sized = sized if "key" in sized.columns else sized.withColumn("key", F.xxhash64("id"))
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give them weights by group")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.size for r in totals]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, float(PASSES))
    per = max(block_words, min(sum(sizes) // max_blocks, SHARD_WORDS // 8))
    n_blocks = [max(1, -(-s // per)) for s in sizes]
    rows = [(r.source, k, b, s, g) for k, (r, b, s, g) in enumerate(zip(totals, n_blocks, sizes, goal, strict=True))]
    sources = spark.createDataFrame(rows, "source string, source_no int, blocks long, source_size long, target double")

    at = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).select("source_no", "source_size", "target", "key", "size", F.pmod(_place(F.col("key"), seed), "blocks").alias("block"))
    # the permuted blocks of each source and where each starts
    words = at.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    by_place = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed + 1), "source_no", "block"), "block")
    words = words.withColumns({"rank": F.row_number().over(by_place) - 1, "until": F.sum("words").over(by_place)})
    words = words.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(PASSES), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    words = words.withColumn("part", F.when(F.col("whole") < PASSES, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    words = words.withColumn("need", F.col("part") - (F.col("until") - F.col("words")))  # words of the last pass still to take here
    words = stored(words.withColumn("cut", (F.col("need") > 0) & (F.col("need") < F.col("words"))), "blocks")
    # the block that the last pass takes in part: its rows in order, up to the nearest
    inside = at.join(F.broadcast(words.where("cut").select("source_no", "block", "need")), ["source_no", "block"])
    by_order = Window.partitionBy("source_no", "block").orderBy(_order(F.col("key"), seed), "key", "size")
    inside = inside.withColumn("until", F.sum("size").over(by_order)).where(F.col("until") - F.col("size") / 2 <= F.col("need"))
    last = inside.groupBy("source_no", "block").agg(F.max(F.struct(_order(F.col("key"), seed).alias("place"), "key")).alias("last"))
    drawn = words.join(last, ["source_no", "block"], "left").withColumn("passes", F.col("whole") + ((F.col("need") >= F.col("words")) | F.col("last").isNotNull()).cast("int"))
    drawn = stored(drawn.select("source_no", "block", "rank", "whole", "cut", "last", "passes"), "drawn")

    # a stratum is one pass over one source
    counts = {(r.source_no, p): n for r in drawn.groupBy("source_no").agg(*[F.sum((F.col("passes") > p).cast("long")).alias(f"n{p}") for p in range(PASSES)]).collect() for p, n in enumerate((r.n0, r.n1)) if n}
    strata = sorted(counts)
    quotas = [counts[s] for s in strata]
    if shards is None:
        shards = max(1, min(sum(quotas), int(-(-sum(goal) // SHARD_WORDS))))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                first, n = shard_quotas(quotas, int(shard), shards, seed)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"source_no": [strata[k][0] for k in some], "pass": [strata[k][1] for k in some], "first": first[some], "n": n[some], "shard": int(shard)})

    tree = spark.range(shards).repartition(min(shards, 16 + shards // 10_000)).mapInPandas(leaves, "source_no int, pass int, first long, n long, shard int")
    owned = tree.select("source_no", "pass", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
    # the blocks that a pass draws are the first of the permutation, so their ranks have no holes
    takes = drawn.where("passes > 0").select("source_no", "block", "whole", "cut", "last", "rank", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    blocks = takes.join(owned, ["source_no", "pass", "rank"]).groupBy("source_no", "block", "whole", "cut", "last").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("takes"))
    plan = Mix(sources, stored(blocks, "takes"), seed, shards, sum(n_blocks) <= 2 * max(max_blocks, len(totals)))
    discard(words, drawn)
    return plan


def with_takes(docs: DataFrame, mix: Mix, key: Column, source: str = "source") -> DataFrame:
    """(row, at, takes): every row of ``docs`` as a struct, its source's row of the
    plan, and the array of (pass, shard) that take it, empty where none does. ``key`` is
    what the plan knows a row by. No row is shuffled as long as the plan is small enough to be
    sent; beyond 2 * MAX_BLOCKS blocks, or two a source, it is joined by block."""
    rows = docs.select(F.struct("*").alias("row"), key.alias("id"), F.col(source).alias("source"))
    sources = mix.sources.select(F.col("source").alias("name"), F.struct("source_no", "blocks", "source_size", "target").alias("at"))
    placed = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).select("row", "id", "at", F.struct(F.col("at.source_no").alias("s"), F.pmod(_place(F.col("id"), mix.seed), "at.blocks").alias("b")).alias("key"))
    plan = mix.blocks.select(F.struct(F.col("source_no").alias("s"), F.col("block").alias("b")).alias("key"), F.struct("whole", "cut", "last", "takes").alias("plan"))
    here = F.struct(_order(F.col("id"), mix.seed).alias("place"), F.col("id").alias("key"))
    taken = F.filter("plan.takes", lambda t: (t["pass"] < F.col("plan.whole")) | ~F.col("plan.cut") | (here <= F.col("plan.last")))
    none = F.array().cast("array<struct<pass: int, shard: int>>")
    return placed.join(F.broadcast(plan) if mix.sent else plan, "key", "left").select("row", "at", F.coalesce(taken, none).alias("takes"))


def sizes(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id") -> DataFrame:
    """(id, key, source, size) of every row, written."""
    number = F.col(id).cast("long")
    return stored(docs.select(number.alias("id"), row_key(number, F.col(text)).alias("key"), F.col(source).alias("source"), words_in(F.col(text)).alias("size")), "sizes")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", **options) -> DataFrame:
    """The mixed rows: ``docs``' columns, then ``_pass``, ``_shard`` and ``_place``,
    the order within the shard; input columns of these names are replaced. A
    document taken twice gives two rows.

    Null sources are one source, the last. A null or empty text has size 0 and
    goes with its block. Rows of one id and one text go together, so a source's words are
    off by half of these at most. No rows give no rows.
    """
    sized = sizes(docs, text, source, id)
    plan = plan_mix(sized, **options)
    discard(sized)
    key = row_key(F.col(id).cast("long"), F.col(text))
    rows = with_takes(docs, plan, key, source).select("row", F.explode("takes").alias("take"))
    order = F.xxhash64(F.lit(plan.seed), "take.shard", "take.pass", row_key(F.col(f"row.{id}").cast("long"), F.col(f"row.{text}")))
    return rows.select(*[F.col(f"row.{c}") for c in docs.columns if c not in TAKE], F.col("take.pass").alias("_pass"), F.col("take.shard").alias("_shard"), order.alias("_place"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mixed rows shard by shard, each shuffled on its own by ``_place``."""
    return mixed.repartition("_shard").sortWithinPartitions("_shard", "_place")


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder a shard, each shuffled on its own by ``_place``."""
    shuffled(mixed).write.partitionBy("_shard").parquet(path)
