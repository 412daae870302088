"""Exact duplicates by a tree merge of sorted digest runs (DataFrame only).

Every input partition makes one run: its distinct digests in order, each with
the identifier to keep and its number of rows. Runs meet in binomial rounds:
round k puts the runs whose numbers agree above bit ``k * bits`` together and
merges them, so that a run number loses ``bits`` bits a round until one run is
left. A digest has one row per run at most when it is exchanged, however many
copies it has, and every run is cut by its digests, so that even the last merge
is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import single_rows, stored, without

KEY = ["digest", "bytes", "proof"]


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, digest, bytes, proof) of each row; a null text counts as empty.

    ``digest`` is the SHA-256 of the UTF-8 text. ``bytes`` and ``proof`` (a hash
    of another family) verify it: rows meet only when all three agree.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("bytes"), F.xxhash64(body).alias("proof"))


def _rounds(runs: int, bits: int) -> int:
    k = 0
    while (runs - 1) >> (bits * k):
        k += 1
    return max(k, 1)


def merge_runs(prints: DataFrame, keep: str = "largest", runs: int = 4096, bits: int = 6) -> DataFrame:
    """One row per distinct text: KEY, keep_id, group_size, by a tree of merges.

    ``runs`` bounds the run numbers (partition numbers beyond it share a run);
    each round merges up to ``2 ** bits`` runs. The kept identifier is a struct
    in the aggregate, which makes Spark sort each side by key and merge the
    sorted rows. A null id is kept only where all ids of a group are null.
    """
    known = F.when(F.col("id").isNull(), 0).otherwise(1)
    best: Column
    if keep == "largest":
        pick, best = F.max, F.struct(known.alias("known"), F.col("id"))
    elif keep == "smallest":
        pick, best = F.min, F.struct((1 - known).alias("known"), F.col("id"))
    else:
        raise ValueError("keep is 'largest' or 'smallest'")
    level = prints.select(*KEY, best.alias("best"), F.lit(1).cast("long").alias("n"), F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"))
    level = level.groupBy("run", *KEY).agg(pick("best").alias("best"), F.sum("n").alias("n"))
    for _ in range(_rounds(runs, bits)):
        level = level.withColumn("run", F.shiftright("run", bits)).groupBy("run", *KEY).agg(pick("best").alias("best"), F.sum("n").alias("n"))
    return level.select(*KEY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "largest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one group. Repeated rows (same id, same text) count
    in ``group_size`` and share one verdict; a row without id is kept only in a
    group without any id. No input row gives no output row; other columns of the
    input play no part.
    """
    prints = stored(fingerprints(docs, text, id), "digests")
    groups = merge_runs(prints, keep)
    return prints.join(groups, KEY).select(
        F.col("id").alias(id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def drop_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "largest", single: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that exact copies leave: one
    row of each text.

    Texts are moved once, by id and digest. Rows without id go where another of
    their text has one. Of repeated rows of the kept id, and of a text whose rows
    all lack an id, one is left; without ``single`` they all stay. Only
    texts that have such rows are looked at again.
    """
    groups = stored(exact_groups(docs, text, id, keep), "verdicts")
    rows = without(docs, groups.where("not kept").select(id, F.unhex("text_sha256")), F.col(id), _digest(text))
    if not single:
        return rows
    again = stored(groups.where("kept").groupBy("text_sha256").count().where("count > 1").select(F.unhex("text_sha256").alias("digest")), "repeated")
    return single_rows(rows, again, _digest(text))
