"""Sequential rules over sorted runs.

Rows are dealt by key and sorted, and one Arrow stream a task passes over them:
a group is handed to the rule as soon as its last row is seen, so a task holds
one group and never its partition, and millions of small groups cost no call of
the engine each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window, WindowSpec

Rule = Callable[[dict[str, list]], dict[str, list]]
StreamRule = Callable[[Iterator[tuple]], Iterator[tuple]]


#: Seconds, and positions, of a group that are sorted together where a group is cut into islands.
STRETCH, POSITIONS = 3600.0, 20_000


def in_order(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def by_blocks(column: str, width: float) -> Column:
    """Number of the stretch of ``width`` that a value lies in; null lies before
    all others and NaN behind them, as in a sort."""
    c = F.col(column)
    low, high = F.lit(-(2**63)), F.lit(2**63 - 1)
    return F.when(c.isNull(), low).when(F.isnan(c.cast("double")), high).otherwise(F.floor(c / width)).cast("long")


def row_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before in its group; null in the first.

    Only rows of one block are sorted together, ``block`` being a number that grows with the
    order; of each block its last row goes on to the next. So a group of any length is spread over
    tasks. Rows with a null key are in no group and are left out.
    """
    rows = df.withColumn("_block", block)
    last = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    last = last.withColumn("_held", F.lag("_last").over(in_order(keys, ["_block"]))).drop("_last")
    here = F.lag(F.struct(value)).over(in_order([*keys, "_block"], order))
    rows = rows.join(last, [*keys, "_block"]).withColumn(name, F.coalesce(here, F.col("_held"))[value])
    return rows.select(*df.columns, name)


def sum_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value``, a LONG, over the earlier rows of the
    group, by blocks as in ``row_before``. Keys are not null."""
    rows = df.withColumns({"_block": block, "_value": value.cast("long")})
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    earlier = lambda by, order, c: F.coalesce(F.sum(c).over(in_order(by, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("_held", earlier(keys, ["_block"], "_total")).drop("_total")
    rows = rows.join(totals, [*keys, "_block"]).withColumn(name, F.col("_held") + earlier([*keys, "_block"], order, "_value"))
    return rows.select(*[c for c in df.columns if c != name], name)


@dataclass(frozen=True)
class Scan:
    """A running value of a group in its order: ``max`` and ``sum`` of the rows up to this
    one, ``last`` and ``next`` value that is not null before or after it, ``total``
    sum of the whole group. ``own`` is whether the row itself counts. To keep
    nulls, as in a shift by one row, wrap the value in a struct."""

    kind: str
    value: Column
    own: bool = False


def scans(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, wanted: dict[str, Scan]) -> DataFrame:
    """``df`` with a column for each of ``wanted``: a prefix scan in parallel.

    ``block`` is a number that grows with the order. Each block is folded to one value,
    the folds of the blocks before (or after) are carried to it, and inside it a window
    goes on from there. So a group of any length is spread over tasks by block,
    and what meets for a group is a row a block. All values share one pass. A null
    key is a key like others. Rows that tie in ``order`` must not differ in a
    value that ``last`` or ``next`` looks for.
    """
    rows = df.withColumns({"_block": block} | {f"_in_{n}": s.value for n, s in wanted.items()})
    own, at = [f"_k{i}" for i in range(len(keys))], F.struct(*order)
    folded, carried, here = [], {}, {}
    blocks, inside = in_order(own, ["_block"]), in_order([*keys, "_block"], order)
    first, end = Window.unboundedPreceding, Window.unboundedFollowing
    for n, s in wanted.items():
        c, back, ahead = F.col(f"_in_{n}"), inside.rowsBetween(first, 0 if s.own else -1), inside.rowsBetween(0 if s.own else 1, end)
        known = F.when(c.isNotNull(), at)
        folded.append({"max": F.max(c), "sum": F.sum(c), "total": F.sum(c), "last": F.max_by(c, known), "next": F.min_by(c, known)}[s.kind].alias(f"_of_{n}"))
        f = F.col(f"_of_{n}")
        over = {"max": F.max(f), "sum": F.sum(f), "total": F.sum(f), "last": F.last(f, ignorenulls=True), "next": F.first(f, ignorenulls=True)}[s.kind]
        carried[f"_to_{n}"] = over.over(Window.partitionBy(*own) if s.kind == "total" else blocks.rowsBetween(1, end) if s.kind == "next" else blocks.rowsBetween(first, -1))
        zero = lambda x: F.coalesce(x, F.lit(0))
        here[n] = {
            "max": lambda c=c, w=back, n=n: F.greatest(F.max(c).over(w), F.col(f"_to_{n}")),
            "sum": lambda c=c, w=back, n=n: zero(F.sum(c).over(w)) + zero(F.col(f"_to_{n}")),
            "total": lambda n=n: zero(F.col(f"_to_{n}")),
            "last": lambda c=c, w=back, n=n: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_to_{n}")),
            "next": lambda c=c, w=ahead, n=n: F.coalesce(F.first(c, ignorenulls=True).over(w), F.col(f"_to_{n}")),
        }[s.kind]()
    totals = rows.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "_block").agg(*folded).withColumns(carried)
    totals = totals.select(*own, F.col("_block").alias("_b"), *carried)
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for k, o in zip(keys, own, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return rows.join(totals, same).withColumns(here).select(*[c for c in df.columns if c not in wanted], *wanted)


def cut_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, cut: Column) -> DataFrame:
    """``df`` with ``island``: a new one starts at each row where ``cut`` holds."""
    rows = df.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("long"))
    rows = sum_before(rows, keys, order, block, F.col("_cut"), "island")
    return rows.withColumn("island", F.col("island") + F.col("_cut")).drop("_cut")


def renumbered(parts: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Results of (keys, island) numbered through each group."""
    rows = parts.withColumnRenamed(number, "_number")
    return sum_before(rows, keys, ["island", "_number"], by_blocks("island", 1000), F.lit(1), number).select(*[c for c in parts.columns if c not in ("island", number)], number)


def _dealt(df: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def over_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Rule, schema: str, columns: Sequence[str] | None = None, types: dict[str, pa.DataType] | None = None, parts: int | None = None) -> DataFrame:
    """``rule`` maps the columns of one group, in order, to columns of the result;
    the keys are added in front. ``schema`` is of the result without the keys; ``types`` names
    Arrow types of columns that may be empty arrays. Of rows that are dealt into
    ``parts`` by the keys already, as a bucketed table is, none is moved."""
    keys, order = list(keys), list(order)
    columns = [*dict.fromkeys([*keys, *(columns or df.columns)])]
    out = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + schema
    fields = StructType.fromDDL(schema).names

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] | None = None
        held_key: tuple | None = None
        made: dict[str, list] = {f: [] for f in [*keys, *fields]}
        shape = None

        def finish() -> None:
            got = rule(held)
            n = len(got[fields[0]])
            for f in fields:
                made[f].extend(got[f])
            for k, v in zip(keys, held_key, strict=True):
                made[k].extend([v] * n)

        def full() -> pa.RecordBatch:
            known = shape | (types or {})
            rows = pa.RecordBatch.from_pydict({k: pa.array(v, known[k]) if k in known else pa.array(v) for k, v in made.items()})
            for v in made.values():
                v.clear()
            return rows

        for batch in batches:
            shape = {k: batch.schema.field(k).type for k in keys}
            cols = {c: batch.column(c).to_pylist() for c in columns}
            key_rows = list(zip(*(cols[k] for k in keys), strict=True))
            at = 0
            while at < len(key_rows):
                to = at + 1
                while to < len(key_rows) and key_rows[to] == key_rows[at]:
                    to += 1
                if held is not None and key_rows[at] == held_key:
                    for c in columns:
                        held[c].extend(cols[c][at:to])
                else:
                    if held is not None:
                        finish()
                    held_key, held = key_rows[at], {c: cols[c][at:to] for c in columns}
                at = to
            if len(made[fields[0]]) >= 4096:
                yield full()
        if held is not None:
            finish()
        if made[fields[0]]:
            yield full()

    return _dealt(df.select(*columns), keys, parts).sortWithinPartitions(*keys, *order).mapInArrow(stream, out)


def over_streams(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: StreamRule, schema: str, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """``over_runs`` for a rule that maps the rows of a group, tuples of ``columns``
    in order, to rows of the result one by one: no group is ever held."""
    keys, order, columns = list(keys), list(order), list(columns)
    out = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + schema
    fields = StructType.fromDDL(schema).names

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape: dict[str, pa.DataType] = {}
        made: list[tuple] = []

        def rows() -> Iterator[tuple[tuple, tuple]]:
            for batch in batches:
                shape.update((k, batch.schema.field(k).type) for k in keys)
                key_rows = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
                yield from zip(key_rows, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True)

        def full() -> pa.RecordBatch:
            cols = dict(zip([*keys, *fields], zip(*made, strict=True), strict=True))
            made.clear()
            return pa.RecordBatch.from_pydict({k: pa.array(v, shape.get(k)) for k, v in cols.items()})

        for key, group in groupby(rows(), key=itemgetter(0)):
            for got in rule(row for _, row in group):
                made.append((*key, *got))
                if len(made) >= 4096:
                    yield full()
        if made:
            yield full()

    return _dealt(df.select(*dict.fromkeys([*keys, *order, *columns])), keys, parts).sortWithinPartitions(*keys, *order).mapInArrow(stream, out)
