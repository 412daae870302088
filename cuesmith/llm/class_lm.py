"""Class-based n-gram scores: exchange clustering puts words into classes, and a
text's probability is the product of class transitions and word emissions.

Each of the ``lookup`` most frequent words is a unit of its own; while these are clustered,
rarer words and unseen ones share units by their ending. All that the clustering asks of the corpus is how
often each unit stands before and behind each other one. That is counted once, summed
where a unit's counts meet, and written as a table dealt by unit. A round is two passes over it:
the class transitions, 64 x 64 sums, over the cells behind each unit, and then, in the tasks, over the rows of
the units that may move, the class of each that raises the likelihood of the class bigrams most, the others held
fixed. Half of the units may move in a round; the rounds end when the likelihood no longer
rises, and the best one counts. Then every rarer word of the training rows, however many there
are, is exchanged too: how often each class stands beside it comes together by word, and it leaves
its ending's class for the one that raises the likelihood most. These classes are a
table, joined by word; they count if the transitions, counted again, are likelier. Only
words that training rows do not have keep the class of their ending.

P(word | previous) = P(class | class of previous) * P(word | class). Transitions
are smoothed towards the class frequencies; every word gives up an absolute
discount to the unseen words of its class. Counts and classes of the ``lookup`` most
frequent words go to the tasks; those of the rest are joined.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

END = b""  # no word is empty
PLACE, CELL = "<u4", "<u4"
KEPT = ("key", "id", "held_out", "n_tokens", "n_known", "base", "emit")
SCORED = ("id", "held_out", "n_tokens", "n_known", "base")


@dataclass(frozen=True)
class Model:
    """``classes`` with the end's own, ``lookup`` words at most that are clustered in rounds and
    are broadcast, ``endings`` units where the others start, ``rounds`` of exchange at most,
    ``prior`` transitions of smoothing, ``part_pairs`` neighbours to a part of the table."""

    classes: int = 64
    endings: int = 1_024
    lookup: int = 300_000
    rounds: int = 12
    prior: float = 50.0
    flush: int = 300_000
    part_pairs: int = 1_000_000


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(``tokens_of`` all texts of a column, one after another; how many each has)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, cuts = lists.flatten(), np.asarray(lists.offsets)
    some = pc.not_equal(pc.binary_length(words), 0)  # white space around a text leaves empty words
    held = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some).cast(pa.binary()), np.diff(held[cuts])


def slices(batch: pa.RecordBatch, size: np.ndarray, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of rows whose sizes add up to ``most``, or of one larger row."""
    upto, a = np.cumsum(size), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def sizes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def held_out(id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % parts == part, F.lit(False))


def word_counts(docs: DataFrame, model: Model) -> DataFrame:
    """(word, n) of the column ``text`` with one END a row; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

        for whole in batches:
            for batch in slices(whole, sizes(whole.column("text"))):
                counts = words_of(batch.column("text"))[0].value_counts()
                ends = pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([batch.num_rows], pa.int64())})
                held += [pa.table({"word": counts.field("values"), "n": counts.field("counts")}), ends]
                size += len(counts) + 1
                if size > 2 * model.flush:
                    held = [added()]
                    size = held[0].num_rows
                    if size > model.flush:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from added().to_batches()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(vocabulary: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words and their counts, most first: all above a count
    that at most ``most`` words reach. The count is found from a histogram of
    fixed bins; words and counts come to the driver as columns, not as rows."""
    bin_ = F.floor(F.log2("n") * 16)
    bins = vocabulary.where(F.col("word") != END).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    held, least = 0, None
    for r in sorted(bins, key=lambda r: -r.bin):
        held += r.words
        if held > most:
            break
        least = r.least
    if least is None:
        return [], np.zeros(0)
    got = vocabulary.where((F.col("n") >= least) & (F.col("word") != END)).orderBy(F.desc("n"), "word").toArrow()
    return got.column("word").to_pylist(), got.column("n").to_numpy().astype(float)


def ending_unit(word: bytes, words: int, model: Model) -> int:
    """The unit of a word that is none of the ``words`` with one of their own."""
    return 1 + words + zlib.crc32(word[-2:]) % model.endings


def ending_units(column: pa.Array, words: int, model: Model) -> np.ndarray:
    """``ending_unit`` of a column of words; each ending is looked at once."""
    endings = pc.binary_slice(column, -2).dictionary_encode()
    units = np.array([ending_unit(w, words, model) for w in endings.dictionary.to_pylist()], np.int64)
    return units[endings.indices.to_numpy()]


def encoded(docs: DataFrame, top: tuple[list[bytes], np.ndarray], discount: float, model: Model, end_n: int) -> DataFrame:
    """Each row as units, with the sums over the words in ``top`` and the others listed.

    (key, id, held_out, n_tokens, n_known, base, emit, units, rare); ``base`` adds
    log10(c + 1), ``emit`` log10 of the count less discount. ``rare`` has a word, how often
    it stands in the row and its packed places there.
    """
    words, n = top
    own = len(words)
    sums = np.stack([np.log10(n + 1), np.log10(np.maximum(n - discount, 1e-9))], 1)
    shared = docs.sparkSession.sparkContext.broadcast((words, sums))
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32()), ("places", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, sums = shared.value
        words = pa.array(words, pa.binary())
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, sizes(whole.column("text"))):
                tokens, many = words_of(batch.column("text"))
                rows, coded = batch.num_rows, tokens.dictionary_encode()
                kinds, index = coded.dictionary, coded.indices.to_numpy()  # each word is looked up once a slice
                places = pc.index_in(kinds, words).fill_null(-1).to_numpy().astype(np.int64)
                units, missing = places + 1, places < 0
                units[missing] = ending_units(kinds.filter(pa.array(missing)), own, model)
                row, of_kind = np.repeat(np.arange(rows), many), np.zeros((3, len(kinds)))
                of_kind[:, ~missing] = *sums[places[~missing]].T, np.ones((~missing).sum())
                base, emit, n_known = (np.bincount(row, x[index], rows) for x in of_kind)
                rest = np.flatnonzero(missing[index])
                rest = rest[np.argsort(row[rest] * len(kinds) + index[rest], kind="stable")]  # by row, then word, then place
                first = np.flatnonzero(np.concatenate([[True], (row[rest[1:]] != row[rest[:-1]]) | (index[rest[1:]] != index[rest[:-1]])])) if len(rest) else rest
                counts = np.diff(np.append(first, len(rest)))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[rest[first]], minlength=rows))])
                inside = rest - (np.cumsum(many) - many)[row[rest]]
                rare = pa.StructArray.from_arrays([kinds.take(pa.array(index[rest[first]])), pa.array(counts, pa.int32()), packed_rows(inside.astype(PLACE), counts)], fields=list(rare_type.value_type))
                numbers_ = (np.arange(key, key + rows), many + 1, n_known.astype(np.int64) + (end_n > 0), base + math.log10(end_n + 1), emit)
                key += rows
                columns = [pa.array(x, t) for x, t in zip(numbers_, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [columns[0], batch.column("id"), batch.column("held_out"), *columns[1:], packed_rows(units.astype(PLACE)[index], many), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)],
                    ["key", "id", "held_out", "n_tokens", "n_known", "base", "emit", "units", "rare"],
                )

    schema = f"key long, id {docs.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, emit double, units binary, rare array<struct<word: binary, n: int, places: binary>>"
    return docs.mapInArrow(run, schema)


CELLS = {"unit": "<u4", "after": "u1", "other": "<u4", "n": "<u2"}
#: The greatest count of one cell; a greater one is several cells, which readers add up.
MOST = 2**16 - 1
#: A row of units that move in the same rounds: how many cells each has behind and before it, and those cells.
SIDES = {"unit": "<u4", "behind": "<u4", "before": "<u4", "other_behind": "<u4", "n_behind": "<u2", "other_before": "<u4", "n_before": "<u2"}
#: Halves of the units; the rounds go through them, both sides of each.
HALVES = 6


def _cut(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    if cells["n"].max() > MOST:
        times = -(-cells["n"] // MOST)
        last = np.cumsum(times) - 1
        cut = {k: np.repeat(x, times) for k, x in cells.items()}
        cut["n"][:] = MOST
        cut["n"][last] = cells["n"] - (times - 1) * MOST
        return cut
    return cells


def _packed(part: int, cells: dict[str, np.ndarray]) -> pa.RecordBatch:
    cells = _cut(cells)
    columns = [pa.array([part], pa.int32()), *(pa.array([cells[k].astype(t).tobytes()], pa.binary()) for k, t in CELLS.items())]
    return pa.RecordBatch.from_arrays(columns, ["part", *CELLS])


def _by_half(part: int, cells: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A part's cells, which are in order of unit, a row for the units that are on the same side of each half."""
    cells = _cut(cells)
    first = np.concatenate([[True], cells["unit"][1:] != cells["unit"][:-1]])
    units, row = cells["unit"][first].astype(np.int64), np.cumsum(first) - 1
    half = np.where(units == 0, 2**HALVES, (units * 2654435761 >> 3) % 2**HALVES)  # the end never moves
    rows = np.bincount(half, minlength=2**HALVES + 1)
    held = np.flatnonzero(rows)
    order = np.argsort(half, kind="stable")
    out = {"unit": packed_rows(units[order].astype(SIDES["unit"]), rows[held])}
    for side, name in ((1, "behind"), (0, "before")):
        some = cells["after"] == side
        of = row[some]
        out[name] = packed_rows(np.bincount(of, minlength=len(units))[order].astype(SIDES[name]), rows[held])
        of = half[of].astype(np.uint8)
        moved_, many = np.argsort(of, kind="stable"), np.bincount(of, minlength=2**HALVES + 1)[held]
        for k in ("other", "n"):
            out[f"{k}_{name}"] = packed_rows(cells[k][some][moved_].astype(SIDES[f"{k}_{name}"]), many)
    columns = [pa.array(np.full(len(held), part), pa.int32()), pa.array(held, pa.int32()), *(out[k] for k in SIDES)]
    return pa.RecordBatch.from_arrays(columns, ["part", "half", *SIDES])


def contexts(units: DataFrame, n_units: int, tokens: int, model: Model, by_half: bool = False) -> DataFrame:
    """The table of neighbours: (part, unit, after, other, n), a row a part, its columns packed
    numbers in order of unit, side and other. ``after`` is 1 where ``other``
    stands behind the unit, else 0. With ``by_half`` a part is (part, half, ``SIDES``) instead, in rows of
    units that move in the same rounds, so that a pass reads the rows and the sides that it needs.

    A part has the units of one remainder. Parts grow in number with the corpus, so that
    a task holds its share of the pairs, and of a very frequent unit no
    more than every other unit once on each side.
    """
    parts = max(8, min(20_000, -(-2 * tokens // model.part_pairs)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, end = [], 0, bytes(4)

        def rows() -> Iterator[pa.RecordBatch]:
            u = np.frombuffer(end + end.join(held) + end, np.uint32).astype(np.int64)
            key, n = np.unique(u[:-1] * n_units + u[1:], return_counts=True)
            left, right = key // n_units, key % n_units
            for after, unit, other in ((1, left, right), (0, right, left)):
                order = np.argsort((unit % parts).astype(np.uint16), kind="stable")
                unit, other, many = unit[order], other[order], n[order]
                cuts = np.searchsorted(unit % parts, np.arange(parts + 1))
                for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                    at = slice(cuts[k], cuts[k + 1])
                    yield _packed(int(k), {"unit": unit[at], "after": np.full(cuts[k + 1] - cuts[k], after), "other": other[at], "n": many[at]})
            held.clear()

        for batch in batches:
            for raw in batch.column("units").to_pylist():
                held.append(raw)
                size += len(raw) // 4 + 1
                if size > model.part_pairs:
                    yield from rows()
                    size = 0
        if held:
            yield from rows()

    def summed(some: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        unit, after, other, n = (np.concatenate([x[k] for x in some]).astype(np.int64) for k in CELLS)
        key = (unit * 2 + after) * n_units + other
        if 2 * n_units**2 < 2**63 // (MOST + 1) and n.max() <= MOST:  # numbers that carry their count are sorted faster than an order of them
            key = np.sort(key * (MOST + 1) + n)
            key, n = key // (MOST + 1), key % (MOST + 1)
        else:
            order = np.argsort(key)
            key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, other = np.divmod(key[first], n_units)
        return {"unit": key // 2, "after": key % 2, "other": other, "n": np.add.reduceat(n, first)}

    out = _by_half if by_half else _packed

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, some, size = None, [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                at = batch.column("part")[k].as_py()
                if at != part and some:
                    yield out(part, summed(some))
                    some, size = [], 0
                part = at
                some.append({c: np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in CELLS.items()})
                size += len(some[-1]["unit"])
                if size > 2 * model.part_pairs:
                    some = [_cut(summed(some))]
                    size = len(some[0]["unit"])
        if some:
            yield out(part, summed(some))

    schema = "part int, unit binary, after binary, other binary, n binary"
    dealt = units.mapInArrow(counted, schema).repartition(parts, "part").sortWithinPartitions("part")
    if by_half:
        schema = f"part int, half int, {', '.join(f'{k} binary' for k in SIDES)}"
    return stored(dealt.mapInArrow(merged, schema), "contexts", compression="zstd")


def _sides(batches: Iterator[pa.RecordBatch], c: int) -> Iterator[dict[str, np.ndarray]]:
    """The packed columns of some rows at a time, as many as tasks should hold with ``c`` numbers a unit."""
    for whole in batches:
        names = whole.schema.names
        size = sum(sizes(whole.column(k)) * (c if k == "unit" else 1) for k in names)
        for batch in slices(whole, size):
            yield {k: numbers(batch.column(k), SIDES[k])[0] for k in names}


def class_pairs(table: DataFrame, classes: np.ndarray, c: int) -> np.ndarray:
    """Transitions of the classes over the table of neighbours; tasks send sums."""

    small = classes.astype("u1" if c <= 256 else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(c * c)
        for x in _sides(batches, 1):
            total += np.bincount(np.repeat(small[x["unit"]] * np.int64(c), x["behind"]) + small[x["other_behind"]], x["n_behind"], c * c)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    out = np.zeros(c * c)
    pairs = table.select("unit", "behind", "other_behind", "n_behind")  # each pair stands once behind a unit
    for r in pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # c * c rows at most
        out[r.cell] = r.n
    return out.reshape(c, c)


def moved(table: DataFrame, classes: np.ndarray, n: np.ndarray, turn: int) -> np.ndarray:
    """The classes after a round: half of the units, another half each turn, take their best."""
    c = len(n)
    small = classes.astype("u1" if c <= 256 else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = small_steps(n)
        for x in _sides(batches, c):
            unit, of = x["unit"], np.arange(len(x["unit"]))
            right, left = (np.bincount(np.repeat(of * c, x[k]) + small[x[f"other_{k}"]], x[f"n_{k}"], len(unit) * c).reshape(-1, c) for k in ("behind", "before"))
            self_ = np.flatnonzero(np.repeat(unit, x["behind"]) == x["other_behind"])
            twice = np.bincount(np.repeat(of, x["behind"])[self_], x["n_behind"][self_], len(unit))
            order = np.argsort(x["behind"].astype(np.int64) + x["before"], kind="stable")  # units of few cells have a quicker way
            for a in range(0, len(unit), 512):
                some = order[a : a + 512]
                own = small[unit[some]].astype(np.int64)
                best = best_classes(left[some], right[some], twice[some], own, n, steps)
                at = np.flatnonzero(best != own)
                yield pa.RecordBatch.from_arrays([pa.array(unit[some[at]].astype(np.int64)), pa.array(best[at].astype(np.int32))], ["unit", "class"])

    side = F.shiftright("half", turn // 2 % HALVES)
    table = table.where((F.col("half") < 2**HALVES) & ((side + turn) % 2 == 0)).select(*SIDES)
    out = classes.copy()
    got = table.mapInArrow(run, "unit long, class int").toArrow()  # one row a moved unit at most
    out[got.column("unit").to_numpy()] = got.column("class").to_numpy()
    return out


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def transitions(after: np.ndarray, classes: np.ndarray, c: int) -> np.ndarray:
    out = np.zeros((c, c))
    np.add.at(out, classes, after)
    return out


def likelihood(n: np.ndarray) -> float:
    return float(_h(n).sum() - _h(n.sum(0)).sum() - _h(n.sum(1)).sum())


def small_steps(n: np.ndarray, most: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """What 1, 2, ... more of a transition add, by (how many, class beside the unit, class of
    the unit): of the classes behind the unit, and of those before it."""
    add = _h(n + np.arange(1, most + 1)[:, None, None]) - _h(n)
    k = np.arange(len(n))
    add[:, k, k] = 0
    return np.ascontiguousarray(add.transpose(0, 2, 1)), add


def best_classes(before: np.ndarray, after: np.ndarray, twice: np.ndarray, own: np.ndarray, n: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The class of each of some units that raises the likelihood most, all else held.
    ``steps`` are ``small_steps`` of ``n``.

    ``before`` and ``after`` have a row a unit: how often each class stands before and behind it;
    ``twice`` how often it stands behind itself, ``own`` its class; ``n`` are the transitions.
    """
    rows, c = np.arange(len(own)), len(n)
    right, left = after.copy(), before.copy()
    right[rows, own] -= twice
    left[rows, own] -= twice
    gain = np.zeros((len(own), c))
    for mine, others, table, more in ((right, left, n, steps[0]), (left, right, n.T, steps[1])):
        # small counts of other classes, most of all cells: what they add is looked up
        quick = (mine > 0) & (mine <= len(more))
        quick[rows, own] = False
        unit, k = np.nonzero(quick)
        m, x = mine[unit, k], table[own[unit], k]
        if len(unit) >= 8 * len(own):
            for k_, step in enumerate(more, 1):
                some = quick & (mine == k_)
                if some.any():
                    gain += some @ step
        elif len(unit):  # few cells: rows of the table are added up, without a product over all cells
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            gain[unit[first]] += np.add.reduceat(more[m.astype(np.int64) - 1, k], first, axis=0)
        off = 2 * _h(x) - _h(x - m) - _h(x + m)  # the own class is without the unit
        gain[rows, own] += np.bincount(unit, off, len(own))
        unit, k = np.nonzero((mine > 0) & ~quick)  # only these cells change what their row holds
        if not len(unit):
            continue
        many = mine[unit, k][:, None]
        rest = table[:, k].T.copy()  # by class of the unit, without the unit
        rest[np.arange(len(unit)), own[unit]] -= many[:, 0]
        same = k == own[unit]
        rest[same] -= others[unit[same]]
        rest[np.flatnonzero(same), k[same]] -= twice[unit[same]]
        without = _h(table)[:, k].T  # by class of the unit, with it
        at = (np.arange(len(unit)), own[unit])
        without[at] = _h(rest[at])
        without[same] = _h(rest[same])
        add = _h(rest + many) - without
        add[np.arange(len(unit)), k] = 0  # the diagonal is below
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        gain[unit[first]] += np.add.reduceat(add, first, axis=0)
    both = right + left + twice[:, None]
    unit, k = np.nonzero(both)  # elsewhere the diagonal stays as it is
    rest = np.diag(n)[k] - np.where(k == own[unit], both[unit, k], 0)
    gain[unit, k] += _h(rest + both[unit, k]) - _h(rest)
    for total, mine in ((n.sum(1), right), (n.sum(0), left)):
        size = mine.sum(1) + twice
        sizes, at = np.unique(size, return_inverse=True)
        add = (_h(total + sizes[:, None]) - _h(total))[at]
        add[rows, own] = _h(total[own]) - _h(total[own] - size)  # the own class is without the unit
        gain -= add
    gain[:, 0] = -np.inf  # the end's class is its own
    best = gain.argmax(1)
    return np.where(gain[rows, best] > gain[rows, own] + 1e-6, best, own)


def exchange(before: np.ndarray, after: np.ndarray, twice: np.ndarray, classes: np.ndarray, movable: np.ndarray, c: int) -> np.ndarray:
    """``classes`` with the best class of each movable unit; the arrays have all units."""
    out, n = classes.copy(), transitions(after, classes, c)
    out[movable] = best_classes(before[movable], after[movable], twice[movable], classes[movable], n, small_steps(n))
    return out


def cluster(table: DataFrame, n_units: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class transitions) of the best round."""
    k = np.arange(n_units)
    classes = np.where(k == 0, 0, 1 + k % (model.classes - 1))
    best, idle = None, 0
    for turn in range(model.rounds + 1):
        n = class_pairs(table, classes, model.classes)
        value = likelihood(n)
        idle = 0 if best is None or value > best[0] + 1e-4 * abs(best[0]) else idle + 1
        if best is None or value > best[0]:
            best = (value, classes, n)
        if turn == model.rounds or idle == 2:  # neither half gains any more
            break
        classes = moved(table, classes, n, turn)
    return best[1], best[2]


def numbers(column: pa.Array, kind: str | np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers packed in a binary column, one row after another; how many each row has)."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, cuts, data = column.buffers()
    cuts = np.frombuffer(cuts, "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = data.slice(int(cuts[0]), int(cuts[-1] - cuts[0])) if cuts[-1] > cuts[0] else b""
    return np.frombuffer(raw, kind), np.diff(cuts) // np.dtype(kind).itemsize


def packed_rows(values: np.ndarray, many: np.ndarray) -> pa.Array:
    """A binary column whose rows hold the next ``many`` of ``values``."""
    cuts = np.concatenate([[0], np.cumsum(many * values.dtype.itemsize)]).astype("<i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(values.tobytes())])


def paths_of(tokens: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows' tokens one after another with an end, 0, before each row and behind the last; where each row's end stands)."""
    first = np.concatenate([[0], np.cumsum(many + 1)])
    at = np.zeros(first[-1] + 1, np.int64)
    inside = np.ones(len(at), bool)
    inside[first] = False
    at[inside] = tokens
    return at, first


def listed(column: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the structs in a column of lists, where their places are in ``paths_of``'s array, how many places each has)."""
    flat = column.flatten()
    places, many = numbers(flat.field("places"), PLACE)
    row = np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets)))
    return flat, places.astype(np.int64) + 1 + np.repeat(first[row], many), many


def beside_rare(rows: DataFrame, classes: np.ndarray, model: Model) -> DataFrame:
    """(word, cells, n) of each rare word of ``encoded`` rows, a row a task and flush: packed
    counts of the classes before it (cells from 0), behind it (from ``model.classes``) and,
    in the last cell, of itself behind itself."""
    c = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            words = pa.concat_arrays([x for x, _, _ in held]).dictionary_encode()
            number, shift, keys = words.indices.to_numpy().astype(np.int64), 0, []
            for some, of, cell in held:
                keys.append(number[shift + of] * (2 * c + 1) + cell)
                shift += len(some)
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            held.clear()
            many = np.bincount(key // (2 * c + 1), minlength=len(words.dictionary))
            return pa.RecordBatch.from_arrays([words.dictionary, packed_rows((key % (2 * c + 1)).astype(CELL), many), packed_rows(n.astype("<i8"), many)], ["word", "cells", "n"])

        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                at, first = paths_of(*numbers(batch.column("units"), PLACE))
                at = classes[at].astype(np.int64)
                flat, k, many = listed(batch.column("rare"), first)
                of = np.repeat(np.arange(len(flat)), many)
                again = (k[1:] - k[:-1] == 1) & (of[1:] == of[:-1])
                cell = np.concatenate([at[k - 1], c + at[k + 1], np.full(again.sum(), 2 * c)])
                held.append((flat.field("word"), np.concatenate([of, of, of[1:][again]]), cell))
                size += len(cell)
                if size > 4 * model.flush:
                    yield out()
                    size = 0
        if held:
            yield out()

    return rows.select("units", "rare").mapInArrow(run, "word binary, cells binary, n binary")


def rare_words(rows: DataFrame, classes: np.ndarray, n: np.ndarray, own: int, model: Model) -> DataFrame:
    """(word, n, own, class) of every rare word of ``encoded`` training rows, written: its count, the class
    of its ending and the class that raises the likelihood most.

    Words go one small block after another, and a block sees what the task's blocks before it brought
    to each class, times the number of tasks, as all fill the classes at the same pace: else all words would
    flock to the emptiest class. Where words came from is not taken off. The order is by hash of the word, so reruns agree.
    """
    c = model.classes
    parts = max(8, min(20_000, -(-int(n.sum()) // (4 * model.part_pairs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, held = n.copy(), 4, None
        for whole in chain(batches, [None]):  # rows of a word stand one after another
            here = pa.concat_batches([x for x in (held, whole) if x is not None]) if held or whole else None
            if not here:
                continue
            word = here.column("word")
            first = np.flatnonzero(np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]))
            cuts, a = np.append(first, len(word)), 0
            ready = len(first) - (whole is not None)  # the last word may go on in the next batch
            while a < ready and (whole is None or a + block <= ready):
                some = cuts[a : min(a + block, ready) + 1]
                batch, words = here.slice(some[0], some[-1] - some[0]), word.take(pa.array(some[:-1]))
                a, block = a + block, min(512, 2 * block)
                (cells, many), (times, _) = (numbers(batch.column(k), t) for k, t in (("cells", CELL), ("n", "<i8")))
                row = np.repeat(np.repeat(np.arange(len(words)), np.diff(some)), many)
                beside = np.bincount(row * (2 * c + 1) + cells, times, len(words) * (2 * c + 1)).reshape(len(words), -1)
                before, after, twice = beside[:, :c], beside[:, c : 2 * c], beside[:, 2 * c]
                start = classes[ending_units(words, own, model)].astype(np.int64)
                best = best_classes(before, after, twice, start, now, small_steps(now))
                move = best != start
                to = np.eye(c)[best[move]]
                # a word behind itself arrives with both ends
                before_, after_ = before[move] - twice[move, None] * np.eye(c)[start[move]], after[move] - twice[move, None] * np.eye(c)[start[move]]
                now = now + parts * (before_.T @ to + to.T @ after_ + np.diag(to.T @ twice[move]))
                yield pa.RecordBatch.from_arrays([words, pa.array(before.sum(1).astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(best.astype(np.int32))], ["word", "n", "own", "class"])
            held = here.slice(cuts[min(a, ready)])

    by_word = beside_rare(rows, classes, model).repartition(parts, "word").sortWithinPartitions(F.xxhash64("word"), "word")
    return stored(by_word.mapInArrow(run, "word binary, n long, own int, class int"), "rare")


def _paths(batch: pa.RecordBatch, exchanged: bool, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``paths_of`` rows of classes, and the places of unseen words; of
    ``moves``, those with a class are rare words that left their ending's, the others unseen."""
    at, first = paths_of(*numbers(batch.column("seq"), kind))
    flat, k, many = listed(batch.column("moves"), first)
    to = np.repeat(flat.field("class").fill_null(-1).to_numpy(zero_copy_only=False), many)
    if exchanged:
        at[k[to >= 0]] = to[to >= 0]
    return at, first, k[to < 0]


def transitions_again(rows: DataFrame, c: int, kind: np.dtype) -> np.ndarray:
    """Transitions of rows whose rare words have the classes they were exchanged to; tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(c * c, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                at, _, _ = _paths(batch.slice(a, 512), True, kind)
                total += np.bincount(at[:-1] * c + at[1:], minlength=c * c)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(c * c)
    for r in rows.select("seq", "moves").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # c * c rows at most
        out[r.cell] = r.n
    return out.reshape(c, c)


def score_corpus(docs: DataFrame, model: Model = Model(), text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens,
    base_score and score, both log10 probabilities of the whole text and its end.

    Learns from the rows that are not held out; held out are those whose crc32 of
    the id as text leaves 2 when divided by 7, and never a row without id. A null
    or empty text is its end alone. Repeated rows count and are scored each. With
    nothing to learn from, base_score is 0 for each token. Other columns of the
    input play no part.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), held_out(F.col(id)).alias("held_out"))
    vocabulary = stored(word_counts(rows.where("not held_out"), model), "vocabulary")
    of = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("two"), F.max(F.when(F.col("word") == END, F.col("n"))).alias("ends")).first()
    n, v, ends = of.n or 0, of.v or 0, of.ends or 0
    discount = min(0.9, max(0.1, of.once / (of.once + 2 * of.two))) if of.once else 0.5
    top = frequent_words(vocabulary, model.lookup)
    discard(vocabulary)
    table = stored(encoded(rows, top, discount, model, ends), "encoded", compression="zstd")
    own, n_units, c = len(top[0]), 1 + len(top[0]) + model.endings, model.classes
    neighbours = contexts(table.where("not held_out").select("units"), n_units, n, model, by_half=True)
    classes, counts = cluster(neighbours, n_units, model)
    discard(neighbours)
    kind = np.dtype("u1" if c <= 256 else "<u2")
    classes = classes.astype(kind)
    rare = rare_words(table.where("not held_out"), classes, counts, own, model)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = [classes[np.frombuffer(raw.as_py(), np.uint32)].tobytes() for raw in batch.column("units")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEPT), pa.array(seq, pa.binary())], [*KEPT, "seq"])

    paths = table.drop("rare").mapInArrow(passed, f"key long, id {docs.schema[id].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, emit double, seq binary")
    found = table.select("key", F.explode("rare").alias("r")).select("key", "r.word", F.col("r.n").alias("times"), "r.places").join(rare, "word", "left")
    sums = found.groupBy("key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times") * F.log10(F.col("n") - discount)).otherwise(0)).alias("rare_emit"),
        F.collect_list(F.when(F.col("n").isNull() | (F.col("own") != F.col("class")), F.struct("places", "class"))).alias("moves"),
    )
    none = F.array().cast("array<struct<places: binary, class: int>>")
    both = paths.join(sums, "key", "left").fillna(0, ["rare_known", "rare_base", "rare_emit"])
    both = both.select("id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).cast("long").alias("n_known"), (F.col("base") + F.col("rare_base")).alias("base"), (F.col("emit") + F.col("rare_emit")).alias("emit"), "seq", F.coalesce("moves", none).alias("moves"))
    both = stored(both, "paths", compression="zstd")
    discard(table)
    again = transitions_again(both.where("not held_out"), c, kind)
    exchanged = likelihood(again) >= likelihood(counts)
    counts = again if exchanged else counts

    size = counts.sum(0)  # tokens of each class
    share = size / size.sum() if size.sum() else np.full(c, 1 / c)
    share = np.maximum(share, 1e-12)
    log_t = np.log10((counts + model.prior * share) / (counts.sum(1, keepdims=True) + model.prior))
    log_size = np.log10(np.maximum(size, 1.0))
    # distinct words of each class: their discounts are its unseen words' mass
    kinds = np.bincount(classes[1 : 1 + own], minlength=c).astype(float)
    for r in rare.groupBy((F.col("class") if exchanged else F.col("own")).alias("class")).count().collect():  # a row a class
        kinds[r["class"]] += r["count"]
    discard(rare)
    unseen = np.log10(discount * np.maximum(kinds, 1.0))

    log_size[0] = 0.0  # the end is the only word of its class
    step = log_t - log_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                at, first, new = _paths(batch, exchanged, kind)
                value = step[at[:-1], at[1:]]
                value[new - 1] += unseen[at[new]]
                out = np.add.reduceat(value, first[:-1]) + batch.column("emit").to_numpy()
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in SCORED), pa.array(out, pa.float64())], [*SCORED, "score"])

    scored = both.mapInArrow(run, f"id {docs.schema[id].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)
    return scored.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def perplexity(scores: DataFrame, score: str = "score") -> DataFrame:
    """Perplexity a token of the training and the held-out rows."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens")).alias("perplexity"))
