"""Subtitle segmentation: one parameter set per profile, one rule per kind."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.functions import text as t
from cuesmith.operators.runs import POSITIONS, STRETCH, Scan, by_blocks, cut_islands, in_order, over_runs, over_streams, renumbered, row_before, scans, sum_before
from cuesmith.operators.tokens import CHUNK, punctuate, repair_durations, repaired, with_transcript
from cuesmith.sources.scratch import written

SUBTITLE = "sub_no long, start double, `end` double, text string"


@dataclass(frozen=True)
class Profile:
    """Limits in characters and seconds (fixed defaults).

    ``sentence_needs_text``: a sentence end cuts only from ``min_chars`` on.
    ``sentence_not_held``: a cut at a sentence end is made however short it is.
    ``max_gap``: no merge into a previous subtitle farther away; None is no limit.
    """

    repair: bool = True
    sentence_needs_text: bool = False
    sentence_not_held: bool = True
    max_chars: int = 42
    min_chars: int = 8
    max_duration: float = 6.5
    min_duration: float = 0.7
    pause: float = 0.65
    short_chars: int = 4
    short_duration: float = 0.5
    merged_chars: int = 52
    merged_duration: float = 7.5
    max_gap: float | None = 1.0


MAIN = Profile()
LEGACY = Profile(repair=False, sentence_needs_text=True, sentence_not_held=False, max_gap=None)


@dataclass(frozen=True)
class GapProfile:
    gap: float = 0.50
    strong_gap: float = 0.85
    punctuation_gap: float = 0.25
    max_chars: int = 28
    min_chars: int = 6
    max_duration: float = 6.0
    min_duration: float = 0.60
    gap_chars: int = 8
    gap_duration: float = 0.80


GAP = GapProfile()
Cue = tuple[float, float, str]


def cuts_here(words: list[str], first: float, end: float, after: float | None, p: Profile) -> tuple[bool, str]:
    """Whether the open subtitle ends with its last word, which ends at ``end``, and its
    text where that was needed; ``after`` is the next token's start, None behind the last."""
    word = words[-1]
    sentence = bool(t.py_ends_sentence(word))
    if end - first < p.min_duration and after is not None and not (sentence and p.sentence_not_held):
        return False, ""
    joined = t.py_join(words)
    if after is None or end - first >= p.max_duration or (sentence and not p.sentence_needs_text):
        return True, joined
    length = len(joined)
    paused = after - end >= p.pause
    return length >= p.max_chars or (length >= p.min_chars and (paused or sentence)) or (length >= int(p.max_chars * 0.75) and bool(t.py_soft(word))), joined


def cut_stream(tokens: Iterable[tuple[str, float, float]], p: Profile) -> Iterator[Cue]:
    """Cues of one ordered group of (text, start, end), each as soon as it is cut.
    The pause is to the next token, blank or not."""
    words: list[str] = []
    first = last = 0.0
    coming = iter(tokens)
    after = next(coming, None)
    while after is not None:
        (word, start, end), after = after, next(coming, None)
        if not word.strip():
            continue
        if not words:
            first = start
        words.append(word)
        last = end
        cut, joined = cuts_here(words, first, last, after and after[1], p)
        if cut:
            if joined:
                yield first, last, joined
            words.clear()
    if words and (joined := t.py_join(words)):
        yield first, last, joined


Token = tuple[str, float, float]


def cut_chain(tokens: list[tuple[str, float, float, float | None]], held: list[Token], p: Profile, known: set[int], final: bool) -> tuple[list[tuple[int, float, float, str]], list[Token] | None]:
    """Cuts of a block's tokens (text, start, end, next start) that begin with the open
    tokens ``held``: (place of the cut, start, end, text), and the tokens left open.

    What follows a cut depends on nothing before it. So at the first cut that is
    ``known`` from another beginning both go on alike: the work stops, and None stands
    for the tokens left open. Behind the last token of all the open ones are a cue.
    """
    out: list[tuple[int, float, float, str]] = []
    held = list(held)
    for k, (word, start, end, after) in enumerate(tokens):
        if not word.strip():
            continue
        held.append((word, start, end))
        cut, joined = cuts_here([h[0] for h in held], held[0][1], end, after, p)
        if cut:
            out.append((k, held[0][1], end, joined))
            held = []
            if k in known:
                return out, None
    if final and held:
        out.append((len(tokens), held[0][1], held[-1][2], t.py_join([h[0] for h in held])))
        held = []
    return out, held


def cut_tokens(texts: list[str], starts: list[float], ends: list[float], p: Profile) -> list[Cue]:
    return list(cut_stream(zip(texts, starts, ends, strict=True), p))


def merge_stream(cues: Iterable[Cue], p: Profile) -> Iterator[Cue]:
    """Short cues go into the one before them; a short first cue stays. Only the
    last cue is held back."""
    before: Cue | None = None
    for cue in cues:
        start, end, words = cue
        if before and (len(words) < p.short_chars or end - start < p.short_duration):
            both = t.py_combine(before[2], words)
            near = p.max_gap is None or start - before[1] <= p.max_gap
            if near and len(both) <= p.merged_chars and end - before[0] <= p.merged_duration:
                before = (before[0], end, both)
                continue
        if before:
            yield before
        before = cue
    if before:
        yield before


def merge_short_cues(cues: list[Cue], p: Profile) -> list[Cue]:
    return list(merge_stream(cues, p))


# Marks that end a cue, and marks that may.
_STRONG = "。！？；.!?;"
_WEAK = "，、,:："


def cut_units(texts: list[str], starts: list[float], ends: list[float], p: GapProfile) -> list[Cue]:
    """Cues of one group of timed units in (start, end) order, without blank ones."""
    cues: list[Cue] = []
    open_at = 0
    for k in range(len(texts)):
        joined = t.py_join_units(texts[open_at : k + 1])
        length, duration = len(joined), max(0.0, ends[k] - starts[open_at])
        gap = max(0.0, starts[k + 1] - ends[k]) if k + 1 < len(texts) else float("inf")
        mark = joined[-1:]
        cut = (
            length >= p.max_chars
            or duration >= p.max_duration
            or (bool(mark) and mark in _STRONG and (length >= 4 or gap >= p.punctuation_gap))
            or (bool(mark) and mark in _WEAK and length >= 6 and gap >= p.punctuation_gap)
            or gap >= p.strong_gap
            or (gap >= p.gap and length >= p.gap_chars and duration >= p.gap_duration)
        )
        if cut:
            if joined:
                start, end = starts[open_at], ends[k]
                cues.append((start, end if end > start else start + p.min_duration, joined))
            open_at = k + 1
    return cues


def fragment_stream(cues: Iterable[Cue], p: GapProfile) -> Iterator[Cue]:
    """A tiny cue is glued to the next, once, when the two stay short enough. One cue is held."""
    coming = iter(cues)
    cue = next(coming, None)
    while cue is not None:
        start, end, words = cue
        after = next(coming, None)
        if after is not None and len(t.py_clean(words)) < p.min_chars and end - start < p.min_duration * 1.5:
            both = t.py_clean(words + after[2])
            if len(t.py_clean(both)) <= p.max_chars + 8:
                yield start, after[1], both
                cue = next(coming, None)
                continue
        yield start, end, t.py_clean(words)
        cue = after


def merge_fragments(cues: list[Cue], p: GapProfile) -> list[Cue]:
    return list(fragment_stream(cues, p))


def monotonic_stream(cues: Iterable[Cue]) -> Iterator[Cue]:
    last = 0.0
    for start, end, words in cues:
        start = max(start, last)
        last = max(end, start + 0.05)
        yield start, last, words


def monotonic_cues(cues: list[Cue]) -> list[Cue]:
    return list(monotonic_stream(cues))


def _columns(cues: list[Cue]) -> dict[str, list]:
    return {"sub_no": list(range(len(cues))), "start": [c[0] for c in cues], "end": [c[1] for c in cues], "text": [c[2] for c in cues]}


def segment(tokens: DataFrame, profile: Profile = MAIN, keys: tuple[str, ...] = ("media_id", "chunk_index"), order: tuple[str, ...] = ("pos",), merge: bool = True, parts: int | None = None) -> DataFrame:
    """Subtitles (keys, sub_no, start, end, text) of each group of tokens; ``parts`` as in ``over_runs``."""
    rows = repair_durations(tokens) if profile.repair else tokens

    def rule(g: dict[str, list]) -> dict[str, list]:
        cues = cut_tokens(g["text"], g["start"], g["end"], profile)
        return _columns(merge_short_cues(cues, profile) if merge else cues)

    return over_runs(rows, keys, order, rule, SUBTITLE, [*keys, *order, "text", "start", "end"], parts=parts)


def segment_said(tokens: DataFrame, transcripts: DataFrame, profile: Profile = MAIN, parts: int | None = None) -> DataFrame:
    """``segment`` of the tokens with their transcript's punctuation, a chunk a group: both rules,
    and the repair between them, in one pass over tokens that are shuffled once."""

    def rule(g: dict[str, list]) -> dict[str, list]:
        texts = punctuate(g["text"], g["_said"][0]) if g["_said"][0] else g["text"]
        starts = repaired(texts, g["start"], g["end"]) if profile.repair else g["start"]
        return _columns(merge_short_cues(cut_tokens(texts, starts, g["end"], profile), profile))

    return over_runs(with_transcript(tokens, transcripts), CHUNK, ("pos",), rule, SUBTITLE, [*CHUNK, "pos", "text", "start", "end", "_said"], parts=parts)


def segment_stream(tokens: DataFrame, profile: Profile = LEGACY, keys: tuple[str, ...] = ("media_id",), order: tuple[str, ...] = ("pos",), parts: int | None = None) -> DataFrame:
    """``segment`` for long groups of a profile without islands: tokens pass one by
    one, and a task holds the open subtitle and the one before it."""
    rows = repair_durations(tokens) if profile.repair else tokens

    def rule(group: Iterator[tuple]) -> Iterator[tuple]:
        for k, cue in enumerate(merge_stream(cut_stream(group, profile), profile)):
            yield k, *cue

    return over_streams(rows, keys, order, rule, SUBTITLE, ["text", "start", "end"], parts)


def merge_short(subtitles: DataFrame, profile: Profile = MAIN, keys: tuple[str, ...] = ("media_id", "chunk_index")) -> DataFrame:
    def rule(g: dict[str, list]) -> dict[str, list]:
        return _columns(merge_short_cues(list(zip(g["start"], g["end"], g["text"], strict=True)), profile))

    return over_runs(subtitles, keys, ("sub_no",), rule, SUBTITLE, [*keys, "sub_no", "start", "end", "text"])


def gap_segment(units: DataFrame, profile: GapProfile = GAP, keys: tuple[str, ...] = ("media_id",), order: tuple[str, ...] = ("pos",), post: bool = True) -> DataFrame:
    """Subtitles of timed units by gaps and punctuation; with ``post`` fragments
    are glued and times made monotonic.

    A strong gap always cuts, so the islands between two of them are cut apart;
    only the finished subtitles are brought back together, and pass one by one.
    """

    def rule(g: dict[str, list]) -> dict[str, list]:
        return _columns(cut_units(g["text"], g["start"], g["end"], profile))

    def finish(group: Iterator[tuple]) -> Iterator[tuple]:
        for k, cue in enumerate(monotonic_stream(fragment_stream(group, profile))):
            yield k, *cue

    rows, by = units.where(t.strip(F.col("text")) != ""), ("start", "end", *order)
    block = by_blocks("start", STRETCH)
    gap = F.col("start") - F.col("_before")
    rows = cut_islands(row_before(rows, keys, by, block, "end", "_before"), keys, by, block, (gap >= profile.strong_gap) & ~F.isnan(gap)).drop("_before")
    parts = over_runs(rows, (*keys, "island"), by, rule, SUBTITLE, [*keys, "island", *order, "text", "start", "end"])
    if post:
        return over_streams(parts, keys, ("island", "sub_no"), finish, SUBTITLE, ["start", "end", "text"])
    return renumbered(written(parts, "cues"), keys, "sub_no").select(*keys, "sub_no", "start", "end", "text")


def islands(tokens: DataFrame, keys: tuple[str, ...] = ("media_id", "chunk_index"), order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``tokens`` with ``island``: the main profile always cuts after a sentence
    end, so the tokens between two of them can be segmented on their own."""
    ends = (t.ends_sentence(F.col("text")) & (t.strip(F.col("text")) != "")).cast("long")
    return sum_before(tokens, keys, order, by_blocks(order[0], POSITIONS if order[0].endswith("pos") else STRETCH), ends, "island")


def segment_long(tokens: DataFrame, profile: Profile = MAIN, keys: tuple[str, ...] = ("media_id",), order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``segment`` for groups too long for one task: cut by island, then merged.

    An island's last token is its last, which the sentence rule would cut at
    anyway, so the parts are those of the whole; the last island ends as the
    group does. Only the finished subtitles, about a tenth of the rows, are
    brought back together to merge short ones.
    """
    if profile.sentence_needs_text or not profile.sentence_not_held:
        raise ValueError("only a profile that cuts at every sentence end has islands")
    parts = segment(islands(tokens, keys, order), profile, (*keys, "island"), order, merge=False)

    def rule(group: Iterator[tuple]) -> Iterator[tuple]:
        for k, cue in enumerate(merge_stream(group, profile)):
            yield k, *cue

    return over_streams(parts, keys, ("island", "sub_no"), rule, SUBTITLE, ["start", "end", "text"])


_CUES = "array<struct<at: int, start: double, `end`: double, text: string>>"
_OPEN = "array<struct<text: string, start: double, `end`: double>>"
_TOKENS = "array<struct<text: string, start: double, `end`: double, after: double>>"


def _arrow(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([pa.field(n, k) for n, k in fields.items()]))


_F, _S = pa.float64(), pa.string()
_ARROW = {"cues": _arrow(at=pa.int32(), start=_F, end=_F, text=_S), "open": _arrow(text=_S, start=_F, end=_F), "tokens": _arrow(text=_S, start=_F, end=_F, after=_F)}


def _cue_rows(cues: list[tuple[int, float, float, str]]) -> list[dict]:
    return [dict(zip(("at", "start", "end", "text"), c, strict=True)) for c in cues]


def _open_rows(held: list[Token]) -> list[dict]:
    return [dict(zip(("text", "start", "end"), h, strict=True)) for h in held]


def segment_blocks(tokens: DataFrame, profile: Profile = LEGACY, keys: tuple[str, ...] = ("media_id",), order: tuple[str, ...] = ("pos",), size: int = POSITIONS) -> DataFrame:
    """``segment`` for long groups of any profile, by speculation.

    The tokens are dealt in blocks of ``size`` along the first order column, a number. Each block is first
    cut as if nothing were open at its start. Then it is cut again from what its
    predecessor left open, only until a cut coincides with one found before: from there
    on both are the same. Where that changes what a block leaves open, which takes
    a block without such a cut, its successor is cut again, and so on until nothing
    changes. Short cues go into earlier ones by islands: one that is not short starts its
    own. No task holds more than a block, and later rounds touch changed blocks only.
    """
    keys = tuple(keys)
    block = by_blocks(order[0], size)
    rows = repair_durations(tokens) if profile.repair else tokens
    rows = scans(rows.select(*keys, *order, "text", "start", "end"), keys, order, block, {"_after": Scan("next", F.struct("start"))})
    rows = rows.withColumns({"block": block, "after": F.col("_after.start"), "final": F.col("_after").isNull()})

    def speculate(g: dict[str, list]) -> dict[str, list]:
        own = list(zip(g["text"], g["start"], g["end"], g["after"], strict=True))
        cues, held = cut_chain(own, [], profile, set(), g["final"][-1])
        told = [dict(zip(("text", "start", "end", "after"), x, strict=True)) for x in own]
        return {"tokens": [told], "cues": [_cue_rows(cues)], "open": [_open_rows(held)], "final": [g["final"][-1]]}

    made = over_runs(rows, (*keys, "block"), order, speculate, f"tokens {_TOKENS}, cues {_CUES}, open {_OPEN}, final boolean", [*keys, "block", *order, "text", "start", "end", "after", "final"], _ARROW)
    blocks = written(made, "blocks")
    by = [*keys, "block"]
    nothing = F.array().cast(_OPEN)
    ends = blocks.select(*by, "cues", "open", nothing.alias("entry"))
    before = F.lag("open").over(in_order(keys, ["block"]))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                own = [(x["text"], x["start"], x["end"], x["after"]) for x in row["tokens"]]
                held = [(x["text"], x["start"], x["end"]) for x in row["entry"]]
                cues, left = cut_chain(own, held, profile, {c["at"] for c in row["cues"]}, row["final"])
                told = _cue_rows(cues)
                if left is None:  # the rest is as it was
                    told += [c for c in row["cues"] if c["at"] > cues[-1][0]]
                    left = row["open"]
                else:
                    left = _open_rows(left)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(k, 1) for c in by] + [pa.array([told], _ARROW["cues"]), pa.array([left], _ARROW["open"])], [*by, "cues", "open"])

    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    while True:
        entries = ends.withColumn("now", F.coalesce(before, nothing))
        changed = entries.where(F.col("now") != F.col("entry")).select(*by, F.col("now").alias("entry"), "cues", "open")
        if changed.isEmpty():
            break
        out = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in by) + f", cues {_CUES}, open {_OPEN}"
        work = blocks.select(*by, "tokens", "final").alias("l").join(changed.alias("r"), same).select(*[f"l.{c}" for c in by], "tokens", "final", "entry", "cues", "open")
        fresh = work.mapInArrow(again, out).select(*by, F.col("cues").alias("_cues"), F.col("open").alias("_open"), F.lit(True).alias("_fresh"))
        joined = entries.alias("l").join(fresh.alias("r"), same, "left")
        pick = lambda new, old: F.when(F.col("_fresh"), F.col(new)).otherwise(F.col(old))
        ends = written(joined.select(*[f"l.{c}" for c in by], pick("_cues", "cues").alias("cues"), pick("_open", "open").alias("open"), F.col("now").alias("entry")), "blocks")
    cues = ends.select(*by, F.explode("cues").alias("c")).select(*by, "c.*").where("text <> ''")
    return merge_long(cues, profile, keys, ("block", "at"), by_blocks("block", 16))


def merge_long(cues: DataFrame, profile: Profile, keys: tuple[str, ...], order: tuple[str, ...], block: Column) -> DataFrame:
    """Short cues into the one before, (keys, sub_no, start, end, text), for groups of any
    length: a cue that is not short is never merged, so it starts an island."""
    short = (F.length("text") < profile.short_chars) | (F.col("end") - F.col("start") < profile.short_duration)

    def rule(g: dict[str, list]) -> dict[str, list]:
        return _columns(merge_short_cues(list(zip(g["start"], g["end"], g["text"], strict=True)), profile))

    rows = cut_islands(cues, keys, order, block, ~short)
    parts = written(over_runs(rows, (*keys, "island"), order, rule, SUBTITLE, [*keys, "island", *order, "start", "end", "text"]), "cues")
    return renumbered(parts, keys, "sub_no").select(*keys, "sub_no", "start", "end", "text")
