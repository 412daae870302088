"""Aligned tokens: clean-up, repair, order, punctuation, pauses."""

from __future__ import annotations

from array import array
from bisect import bisect_left

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.functions import text as t
from cuesmith.operators.runs import STRETCH, by_blocks, over_runs, sum_before

CHUNK = ("media_id", "chunk_index")


def normalize_items(items: DataFrame, item: str = "item", offset: str = "offset") -> DataFrame:
    """Tokens of aligner items (JSON objects): the first name that is present of
    text/word, start_time/start, end_time/end. Null or blank text, times that are
    no finite numbers and ends not after starts are dropped; times move by ``offset``."""
    fields = F.from_json(F.col(item), "map<string,string>")

    def first(*names: str) -> Column:
        found = F.lit(None).cast("string")
        for n in reversed(names):
            found = F.when(F.map_contains_key(fields, n), fields[n]).otherwise(found)
        return found

    rows = items.withColumns({"text": t.strip(first("text", "word")), "start": first("start_time", "start").try_cast("double"), "end": first("end_time", "end").try_cast("double")})
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = rows.where((F.col("text") != "") & finite(F.col("start")) & finite(F.col("end")) & (F.col("end") > F.col("start")))
    return rows.withColumns({"start": F.col("start") + F.col(offset), "end": F.col("end") + F.col(offset)}).drop(item, offset)


def builtin_tokens(rows: DataFrame) -> DataFrame:
    """Tokens of an engine with its own times: an end of 0 is start + duration."""
    end = F.when(F.col("end") > 0, F.col("end")).otherwise(F.col("start") + F.col("duration"))
    kept = rows.withColumn("end", end).where(F.col("end") > F.col("start"))
    return kept.withColumns({"start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset")}).drop("duration", "offset")


def repair_durations(tokens: DataFrame) -> DataFrame:
    """One or two characters that last over 4 s start half a second each before their end."""
    n = F.length(t.strip(F.col("text")))
    wrong = n.between(1, 2) & (F.col("end") - F.col("start") > 4.0)
    return tokens.withColumn("start", F.when(wrong, F.col("end") - n * 0.5).otherwise(F.col("start")))


def repaired(texts: list[str], starts: list[float], ends: list[float]) -> list[float]:
    """The starts of ``repair_durations`` inside a rule."""
    size = [len(x.strip()) for x in texts]
    return [e - n * 0.5 if 1 <= n <= 2 and e - s > 4.0 else s for n, s, e in zip(size, starts, ends, strict=True)]


def absolute_times(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk-relative times moved by the padded start of their chunk."""
    offsets = chunks.select(*CHUNK, F.col("padded_start").alias("_at"))
    return tokens.join(offsets, list(CHUNK)).withColumns({"start": F.col("start") + F.col("_at"), "end": F.col("end") + F.col("_at")}).drop("_at")


def with_pause(tokens: DataFrame, keys: tuple[str, ...] = CHUNK, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Seconds to the next token, blank ones included; 999 after the last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return tokens.withColumn("pause", F.coalesce(F.lead("start").over(w) - F.col("end"), F.lit(999.0)))


def media_order(tokens: DataFrame) -> DataFrame:
    """All tokens of a recording by (start, end), then chunk and position; ``media_pos``
    numbers them from 0. Stretches of an hour are sorted on their own."""
    return sum_before(tokens, ["media_id"], ["start", "end", "chunk_index", "pos"], by_blocks("start", STRETCH), F.lit(1), "media_pos")


#: Characters to look through, at most, without an index of places: transcript times distinct tokens.
SMALL_SEARCH = 20_000_000


class Places:
    """Where tokens next occur in a transcript.

    A search that gave a place, or none, also answers every later one up to that place, so
    a token looks at each character once. Where transcript and distinct tokens are many, one
    pass of an automaton over the transcript notes all places instead.
    """

    def __init__(self, transcript: str, words: set[str]):
        self.transcript = transcript
        self.known: dict[str, tuple[int, int]] = {}
        self.places: dict[str, array] | None = None
        if len(transcript) * len(words) > SMALL_SEARCH:
            self.places = {w: array("q") for w in words}
            search = ahocorasick.Automaton()
            for w in words:
                search.add_word(w, w)
            search.make_automaton()
            for end, w in search.iter(transcript):
                self.places[w].append(end + 1 - len(w))

    def find(self, word: str, at: int) -> int:
        if self.places is not None:
            own = self.places[word]
            k = bisect_left(own, at)
            return own[k] if k < len(own) else -1
        since, place = self.known.get(word, (0, -2))
        if place == -2 or not (since <= at and (place == -1 or at <= place)):
            place = self.transcript.find(word, at)
            self.known[word] = (at, place)
        return place


def punctuate(texts: list[str], transcript: str) -> list[str]:
    """Each found token takes the marks that the transcript has between it and the next."""
    words = [x.strip() for x in texts]
    places = Places(transcript, {w for w in words if w})
    out, at = list(texts), 0
    for k, (own, word) in enumerate(zip(texts, words, strict=True)):
        here = places.find(word, at) if word else -1
        if here < 0:
            continue
        at = here + len(word)
        after = words[k + 1] if k + 1 < len(words) else ""
        there = places.find(after, at) if after else -1
        marks = t.py_punctuation(transcript[at:there]) if there >= 0 else ""
        if marks and not own.endswith(marks):
            out[k] = own + marks
    return out


def with_transcript(tokens: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``tokens`` with ``_said``, the chunk's transcript on its first token and null on the rest."""
    w = Window.partitionBy(*CHUNK).orderBy("pos")
    rows = tokens.withColumn("_n", F.row_number().over(w))
    said = transcripts.select(*[F.col(c).alias(f"_{c}") for c in CHUNK], F.col("transcript").alias("_said"))
    # equal on the chunk alone, so that the tokens stay where the window has them
    first = (F.col("_n") == 1) & (F.col("media_id") == F.col("_media_id")) & (F.col("chunk_index") == F.col("_chunk_index"))
    return rows.join(said, first, "left").drop(*[f"_{c}" for c in CHUNK])


def restore_punctuation(tokens: DataFrame, transcripts: DataFrame, parts: int | None = None) -> DataFrame:
    """Tokens with the transcript's punctuation; without a transcript as they are.
    ``parts`` as in ``over_runs``.

    The transcript travels once a chunk, on the chunk's first token, and not with
    every token.
    """
    rows = with_transcript(tokens, transcripts)

    def rule(g: dict[str, list]) -> dict[str, list]:
        said = g["_said"][0]
        texts = punctuate(g["text"], said) if said else g["text"]
        return {"pos": g["pos"], "text": texts, "start": g["start"], "end": g["end"]}

    return over_runs(rows, CHUNK, ("pos",), rule, "pos long, text string, start double, `end` double", [*CHUNK, "pos", "text", "start", "end", "_said"], parts=parts)
