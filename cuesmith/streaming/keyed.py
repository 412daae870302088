"""Keyed streams with typed state and timers: parts that complete once, and sessions of tokens
by the pause between one token's end and the next one's start."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuesmith.streaming.stream import PART_SCHEMA

#: The state store that typed state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SESSION_SCHEMA = "user_id long, first timestamp, last timestamp, n long"


def _timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The key's only timer."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(at)


class Parts(StatefulProcessor):
    """``seen``: the chunks of a part that are in; ``told``: that its row was given, which
    is forgotten ``timeout_ms`` later."""

    def __init__(self, size: int, timeout_ms: int):
        self.size, self.timeout_ms = size, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "chunk_index long", "here boolean")
        self.told = handle.getValueState("told", "complete boolean", self.timeout_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        media, part = key
        expected = None
        for row in rows:
            expected = min(self.size, row["chunk_count"] - part * self.size)
            if not self.told.exists():
                self.seen.updateValue((row["chunk_index"],), (True,))
        if self.told.exists():
            return
        chunks = sum(1 for _ in self.seen.keys())
        if chunks >= expected:
            self.told.update((True,))
            self.seen.clear()
            _timer(self.handle, None)
            yield Row(media_id=media, part=part, chunks=chunks, complete=True)
        else:
            _timer(self.handle, timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        chunks = sum(1 for _ in self.seen.keys())
        self.seen.clear()
        if chunks:
            yield Row(media_id=key[0], part=key[1], chunks=chunks, complete=False)


def complete_parts(chunks: DataFrame, size: int = 10, timeout_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """``stream.complete_parts`` on typed state: a chunk that comes adds one entry to a map and
    rewrites nothing else, and what is remembered of a part that was told goes by itself."""
    keyed = chunks.withColumn("part", F.floor(F.col("chunk_index") / size).cast("long"))
    return keyed.groupBy("media_id", "part").transformWithState(Parts(size, timeout_ms), PART_SCHEMA, "Append", "ProcessingTime")


class TokenSessions(StatefulProcessor):
    """``waiting``: tokens that the watermark has not reached; ``open``: the session that
    the last settled token belongs to. Times are microseconds."""

    def __init__(self, pause: int):
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start long, id long", "stop long")
        self.open = handle.getValueState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        soonest = None
        for row in rows:
            if row["start_us"] >= mark:
                self.waiting.updateValue((row["start_us"], row["id"]), (row["stop_us"],))
                soonest = row["start_us"] if soonest is None else min(soonest, row["start_us"])
        if soonest is not None:
            timers = [t for t in self.handle.listTimers()]
            _timer(self.handle, min([soonest // 1000 + 1, *timers]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator())
        settled = [w for w in waiting if w[0] < mark]
        session = tuple(self.open.get()) if self.open.exists() else None
        for start, number, stop in settled:
            self.waiting.removeKey((start, number))
            if session and start - session[1] >= self.pause:
                yield self._row(key, session)
                session = None
            session = (session[0], stop, session[2] + 1) if session else (start, stop, 1)
        if session and session[1] + self.pause <= mark:
            yield self._row(key, session)
            session = None
        if session:
            self.open.update(session)
        else:
            self.open.clear()
        later = waiting[len(settled) :]
        due = [w[0] // 1000 + 1 for w in later[:1]] + ([-(-(session[1] + self.pause) // 1000)] if session else [])
        _timer(self.handle, min(due, default=None))

    def _row(self, key, session: tuple[int, int, int]) -> Row:
        return Row(user_id=key[0], first_us=session[0], last_us=session[1], n=session[2])


def token_sessions(tokens: DataFrame, pause_seconds: float, late: str = "5 minutes") -> DataFrame:
    """(user_id, first, last, n) of tokens (user_id, id, start, stop): a session ends where
    the next token starts ``pause_seconds`` or more after the last one's end, tokens
    standing in order of (start, id). That is the rule of the batch pause; a session
    window knows starts only. A session is given once the watermark is past its end and
    the pause; tokens later than ``late`` are left out. State is a key's tokens since
    the watermark and one open session."""
    rows = tokens.withWatermark("start", late).select("user_id", "id", "start", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"))
    found = rows.groupBy("user_id").transformWithState(TokenSessions(round(pause_seconds * 1_000_000)), "user_id long, first_us long, last_us long, n long", "Append", "EventTime")
    return found.select("user_id", F.timestamp_micros("first_us").alias("first"), F.timestamp_micros("last_us").alias("last"), "n")
