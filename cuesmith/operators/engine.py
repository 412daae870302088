"""The hook for a speech engine: batches of pending chunks through a model that
each worker loads once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

#: (chunk rows) -> one (transcript, tokens) per row, in order; tokens are (text, start, end).
Engine = Callable[[list[dict]], list[tuple[str, list[tuple[str, float, float]]]]]
SCHEMA = "media_id long, chunk_index long, transcript string, tokens array<struct<text: string, start: double, `end`: double>>"


_LOADED: dict[str, Engine] = {}


def loaded(key: str, load: Callable[[], Engine]) -> Engine:
    """The engine of a run, loaded once in a worker however many tasks it takes; an
    earlier run's goes, so a worker holds one."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = load()
    return _LOADED[key]


def run_engine(pending: DataFrame, load: Callable[[], Engine], batch: int = 4, profile: ResourceProfile | None = None) -> DataFrame:
    """``load`` makes the engine, once in each worker; times come back absolute, moved by
    the chunk's ``padded_start``. Chunks go to it by ``batch``, whatever the size of Arrow's
    batches is. A batch that returns another number of results than it got is an
    error. ``profile`` names the resources of the stage, such as GPUs of a task."""
    key = uuid.uuid4().hex

    def heard(asked: list[dict]) -> pd.DataFrame:
        got = loaded(key, load)(asked)
        if len(got) != len(asked):
            raise ValueError(f"the engine returned {len(got)} results for {len(asked)} chunks")
        made = [
            (r["media_id"], r["chunk_index"], said, [{"text": w, "start": s + r["padded_start"], "end": e + r["padded_start"]} for w, s, e in tokens])
            for r, (said, tokens) in zip(asked, got, strict=True)
        ]
        return pd.DataFrame(made, columns=["media_id", "chunk_index", "transcript", "tokens"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[dict] = []
        for rows in batches:
            waiting += rows.to_dict("records")
            while len(waiting) >= batch:
                yield heard(waiting[:batch])
                del waiting[:batch]
        if waiting:
            yield heard(waiting)

    return pending.mapInPandas(run, SCHEMA, profile=profile)
