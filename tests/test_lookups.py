"""Codes by automaton, places in transcripts, and engines that load once a worker."""

import os
import random
import time
import uuid

import pytest

from cuesmith.operators import backlog, engine, tokens


def test_many_codes_of_one_prefix(spark, monkeypatch):
    x = random.Random(1)
    codes = [f" brand#{k}-{x.randint(0, 9)}" for k in range(10_000)] + [None, " ", "-", "BRAND#7-", "b"]
    folders = [f"Brand#{x.randint(0, 12_000)}-{x.randint(0, 99)}" for _ in range(400)] + ["ß-Brand#77", "", None]
    plain = lambda c: (c or "").strip().upper().replace("-", "")
    want = {}
    for c in codes:
        if plain(c):
            hits = [f for f in folders if f is not None and plain(c) in f.upper().replace("-", "")]
            want[c] = min(hits, key=str.encode) if hits else None
    asked = spark.createDataFrame([(c,) for c in codes], "code string")
    files = spark.createDataFrame([(f, "a.mp4") for f in folders], "folder string, file string").repartition(3)
    for most in (backlog.MOST_BYTES, 200_000):  # one automaton, and several
        monkeypatch.setattr(backlog, "MOST_BYTES", most)
        got = {r.code: r for r in backlog.match_catalog(asked, files).collect()}
        assert {c: got[c].folder for c in want} == want
        assert {got[c].status for c in (None, " ", "-")} == {"invalid"}


def slow_punctuate(texts, transcript):
    out, at = list(texts), 0
    for k, own in enumerate(texts):
        word = own.strip()
        here = transcript.find(word, at) if word else -1
        if here < 0:
            continue
        at = here + len(word)
        after = texts[k + 1].strip() if k + 1 < len(texts) else ""
        there = transcript.find(after, at) if after else -1
        marks = tokens.t.py_punctuation(transcript[at:there]) if there >= 0 else ""
        if marks and not own.endswith(marks):
            out[k] = own + marks
    return out


@pytest.mark.parametrize("small", [0, 10**9])
def test_punctuation_by_places(monkeypatch, small):
    monkeypatch.setattr(tokens, "SMALL_SEARCH", small)
    for seed in range(300):
        x = random.Random(seed)
        words = ["a", "aa", "ab", "b", "你", "好", "你好", "c"]
        said = "".join(x.choice([*words, ",", ". ", "，", " "]) for _ in range(x.randint(0, 60)))
        texts = [x.choice([*words, " a ", "", " ", "zz", "a,"]) for _ in range(x.randint(0, 25))]
        assert tokens.punctuate(texts, said) == slow_punctuate(texts, said)


def test_long_transcripts_with_missing_tokens_take_linear_time():
    x = random.Random(2)
    words = [f"{x.getrandbits(40):x}" for _ in range(90_000)]
    said = ", ".join(words)
    assert len(said) > 1_000_000
    texts = [w if x.random() < 0.5 else f"q{k}" for k, w in enumerate(words)]
    start = time.time()
    out = tokens.punctuate(texts, said)
    assert time.time() - start < 20
    assert sum(a != b for a, b in zip(texts, out, strict=True)) > 10_000


def test_an_engine_loads_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda rows: [(f"{len(rows)} {os.getpid()}", [("w", 0.0, 1.0)]) for _ in rows]

    rows = spark.range(80).selectExpr("id AS media_id", "0L AS chunk_index", "2.0D AS padded_start").repartition(20)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = engine.run_engine(rows, load, 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    workers = {r.transcript.split()[1] for r in got}
    assert len(got) == 80 and len(os.listdir(folder)) == len(workers) <= 8
    assert sum(r.transcript.startswith("4 ") for r in got) >= 40  # batches are filled across Arrow's
    assert {(t.start, t["end"]) for r in got for t in r.tokens} == {(2.0, 3.0)}
