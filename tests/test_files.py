"""Subtitle files as a data source, and the job from a folder of artifacts to files."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuesmith.jobs import resume
from cuesmith.operators import merge
from cuesmith.sources import files
from cuesmith.sources.subtitle_files import STAGING, parse_body, read_subtitles, register, write_named, write_subtitles

NAMES = ["my film", "影片 1", "a#1", "Ep: 2", "100%", "plain", "a+b", "x%20y"]
SCHEMA = "file string, sub_no long, start double, `end` double, text string"


def entries(spark, names=NAMES, n=40):
    rows = [(m, k, k * 1.5, k * 1.5 + 0.7, f"text {k}\nof {m}") for m in names for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "sub_no")


def test_files_are_named_after_recordings_and_read_again(spark, tmp_path):
    out = str(tmp_path / "out dir%20")
    write_subtitles(entries(spark), out)
    assert sorted(p.name for p in (tmp_path / "out dir%20").iterdir()) == sorted(f"{m}.srt" for m in NAMES)
    manifest = files.read_manifest(spark, out)
    assert {(r.media_id, r.kind) for r in manifest.collect()} == {(m, "final") for m in NAMES}
    back = read_subtitles(spark, out)
    assert sorted(back.collect()) == sorted(entries(spark).collect())
    body = merge.srt_body(entries(spark, ["plain"]).withColumn("sub_no", F.col("sub_no") + 1), ("file",), "sub_no").first()["body"]
    assert (tmp_path / "out dir%20" / "plain.srt").read_text() == body


def test_webvtt_files(spark, tmp_path):
    rows = entries(spark, ["a"], 3).union(spark.createDataFrame([("a", 9, 1.6, 2.0, "  ")], SCHEMA))
    write_subtitles(rows, str(tmp_path / "v"), "vtt")
    want = merge.vtt_body(rows.orderBy("start").withColumn("sub_no", F.rint(F.col("start") * 10).cast("long")), ("file",), "sub_no").first()["body"]
    assert (tmp_path / "v" / "a.vtt").read_text() == want


def test_parsing_is_that_of_bodies(spark):
    t = "00:00:01,000 --> 00:00:02,500"
    bodies = ["", f"1\n{t}\nhello\n", f"1\r\n{t}\r\na\r\nb\r\n\r\n\r\n2\r{t} x\rlast", f"\n\n7\n{t}\n \n\n8\n{t}\n　c　\n", f"1\n{t}", f"1\nno times\nx\n\n2\n {t}\ny", f"{t}\nx\ny\nz", f"1\n{t}\none\n \ntwo"]
    df = spark.createDataFrame([(k, 0, b) for k, b in enumerate(bodies)], "media_id int, chunk_index int, body string")
    want = {}
    for r in files.parse_srt(df).collect():
        want.setdefault(r.media_id, []).append((r.sub_no, r.start, r["end"], r.text))
    assert {k: list(parse_body(b)) for k, b in enumerate(bodies) if list(parse_body(b))} == {k: sorted(v) for k, v in want.items()}


def test_modes(spark, tmp_path):
    out = str(tmp_path / "o")
    write_subtitles(entries(spark, ["a", "b"], 2), out)
    write_subtitles(entries(spark, ["b", "c"], 1), out)  # overwrite: only the files at hand
    assert {r.file: r["count"] for r in read_subtitles(spark, out).groupBy("file").count().collect()} == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(PySparkException):
        write_subtitles(entries(spark, ["c", "d"], 1), out, mode="append")
    write_subtitles(entries(spark, ["d", "sub/e"], 1), out, mode="append")
    assert {r.file for r in read_subtitles(spark, out).collect()} == {"a", "b", "c", "d", "sub/e"}
    write_named(spark.createDataFrame([("t/x y.txt", "body"), ("n.txt", None)], "file string, body string"), out)
    assert (tmp_path / "o" / "t" / "x y.txt").read_text() == "body" and (tmp_path / "o" / "n.txt").read_text() == ""


@pytest.mark.parametrize("bad", ["", "..", "a/../b", "a\0", None])
def test_a_failed_write_leaves_no_file(spark, tmp_path, bad):
    out = tmp_path / "o"
    out.mkdir()
    rows = entries(spark, ["a", "b"], 2).union(spark.createDataFrame([(bad, 0, 0.0, 1.0, "x")], SCHEMA))
    with pytest.raises(PySparkException):
        write_subtitles(rows, str(out))
    assert not any(out.iterdir())


def test_files_in_pieces_are_refused(spark, tmp_path):
    register(spark)
    out = tmp_path / "o"
    out.mkdir()
    for rows in (entries(spark, ["a"]).repartition(4), entries(spark, ["a"], 4).coalesce(1).sort(F.desc("start")), entries(spark, ["a", "b"], 4).coalesce(1).sort("start")):
        with pytest.raises(PySparkException):
            rows.write.format("srt").mode("overwrite").save(str(out))
        assert not any(out.iterdir())


def test_reader_passes_unfinished_files_by_and_deals_files(spark, tmp_path):
    write_subtitles(entries(spark, ["a"], 1), str(tmp_path))
    (tmp_path / f"{STAGING}x").mkdir()
    (tmp_path / f"{STAGING}x" / "b.srt").write_text((tmp_path / "a.srt").read_text())
    assert [r.file for r in read_subtitles(spark, str(tmp_path)).collect()] == ["a"]
    (tmp_path / "none").mkdir()
    assert read_subtitles(spark, str(tmp_path / "none")).count() == 0


# the job


def put(root, media, chunk, words, said=None, at=0.0):
    work = root / f"{media}.srt_work"
    work.mkdir(parents=True, exist_ok=True)
    tokens = [{"text": w, "start": chunk * 60 + at + k / 2, "end": chunk * 60 + at + k / 2 + 0.4} for k, w in enumerate(words.split())]
    (work / f"chunk_{chunk:04d}.tokens.json").write_text(json.dumps(tokens))
    (work / f"chunk_{chunk:04d}.txt").write_text(said or words)


def stamps(out):
    return {str(p.relative_to(out)): p.stat().st_mtime_ns for p in out.rglob("*") if p.is_file() and not str(p.relative_to(out)).startswith("_")}


def changed(before, after):
    return {k for k in after if after[k] != before.get(k)}


def test_odd_names_from_artifacts_to_final_files_twice(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    for m in NAMES:
        for k in range(2):
            put(root, m, k, "one two three four! five six seven")
    for _ in range(2):
        missing = resume.write_final_files(spark, str(root), str(out), part=2)
        assert missing.count() == 0
        first = stamps(out)
        assert {f"{m}.srt" for m in NAMES} | {f"{m}.txt" for m in NAMES} <= set(first)
        for m in NAMES:
            work = {f"{m}.srt_work/{x}" for x in ("chunk_0000.srt", "chunk_0001.srt", "part_0000_0001.srt", "all.tokens.json")}
            assert work <= set(first)
    manifest = {(r.media_id, r.kind) for r in files.read_manifest(spark, str(out)).collect()}
    assert manifest == {(m, k) for m in NAMES for k in ("srt", "part_srt", "all_tokens", "final", "final_txt")}
    assert resume.left(spark, str(root), str(out)).count() == 0
    tokens = json.loads((out / "100%.srt_work" / "all.tokens.json").read_text())
    assert len(tokens) == 14 and [t["start"] for t in tokens] == sorted(t["start"] for t in tokens)


def test_a_corrected_chunk_makes_its_part_and_final_again_and_nothing_else(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    for m in ("a", "b"):
        for k in range(5):
            put(root, m, k, "one two three! four five")
    put(root, "empty", 0, "")
    job = lambda **how: resume.write_final_files(spark, str(root), str(out), part=2, **how)
    assert job().count() == 0
    first = stamps(out)
    assert "a.srt_work/part_0004_0004.srt" in first
    job()
    assert stamps(out) == first
    put(root, "a", 3, "one corrected text!")
    assert {(r.media_id, r.chunk_index) for r in resume.left(spark, str(root), str(out)).where("fresh").collect()} == {("a", 3)}
    job()
    second = stamps(out)
    assert changed(first, second) == {"a.srt", "a.txt", "a.srt_work/all.tokens.json", "a.srt_work/chunk_0003.srt", "a.srt_work/part_0002_0003.srt"}
    assert "corrected" in (out / "a.srt").read_text()
    # a late chunk, an invalid one and one without tokens
    put(root, "b", 5, "late words here.")
    put(root, "b", 6, "x")
    (root / "b.srt_work" / "chunk_0006.tokens.json").write_text("{}")
    (root / "b.srt_work" / "chunk_0007.wav").write_text("w" * 2000)
    assert {(r.media_id, r.chunk_index) for r in job().collect()} == {("b", 6), ("b", 7)}
    third = stamps(out)
    assert changed(second, third) == {"b.srt", "b.txt", "b.srt_work/all.tokens.json", "b.srt_work/chunk_0005.srt", "b.srt_work/part_0004_0005.srt"} | {"b.srt_work/part_0004_0004.srt"} & changed(second, third)
    # a chunk that goes, and a final file that goes
    (root / "a.srt_work" / "chunk_0004.tokens.json").unlink()
    (out / "b.srt").unlink()
    job()
    assert changed(third, stamps(out)) >= {"a.srt", "b.srt"} and "a.srt_work/chunk_0000.srt" not in changed(third, stamps(out))
    fourth = stamps(out)
    job()
    assert stamps(out) == fourth


@pytest.mark.parametrize(("flag", "again"), [("force_wav", set()), ("force_chunks", set()), ("force_srt", {"chunk_0000.srt", "part_0000_0000.srt"}), ("force_parts", {"chunk_0000.srt", "part_0000_0000.srt"}), ("force_asr", {"chunk_0000.srt", "part_0000_0000.srt"})])
def test_flags_make_their_files_again(spark, tmp_path, flag, again):
    root, out = tmp_path / "in", tmp_path / "out"
    put(root, "a", 0, "one two three!")
    resume.write_final_files(spark, str(root), str(out), part=2)
    first = stamps(out)
    resume.write_final_files(spark, str(root), str(out), part=2, flags=[flag])
    got = changed(first, stamps(out))
    assert {f"a.srt_work/{x}" for x in again} <= got if again else not got


def test_changes_by_content(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    for k in range(2):
        put(root, "a b", k, "one two three!")
    resume.write_final_files(spark, str(root), str(out), content=True)
    for p in root.rglob("*.json"):
        os.utime(p, ns=(0, 10**18))
    assert resume.left(spark, str(root), str(out), content=True).count() == 0
    assert resume.left(spark, str(root), str(out)).where("fresh").count() == 2
    work = root / "a b.srt_work"
    times = (work / "chunk_0001.tokens.json").stat()
    body = (work / "chunk_0001.tokens.json").read_text().replace("two", "six")  # as long, and as old
    (work / "chunk_0001.tokens.json").write_text(body)
    os.utime(work / "chunk_0001.tokens.json", ns=(times.st_atime_ns, times.st_mtime_ns))
    assert {r.chunk_index for r in resume.left(spark, str(root), str(out), content=True).where("fresh").collect()} == {1}
