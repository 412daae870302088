"""Every query the library registers, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.functions import text as t
from cuesmith.jobs import fixtures as fx
from cuesmith.jobs import oracles as o
from cuesmith.operators import backlog, engine, intervals, merge, plan, segment, tokens, units
from cuesmith.sources import files, subtitle_files, token_table
from cuesmith.sources.scratch import shared_folder
from cuesmith.streaming import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


# Subtitles


@query("subtitles_main", f"{o.MAIN} SELECT media_id, chunk_index, {o.SUBS}")
def _(s, d):
    return segment.segment(fx.tokens(s, d), segment.MAIN)


@query("subtitles_legacy", f"{o.LEGACY} SELECT media_id, chunk_index, {o.SUBS}")
def _(s, d):
    return segment.segment(fx.tokens(s, d), segment.LEGACY)


@query("subtitles_uncut", "WITH " + o.TOKENS + "," + o.cut("tokens", "media_id, chunk_index", True, False, True) + ", subs AS (SELECT media_id, chunk_index, unnest(range(len(out))) AS sub_no, unnest(out) AS c FROM cues) SELECT media_id, chunk_index, " + o.SUBS)
def _(s, d):
    return segment.segment(fx.tokens(s, d), segment.MAIN, merge=False)


_ORDERED = ", ordered AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY \"start\", \"end\", chunk_index, pos) - 1 AS media_pos FROM tokens)"


def _bucketed(rows: DataFrame) -> token_table.TokenTable:
    """``rows`` in a bucketed table of their own."""
    spark = rows.sparkSession
    return token_table.write_tokens(rows, f"tokens_{uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), shared_folder(spark, "tokens"))


@query("subtitles_from_table", f"{o.MAIN} SELECT media_id, chunk_index, {o.SUBS}")
def _(s, d):
    """Tokens from a bucketed table, cut where they lie."""
    table = _bucketed(fx.tokens(s, d))
    return segment.segment(table.tokens(), segment.MAIN, parts=table.buckets)


@query("media_subtitles_legacy", "WITH " + o.TOKENS + _ORDERED + "," + o.cut("ordered", "media_id", False, True, False, "media_pos") + "," + o.merged("media_id", False) + f" SELECT media_id, {o.SUBS}")
def _(s, d):
    return segment.segment_stream(tokens.media_order(fx.tokens(s, d)), segment.LEGACY, ("media_id",), ("media_pos",))


@query("media_subtitles_by_block", "WITH " + o.TOKENS + _ORDERED + "," + o.cut("ordered", "media_id", False, True, False, "media_pos") + "," + o.merged("media_id", False) + f" SELECT media_id, {o.SUBS}")
def _(s, d):
    return segment.segment_blocks(tokens.media_order(fx.tokens(s, d)), segment.LEGACY, ("media_id",), ("media_pos",))


@query("part_subtitles_main", "WITH " + o.TOKENS + ", parts AS (SELECT *, chunk_index // 2 AS part, row_number() OVER (PARTITION BY media_id ORDER BY \"start\", \"end\", chunk_index, pos) - 1 AS media_pos FROM tokens)," + o.cut("parts", "media_id, part", True, False, True, "media_pos") + "," + o.merged("media_id, part", True) + f" SELECT media_id, part, {o.SUBS}")
def _(s, d):
    rows = tokens.media_order(fx.tokens(s, d)).withColumn("part", F.floor(F.col("chunk_index") / 2))
    return segment.segment(rows, segment.MAIN, ("media_id", "part"), ("media_pos",))


_READY = o.DONE.removeprefix(o.TRANSCRIPTS) + """, ready AS (SELECT media_id, chunk_index // 2 AS part FROM transcripts GROUP BY ALL EXCEPT
    SELECT media_id, chunk_index // 2 FROM transcripts t WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.media_id = t.media_id AND d.chunk_index = t.chunk_index))"""


@query("part_subtitles_legacy", "WITH " + o.TOKENS + _READY + ", parts AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY \"start\", \"end\", chunk_index, pos) - 1 AS media_pos FROM (SELECT *, chunk_index // 2 AS part FROM tokens) JOIN ready USING (media_id, part))," + o.cut("parts", "media_id, part", False, True, False, "media_pos") + "," + o.merged("media_id, part", False) + f" SELECT media_id, part, {o.SUBS}")
def _(s, d):
    """Parts of which every chunk is done, cut by the older profile."""
    chunks = fx.chunks(s, d)
    done = chunks.join(backlog.pending_chunks(chunks, fx.manifest(s, d)), ["media_id", "chunk_index"], "left_anti")
    ready = backlog.ready_parts(chunks, done, 2).where("ready").select("media_id", "part")
    rows = tokens.media_order(fx.tokens(s, d)).withColumn("part", F.floor(F.col("chunk_index") / 2)).join(ready, ["media_id", "part"], "left_semi")
    return segment.segment_stream(rows, segment.LEGACY, ("media_id", "part"), ("media_pos",))


@query("media_subtitles_by_island", "WITH " + o.TOKENS + _ORDERED + "," + o.cut("ordered", "media_id", True, False, True, "media_pos") + "," + o.merged("media_id", True) + f" SELECT media_id, {o.SUBS}")
def _(s, d):
    return segment.segment_long(tokens.media_order(fx.tokens(s, d)), segment.MAIN, ("media_id",), ("media_pos",))


@query("merge_short", f"{o.LEGACY}, again AS (SELECT media_id, chunk_index, list(c ORDER BY sub_no) AS out FROM subs GROUP BY ALL), " + o.merged("media_id, chunk_index", True, "again").replace("short AS", "short2 AS").replace("subs AS", "subs2 AS").replace("FROM short)", "FROM short2)") + ' SELECT media_id, chunk_index, sub_no, c.s AS "start", c.e AS "end", c.t AS text FROM subs2')
def _(s, d):
    return segment.merge_short(segment.segment(fx.tokens(s, d), segment.LEGACY), segment.MAIN)


@query("final_subtitles", f'{o.FINAL} SELECT media_id, entry_no, "start", "end", text FROM final')
def _(s, d):
    return merge.final_entries(segment.segment(fx.tokens(s, d), segment.MAIN), 0.5)


@query("final_srt", f"""{o.FINAL} SELECT media_id, string_agg(entry_no || chr(10) || {o.srt_time('"start"')} || ' --> ' || {o.srt_time('"end"')} || chr(10) || text || chr(10), chr(10) ORDER BY entry_no) AS body FROM final GROUP BY media_id""")
def _(s, d):
    return merge.srt_body(merge.final_entries(segment.segment(fx.tokens(s, d), segment.MAIN), 0.5))


@query("final_vtt", f"""{o.FINAL} SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({o.srt_time('"start"', '.')} || ' --> ' || {o.srt_time('"end"', '.')} || chr(10) || text || chr(10), chr(10) ORDER BY entry_no) AS body FROM final GROUP BY media_id""")
def _(s, d):
    return merge.vtt_body(merge.final_entries(segment.segment(fx.tokens(s, d), segment.MAIN), 0.5))


@query("debug_transcripts", f"""{o.FINAL} SELECT media_id, string_agg(printf('[%.3f - %.3f]', "start", "end") || chr(10) || text || chr(10), chr(10) ORDER BY entry_no) AS body FROM final GROUP BY media_id""")
def _(s, d):
    return merge.debug_body(merge.final_entries(segment.segment(fx.tokens(s, d), segment.MAIN), 0.5))


@query("srt_round_trip", f"{o.MAIN} SELECT media_id, chunk_index, sub_no, {o.quantized('c.s')} AS \"start\", {o.quantized('c.e')} AS \"end\", c.t AS text FROM subs WHERE trim(c.t) <> ''")
def _(s, d):
    subs = segment.segment(fx.tokens(s, d), segment.MAIN)
    bodies = merge.srt_body(subs.withColumn("entry_no", F.col("sub_no") + 1), ("media_id", "chunk_index"))
    return files.parse_srt(bodies)


_NAMES = ["my film ", "影片 ", "a#", "Ep: ", "100% "]


@query("subtitle_files", o.FINAL + f""" SELECT {_NAMES}[media_id % 5 + 1] || media_id AS file, 'final' AS kind, entry_no - 1 AS sub_no, {o.quantized('"start"')} AS "start", {o.quantized('"end"')} AS "end", text FROM final""")
def _(s, d):
    """Final subtitles written as files by their recordings' names, listed as artifacts and read again."""
    named = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("media_id") % 5 + 1).cast("int")), "media_id")
    rows = merge.final_entries(segment.segment(fx.tokens(s, d), segment.MAIN), 0.5).withColumn("file", named).withColumnRenamed("entry_no", "sub_no")
    folder = shared_folder(s)
    subtitle_files.write_subtitles(rows, folder)
    kinds = files.read_manifest(s, folder).select(F.col("media_id").alias("file"), "kind")
    return subtitle_files.read_subtitles(s, folder).join(kinds, "file").select("file", "kind", "sub_no", "start", "end", "text")


@query("display_delay", f'{o.MAIN} SELECT media_id, chunk_index, sub_no, c.s AS "start", least(c.e + 0.5::DOUBLE, coalesce(lead(c.s) OVER w, c.e + 0.5::DOUBLE)) AS "end", c.t AS text FROM subs WINDOW w AS (PARTITION BY media_id ORDER BY c.s, c.e, chunk_index, sub_no)')
def _(s, d):
    return merge.display_delay(segment.segment(fx.tokens(s, d), segment.MAIN), 0.5)


@query("merge_summary", f"{o.FINAL} SELECT media_id, count(*) AS entries, count(DISTINCT chunk_index) AS chunks FROM final GROUP BY media_id")
def _(s, d):
    return merge.merge_summary(merge.through_file(segment.segment(fx.tokens(s, d), segment.MAIN)))


_MONOTONIC = """, l AS (SELECT user_id AS media_id, list(struct_pack(n := rn - 1, s := CAST(rn * 500 + event_id % 700 AS DOUBLE) / 1000.0::DOUBLE, e := CAST(rn * 500 + event_id % 900 AS DOUBLE) / 1000.0::DOUBLE) ORDER BY rn) AS items FROM ranked GROUP BY user_id),
f AS (SELECT media_id, list_reduce(items, lambda a, x: struct_pack(last := greatest(x.e, greatest(x.s, a.last) + 0.05::DOUBLE), out := list_append(a.out, struct_pack(n := x.n, s := greatest(x.s, a.last), e := greatest(x.e, greatest(x.s, a.last) + 0.05::DOUBLE)))),
      struct_pack(last := 0.0::DOUBLE, out := []::STRUCT(n BIGINT, s DOUBLE, e DOUBLE)[])).out AS out FROM l)
SELECT media_id, c.n AS sub_no, round(c.s, 6) AS "start", round(c.e, 6) AS "end" FROM (SELECT media_id, unnest(out) AS c FROM f)"""


@query("monotonic", "WITH " + o.RANKED + _MONOTONIC)
def _(s, d):
    rows = fx._ranked(s, d).select(F.col("user_id").alias("media_id"), (F.col("rn") - 1).alias("sub_no"), ((F.col("rn") * 500 + F.col("event_id") % 700).cast("double") / 1000.0).alias("start"), ((F.col("rn") * 500 + F.col("event_id") % 900).cast("double") / 1000.0).alias("end"))
    return merge.monotonic(rows).select("media_id", "sub_no", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("transcripts", f"WITH {o.TRANSCRIPTS} SELECT media_id, string_agg(trim(transcript, ' \t\n\r'), chr(10) ORDER BY chunk_index) AS body FROM transcripts WHERE trim(transcript, ' \t\n\r') <> '' GROUP BY media_id")
def _(s, d):
    return merge.transcript_body(fx.transcripts(s, d))


# Tokens


@query("token_pause", "WITH " + o.TOKENS + ' SELECT media_id, chunk_index, pos, coalesce(lead("start") OVER (PARTITION BY media_id, chunk_index ORDER BY pos) - "end", 999.0::DOUBLE) AS pause FROM tokens')
def _(s, d):
    return tokens.with_pause(fx.tokens(s, d)).select("media_id", "chunk_index", "pos", "pause")


@query("repair_durations", "WITH " + o.TOKENS + """ SELECT media_id, chunk_index, pos, text, CASE WHEN length(trim(text)) BETWEEN 1 AND 2 AND "end" - "start" > 4.0::DOUBLE THEN "end" - 0.5::DOUBLE * length(trim(text)) ELSE "start" END AS "start", "end" FROM tokens""")
def _(s, d):
    return tokens.repair_durations(fx.tokens(s, d))


@query("media_order", "WITH " + o.TOKENS + _ORDERED + " SELECT media_id, chunk_index, pos, media_pos FROM ordered")
def _(s, d):
    return tokens.media_order(fx.tokens(s, d)).select("media_id", "chunk_index", "pos", "media_pos")


_PUNCTUATED = (
    "WITH " + o.BARE + f""", nx AS (SELECT *, lead(text) OVER (PARTITION BY media_id, chunk_index ORDER BY pos) AS nxt FROM tokens),
    l AS (SELECT media_id, chunk_index, any_value(transcript) AS said, list(struct_pack(p := pos, w := text, nxt := nxt, s := "start", e := "end") ORDER BY pos) AS items FROM nx JOIN transcripts USING (media_id, chunk_index) GROUP BY ALL),
    f AS (SELECT media_id, chunk_index, list_reduce(list_transform(items, lambda x: struct_pack(x := x, said := said)), lambda a, y: struct_pack(
            cur := CASE WHEN strpos(substr(y.said, a.cur), y.x.w) > 0 THEN a.cur + strpos(substr(y.said, a.cur), y.x.w) - 1 + length(y.x.w) ELSE a.cur END,
            out := list_append(a.out, struct_pack(p := y.x.p, s := y.x.s, e := y.x.e, w := y.x.w || CASE
              WHEN strpos(substr(y.said, a.cur), y.x.w) > 0 AND y.x.nxt IS NOT NULL AND strpos(substr(y.said, a.cur + strpos(substr(y.said, a.cur), y.x.w) - 1 + length(y.x.w)), y.x.nxt) > 0
              THEN regexp_replace(substr(y.said, a.cur + strpos(substr(y.said, a.cur), y.x.w) - 1 + length(y.x.w), strpos(substr(y.said, a.cur + strpos(substr(y.said, a.cur), y.x.w) - 1 + length(y.x.w)), y.x.nxt) - 1), '{o.KEPT}', '', 'g') ELSE '' END))),
          struct_pack(cur := 1::BIGINT, out := []::STRUCT(p BIGINT, s DOUBLE, e DOUBLE, w VARCHAR)[])).out AS out FROM l)
    SELECT media_id, chunk_index, c.p AS pos, c.w AS text, c.s AS "start", c.e AS "end" FROM (SELECT media_id, chunk_index, unnest(out) AS c FROM f)"""
)


@query("restore_punctuation", _PUNCTUATED)
def _(s, d):
    return tokens.restore_punctuation(fx.bare_tokens(s, d), fx.transcripts(s, d))


@query("punctuation_from_table", _PUNCTUATED)
def _(s, d):
    """Tokens from a bucketed table, punctuated where they lie."""
    table = _bucketed(fx.bare_tokens(s, d))
    return tokens.restore_punctuation(table.tokens(), fx.transcripts(s, d), parts=table.buckets)


@query("subtitles_from_transcripts", _PUNCTUATED.replace("    SELECT media_id, chunk_index, c.p AS pos", ", restored AS (SELECT media_id, chunk_index, c.p AS pos") + ")," + o.cut("restored", "media_id, chunk_index", True, False, True) + "," + o.merged("media_id, chunk_index", True) + f" SELECT media_id, chunk_index, {o.SUBS}")
def _(s, d):
    return segment.segment_said(fx.bare_tokens(s, d), fx.transcripts(s, d), segment.MAIN)


@query("token_json", "WITH " + o.BARE + ' SELECT media_id, chunk_index, count(*) AS n, sum(length(text)) AS chars, round(sum("end" - "start"), 3) AS seconds FROM tokens GROUP BY ALL')
def _(s, d):
    back = files.tokens_of(files.parse_token_json(files.token_json(fx.bare_tokens(s, d))))
    return back.groupBy("media_id", "chunk_index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))


_ITEMS = """WITH r AS (SELECT user_id, event_id, event_type AS w, value AS v, event_id % 6 AS k FROM events)
SELECT user_id AS media_id, event_id AS pos, w AS text, v + 60 AS "start", v + CASE WHEN k = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END + 60 AS "end" FROM r WHERE k IN (0, 1, 5)"""


@query("normalize_items", _ITEMS)
def _(s, d):
    k, w, v = F.col("event_id") % 6, F.col("event_type"), F.col("value")
    item = (
        F.when(k == 0, F.to_json(F.struct(F.concat(F.lit(" "), w, F.lit(" ")).alias("text"), v.alias("start"), (v + 1.0).alias("end"))))
        .when(k == 1, F.to_json(F.struct(w.alias("word"), v.cast("string").alias("start_time"), (v + 0.5).alias("end_time"), F.lit(9).alias("start"))))
        .when(k == 2, F.concat(F.lit('{"text":null,"word":"x","start":0,"end":1}')))
        .when(k == 3, F.to_json(F.struct(w.alias("text"), v.alias("start"), v.alias("end"))))
        .when(k == 4, F.to_json(F.struct(w.alias("text"), F.lit("q").alias("start"), v.alias("end"))))
        .otherwise(F.to_json(F.struct(w.alias("text"), v.alias("start"), (v + 1.0).alias("end_time"))))
    )
    rows = fx._table(s, d, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("pos"), item.alias("item"), F.lit(60.0).alias("offset"))
    return tokens.normalize_items(rows)


@query("builtin_tokens", """WITH r AS (SELECT user_id AS media_id, event_id AS pos, event_type AS text, value AS s, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE value + event_id % 3 - 1 END AS e FROM events), f AS (SELECT *, CASE WHEN e > 0 THEN e ELSE s + 0.5::DOUBLE END AS x FROM r)
SELECT media_id, pos, text, s + 10 AS "start", x + 10 AS "end" FROM f WHERE x > s""")
def _(s, d):
    end = F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("value") + F.col("event_id") % 3 - 1)
    rows = fx._table(s, d, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"), F.col("value").alias("start"), end.alias("end"), F.lit(0.5).alias("duration"), F.lit(10.0).alias("offset"))
    return tokens.builtin_tokens(rows)


@query("join_tokens_text", "WITH " + o.TOKENS + f" SELECT media_id, chunk_index, {o.joined('list(text ORDER BY pos)')} AS text FROM tokens GROUP BY media_id, chunk_index")
def _(s, d):
    words = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return fx.tokens(s, d).groupBy("media_id", "chunk_index").agg(words.alias("words")).select("media_id", "chunk_index", t.join_words(F.col("words")).alias("text"))


# Text functions over documents


@query("normalize_transcript", f"SELECT doc_id, regexp_replace(regexp_replace(text, '{o.SP}+', ' ', 'g'), '^{o.SP}+|{o.SP}+$', '', 'g') AS text FROM documents")
def _(s, d):
    return fx._table(s, d, "documents").select("doc_id", t.normalize_transcript(F.col("text")).alias("text"))


@query("text_flags", f"""SELECT doc_id, regexp_matches(text, '{o.CJK}') AS cjk, regexp_matches(text, '{o.SENTENCE}{o.SP}*$') AS sentence, regexp_matches(text, '{o.SOFT}{o.SP}*$') AS soft, regexp_matches(text, '[^\\s]') AS effective,
    regexp_replace(text, '{o.KEPT}', '', 'g') AS marks FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - page_id, url FROM pages)""")
def _(s, d):
    rows = fx._table(s, d, "documents").select("doc_id", "text").unionByName(fx._table(s, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("url").alias("text")))
    c = F.col("text")
    return rows.select("doc_id", t.is_cjk(c).alias("cjk"), t.ends_sentence(c).alias("sentence"), t.has_soft_punctuation(c).alias("soft"), t.is_effective(c).alias("effective"), t.collect_punctuation(c).alias("marks"))


@query("clean_subtitle_text", f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{o.SP}+', ' ', 'g'), '^{o.SP}+|{o.SP}+$', '', 'g') AS x FROM documents)
SELECT doc_id, regexp_replace(x, '{o.SP}+({o.CLEAN_CLOSES})', '\\1', 'g') AS text, length(regexp_replace(x, '{o.SP}+({o.CLEAN_CLOSES})', '\\1', 'g')) AS visual FROM a""")
def _(s, d):
    c = F.col("text")
    return fx._table(s, d, "documents").select("doc_id", t.clean_subtitle(c).alias("text"), t.visual_length(c).cast("long").alias("visual"))


@query("extract_text", f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE regexp_replace(regexp_replace(text, '{o.SP}+', ' ', 'g'), '^{o.SP}+|{o.SP}+$', '', 'g') END AS text FROM documents")
def _(s, d):
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.to_json(F.struct("text"))).when(k == 1, F.substring(F.to_json(F.array("text")), 2, 1 << 30)).otherwise(F.to_json(F.struct(F.col("text").alias("other"))))
    said = F.when(k == 1, F.regexp_replace(said, r"\]$", "")).otherwise(said)
    return fx._table(s, d, "documents").select("doc_id", t.extract_text(said).alias("text"))


@query("srt_times", f"SELECT event_id, {o.srt_time('value * 7.0005::DOUBLE')} AS srt, {o.srt_time('value * 7.0005::DOUBLE', '.')} AS vtt, {o.quantized('value * 7.0005::DOUBLE')} AS back FROM events")
def _(s, d):
    v = F.col("value") * 7.0005
    return fx._table(s, d, "events").select("event_id", t.srt_time(v).alias("srt"), t.vtt_time(v).alias("vtt"), t.parse_srt_time(t.srt_time(v)).alias("back"))


# Units


_PIECES = rf"""WITH {o.TRANSCRIPTS}, p AS (SELECT media_id, chunk_index, unnest(r) AS piece, unnest(range(len(r))) AS k FROM (SELECT *, regexp_extract_all(transcript, '[A-Za-z0-9'']+|{o.SP.replace('[', '[^', 1)}') AS r FROM transcripts)),
n AS (SELECT *, CASE WHEN regexp_matches(piece, '^[A-Za-z0-9'']+$') THEN regexp_replace(lower(piece), '[^a-z'']', '', 'g') ELSE '' END AS norm FROM p),
u AS (SELECT *, sum(CASE WHEN norm <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, chunk_index ORDER BY k) AS u FROM n)
SELECT media_id, chunk_index, CAST(u - 1 AS BIGINT) AS unit_no, first(piece ORDER BY k) AS display, first(norm ORDER BY k) AS norm, coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE norm = ''), '') AS suffix FROM u WHERE u > 0 GROUP BY media_id, chunk_index, u"""


@query("alignment_units", _PIECES)
def _(s, d):
    return units.alignment_units(fx.transcripts(s, d))


@query("span_to_unit", f"""WITH {o.RANKED}, sp AS (SELECT user_id AS media_id, (rn - 1) // 3 AS unit_no, (rn - 1) % 3 AS span_no, rn * 4 AS s, rn * 4 + event_id % 4 AS e, value AS score, user_id::DOUBLE AS off FROM ranked)
SELECT media_id, unit_no, round(min_by(s, span_no) * 0.02::DOUBLE + any_value(off), 6) AS "start", round(max_by(e, span_no) * 0.02::DOUBLE + any_value(off), 6) AS "end", round(sum(score * greatest(1, e - s)) / sum(greatest(1, e - s)), 6) AS score FROM sp GROUP BY media_id, unit_no""")
def _(s, d):
    got = units.timed_units(fx.spans(s, d))
    return got.select("media_id", "unit_no", *[F.round(c, 6).alias(c) for c in ("start", "end", "score")])


@query("units_tsv", """WITH r AS (SELECT user_id AS media_id, event_id AS pos, value AS v, event_type AS w FROM events) SELECT media_id, pos, printf('%.3f', v) || chr(9) || printf('%.3f', v + 1.0::DOUBLE) || chr(9) || printf('%.4f', v / 8) || chr(9) || w AS line FROM r""")
def _(s, d):
    v = F.col("value")
    return units.units_tsv(fx._table(s, d, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("pos"), v.alias("start"), (v + 1.0).alias("end"), (v / 8).alias("score"), F.col("event_type").alias("text")))


@query("subtitles_gap", "WITH " + o.TOKENS + o.GAP + " SELECT media_id, " + o.SUBS.replace("FROM subs", "FROM gsubs"))
def _(s, d):
    return segment.gap_segment(fx.tokens(s, d).withColumn("pos", F.col("chunk_index") * 100_000 + F.col("pos")), segment.GAP)


# Planning and speech


@query("chunk_counts", "SELECT user_id AS media_id, CAST(ceil(((count(*) + 2) * 3000) / 60000.0::DOUBLE) AS BIGINT) AS chunks FROM events GROUP BY user_id")
def _(s, d):
    return plan.chunk_counts(fx.media(s, d), 60.0).select("media_id", "chunks")


@query("fixed_chunks", f'WITH {o.MEDIA} SELECT media_id, k AS chunk_index, k * 60.0::DOUBLE AS "start", least(k * 60.0::DOUBLE + 60, duration) AS "end" FROM (SELECT media_id, duration, unnest(range(CAST(ceil(duration / 60) AS BIGINT))) AS k FROM media)')
def _(s, d):
    return plan.fixed_chunks(fx.media(s, d), 60.0)


@query("sample_chunks", f"WITH {o.MEDIA} SELECT media_id, k AS chunk_index, k * 480000 AS first, least((k + 1) * 480000, samples) AS last FROM (SELECT media_id, samples, unnest(range((samples + 479999) // 480000)) AS k FROM media) WHERE least((k + 1) * 480000, samples) - k * 480000 >= 4000")
def _(s, d):
    return plan.sample_chunks(fx.media(s, d), 30.0, 16_000)


_VAD = "WITH " + o.SEGMENTS + f""", {o.MEDIA}, l AS (SELECT media_id, list(struct_pack(s := "start", e := "end") ORDER BY seg_no) AS items FROM segments GROUP BY media_id),
v AS (SELECT media_id, unnest(range(len(out))) AS chunk_index, unnest(out) AS c FROM (SELECT media_id, list_reduce(items, lambda a, x: CASE WHEN len(a) > 0 AND x.e - a[len(a)].s <= 20.0::DOUBLE THEN list_append(a[:len(a) - 1], struct_pack(s := a[len(a)].s, e := x.e)) ELSE list_append(a, x) END, []::STRUCT(s DOUBLE, e DOUBLE)[]) AS out FROM l))"""


@query("speech_chunks", _VAD + ' SELECT media_id, chunk_index, c.s AS "start", c.e AS "end" FROM v')
def _(s, d):
    return plan.speech_chunks(fx.segments(s, d), 20.0)


@query("padded_chunks", _VAD + ' SELECT media_id, chunk_index, c.s AS "start", c.e AS "end", greatest(0.0::DOUBLE, c.s - 1) AS padded_start, least(duration, c.e + 1) AS padded_end FROM v JOIN media USING (media_id)')
def _(s, d):
    return plan.padded(plan.speech_chunks(fx.segments(s, d), 20.0), fx.media(s, d), 1.0)


@query("overlap_regions", "WITH " + o.SEGMENTS + f""", {o.MEDIA}, c AS (SELECT media_id, k AS chunk_index, k * 10.0::DOUBLE AS c0, least(k * 10.0::DOUBLE + 10, duration) AS c1 FROM (SELECT media_id, duration, unnest(range(CAST(ceil(duration / 10) AS BIGINT))) AS k FROM media))
SELECT media_id, chunk_index, seg_no, greatest("start", c0) AS "start", least("end", c1) AS "end" FROM c JOIN segments USING (media_id) WHERE "end" > c0 AND "start" < c1""")
def _(s, d):
    return intervals.overlap(plan.fixed_chunks(fx.media(s, d), 10.0), fx.segments(s, d))


@query("clip_to_speech", "WITH " + o.SEGMENTS + f""", {o.CLIP}, a AS (SELECT c.*, s."start" AS r0 FROM clip c ASOF LEFT JOIN segments s ON c.media_id = s.media_id AND c."start" <= s."end"),
b AS (SELECT a.*, s."end" AS r1 FROM a ASOF LEFT JOIN segments s ON a.media_id = s.media_id AND a."end" >= s."start")
SELECT media_id, pos, text, greatest("start", r0) AS "start", least("end", r1) AS "end" FROM b WHERE r0 IS NOT NULL AND r1 IS NOT NULL AND least("end", r1) > greatest("start", r0)""")
def _(s, d):
    return intervals.clip_to_speech(fx.clip_tokens(s, d), fx.segments(s, d))


@query("speech_from_frames", "WITH " + o.FRAMES + """, g AS (SELECT *, coalesce(t - (lag(t) OVER (PARTITION BY media_id ORDER BY frame_no) + 0.032::DOUBLE) >= 0.3::DOUBLE, true) AS fresh FROM frames WHERE prob >= 0.5::DOUBLE),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY media_id ORDER BY frame_no) AS run FROM g),
s AS (SELECT media_id, min(t) AS s, max(t) + 0.032::DOUBLE AS e FROM r GROUP BY media_id, run HAVING max(t) + 0.032::DOUBLE - min(t) >= 0.25::DOUBLE)
SELECT media_id, row_number() OVER w - 1 AS seg_no, greatest(0.0::DOUBLE, s - 0.3::DOUBLE, coalesce((lag(e) OVER w + s) / 2, 0.0::DOUBLE)) AS "start", least(e + 0.3::DOUBLE, coalesce((e + lead(s) OVER w) / 2, e + 0.3::DOUBLE)) AS "end" FROM s WINDOW w AS (PARTITION BY media_id ORDER BY s)""")
def _(s, d):
    return plan.speech_from_frames(fx.frames(s, d))


@query("absolute_times", "WITH " + o.BARE + ', o AS (SELECT media_id, chunk_index, greatest(0.0::DOUBLE, chunk_index * 60.0::DOUBLE - 1) AS shift FROM transcripts) SELECT media_id, chunk_index, pos, text, "start" + shift AS "start", "end" + shift AS "end" FROM tokens JOIN o USING (media_id, chunk_index)')
def _(s, d):
    plans = fx.chunks(s, d).withColumn("padded_start", F.greatest(F.lit(0.0), F.col("chunk_index") * F.lit(60.0) - 1))
    return tokens.absolute_times(fx.bare_tokens(s, d), plans)


@query("speech_json", "WITH " + o.SEGMENTS + ' SELECT media_id, seg_no, "start", "end" FROM segments')
def _(s, d):
    return files.segments_of(files.segment_json(fx.segments(s, d)))


# Backlog


@query("pending_chunks", f"WITH {o.DONE} SELECT media_id, chunk_index FROM transcripts EXCEPT SELECT * FROM done")
def _(s, d):
    return backlog.pending_chunks(fx.chunks(s, d), fx.manifest(s, d))


@query("media_done", f"WITH {o.DONE} SELECT media_id, count(*) - count(d.chunk_index) AS pending, count(*) = count(d.chunk_index) AS all_done FROM transcripts t LEFT JOIN done d USING (media_id, chunk_index) GROUP BY media_id")
def _(s, d):
    return backlog.media_done(fx.chunks(s, d), fx.manifest(s, d))


@query("missing_artifacts", f"WITH {o.MANIFEST} SELECT media_id, chunk_index, kind FROM transcripts, (VALUES ('tokens'), ('srt')) k(kind) EXCEPT SELECT media_id, chunk_index, kind FROM manifest WHERE size >= CASE kind WHEN 'tokens' THEN 2 ELSE 0 END")
def _(s, d):
    return backlog.missing_artifacts(fx.chunks(s, d), fx.manifest(s, d))


@query("after_force", f"WITH {o.MANIFEST} SELECT media_id, kind, chunk_index, size FROM manifest WHERE kind NOT IN ('srt', 'part_srt')")
def _(s, d):
    return backlog.after_force(fx.manifest(s, d), ["force_srt"])


_STORE = "WITH " + o.TRANSCRIPTS + """, f AS (
    SELECT 'v' || media_id AS media_id, kind, chunk_index, length(transcript) AS size FROM transcripts, (VALUES ('wav'), ('txt'), ('tokens'), ('srt'), ('part_srt')) k(kind)
    UNION ALL SELECT 'v' || media_id, kind, NULL, sum(length(transcript))::BIGINT FROM transcripts, (VALUES ('all_tokens'), ('vad'), ('full_wav'), ('final'), ('final_txt')) k(kind) GROUP BY media_id, kind),
    gone(flag, kind) AS (VALUES ('force_asr', 'txt'), ('force_asr', 'tokens'), ('force_asr', 'srt'), ('force_asr', 'all_tokens'), ('force_asr', 'part_srt'), ('force_asr', 'vad'), ('force_srt', 'srt'), ('force_srt', 'part_srt'),
        ('force_parts', 'srt'), ('force_parts', 'part_srt'), ('force_chunks', 'wav'), ('force_chunks', 'vad'), ('force_wav', 'full_wav'))"""


@query("manifest", _STORE + " SELECT media_id, kind, chunk_index, size FROM f")
def _(s, d):
    return files.artifacts(fx.artifact_files(s, d))


@query("after_each_force", _STORE + " SELECT flag, media_id, f.kind, chunk_index, size FROM f, (SELECT DISTINCT flag FROM gone) x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.flag = x.flag AND g.kind = f.kind)")
def _(s, d):
    manifest = files.artifacts(fx.artifact_files(s, d))
    return reduce(DataFrame.unionByName, [backlog.after_force(manifest, [flag]).select(F.lit(flag).alias("flag"), "*") for flag in backlog.FORCED])


@query("stale_tokens", "WITH " + o.BARE + ", m AS (SELECT media_id, chunk_index FROM transcripts WHERE (media_id + chunk_index) % 7 <> 0) SELECT media_id, chunk_index FROM transcripts WHERE regexp_matches(transcript, '[A-Za-z]') EXCEPT SELECT media_id, chunk_index FROM tokens JOIN m USING (media_id, chunk_index)")
def _(s, d):
    kept = fx.manifest(s, d).where("kind = 'tokens'").select("media_id", "chunk_index")  # the other chunks' token files are empty
    return backlog.stale_tokens(fx.transcripts(s, d), fx.bare_tokens(s, d).join(kept, ["media_id", "chunk_index"], "left_semi"))


@query("parts_ready", f"""WITH {o.DONE}, c AS (SELECT media_id, max(chunk_index) AS top FROM transcripts GROUP BY 1)
SELECT media_id, chunk_index // 2 AS part, chunk_index // 2 * 2 AS first_chunk, least(chunk_index // 2 * 2 + 1, any_value(top)) AS last_chunk, count(DISTINCT d.chunk_index) AS done, count(DISTINCT d.chunk_index) = least(chunk_index // 2 * 2 + 1, any_value(top)) - chunk_index // 2 * 2 + 1 AS ready
FROM transcripts t LEFT JOIN done d USING (media_id, chunk_index) JOIN c USING (media_id) GROUP BY media_id, chunk_index // 2""")
def _(s, d):
    chunks, manifest = fx.chunks(s, d), fx.manifest(s, d)
    done = chunks.join(backlog.pending_chunks(chunks, manifest), ["media_id", "chunk_index"], "left_anti")
    return backlog.ready_parts(chunks, done, 2)


@query("progress_percent", f"WITH {o.DONE} SELECT media_id, 20.0::DOUBLE + 75.0::DOUBLE * count(d.chunk_index) / count(*) AS percent FROM transcripts t LEFT JOIN (SELECT *, 1 AS x FROM done) d USING (media_id, chunk_index) GROUP BY media_id")
def _(s, d):
    chunks, manifest = fx.chunks(s, d), fx.manifest(s, d)
    return backlog.progress_percent(chunks, chunks.join(backlog.pending_chunks(chunks, manifest), ["media_id", "chunk_index"], "left_anti"))


_CATALOG = """WITH catalog AS (SELECT p_brand || '-' || p_partkey AS folder, p_name || '-' || i || ['.mp4', '.MKV', '.txt', '-C.mp4'][p_partkey % 4 + 1] AS file FROM (SELECT *, unnest(range(1, CASE WHEN p_size % 5 = 0 THEN 3 ELSE 2 END)) AS i FROM part)),
codes AS (SELECT ' brand#' || n_nationkey || '-' || n_nationkey % 10 AS code FROM nation),
hit AS (SELECT code, min(folder) AS folder FROM codes LEFT JOIN catalog ON contains(replace(upper(folder), '-', ''), replace(upper(trim(code)), '-', '')) GROUP BY code),
vid AS (SELECT folder, count(*) AS n, min(file) AS f FROM catalog WHERE regexp_matches(lower(file), '\\.(mp4|avi|mkv|mov|wmv|flv|ts|m2ts|webm)$') GROUP BY folder)
SELECT code, folder, CASE WHEN n = 1 AND NOT contains(f, '-C.') THEN f END AS file, CASE WHEN folder IS NULL THEN 'not_found' WHEN n IS NULL THEN 'no_video' WHEN n > 1 THEN 'multiple' WHEN contains(f, '-C.') THEN 'has_subtitles' ELSE 'ok' END AS status FROM hit LEFT JOIN vid USING (folder)"""


@query("catalog_match", _CATALOG)
def _(s, d):
    return backlog.match_catalog(fx.requests(s, d), fx.catalog(s, d))


_MANY = "codes AS (SELECT DISTINCT ' ' || lower(p_brand) || '-' || p_partkey % 1000 AS code FROM part)"


@query("catalog_match_many", _CATALOG.replace(_CATALOG[_CATALOG.index("codes AS ("):_CATALOG.index(",\nhit AS")], _MANY))
def _(s, d):
    """More codes than stand beside the folders, most beginning alike and many inside others."""
    codes = fx._table(s, d, "part").select(F.concat(F.lit(" "), F.lower("p_brand"), F.lit("-"), F.col("p_partkey") % 1000).alias("code"))
    return backlog.match_catalog(codes, fx.catalog(s, d))


@query("recent_codes", f"""WITH u AS (SELECT user_id, upper(event_type) || '-' || coalesce(json_extract_string(props, '$.k'), '') AS code, max(ts) AS ts FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, code) AS rank FROM u) SELECT user_id, rank, code, ts FROM r WHERE rank <= 20""")
def _(s, d):
    return backlog.recent_codes(fx.uses(s, d))


@query("progress_collapse", f"""WITH {o.RANKED}, p AS (SELECT user_id AS session_id, rn AS seq, event_type || ' [' || rn || '/' || count(*) OVER (PARTITION BY user_id) || ']' AS stage, event_type AS k FROM ranked), l AS (SELECT *, lag(k) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM p) SELECT session_id, seq, stage FROM l WHERE k IS DISTINCT FROM before""")
def _(s, d):
    return backlog.collapse_progress(fx.progress(s, d))


@query("first_chunks", f"WITH {o.TRANSCRIPTS} SELECT media_id, chunk_index FROM transcripts WHERE chunk_index < 2")
def _(s, d):
    return backlog.first_chunks(fx.chunks(s, d), 2)


@query("one_chunk", f"WITH {o.TRANSCRIPTS} SELECT media_id, chunk_index FROM transcripts WHERE chunk_index = 1")
def _(s, d):
    return backlog.one_chunk(fx.chunks(s, d), 2)


@query("completed_chunks", f"WITH {o.DONE} SELECT media_id, chunk_index FROM done")
def _(s, d):
    chunks = fx.chunks(s, d)
    return chunks.join(backlog.pending_chunks(chunks, fx.manifest(s, d)), ["media_id", "chunk_index"], "left_anti").distinct()


@query("sentence_islands", "WITH " + o.TOKENS + f""", e AS (SELECT *, CASE WHEN regexp_matches(text, '{o.SENTENCE}{o.SP}*$') THEN 1 ELSE 0 END AS cut FROM tokens)
SELECT media_id, chunk_index, pos, CAST(coalesce(sum(cut) OVER (PARTITION BY media_id, chunk_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS island FROM e""")
def _(s, d):
    return segment.islands(fx.tokens(s, d)).select("media_id", "chunk_index", "pos", "island")


@query("combine_text", "SELECT doc_id, CASE WHEN b = '' THEN a WHEN a = '' THEN b ELSE a || ' ' || b END AS text FROM (SELECT doc_id, coalesce(text, '') AS a, coalesce(source, '') AS b FROM documents)")
def _(s, d):
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    return fx._table(s, d, "documents").select("doc_id", t.combine(whole("text"), whole("source")).alias("text"))


@query("combine_turns", "SELECT media_id, chunk_index, CASE WHEN b IS NULL OR b = '' THEN a WHEN a = '' THEN b ELSE a || ' ' || b END AS text FROM (SELECT conv_id AS media_id, turn AS chunk_index, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)")
def _(s, d):
    after = F.lead("transcript").over(Window.partitionBy("media_id").orderBy("chunk_index"))
    return fx.transcripts(s, d).withColumn("after", F.coalesce(after, F.lit(""))).select("media_id", "chunk_index", t.combine(F.col("transcript"), F.col("after")).alias("text"))


@query("normalize_romanized", "SELECT doc_id, regexp_replace(lower(translate(text, '’`', chr(39) || chr(39))), '[^a-z' || chr(39) || ']', '', 'g') AS text FROM documents")
def _(s, d):
    return fx._table(s, d, "documents").select("doc_id", t.normalize_romanized(F.col("text")).alias("text"))


@query("gap_summary", "WITH " + o.TOKENS + o.GAP + " SELECT media_id, count(*) AS cues, round(max(c.e), 6) AS last FROM gsubs GROUP BY media_id")
def _(s, d):
    rows = segment.gap_segment(fx.tokens(s, d).withColumn("pos", F.col("chunk_index") * 100_000 + F.col("pos")), segment.GAP)
    return rows.groupBy("media_id").agg(F.count(F.lit(1)).alias("cues"), F.round(F.max("end"), 6).alias("last"))


# Streams


@query("stream_subtitles", f"{o.MAIN} SELECT media_id, chunk_index, {o.SUBS}")
def _(s, d):
    return tables.subtitles(s, d)


@query("stream_parts", "SELECT conv_id AS media_id, turn // 2 AS part, count(DISTINCT turn) AS chunks, true AS complete FROM conversations GROUP BY ALL")
def _(s, d):
    return tables.parts(s, d)


@query("stream_windows", """SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS "start", time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", count(*) AS n FROM events GROUP BY ALL""")
def _(s, d):
    return tables.windows(s, d)


@query("stream_sessions", """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours', true) AS fresh FROM events),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def _(s, d):
    return tables.sessions(s, d)


@query("stream_first_results", f"WITH {o.TRANSCRIPTS} SELECT media_id, chunk_index, transcript AS text FROM transcripts")
def _(s, d):
    return tables.first_deliveries(s, d)


@query("stream_late_parts", """WITH c AS (SELECT conv_id AS media_id, turn, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations)
SELECT media_id, turn // 2 AS part, count(*) AS chunks, count(*) = least(2, any_value(top) + 1 - turn // 2 * 2) AS complete FROM c WHERE turn < top GROUP BY media_id, turn // 2""")
def _(s, d):
    return tables.late_parts(s, d)


@query("stream_closed_windows", """WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '5 minutes' AS mark FROM events),
w AS (SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS "start", time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", count(*) AS n FROM events GROUP BY ALL) SELECT w.* FROM w, m WHERE "end" <= mark""")
def _(s, d):
    return tables.closed_windows(s, d)


@query("stream_closed_sessions", """WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '5 minutes' AS mark FROM events),
g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours', true) AS fresh FROM events),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
x AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run) SELECT x.* FROM x, m WHERE last + INTERVAL '6 hours' - INTERVAL '1 microsecond' <= mark""")
def _(s, d):
    return tables.closed_sessions(s, d)


@query("stream_typed_parts", """WITH c AS (SELECT conv_id AS media_id, turn, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations)
SELECT media_id, turn // 2 AS part, count(*) AS chunks, count(*) = least(2, any_value(top) + 1 - turn // 2 * 2) AS complete FROM c WHERE turn < top GROUP BY media_id, turn // 2""")
def _(s, d):
    return tables.late_parts(s, d, typed=True)


@query("stream_token_sessions", """WITH t AS (SELECT user_id, event_id, ts, ts + to_seconds(event_id % 7200) AS stop FROM events), m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '10 days' AS mark FROM events),
g AS (SELECT *, coalesce(ts - lag(stop) OVER w >= INTERVAL '6 hours', true) AS fresh FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
x AS (SELECT user_id, min(ts) AS first, max_by(stop, (ts, event_id)) AS last, count(*) AS n FROM r GROUP BY user_id, run) SELECT x.* FROM x, m WHERE last + INTERVAL '6 hours' <= mark""")
def _(s, d):
    return tables.token_sessions(s, d)


def _stub():
    """An engine that hears a chunk's words half a second apart."""
    return lambda rows: [(f"{len(r['transcript'])} characters", [(w, k / 2, k / 2 + 0.25) for k, w in enumerate(r["transcript"].split(" "))]) for r in rows]


@query("engine_stub", f"""WITH {o.DONE}, p AS (SELECT * FROM transcripts t WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.media_id = t.media_id AND d.chunk_index = t.chunk_index)),
w AS (SELECT media_id, chunk_index, length(transcript) || ' characters' AS transcript, unnest(string_split(transcript, ' ')) AS text, unnest(range(len(string_split(transcript, ' ')))) AS pos FROM p)
SELECT media_id, chunk_index, transcript, pos, text, chunk_index * 60.0::DOUBLE + pos / 2.0::DOUBLE AS "start", chunk_index * 60.0::DOUBLE + (pos / 2.0::DOUBLE + 0.25::DOUBLE) AS "end" FROM w""")
def _(s, d):
    rows = fx.transcripts(s, d).withColumn("padded_start", F.col("chunk_index") * 60.0)
    heard = engine.run_engine(backlog.pending_chunks(rows, fx.manifest(s, d)), _stub)
    return heard.select("media_id", "chunk_index", "transcript", F.posexplode("tokens").alias("pos", "t")).select("media_id", "chunk_index", "transcript", F.col("pos").cast("long").alias("pos"), "t.*")
