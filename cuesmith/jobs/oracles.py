"""DuckDB text of the derived tables and of the sequential rules, for the oracles."""

SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[一-鿿぀-ヿ가-힯]"
HAN = r"[一-鿿]"
SENTENCE = r"[。！？!?；;…]"
SOFT = r"[，,、：:]"
CLOSES = r"[,.!?;:%，。！？；：]"
CLEAN_CLOSES = r"[，。！？；：、,.!?;:]"
KEPT = r"[^。．.，,、！？!?；;：:…]"

TRANSCRIPTS = "transcripts AS (SELECT conv_id AS media_id, turn AS chunk_index, text AS transcript FROM conversations)"
WORDS = (
    TRANSCRIPTS
    + r""", words AS (
    SELECT *, chunk_index * 120000 + 400 * pos + 900 * (pos // 7) AS start_ms,
           chunk_index * 120000 + 400 * pos + 900 * (pos // 7) + 250 + 20 * (length(word) % 8) + CASE WHEN pos % 53 = 17 THEN 5000 ELSE 0 END AS end_ms
    FROM (SELECT media_id, chunk_index, unnest(w) AS word, unnest(range(len(w))) AS pos
          FROM (SELECT *, string_split_regex(transcript, '[ \n\t\r]+') AS w FROM transcripts)))"""
)
TIMES = 'CAST(start_ms AS DOUBLE) / 1000.0::DOUBLE AS "start", CAST(end_ms AS DOUBLE) / 1000.0::DOUBLE AS "end"'
BARE = WORDS + f", tokens AS (SELECT media_id, chunk_index, pos, regexp_replace(word, '[.,!?;:…]', '', 'g') AS text, {TIMES} FROM words WHERE regexp_replace(word, '[.,!?;:…]', '', 'g') <> '')"
TOKENS = WORDS + rf", tokens AS (SELECT media_id, chunk_index, pos, CASE WHEN pos % 3 = 0 THEN regexp_replace(word, '\.$', '!') ELSE word END AS text, {TIMES} FROM words)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
SEGMENTS = RANKED + f""", segments AS (SELECT media_id, seg_no, {TIMES} FROM (
    SELECT user_id AS media_id, rn - 1 AS seg_no, rn * 3000 + event_id % 1000 AS start_ms, rn * 3000 + event_id % 1000 + 500 + (event_id * 7) % 1500 AS end_ms FROM ranked))"""
MEDIA = "media AS (SELECT user_id AS media_id, CAST((count(*) + 2) * 3000 AS DOUBLE) / 1000.0::DOUBLE AS duration, (count(*) + 2) * 48000 + user_id % 16000 AS samples FROM events GROUP BY user_id)"
CLIP = f"""clip AS (SELECT media_id, pos, text, {TIMES} FROM (
    SELECT user_id AS media_id, rn - 1 AS pos, event_type AS text, rn * 3000 + (event_id * 13) % 3000 AS start_ms, rn * 3000 + (event_id * 13) % 3000 + 200 + (event_id * 17) % 2500 AS end_ms FROM ranked))"""
FRAMES = RANKED + ", frames AS (SELECT user_id AS media_id, rn - 1 AS frame_no, CAST((rn - 1) * 32 AS DOUBLE) / 1000.0::DOUBLE AS t, CASE WHEN ((rn - 1) // (5 + user_id % 7)) % 2 = 0 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS prob FROM ranked)"
MANIFEST = TRANSCRIPTS + """, manifest AS (
    SELECT media_id, 'tokens' AS kind, chunk_index, length(transcript) AS size FROM transcripts WHERE (media_id + chunk_index) % 7 <> 0
    UNION ALL SELECT media_id, 'srt', chunk_index, 0 FROM transcripts WHERE (media_id + chunk_index) % 5 <> 0)"""
DONE = MANIFEST + """, done AS (SELECT media_id, chunk_index FROM manifest WHERE kind = 'srt' AND size >= 0 INTERSECT SELECT media_id, chunk_index FROM manifest WHERE kind = 'tokens' AND size >= 2)"""


def joined(words: str) -> str:
    """Text of a list of words; the tables have no CJK, so words are spaced."""
    return f"regexp_replace(regexp_replace(regexp_replace(array_to_string({words}, ' '), '{SP}+({CLOSES})', '\\1', 'g'), '([\\x{{bf}}\\x{{a1}}]){SP}+', '\\1', 'g'), '^{SP}+|{SP}+$', '', 'g')"


def cut(source: str, keys: str, repair: bool, needs_text: bool, not_held: bool, order: str = "pos") -> str:
    """CTEs up to ``cues`` (keys, out): a fold of the cut rule over each group's tokens."""
    start = """CASE WHEN length(trim(text)) BETWEEN 1 AND 2 AND "end" - "start" > 4.0::DOUBLE THEN "end" - 0.5::DOUBLE * length(trim(text)) ELSE "start" END""" if repair else '"start"'
    words, dur = "list_append(a.buf, x.w)", "(x.e - CASE WHEN len(a.buf) = 0 THEN x.s ELSE a.s END)"
    text = joined(words)
    sentence = f"x.sent AND length({text}) >= 8" if needs_text else "x.sent"
    flush = f"(({sentence}) OR (x.pause >= 0.65::DOUBLE AND length({text}) >= 8) OR length({text}) >= 42 OR {dur} >= 6.5::DOUBLE OR (x.soft AND length({text}) >= 31) OR x.fin)"
    held = f"({dur} < 0.7::DOUBLE AND NOT x.fin" + (f" AND NOT ({sentence})" if not_held else "") + ")"
    first = "CASE WHEN len(a.buf) = 0 THEN x.s ELSE a.s END"
    return f"""
    fixed AS (SELECT {keys}, {order}, text, {start} AS s, "end" AS e FROM {source}),
    paused AS (SELECT *, coalesce(lead(s) OVER w - e, 999.0::DOUBLE) AS pause, lead(s) OVER w IS NULL AS fin FROM fixed WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
    lists AS (SELECT {keys}, list(struct_pack(w := text, s := s, e := e, pause := pause, fin := fin, sent := regexp_matches(text, '{SENTENCE}{SP}*$'), soft := regexp_matches(text, '{SOFT}{SP}*$')) ORDER BY {order}) AS items
              FROM paused WHERE regexp_replace(text, '{SP}', '', 'g') <> '' GROUP BY {keys}),
    folded AS (SELECT {keys}, list_reduce(items, lambda a, x:
        CASE WHEN {flush} AND NOT {held}
             THEN struct_pack(buf := []::VARCHAR[], s := 0.0::DOUBLE, e := 0.0::DOUBLE, out := list_append(a.out, struct_pack(s := {first}, e := x.e, t := {text})))
             ELSE struct_pack(buf := {words}, s := {first}, e := x.e, out := a.out) END,
        struct_pack(buf := []::VARCHAR[], s := 0.0::DOUBLE, e := 0.0::DOUBLE, out := []::STRUCT(s DOUBLE, e DOUBLE, t VARCHAR)[])) AS f FROM lists),
    cues AS (SELECT {keys}, CASE WHEN len(f.buf) > 0 THEN list_append(f.out, struct_pack(s := f.s, e := f.e, t := {joined('f.buf')})) ELSE f.out END AS out FROM folded)"""


def merged(keys: str, max_gap: bool, source: str = "cues") -> str:
    """CTEs up to ``subs`` (keys, sub_no, start, end, text): a fold of the merge rule."""
    last = "a[len(a)]"
    both = f"({last}.t || ' ' || x.t)"
    near = f" AND x.s - {last}.e <= 1.0::DOUBLE" if max_gap else ""
    return f"""
    short AS (SELECT {keys}, list_reduce(out, lambda a, x:
        CASE WHEN len(a) > 0 AND (length(x.t) < 4 OR x.e - x.s < 0.5::DOUBLE) AND length({both}) <= 52 AND x.e - {last}.s <= 7.5::DOUBLE{near}
             THEN list_append(a[:len(a) - 1], struct_pack(s := {last}.s, e := x.e, t := {both}))
             ELSE list_append(a, x) END, []::STRUCT(s DOUBLE, e DOUBLE, t VARCHAR)[]) AS out FROM {source}),
    subs AS (SELECT {keys}, unnest(range(len(out))) AS sub_no, unnest(out) AS c FROM short)"""


SUBS = 'sub_no, c.s AS "start", c.e AS "end", c.t AS text FROM subs'
MAIN = "WITH " + TOKENS + "," + cut("tokens", "media_id, chunk_index", True, False, True) + "," + merged("media_id, chunk_index", True)
LEGACY = "WITH " + TOKENS + "," + cut("tokens", "media_id, chunk_index", False, True, False) + "," + merged("media_id, chunk_index", False)


def quantized(column: str) -> str:
    ms = f"CAST(round_even(greatest({column}, 0.0::DOUBLE) * 1000, 0) AS BIGINT)"
    return f"(CAST({ms} // 1000 AS DOUBLE) + CAST({ms} % 1000 AS DOUBLE) / 1000.0::DOUBLE)"


def srt_time(column: str, mark: str = ",") -> str:
    ms = f"CAST(round_even(greatest({column}, 0.0::DOUBLE) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


FINAL = (
    MAIN
    + f""", q AS (SELECT media_id, chunk_index, sub_no, {quantized('c.s')} AS s, {quantized('c.e')} AS e, c.t AS text FROM subs WHERE trim(c.t) <> ''),
    final AS (SELECT media_id, chunk_index, row_number() OVER w AS entry_no, s AS "start", least(e + 0.5::DOUBLE, coalesce(lead(s) OVER w, e + 0.5::DOUBLE)) AS "end", text FROM q WHERE s < 360000 AND e < 360000
              WINDOW w AS (PARTITION BY media_id ORDER BY s, e, chunk_index, sub_no))"""
)


def _clean(text: str) -> str:
    return f"regexp_replace({text}, '{SP}+({CLEAN_CLOSES})', '\\1', 'g')"


def _gap() -> str:
    words, text = "list_append(a.buf, x.w)", _clean("array_to_string(list_append(a.buf, x.w), ' ')")
    first = "CASE WHEN len(a.buf) = 0 THEN x.s ELSE a.s END"
    dur = f"greatest(0.0::DOUBLE, x.e - {first})"
    cut_ = f"""(length({text}) >= 28 OR {dur} >= 6.0::DOUBLE OR (regexp_matches({text}, '[.!?;]$') AND (length({text}) >= 4 OR x.gap >= 0.25::DOUBLE))
        OR (regexp_matches({text}, '[,:]$') AND length({text}) >= 6 AND x.gap >= 0.25::DOUBLE) OR x.gap >= 0.85::DOUBLE OR (x.gap >= 0.5::DOUBLE AND length({text}) >= 8 AND {dur} >= 0.8::DOUBLE))"""
    kind = "STRUCT(s DOUBLE, e DOUBLE, t VARCHAR)"
    tiny = "(length(x.t) < 6 AND x.e - x.s < 0.6::DOUBLE * 1.5::DOUBLE)"
    both = _clean("(a.hold[1].t || x.t)")
    return f""",
    g AS (SELECT media_id, pos, chunk_index, text, "start" AS s, "end" AS e, greatest(0.0::DOUBLE, coalesce(lead("start") OVER w - "end", 1e9::DOUBLE)) AS gap, row_number() OVER w AS n
          FROM tokens WHERE text <> '' WINDOW w AS (PARTITION BY media_id ORDER BY "start", "end", chunk_index, pos)),
    gl AS (SELECT media_id, list(struct_pack(w := text, s := s, e := e, gap := gap) ORDER BY n) AS items FROM g GROUP BY media_id),
    gf AS (SELECT media_id, list_reduce(items, lambda a, x: CASE WHEN {cut_}
        THEN struct_pack(buf := []::VARCHAR[], s := 0.0::DOUBLE, out := list_append(a.out, struct_pack(s := {first}, e := CASE WHEN x.e > {first} THEN x.e ELSE {first} + 0.6::DOUBLE END, t := {text})))
        ELSE struct_pack(buf := {words}, s := {first}, out := a.out) END, struct_pack(buf := []::VARCHAR[], s := 0.0::DOUBLE, out := []::{kind}[])).out AS out FROM gl),
    gm AS (SELECT media_id, list_reduce(out, lambda a, x: CASE
        WHEN len(a.hold) = 1 AND length({both}) <= 36 THEN struct_pack(hold := []::{kind}[], out := list_append(a.out, struct_pack(s := a.hold[1].s, e := x.e, t := {both})))
        WHEN {tiny} THEN struct_pack(hold := [x], out := list_concat(a.out, a.hold))
        ELSE struct_pack(hold := []::{kind}[], out := list_append(list_concat(a.out, a.hold), x)) END, struct_pack(hold := []::{kind}[], out := []::{kind}[])) AS m FROM gf),
    gt AS (SELECT media_id, list_reduce(list_concat(m.out, m.hold), lambda a, x: struct_pack(last := greatest(x.e, greatest(x.s, a.last) + 0.05::DOUBLE), out := list_append(a.out, struct_pack(s := greatest(x.s, a.last), e := greatest(x.e, greatest(x.s, a.last) + 0.05::DOUBLE), t := x.t))),
        struct_pack(last := 0.0::DOUBLE, out := []::{kind}[])).out AS out FROM gm),
    gsubs AS (SELECT media_id, unnest(range(len(out))) AS sub_no, unnest(out) AS c FROM gt)"""


GAP = _gap()
