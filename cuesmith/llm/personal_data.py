"""Personal data by weak supervision, in DataFrame expressions only.

Base patterns and looser ones propose spans. Labelers vote on each: a regular
expression with its check, a gazetteer of known prefixes and endings, the words
before the span, and its shape. Expectation-maximisation over the counts of vote
patterns estimates how far each labeler can be relied on; its posteriors train a
logistic classifier of spans. Base spans always stay; a looser one is added
where the classifier takes it and it overlaps no other of its kind.

All a row's spans are an array in the row, so no key is needed and nothing is
shuffled but counts: there are at most 4 kinds x 3**4 votes x 3 widths of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: Patterns. A run of characters is only entered at its start or where the last
#: match ended, and never given back, so a long run costs its length once.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9._])[0-9]{4}(?:[._][0-9]{4}){3}(?![0-9._])",
    "phone": r"(?<![0-9+)(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: What a text must have for a pattern to be tried: a quick search that most texts fail.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
HINT = {"email": r"[(\[]at[)\]]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[._][0-9]{4}[._]", "phone": r"[0-9]{3}[.-][0-9]{4}"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Gazetteers: what a span of a kind starts or ends with (fixed values).
KNOWN = {
    "email": r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ca|mx|ch|at|nl|br|jp|cn|in|au)$",
    "ip": r"^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
}
#: Words before a span that speak for its kind, and ones that speak for a plain number.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt|schreib|contacto)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|login|adresse|direcci)",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta|pay)",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|appel|llam|ruf)",
}
PLAIN = r"(?i)\b(?:version|release|invoice|order|isbn|issn|ref|sku|serial|build|page|chapter|section|rfc)\b[^a-z]*$"
LABELERS = ("regex", "gazetteer", "context", "shape")
BEFORE = 40


def no_hits() -> Column:
    return F.array().cast("array<struct<start: int, end: int, body: string, before: string>>")


def summed(lengths: Column, width: int = 64) -> Column:
    """For each element of an array of numbers the sum of those before it.

    An array that grows in a fold is copied each time, so only short ones do:
    runs of ``width`` are summed on their own, then the runs' totals in runs of
    ``width`` again, and each run is shifted by what lies before it. A fold's array
    has at most ``width`` elements, or one for each ``width ** 2`` of the input.
    """
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  evaluates ``value`` once

    def fold(total: Column, x: Column) -> Column:
        return F.struct((total["at"] + x).alias("at"), F.concat(total["out"], F.array(total["at"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def runs(xs: Column, get) -> Column:
        """(at, out) of each run; ``get`` takes an element to its number."""
        n = F.floor((F.size(xs) + width - 1) / width).cast("int")
        here = lambda k: F.sequence(k * width, F.least(k * width + width, F.size(xs)) - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(here(k), start, lambda t, i: fold(t, get(F.get(xs, i)))))).otherwise(F.array().cast("array<struct<at: int, out: array<int>>>"))

    def shifted(parts: Column, before: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, k: let(F.get(before, k), lambda b: F.transform(p["out"], lambda x: x + b))))

    def top(outer: Column) -> Column:
        return F.aggregate(F.transform(outer, lambda p: p["at"]), start, fold)["out"]

    def levels(inner: Column) -> Column:
        return let(runs(inner, lambda p: p["at"]), lambda outer: let(top(outer), lambda heads: let(shifted(outer, heads), lambda before: shifted(inner, before))))

    return let(lengths, lambda xs: let(runs(xs, lambda x: x), levels))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order: array of (start, end, body, before);
    places in code points, ``before`` the end of the gap in front. The work grows
    with the text and not with the square of its matches."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def placed(pairs: Column) -> Column:
        at = summed(F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["body"])))

        def hit(x: Column, before: Column) -> Column:
            begin = before + F.length(x["gap"])
            return F.struct(begin.alias("start"), (begin + F.length(x["body"])).alias("end"), x["body"].alias("body"), F.right(x["gap"], F.lit(BEFORE)).alias("before"))

        return F.zip_with(pairs, at, hit)

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("body")))
    return let(pairs, lambda p: F.when(F.size(p) == 0, no_hits()).otherwise(placed(p)))


def hidden(text: Column, kind: str) -> Column:
    """The text with NUL for each character of the kind's base spans: what lies in
    one is found no more, and all else keeps its place."""
    gaps, hits = F.split(text, BASE[kind], -1), F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))
    mask = lambda h: F.when(CHECKS[kind](h), F.repeat(F.lit("\0"), F.length(h))).otherwise(h)
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(mask(h), F.lit("")))), "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def digits_of(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda b: F.lit(True),
    "ip": lambda b: b.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda b: F.when(F.length(digits_of(b)).between(16, 19), luhn(digits_of(b))).otherwise(False),
    "phone": lambda b: F.length(digits_of(b)).between(8, 15),
}
SHAPES: dict[str, Callable[[Column], Column]] = {
    "email": lambda b: F.length(b).between(6, 80) & ~b.rlike(r"^[._%+-]|\.\.|-$"),
    "ip": lambda b: F.length(b).between(7, 45),
    "card": lambda b: F.when(F.length(digits_of(b)).between(13, 19), luhn(digits_of(b))).otherwise(False),
    "phone": lambda b: F.length(digits_of(b)).between(10, 13),
}


def votes(kind: str, base: bool, hit: Column) -> Column:
    """1 for, -1 against, 0 no opinion, of each of LABELERS; ``width`` is a feature."""
    body, before = hit["body"], hit["before"]
    sign = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    return F.struct(
        hit["start"].alias("start"),
        hit["end"].alias("end"),
        F.lit(base).alias("base"),
        (F.lit(1) if base else F.lit(-1)).alias("regex"),
        sign(body.rlike(KNOWN[kind])).alias("gazetteer"),
        F.when(before.rlike(CUES[kind]), F.lit(1)).when(before.rlike(PLAIN), F.lit(-1)).otherwise(F.lit(0)).alias("context"),
        sign(SHAPES[kind](body)).alias("shape"),
        F.when(F.length(body) < 12, F.lit(0)).when(F.length(body) < 20, F.lit(1)).otherwise(F.lit(2)).alias("width"),
    )


def candidates(text: Column, kind: str) -> Column:
    """Base spans of a kind that hold."""
    base = F.filter(F.when(text.rlike(NEEDS[kind]), found(text, BASE[kind])).otherwise(no_hits()), lambda h: CHECKS[kind](h["body"]))
    return F.transform(base, lambda h: votes(kind, True, h))


def loose_candidates(text: Column, kind: str) -> Column:
    """Looser spans of a kind beside its base spans."""
    rest = F.when(text.rlike(NEEDS[kind]), hidden(text, kind)).otherwise(text)
    hits = F.when(text.rlike(HINT[kind]), found(rest, LOOSE[kind])).otherwise(no_hits())
    return F.transform(hits, lambda h: votes(kind, False, h))


def proposed(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, email, ip, card, phone): the candidate spans of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), body.alias("_text"))
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", candidates(F.col("_text"), kind))
    return rows.select("id", *[F.concat(F.col(f"_{kind}"), loose_candidates(F.col("_text"), kind)).alias(kind) for kind in KINDS])


def reliabilities(counts: Sequence[Row], rounds: int = 50) -> dict[str, tuple[float, dict[str, tuple[float, float]]]]:
    """Per kind: the share of true spans, and per labeler how often it is right on
    true and on false spans when it votes, by expectation-maximisation. Votes
    start from eight imagined right ones in ten, so that a kind with few spans
    stays near that."""
    out = {}
    for kind in KINDS:
        rows = [r for r in counts if r["kind"] == kind]
        prior, good = 0.5, {name: (0.8, 0.8) for name in LABELERS}
        for _ in range(rounds if rows else 0):
            true_n, all_n = 1.0, 2.0
            right = {name: [[8.0, 10.0], [8.0, 10.0]] for name in LABELERS}
            for r in rows:
                p = posterior(r, prior, good)
                true_n, all_n = true_n + p * r["n"], all_n + r["n"]
                for name in LABELERS:
                    if v := r[name]:
                        for side, share in ((0, p), (1, 1 - p)):
                            right[name][side][0] += share * r["n"] * ((v > 0) == (side == 0))
                            right[name][side][1] += share * r["n"]
            prior = true_n / all_n
            good = {name: tuple(min(0.99, max(0.5, a / b)) for a, b in sides) for name, sides in right.items()}
        out[kind] = (prior, good)
    return out


def posterior(row: Row, prior: float, good: dict[str, tuple[float, float]]) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for name in LABELERS:
        sens, spec = good[name]
        if row[name] > 0:
            yes, no = yes + math.log(sens), no + math.log(1 - spec)
        elif row[name] < 0:
            yes, no = yes + math.log(1 - sens), no + math.log(spec)
    return 1 / (1 + math.exp(min(500.0, no - yes)))


FEATURES = (*LABELERS, "short", "long")


def features(get: Callable[[str], float]) -> list[float]:
    return [*(get(name) for name in LABELERS), float(get("width") == 0), float(get("width") == 2)]


def classifier(counts: Sequence[Row], model: dict, steps: int = 300, rate: float = 0.5, ridge: float = 0.01) -> dict[str, list[float]]:
    """Weights (bias last) per kind of a logistic model fitted to the posteriors."""
    out = {}
    for kind in KINDS:
        rows = [(features(r.__getitem__) + [1.0], posterior(r, *model[kind]), r["n"]) for r in counts if r["kind"] == kind]
        total, w = sum(n for _, _, n in rows) or 1, [0.0] * (len(FEATURES) + 1)
        for _ in range(steps):
            slope = [ridge * x for x in w]
            for x, p, n in rows:
                miss = (1 / (1 + math.exp(-max(-500.0, min(500.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - p) * n / total
                slope = [s + miss * v for s, v in zip(slope, x, strict=True)]
            w = [a - rate * s for a, s in zip(w, slope, strict=True)]
        out[kind] = w
    return out


def _kind_votes(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[name].alias(name) for name in (*LABELERS, "width")]))


def vote_counts(rows: DataFrame) -> DataFrame:
    spans = rows.select(F.explode(F.concat(*map(_kind_votes, KINDS))).alias("s")).select("s.*")
    return spans.groupBy("kind", *LABELERS, "width").agg(F.count(F.lit(1)).alias("n"))


def _said(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"]))


def _places(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))


def accepted(kind: str, weights: list[float]) -> Callable[[Column], Column]:
    def verdict(s: Column) -> Column:
        x = [s[name].cast("double") for name in LABELERS] + [(s["width"] == w).cast("double") for w in (0, 2)]
        score = F.lit(weights[-1])
        for w, v in zip(weights, x, strict=False):
            score = score + F.lit(w) * v
        return s["base"] | (score > 0)

    return verdict


def find_personal_data(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone and base_sha256 of
    the base spans, and ``spans``, all spans as ``kind:start:end``.

    A null text is an empty one; a text without spans has an empty ``spans``.
    Repeated rows give repeated rows; other columns play no part. With no rows
    at all the classifier keeps its starting point and there is nothing to judge.
    """
    rows = stored(proposed(docs, text, id), "candidates")
    counts = vote_counts(rows).collect()  # at most 4 * 3**4 * 3 rows
    weights = classifier(counts, reliabilities(counts))
    base = {k: F.filter(k, lambda s: s["base"]) for k in KINDS}
    kept = {k: _places(F.filter(k, accepted(k, weights[k]))) for k in KINDS}
    said = lambda spans: F.array_join(F.concat(*[_said(k, a) for k, a in spans.items()]), ",")
    return rows.select(F.col("id").alias(id), *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(said(base), 256).alias("base_sha256"), said(kept).alias("spans"))
